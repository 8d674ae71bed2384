"""Run registered queries beside their checking SQL: python tests/oracle_check.py [sf_dir] [name prefix ...]"""

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}".rstrip("0").rstrip(".")
    if hasattr(v, "item"):
        return plain(v.item())
    return str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, sf_dir, name, fn, sql, con):
    started = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - started
    if sql is None:
        return True, len(got[1]), took, "rows only"
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return False, len(got[1]), took, f"columns {got[0]} <> {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return False, len(got[1]), took, f"{len(got[1])} <> {len(want[1])} rows; only here {list(a - b)[:3]}; only there {list(b - a)[:3]}"
    return True, len(got[1]), took, ""


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf), entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            ok, n, took, why = compare(session, sf, name, fn, oracles.get(name), con)
        except Exception as exc:  # report and go on with the next query
            ok, n, took, why = False, 0, 0, f"{type(exc).__name__}: {str(exc)[:1500]}"
        if not ok:
            bad.append(name)
        print(f"{'ok ' if ok else 'BAD'} {name:32s} {n:7d} rows {took:6.2f}s {why}", flush=True)
    print("failed:", bad)
