"""Detectors and suppression as keyed state: what the stream says equals one batch run, whatever order the rows came in."""

import json
import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from tests.test_kernels import naive_suppress
from vigil.operators import correlate as X
from vigil.streaming import keyed
from vigil.streaming.storage import new_folder

MIN = 60_000_000
SNAP = ("event_id bigint, t bigint, event_type string, host string, source string, user string, source_ip string, http_method string, "
        "request_uri string, status_code string, rule_matches array<struct<rule_code string, risk_score int>>")
WIDTHS = {name: 90 * MIN for name in X.DETECTORS}
DETECTORS = {name: partial(fn, width=WIDTHS[name]) for name, fn in X.DETECTORS.items()}
LATE = 20 * MIN


def event(i, t, rnd):
    kind = rnd.choice([*["login_failed"] * 6, "login_success", "dns.query", "container.stop", "container.restart", "container.create",
                       "browser.search", "browser.download", "process.exec", *["http.get"] * 6])
    web = kind == "http.get"
    hits = [(c, r) for c, r in (("A", 60), ("B", 70), ("C", 20)) if rnd.random() < 0.15]
    return (i, t, kind, rnd.choice(["h1", "h2", "h3", None]), "nginx" if web else rnd.choice(["docker", "auth"]), rnd.choice(["u1", "u1", "u2", None]),
            rnd.choice(["1.1.1.1", "1.1.1.1", "1.1.1.2", None]), "POST" if web else None,
            rnd.choice([*["/login"] * 3, *[f"/admin/{k}" for k in range(4)], "/.git/x", "/config/y"]) if web else None, rnd.choice(["401", "404"]) if web else None, hits or None)


def in_batches(spark, rows, schema, batches):
    """Files that a file stream reads one by one, in order."""
    path = new_folder(spark, "in")
    for batch in batches:
        spark.createDataFrame([rows[i] for i in batch], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(query):
    assert query.awaitTermination(300), query.status
    assert query.exception() is None
    return query


def told(df):
    return sorted((json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.collect()))


@pytest.fixture(scope="module")
def log():
    rnd = random.Random(21)
    rows, t = [], 10**9
    for i in range(300):
        t += rnd.choice([0, 0, 1, 30, 60, 90, 120]) * 1_000_000 + rnd.choice([0, 0, 1])
        rows.append(event(i, t, rnd))
    rows.append((9999, t + 10**12, *[None] * 9))  # moves the time on, so that the last windows are told
    # five batches; some rows come one or two batches late, the batches are in no order inside
    batches = [[] for _ in range(6)]
    for n, row in enumerate(rows[:-1]):
        own = n * 5 // 300
        newest = lambda b: max(r[1] for r in rows[: (b + 1) * 60])
        held = own + 1 if rnd.random() < 0.15 and own < 4 and row[1] > newest(own) - LATE + MIN else own
        batches[held].append(n)
    for b in batches:
        rnd.shuffle(b)
    return rows, [*batches[:5], [len(rows) - 1]]


def test_all_detectors_equal_one_batch_run(spark, log):
    rows, batches = log
    folder = new_folder(spark, "keyed")
    query = drain(keyed.detect_stream(in_batches(spark, rows, SNAP, batches), folder, DETECTORS, LATE))
    df = spark.createDataFrame(rows, SNAP)
    got = keyed.stored_matches(spark, folder, df.schema, DETECTORS)
    want = X.all_matches(df, WIDTHS)
    assert got.columns == want.columns
    assert {r.correlation_type for r in want.select("correlation_type").distinct().collect()} == set(X.DETECTORS)
    assert told(got) == told(want)
    assert keyed.stored_late(spark, folder).isEmpty()
    # behind the last window no state is left but that of the row which moved the time on
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_rows_too_late_go_to_a_table_of_their_own(spark, log):
    rows, batches = log
    again = next(r for r in rows if r[2] == "login_failed" and r[5] and r[6])
    rows = [*rows[:-1], again, rows[-1]]
    late = len(rows) - 2  # comes after everything else
    folder = new_folder(spark, "keyed")
    names = ["failed_login_burst", "multi_host_attack", "brute_force_success"]
    some = {n: DETECTORS[n] for n in names}
    drain(keyed.detect_stream(in_batches(spark, rows, SNAP, [*batches[:5], [len(rows) - 1], [late]]), folder, some, LATE))
    df = spark.createDataFrame(rows[:-2], SNAP)
    want = X.all_matches(df, WIDTHS).where(F.col("correlation_type").isin(names))
    assert told(keyed.stored_matches(spark, folder, df.schema, some)) == told(want)
    refused = keyed.stored_late(spark, folder).collect()
    assert {(r.event_id, r.t) for r in refused} == {again[:2]}
    assert sorted(r.detector for r in refused) == sorted(names)


def test_a_batch_reads_its_own_rows_only(spark, log):
    rows, batches = log
    some = {"failed_login_burst": DETECTORS["failed_login_burst"]}
    query = drain(keyed.detect_stream(in_batches(spark, rows, SNAP, batches), new_folder(spark, "keyed"), some, LATE))
    reads = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert reads == [len(b) for b in batches]


def test_suppression_with_controls_in_any_order(spark):
    rnd = random.Random(22)
    rows = []
    for i in range(200):
        t = rnd.randrange(1, 400) * MIN
        rows.append((f"k{rnd.randrange(3)}", i, t, t + rnd.choice([0, 5, 30]) * MIN))
    controls = [(f"k{rnd.randrange(3)}", rnd.randrange(1, 400) * MIN) for _ in range(15)]
    rows.sort(key=lambda r: r[2])
    batches = [[] for _ in range(4)]
    for n, _ in enumerate(rows):
        batches[min(3, n // 50 + (n % 50 > 40))].append(n)
    for b in batches:
        rnd.shuffle(b)
    stream = in_batches(spark, rows, "key string, id bigint, t bigint, d bigint", batches)
    marks = [*controls, (None, 10**13)]
    # all controls are there before the first row; they wait in the state for their time
    control = in_batches(spark, marks, "key string, t bigint", [[*range(len(controls))], [], [], [], [len(controls)]])
    folder = new_folder(spark, "keyed")
    drain(keyed._sink(keyed.suppress_rows(stream, 1000 * MIN, control), folder))
    got = {r.id: (r.anchor, r.fires) for r in spark.read.parquet(f"{folder}/rows").collect()}
    assert got == naive_suppress([(i, k, t, d) for k, i, t, d in rows], controls)


def test_matches_of_the_first_query_feed_the_second(spark, log):
    rows, batches = log
    some = {n: DETECTORS[n] for n in ("failed_login_burst", "multi_host_attack")}
    one, two = new_folder(spark, "keyed"), new_folder(spark, "keyed")
    drain(keyed.detect_stream(in_batches(spark, rows, SNAP, batches), one, some, LATE))
    df = spark.createDataFrame(rows, SNAP)
    found = keyed.stored_matches(spark, one, df.schema, some, stream=True)
    end = in_batches(spark, [(None, 10**15)], "key string, t bigint", [[0]])
    drain(keyed.suppress_matches_stream(found, two, 0, control=end))
    got = {(r.key, r.id) for r in spark.read.parquet(f"{two}/rows").where("fires").collect()}
    matches = X.all_matches(df, WIDTHS).where(F.col("correlation_type").isin(list(some)))
    want = {(r.key, r.id) for r in X.suppress_matches(matches).where("fires").collect()}
    assert got == want and len(want) > 3


def test_a_restart_goes_on_where_it_stopped(spark, log):
    rows, batches = log
    some = {"reconnaissance_activity": DETECTORS["reconnaissance_activity"]}
    folder, path = new_folder(spark, "keyed"), new_folder(spark, "in")
    for part in (batches[:3], batches[3:]):
        for batch in part:
            spark.createDataFrame([rows[i] for i in batch], SNAP).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SNAP).option("maxFilesPerTrigger", 1).parquet(path)
        drain(keyed.detect_stream(stream, folder, some, LATE))
    df = spark.createDataFrame(rows, SNAP)
    assert told(keyed.stored_matches(spark, folder, df.schema, some)) == told(X.reconnaissance(df, width=90 * MIN))
