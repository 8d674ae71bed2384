import json
import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from vigil.operators import correlate as X
from vigil.operators import ingest, ports
from vigil.operators.kernels import suppress
from vigil.sources import readers
from vigil.streaming import jobs
from vigil.streaming.storage import new_folder

MIN = 60_000_000
SNAP = ("event_id bigint, t bigint, event_type string, host string, source string, user string, source_ip string, "
        "http_method string, request_uri string, status_code string")


def drain(query, seconds=180):
    assert query.awaitTermination(seconds), query.status
    assert query.exception() is None


def as_files(spark, rows, schema, parts):
    """Rows as parquet files that a file stream reads one by one, in order."""
    path = new_folder(spark, "in")
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    return path


def memory(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", new_folder(spark, "cp")).trigger(availableNow=True).start()
    drain(q)
    return spark.table(name)


def test_correlation_stream_equals_batch(spark):
    rnd = random.Random(3)
    rows, t = [], 0
    for i in range(240):
        t += rnd.randrange(1, 50) * 1_000_000
        rows.append((i, t, rnd.choice(["login_failed", "login_failed", "login_success"]), "h", "auth", f"u{rnd.randrange(2)}",
                     f"1.1.1.{rnd.randrange(2)}", None, None, None))
    names = ["failed_login_burst", "brute_force_success"]
    widths = {n: X.fx.SUPPRESSION_MINUTES[n] * MIN for n in names}
    detectors = {n: X.DETECTORS[n] for n in names}
    df = spark.createDataFrame(rows, SNAP)
    found = X.failed_login_burst(df).unionByName(X.brute_force_success(df))
    want = {(r.correlation_key, r.event_id) for r in X.surviving(found).collect()}
    assert want and len(want) < found.count()
    path, folder = as_files(spark, rows, SNAP, 4), new_folder(spark, "corr")
    stream = spark.readStream.schema(SNAP).option("maxFilesPerTrigger", 1).parquet(path)
    drain(jobs.correlate_stream(spark, stream, folder, detectors, widths))
    got = {(r.key, r.id) for r in spark.read.parquet(f"{folder}/fired/batch=*").collect()}
    assert got == want


@pytest.mark.parametrize("late", [None, 24 * 60 * MIN])
def test_correlation_of_late_batches_equals_batch(spark, late):
    rnd = random.Random(8)
    rows, t = [], 0
    for i in range(200):
        t += rnd.randrange(1, 20) * MIN
        rows.append((i, t, rnd.choice(["login_failed", "login_failed", "login_success"]), "h", "auth", f"u{rnd.randrange(2)}",
                     f"1.1.1.{rnd.randrange(2)}", None, None, None))
    widths = {"failed_login_burst": 150 * MIN, "brute_force_success": 90 * MIN}  # longer than the look-back
    detectors = {n: X.DETECTORS[n] for n in widths}
    burst, success = (detectors[n](spark.createDataFrame(rows, SNAP), width=w) for n, w in widths.items())
    found = burst.unionByName(success)
    want = {(r.correlation_key, r.event_id) for r in X.surviving(found, widths).collect()}
    folder = new_folder(spark, "late")
    got, seen = set(), {}
    for k, b in enumerate([0, 2, 1, 4, 3]):
        jobs.correlate_batch(spark, spark.createDataFrame(rows[40 * b:40 * b + 40], SNAP), k, folder, detectors, widths, late=late)
        got -= {(r.key, r.id) for r in spark.read.parquet(f"{folder}/withdrawn/batch={k}").collect()}
        got |= {(r.key, r.id) for r in spark.read.parquet(f"{folder}/fired/batch={k}").collect()}
        seen |= {(r.event_id, r.correlation_type): (r.event_count, r.first_seen) for r in spark.read.parquet(f"{folder}/matches/batch={k}").collect()}
    assert len(want) > 5 and got == want
    assert seen == {(r.event_id, r.correlation_type): (r.event_count, r.first_seen) for r in found.collect()}


def test_suppress_stream_equals_batch(spark):
    rnd = random.Random(4)
    rows = [(f"k{rnd.randrange(3)}", i, (i + 99) * MIN, (i + 99 + rnd.randrange(1, 9)) * MIN) for i in range(120)]
    schema = "key string, id bigint, t bigint, d bigint"
    c = [F.col(x) for x in ("key", "id", "t", "d")]
    want = {r.id for r in suppress(spark.createDataFrame(rows, schema), *c, reach=9 * MIN).where("fires").collect()}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(as_files(spark, rows, schema, 3))
    out = memory(spark, jobs.suppress_stream(stream.withColumn("ts", F.timestamp_micros("t"))), "fired")
    assert {r.id for r in out.collect()} == want


def test_connection_window_stream_equals_batch(spark):
    rnd = random.Random(5)
    rows = [(6_000_000_000 + i * 2_000_000, rnd.choice([80, 443]), f"1.1.1.{rnd.randrange(5)}", rnd.randrange(4), "S") for i in range(300)]
    rows.append((60_000_000_000, 80, "9.9.9.9", 1, "S"))  # moves the watermark past everything else
    schema = "t bigint, port int, remote_ip string, remote_port int, state string"
    batch = ports.connection_windows(spark.createDataFrame(rows[:-1], schema))
    want = {(r.win, r.port, r.event_count, r.unique_pairs, r.unique_ips) for r in batch.collect()}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(as_files(spark, rows, schema, 3))
    out = memory(spark, jobs.connection_windows_stream(stream.withColumn("ts", F.timestamp_micros("t"))), "wins")
    got = {(r.w, r.port, r.event_count, r.unique_pairs, r.unique_ips)
           for r in out.select("*", F.unix_micros("win").alias("w")).collect()}
    assert got == want


def test_duplicates_within_watermark(spark):
    rows = [(i, f"s{i % 3}", "h", "e", (i % 7) if i % 2 else None, (i + 99) * 1_000_000) for i in range(60)]
    schema = "event_id bigint, source string, host string, event_type string, record_number bigint, t bigint"
    want = {(r.source, r.record_number) for r in ingest.drop_duplicate_events(
        spark.createDataFrame(rows, schema), ["event_id"]).where("record_number is not null").collect()}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(as_files(spark, rows, schema, 3))
    out = memory(spark, jobs.drop_duplicate_events_stream(stream.withColumn("ts", F.timestamp_micros("t"))), "dd").collect()
    numbered = [(r.source, r.record_number) for r in out if r.record_number is not None]
    assert len(numbered) == len(set(numbered)) and set(numbered) == want
    assert sum(r.record_number is None for r in out) == 30


@pytest.mark.parametrize("streaming", [False, True])
def test_text_sources(spark, tmp_path, streaming):
    (tmp_path / "site_error.log").write_text("bad\n\n  \n")
    (tmp_path / "access.log").write_text("one\ntwo\n")
    df = readers.tail_text_logs(spark, str(tmp_path), streaming)
    rows = (memory(spark, df, "tail") if streaming else df).collect()
    assert sorted((r.line, r.kind) for r in rows) == [("bad", "error"), ("one", "access"), ("two", "access")]


def test_raw_json_source_and_append_sink(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"event_type": "x", "extra": {"a": 1}}) + "\n{broken\n")
    raw = readers.read_raw_logs(spark, str(tmp_path))
    out = ingest.validate(ingest.with_fields(raw))
    assert sorted(r.status for r in out.collect()) == ["INVALID", "WARNING"]
    path = new_folder(spark, "sink")
    rows = spark.createDataFrame([(1, 0), (2, 86_400_000_000)], "id int, t bigint")
    readers.write_events(rows, path, "t")
    readers.write_events(rows, path, "t")
    back = spark.read.parquet(path)
    assert back.count() == 4 and {str(r.day) for r in back.collect()} == {"1970-01-01", "1970-01-02"}


def test_detector_width_is_an_argument(spark):
    assert callable(partial(X.failed_login_burst, width=MIN))
