"""Timelines against a plain comparison of every record with every bucket."""

import random

import pytest

from vigil.operators import ports

S = 1_000_000
SCHEMA = "source_ip string, first_seen bigint, last_seen bigint, activity_count bigint, bucket string"
START, END, STEP = 1_000 * S, 1_000 * S + 95 * S, 10 * S


def overlapping(rows, bucket):
    return [r for r in rows if r[1] is not None and r[2] is not None and r[1] < bucket + STEP and r[2] >= bucket]


def expected(rows):
    out = {}
    for bucket in range(START, END, STEP):
        hit = overlapping(rows, bucket)
        span = max(0.0, (max(r[2] for r in hit) - min(r[1] for r in hit)) / S) if hit else 0.0
        out[bucket] = (sum(r[3] or 0 for r in hit), len({r[0] for r in hit}), span)
    return out


def expected_ips(rows):
    out = {}
    for bucket in range(START, END, STEP):
        for ip in {r[0] for r in overlapping(rows, bucket)}:
            own = [r for r in overlapping(rows, bucket) if r[0] == ip]
            out[bucket, ip] = (sum(r[3] or 0 for r in own), min(r[1] for r in own), max(r[2] for r in own))
    return out


def compare(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    found = ports.timeline(df, START, END, STEP).collect()
    assert [r.bucket for r in sorted(found)] == list(range(START, END, STEP))
    assert {r.bucket: (r.connection_count, r.active_ips, r.observed_duration_seconds) for r in found} == expected(rows)
    by_ip = ports.timeline_ips(df, START, END, STEP).collect()
    assert {(r.bucket, r.source_ip): (r.activity_count, r.first_seen, r.last_seen) for r in by_ip} == expected_ips(rows)
    assert len(by_ip) == len(expected_ips(rows))


@pytest.mark.parametrize("seed", range(3))
def test_timeline_equals_a_plain_comparison(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(150):
        first = START + rng.randrange(-40 * S, 120 * S, S // 2 * (1 + seed))
        ip = "hot" if rng.random() < 0.5 else f"10.0.0.{rng.randrange(8)}"
        rows.append((ip, first, first + rng.choice([0, 0, S, 10 * S, 35 * S, 200 * S]), rng.randrange(5)))
    compare(spark, rows + rows[:20])


def test_timeline_edges(spark):
    compare(spark, [])
    compare(spark, [("a", START - 5, START - 1, 3)])  # over before the report
    compare(spark, [("a", END + 10 * S, END + 20 * S, 3)])  # behind it
    compare(spark, [("a", START - 5 * S, START, 3), ("b", START + 10 * S, START + 10 * S, 1)])  # ends and begins on an edge
    compare(spark, [("a", START, END + 99 * S, 3)])  # all buckets
    compare(spark, [("a", START + 3 * S, START + S, 3), ("a", START + 30 * S, START + S, 3)])  # ends before it begins
    compare(spark, [("a", None, START, 3), ("a", START, None, 3), (None, START, START + 15 * S, None), (None, START, START, 2)])
    # runs of one address that touch, overlap and leave a gap
    compare(spark, [("a", START, START + 9 * S, 1), ("a", START + 10 * S, START + 25 * S, 2), ("a", START + 21 * S, START + 22 * S, 4), ("a", START + 50 * S, START + 51 * S, 8)])


def test_an_empty_report(spark):
    df = spark.createDataFrame([("a", START, START, 1, "x")], SCHEMA)
    assert ports.timeline(df, START, START, STEP).collect() == []
    assert ports.timeline_ips(df, START, START, STEP).collect() == []


def test_a_record_is_two_rows_however_long_it_is(spark):
    rows = [("a", START, END, 1)] * 50
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    plan = ports.timeline(df, START, END, STEP)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "Generate inline(" in plan
    # an address has a row per bucket in which something changes, here two, for 10 buckets and 50 records
    assert ports._turns(df, START, END, STEP).count() == 2
