"""Inputs that once gave wrong answers."""

import base64
import gzip

from pyspark.sql import functions as F

from vigil.operators import decode
from vigil.operators.alerts import alert_status
from vigil.operators.ingest import drop_duplicate_events
from vigil.operators.notify import with_policy


def test_all_gzip_members_are_read():
    text = base64.b64encode(gzip.compress(b"first line\n") + gzip.compress(b"second line\n")).decode()
    assert decode._gzip(text) == "first line\nsecond line\n"
    assert decode._gzip(base64.b64encode(gzip.compress(b"cut off")[:-4]).decode()) is None


def test_a_redelivered_event_is_one_row(spark):
    rows = [(1, "s", "h", "e", 7, 1), (1, "s", "h", "e", 7, 1), (2, "s", "h", "e", 7, 1), (None, "s", "h", "e", 8, 2), (3, "s", None, "e", None, 3), (3, "s", None, "e", None, 3)]
    df = spark.createDataFrame(rows, "event_id long, source string, host string, event_type string, record_number long, x int").repartition(3)
    got = drop_duplicate_events(df, ["event_id"])
    assert got.columns == df.columns
    assert sorted((r.event_id or 0, r.record_number or 0) for r in got.collect()) == [(0, 8), (1, 7), (3, 0), (3, 0)]


def test_long_numbers_and_ties_in_status_changes(spark):
    alerts = spark.createDataFrame([(1, "ALERT-1", 0), (2, "ALERT-2", 0)], "id long, alert_id string, updated_at long")
    changes = spark.createDataFrame([("ALERT-1", 5, 1, "acknowledge"), ("1", 5, 2, "resolve"), ("9" * 40, 5, 3, "resolve")], "alert_id string, t long, seq long, action string")
    got = {r.alert_id: r.status for r in alert_status(alerts, changes).collect()}
    assert got == {"ALERT-1": "resolved", "ALERT-2": "open"}


def test_the_smallest_of_several_policies(spark):
    policies = spark.createDataFrame([("high", "b", "lead", True), ("high", "a", "chief", True), ("high", "0", "x", False)], "severity string, policy_name string, initial_role string, is_active boolean")
    got = with_policy(spark.createDataFrame([("high",), ("low",)], "severity string"), policies).select("severity", F.col("recipient_group"), "initial_role").collect()
    assert {tuple(r) for r in got} == {("high", "a", "chief"), ("low", "low_policy", "analyst")}
