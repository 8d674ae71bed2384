"""The whole path over the raw texts of all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import notify, rules
from vigil.plans import pipeline
from vigil.plans.adapters import oracle
from vigil.plans.ingest_queries import VERDICT
from vigil.plans.registry import query


@query("pipeline_counts", oracle("""SELECT 'quarantined' AS what, count(*) AS n FROM verdict WHERE status = 'INVALID'
  UNION ALL SELECT 'events', count(*) FILTER (m IN (2, 3, 4, 5)) + count(DISTINCT k) FILTER (m = 8) + count(DISTINCT user_id) FILTER (m = 9) FROM verdict
  UNION ALL SELECT 'suspicious', count(*) FILTER (m = 2) FROM verdict
  UNION ALL SELECT 'alert occurrences', count(*) FILTER (m = 2) FROM verdict""", VERDICT))
def _(t):
    raw = t.snapshot.select("event_id", F.timestamp_micros("t").alias("received"), "raw")
    out = pipeline.run(raw, rules.default_rules(t.spark), notify.default_policies(t.spark), 2024)

    def counted(df, what, n):
        return df.agg(F.coalesce(n, F.lit(0)).cast("bigint").alias("n")).select(F.lit(what).alias("what"), "n")

    return (
        counted(out.quarantine, "quarantined", F.sum("quarantined_count"))
        .unionByName(counted(out.events, "events", F.count("*")))
        .unionByName(counted(out.events, "suspicious", F.count_if("detection.is_suspicious")))
        .unionByName(counted(out.alerts, "alert occurrences", F.sum("occurrence_count")))
    )
