"""The whole path from raw text to alerts, incidents and notifications, as a set of tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.exprs import micros
from vigil.operators import alerts, classify, correlate, formats, incidents, ingest, notify, rules
from vigil.operators.detect import detect
from vigil.streaming.storage import written

PARSE_FIELDS = [
    "detected_format", "parsing_confidence", "decoding_chain", "event_fingerprint", "log_type", "log_subtype", "confidence", "reason",
]
WEB_FIELDS = ["http_method", "request_uri", "status_code", "user_agent"]


@dataclass
class Tables:
    quarantine: DataFrame
    unknown: DataFrame
    events: DataFrame
    correlations: DataFrame
    alerts: DataFrame
    incidents: DataFrame
    notifications: DataFrame


@contextmanager
def compiled_steps(spark: SparkSession) -> Iterator[None]:
    """Java does not compile a method of more than 8,000 bytes of byte code: a step that would make a longer one runs operator by operator
    instead, in methods that are compiled. The steps of the path are that wide."""
    name, limit = "spark.sql.codegen.hugeMethodLimit", "8000"
    given = spark.conf.get(name)
    spark.conf.set(name, limit)
    try:
        yield
    finally:
        spark.conf.set(name, given)


def run(
    raw: DataFrame, rule_table: DataFrame, policies: DataFrame, year: int, widths: dict[str, int] | None = None,
    count_duplicates: bool = False,
) -> Tables:
    """``raw`` has event_id, received (timestamp) and raw (JSON text).

    Duplicates are removed before rules and windows see them; ``count_duplicates`` lets them advance the windows instead.
    Tables that several later steps read (validated, parsed, normalized events, matches, occurrences) are written once.
    """
    with compiled_steps(raw.sparkSession):
        return _run(raw, rule_table, policies, year, widths, count_duplicates)


def _run(raw, rule_table, policies, year, widths, count_duplicates) -> Tables:
    spark = raw.sparkSession
    # only the quarantine still asks for the text itself
    validated = ingest.validate(ingest.with_fields(raw)).withColumn("raw", F.when(F.col("status") == "INVALID", F.col("raw")))
    passed, held = ingest.route(written(validated, "validated"))
    declared = {n: F.col("fields")[n] for n in ("source", "event_type", "timestamp", "message")}
    parsed = formats.merge_into_fields(formats.parse_logs(passed.withColumns(declared), "message", year))
    merged = parsed.drop("parsed", "decoded", "raw", "errors", "warnings", "stage", "status", *declared).withColumns(
        {
            **{n: F.col("fields")[n] for n in ("source", "event_type", "message")},
            "metadata": F.from_json(F.col("fields")["metadata"], ingest.MAP),
        }
    )
    classified = written(classify.classify_log_type(merged), "classified")
    typed = ingest.normalize(classified, F.col("received"), keep=["event_id", *PARSE_FIELDS]).withColumn("t", micros(F.col("ts")))
    typed = written(typed, "typed")
    unique = typed if count_duplicates else ingest.drop_duplicate_events(typed, ["event_id"])
    stored_rules = rules.load_rules(rule_table)
    ruled = rules.match_rules(unique, stored_rules)
    ruled = rules.pattern_rules(ruled, rules.load_rules(rules.web_rules(spark)), out="web_matches")
    fields = {n: F.col("metadata")[n] for n in WEB_FIELDS}
    seen = written(detect(ruled).withColumns(fields), "events")
    counted = rules.threshold_rules(seen, stored_rules, "event_id", "t")
    # few events reach a threshold: how large their table is says how it is joined
    counted = None if counted is None else written(counted, "counted")
    seen = written(rules.with_threshold_matches(seen, counted, "event_id", last="web_matches"), "events")
    found = written(correlate.all_matches(seen, widths), "matches")
    matches = written(correlate.surviving(found, widths), "correlations")
    # at most one match per detector and event
    per_event = matches.groupBy("event_id").agg(
        F.collect_list(F.struct("correlation_type", "severity", "risk_score", "event_count")).alias("correlation_matches")
    )
    occurrences = written(alerts.alert_occurrences(seen.join(per_event, "event_id", "left")), "occurrences")
    deduped = alerts.dedup_alerts(occurrences).withColumn("created_at", F.col("first_seen"))
    stored = written(alerts.daily_ids(deduped, "ALT", "created_at", ["event_id"], "alert_id"), "alerts")
    told = occurrences.select("event_id", "t", "alert_fingerprint", F.col("alert_severity").alias("severity"))
    return Tables(
        quarantine=ingest.quarantine(held, ["event_id"]),
        unknown=ingest.unknown_logs(classified.withColumn("ts", F.col("received")), ["event_id"]),
        events=seen,
        correlations=matches,
        alerts=stored,
        incidents=incidents.create_incidents(stored),
        notifications=notify.notifications(told, policies),
    )
