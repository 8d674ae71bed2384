"""Alerts: gate, scoring, deduplication with escalation, ids, status, search.

Candidate rows have: event_id, t, source, event_type, host, source_ip, user, severity, rule_matches,
correlation_matches (array of structs with correlation_type, severity, risk_score) and detection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import fixed_values as fx
from vigil.functions.exprs import MINUTE, SECOND, any_of, map_literal, or_else, severity_index, severity_name
from vigil.operators.kernels import numbered, running_count
from vigil.sources.stored import KeyedTable

TOP = len(fx.ALERT_SEVERITIES) - 1


def _has_high_rule() -> Column:
    return F.coalesce(F.exists("rule_matches", lambda m: m["severity"].isin("high", "critical")), F.lit(False))


def _has_correlation() -> Column:
    return F.coalesce(F.size("correlation_matches") > 0, F.lit(False))


def _is_suspicious() -> Column:
    return F.coalesce(F.col("detection.is_suspicious"), F.lit(False))


def alert_gate(df: DataFrame) -> DataFrame:
    return df.where(_has_high_rule() | _has_correlation() | _is_suspicious())


def title() -> Column:
    rule, corr = F.get("rule_matches", F.lit(0)), F.get("correlation_matches", F.lit(0))
    return (
        F.when(_has_correlation(), F.concat(F.lit("Correlation Match: "), corr["correlation_type"]))
        .when(F.coalesce(F.size("rule_matches") > 0, F.lit(False)), F.concat(F.lit("Rule Match: "), rule["rule_code"]))
        .when(
            _is_suspicious(),
            F.concat(F.lit("Suspicious Activity Detected: "), or_else(F.col("detection.reason"), F.lit("Unknown"))),
        )
        .otherwise(F.concat(F.lit("Suspicious Log: "), F.col("event_type")))
    )


def alert_type() -> Column:
    return (
        F.when(_has_correlation(), "correlation").when(_has_high_rule(), "rule_match")
        .when(_is_suspicious(), "detection").otherwise("other")
    )


def _each(column: str, name: str) -> Column:
    none = F.array().cast("array<string>" if name == "severity" else "array<bigint>")
    typed = "string" if name == "severity" else "bigint"
    return F.coalesce(F.transform(column, lambda m: m[name].cast(typed)), none)


def max_severity() -> Column:
    named = F.concat(
        F.array(F.col("severity"), F.col("detection.severity")), _each("rule_matches", "severity"),
        _each("correlation_matches", "severity"),
    )
    best = F.array_max(F.transform(named, lambda s: F.coalesce(severity_index(s), F.lit(-1))))
    return F.coalesce(severity_name(F.when(best >= 0, best)), F.lit("low"))


def base_risk() -> Column:
    of_detection = F.greatest(F.coalesce(severity_index(F.col("detection.severity")), F.lit(0)), F.lit(0)) * 20
    risks = F.concat(
        F.array(F.lit(0).cast("bigint"), of_detection.cast("bigint")), _each("rule_matches", "risk_score"),
        _each("correlation_matches", "risk_score"),
    )
    return F.array_max(risks)


def confidence() -> Column:
    score = (
        F.when(_has_correlation(), 50).otherwise(0)
        + F.when(_has_high_rule(), 40).otherwise(0)
        + F.when(_is_suspicious(), 30).otherwise(0)
    )
    return F.least(F.lit(100), F.greatest(F.lit(50), score))


def alert_fingerprint() -> Column:
    def listed(column, name):
        names = F.array_join(F.array_sort(F.transform(column, lambda m: m[name])), ",")
        return F.when(F.coalesce(F.size(column) > 0, F.lit(False)), names)

    text = F.concat_ws(
        "|", "source", "event_type", or_else(F.col("host"), F.lit("unknown_host")),
        listed("rule_matches", "rule_code"), listed("correlation_matches", "correlation_type"),
    )
    return F.sha2(text, 256)


def alert_occurrences(df: DataFrame) -> DataFrame:
    """Gated events with everything an alert needs."""
    return alert_gate(df).withColumns(
        {
            "alert_title": title(),
            "alert_type": alert_type(),
            "alert_severity": max_severity(),
            "risk": base_risk(),
            "confidence": confidence(),
            "alert_fingerprint": alert_fingerprint(),
        }
    )


def escalated(first_index: Column, first_risk: Column, n: Column) -> tuple[Column, Column]:
    """(severity index, risk) after ``n`` occurrences: repeats 6..20 add one level and 5 points, later ones two and 10.

    A severity outside the scale becomes ``high`` at its first escalation and climbs from there.
    """
    one = F.greatest(F.least(n, F.lit(20)) - 5, F.lit(0))
    two = F.greatest(n - 20, F.lit(0))
    levels = one + 2 * two
    known = F.least(F.lit(TOP), first_index + levels)
    unknown = F.when(levels == 0, first_index).otherwise(F.least(F.lit(TOP), F.lit(TOP - 1) + F.greatest(levels - 1, F.lit(0))))
    index = F.when(first_index >= 0, known).otherwise(unknown)
    return index.cast("int"), F.least(F.lit(100), first_risk + 5 * one + 10 * two)


def alert_totals(occurrences: DataFrame, closes: DataFrame | None = None, earlier: DataFrame | None = None, block: int = MINUTE) -> DataFrame:
    """What occurrences add up to per fingerprint and episode, in a form that adds up further (``merge_totals``).

    ``closes`` (alert_fingerprint, t) are close/resolve times: later occurrences start a new episode. ``earlier``
    (alert_fingerprint, closed) counts the closes of earlier runs. Totals are one aggregate with map-side combine, so
    a fingerprint that fires all day never gathers its events. The rule codes are part of the fingerprint, so the
    first occurrence already has all rules of the alert.
    """
    rows = occurrences.select(
        "alert_fingerprint", "t", "event_id", "alert_title", "alert_type", "alert_severity", "confidence", "risk",
        "source", "source_ip", "host", "user", F.lit(False).alias("_close"),
        F.array_sort(F.array_distinct(F.transform("rule_matches", lambda m: m["rule_code"]))).alias("rule_codes"),
    )
    if closes is not None:
        marks = closes.select("alert_fingerprint", "t", F.lit(True).alias("_close"))
        both = rows.unionByName(marks, allowMissingColumns=True)
        counted = running_count(both, ["alert_fingerprint"], "t", ["t", "_close"], F.col("_close"), "episode", block)
        rows = counted.where("not _close")
    else:
        rows = rows.withColumn("episode", F.lit(0).cast("bigint"))
    if earlier is not None:
        rows = rows.join(earlier, "alert_fingerprint", "left").withColumn("episode", F.col("episode") + F.coalesce("closed", F.lit(0))).drop("closed")
    order = F.struct("t", "event_id")
    first = F.struct(
        "event_id", "alert_title", "alert_type", "alert_severity", "risk", "source", "source_ip", "host", "user",
        "rule_codes",
    )
    return rows.groupBy("alert_fingerprint", "episode").agg(
        F.count("*").alias("occurrence_count"),
        F.min("t").alias("first_seen"),
        F.max("t").alias("last_seen"),
        F.min(order).alias("first_order"),
        F.min_by(first, order).alias("f"),
        F.max(order).alias("last_order"),
        F.max_by("confidence", order).alias("confidence"),
        # a stored risk of 0 is replaced by the risk of a later occurrence before it escalates
        F.min(F.when(F.col("risk") > 0, order)).alias("risk_order"),
        F.min_by("risk", F.when(F.col("risk") > 0, order)).alias("first_risk"),
    )


def merge_totals(both: DataFrame) -> DataFrame:
    """One row per fingerprint and episode from rows of several ``alert_totals``."""
    return both.groupBy("alert_fingerprint", "episode").agg(
        F.sum("occurrence_count").alias("occurrence_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min("first_order").alias("first_order"),
        F.min_by("f", "first_order").alias("f"),
        F.max("last_order").alias("last_order"),
        F.max_by("confidence", "last_order").alias("confidence"),
        F.min("risk_order").alias("risk_order"),
        F.min_by("first_risk", "risk_order").alias("first_risk"),
    )


def alerts_of(totals: DataFrame) -> DataFrame:
    """Alerts as they stand after all occurrences in ``totals``."""
    index, risk = escalated(
        severity_index(F.col("f.alert_severity")), F.coalesce("first_risk", "f.risk"), F.col("occurrence_count")
    )
    return (
        totals.withColumns({"_idx": index, "risk_score": risk})
        .select(
            "alert_fingerprint", "episode", "f.event_id", "f.alert_title", "f.alert_type",
            F.coalesce(severity_name(F.when(F.col("_idx") >= 0, F.col("_idx"))), F.col("f.alert_severity")).alias("severity"),
            "risk_score", "confidence", "occurrence_count", "first_seen", "last_seen", "f.source", "f.source_ip",
            "f.host", "f.user", "f.rule_codes",
        )
        .withColumn("priority", priority(F.col("severity")))
    )


def dedup_alerts(occurrences: DataFrame, closes: DataFrame | None = None, block: int = MINUTE) -> DataFrame:
    """One alert per open fingerprint, of one run alone."""
    return alerts_of(alert_totals(occurrences, closes, block=block))


class StoredAlerts:
    """Alerts that runs add to: totals by fingerprint and episode, and how often a fingerprint has been closed.

    Runs come in the order of their events; inside a run any order will do. A run's name is what makes it count once.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        empty = spark.createDataFrame([], _OCCURRENCE)
        self.totals = KeyedTable(spark, f"{path}/totals", alert_totals(empty).schema, ["alert_fingerprint", "episode"], buckets)
        self.closed = KeyedTable(spark, f"{path}/closed", spark.createDataFrame([], "alert_fingerprint string, closed bigint").schema, ["alert_fingerprint"], buckets)

    def add(self, occurrences: DataFrame, run: str, closes: DataFrame | None = None) -> bool:
        """False when the run has been added before."""
        if closes is None:
            closes = occurrences.sparkSession.createDataFrame([], "alert_fingerprint string, t bigint")
        # the closes of this run are stored last: until then a repetition of the run finds what the first attempt found
        added = self.totals.upsert(alert_totals(occurrences, closes, self.closed.read()), merge_totals, run)
        counts = closes.groupBy("alert_fingerprint").agg(F.count("*").alias("closed"))
        fold = lambda both: both.groupBy("alert_fingerprint").agg(F.sum("closed").alias("closed"))
        self.closed.upsert(counts, fold, run)
        return added

    def alerts(self) -> DataFrame:
        return alerts_of(self.totals.read())


_OCCURRENCE = (
    "alert_fingerprint string, t bigint, event_id bigint, alert_title string, alert_type string, alert_severity string, confidence int, risk int, "
    "source string, source_ip string, host string, user string, rule_matches array<struct<rule_code:string>>"
)


def priority(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(map_literal(fx.PRIORITY_BY_SEVERITY), severity), F.lit("P4"))


def daily_ids(df: DataFrame, prefix: str, t: str, order: list[str], out: str, block: int = SECOND, counters: DataFrame | None = None) -> DataFrame:
    """``PREFIX-yyyymmdd-0001`` in creation order of the UTC day.

    The day is numbered second by second, behind the totals of the seconds before: a busy hour is many tasks, and a day has 86,400 totals at
    most. ``counters`` (``day``, ``last``) are the numbers given out by earlier runs, as ``daily_counters`` returns them.
    """
    day = df.withColumn("_day", F.date_format(F.timestamp_micros(t), "yyyyMMdd"))
    given = None if counters is None else counters.select(F.col("day").alias("_day"), "last")
    ranked = numbered(day, ["_day"], t, [t, *order], "_n", block, given)
    # four digits, more when the day is busier (lpad would truncate)
    digits = F.greatest(F.lit(4), F.length(F.col("_n").cast("string")))
    text = F.lpad(F.col("_n").cast("string"), digits, F.lit("0"))
    return ranked.withColumn(out, F.concat_ws("-", F.lit(prefix), "_day", text)).drop("_day", "_n")


def daily_counters(ids: DataFrame, column: str, counters: DataFrame | None = None) -> DataFrame:
    """Day and last number of all ids given out so far: what the next run goes on from. One row per day."""
    parts = F.split(column, "-")
    new = ids.select(F.get(parts, F.size(parts) - 2).alias("day"), F.get(parts, F.size(parts) - 1).cast("bigint").alias("last"))
    both = new if counters is None else new.unionByName(counters.select("day", F.col("last").cast("bigint").alias("last")))
    return both.groupBy("day").agg(F.max("last").alias("last"))


STATUS_BY_ACTION = {
    "acknowledge": "acknowledged",
    "investigate": "investigating",
    "resolve": "resolved",
    "close": "closed",
}


def alert_status(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Current status and stamps. Changes (alert_id, t, seq, action) name an alert by its id or its number."""
    status = F.try_element_at(map_literal(STATUS_BY_ACTION), F.col("action"))
    known = changes.withColumn("status", status).where("status is not null")
    state = known.groupBy("alert_id").agg(
        F.max_by("status", F.struct("t", "seq")).alias("_status"),
        *[
            F.max(F.when(F.col("status") == s, F.col("t"))).alias(f"{s}_at")
            for s in ("acknowledged", "resolved", "closed")
        ],
        F.max("t").alias("updated_at"), F.max(F.struct("t", "seq")).alias("_last"),
    )
    # both spellings are resolved to the alert id before the join, an OR join would pair everything with everything
    by_number = state.where(F.col("alert_id").rlike("^[0-9]+$")).select(
        F.col("alert_id").try_cast("bigint").alias("id"), *[F.col(c) for c in state.columns if c != "alert_id"]
    )
    numbers = alerts.select("id", "alert_id").join(by_number, "id").drop("id")
    merged = (
        state.join(alerts.select("alert_id"), "alert_id", "left_semi")
        .unionByName(numbers)
        .groupBy("alert_id")
        .agg(
            F.max_by("_status", "_last").alias("_status"),
            *[F.max(f"{s}_at").alias(f"{s}_at") for s in ("acknowledged", "resolved", "closed")],
            F.max("updated_at").alias("updated_at"),
        )
    )
    return (
        alerts.drop("updated_at")
        .join(merged, "alert_id", "left")
        .withColumn("status", F.coalesce("_status", F.lit("open")))
        .drop("_status")
    )


SORTABLE = [
    "created_at", "severity", "status", "alert_title", "risk_score", "occurrence_count", "last_seen", "first_seen",
]


def search_alerts(
    alerts: DataFrame, severity=None, status=None, source_ip=None, source=None, search=None, sort_by="created_at",
    sort_order="desc", skip=0, limit=50, tie="alert_id",
) -> tuple[DataFrame, DataFrame]:
    """(page, one-row total)."""
    def holds(name, text):
        return F.lower(F.col(name)).contains(text.lower())

    found = alerts
    if severity:
        found = found.where(F.col("severity") == severity)
    if status:
        found = found.where(F.col("status") == status)
    if source_ip:
        found = found.where(holds("source_ip", source_ip))
    if source:
        found = found.where(holds("source", source))
    if search:
        names = ["alert_id", "alert_title", "source_ip", "source", "host", "user", "rule_text"]
        found = found.where(F.coalesce(any_of(F.coalesce(holds(n, search), F.lit(False)) for n in names), F.lit(False)))
    column = sort_by if sort_by in SORTABLE else "created_at"
    # the store sorts nulls as largest
    order = F.asc_nulls_last(column) if sort_order.lower() == "asc" else F.desc_nulls_first(column)
    page = found.orderBy(order, tie).offset(skip).limit(limit)
    return page, found.agg(F.count("*").alias("total"))


def get_alert(alerts: DataFrame, alert_id=None, number=None, fingerprint=None) -> DataFrame:
    if alert_id is not None:
        return alerts.where(F.col("alert_id") == alert_id).limit(1)
    if number is not None:
        return alerts.where(F.col("id") == number).limit(1)
    return alerts.where(F.col("alert_fingerprint") == fingerprint).orderBy(F.desc("id")).limit(1)


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count_if(F.col("severity") == "critical").alias("critical_alerts"),
        F.count_if(F.col("severity") == "high").alias("high_alerts"),
        F.count_if(F.col("status") == "open").alias("open_alerts"),
    )
