"""Incidents: creation, workflow, notes, lists, dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import fixed_values as fx
from vigil.functions.exprs import HOUR
from vigil.operators.alerts import daily_ids
from vigil.operators.kernels import fold_states

# an assignment moves an open or acknowledged incident on, otherwise it only changes the owner
ACTIONS = {
    state: {
        **{{"acknowledged": "acknowledge", "investigating": "investigate", "closed": "close"}[t]: t for t in targets},
        "assign": "investigating" if state in ("open", "acknowledged") else state,
    }
    for state, targets in fx.INCIDENT_TRANSITIONS.items()
}


def create_incidents(alerts: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """One open incident per alert (alert_id, alert_title, severity, created_at in micros); ids go on behind ``counters`` (day, last)."""
    fresh = alerts.select(
        "alert_id", F.col("alert_title").alias("title"), "severity", F.lit("open").alias("status"), "created_at"
    )
    return daily_ids(fresh, "INC", "created_at", ["alert_id"], "incident_id", counters=counters)


def apply_transitions(changes: DataFrame, block: int = HOUR) -> DataFrame:
    """Replay changes (incident_id, t, seq, action): per change before, after, accepted and the reason of a rejection."""
    replayed = fold_states(
        changes, F.col("incident_id"), F.col("t"), F.col("seq"), F.col("action"), "open", ACTIONS, block
    )
    target = F.when(F.col("action") == "acknowledge", "acknowledged").when(
        F.col("action") == "investigate", "investigating").when(F.col("action") == "close", "closed").otherwise(
        F.col("action"))
    why = F.concat(F.lit("Invalid state transition from '"), F.col("before"), F.lit("' to '"), target, F.lit("'"))
    return replayed.withColumn("rejection", F.when(~F.col("accepted"), why)).withColumnRenamed("key", "incident_id")


def current_state(replayed: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Latest status, stamps and owner. Assigning an open incident sets both stamps at once."""
    moved = F.col("accepted") & (F.col("before") != F.col("after"))
    reached = lambda s, extra: F.max(F.when(moved & ((F.col("after") == s) | extra), F.col("t")))
    skipped = (F.col("before") == "open") & (F.col("after") == "investigating")
    state = replayed.groupBy("incident_id").agg(
        F.max_by("after", F.struct("t", "seq")).alias("status"),
        reached("acknowledged", skipped).alias("acknowledged_at"),
        reached("investigating", F.lit(False)).alias("investigating_at"),
        reached("closed", F.lit(False)).alias("closed_at"),
        F.count_if("accepted").alias("accepted_changes"),
        F.count_if(~F.col("accepted")).alias("rejected_changes"),
    )
    if changes is None:
        return state
    owners = (
        changes.where("action = 'assign'")
        .groupBy("incident_id")
        .agg(
            F.max_by("actor", F.struct("t", "seq")).alias("assigned_to"),
            F.max_by("role", F.struct("t", "seq")).alias("assigned_role"),
        )
    )
    return state.join(owners, "incident_id", "left")


def incident_notes(notes: DataFrame) -> DataFrame:
    """Notes (incident_id, t, seq, note) joined by newline in order: the result is one text per incident."""
    ordered = F.array_sort(F.collect_list(F.struct("t", "seq", "note")))
    return notes.groupBy("incident_id").agg(
        F.array_join(F.transform(ordered, lambda n: n["note"]), "\n").alias("notes"), F.count("*").alias("note_count")
    )


def list_incidents(df: DataFrame, status=None, severity=None, skip=0, limit=100) -> DataFrame:
    if status:
        df = df.where(F.col("status") == status)
    if severity:
        df = df.where(F.col("severity") == severity)
    return df.orderBy(F.desc("created_at"), "incident_id").offset(skip).limit(limit)


def get_incident(df: DataFrame, incident_id: str) -> DataFrame:
    return df.where(F.col("incident_id") == incident_id)


def search_incidents(df: DataFrame, text: str, sort_by: str, ascending: bool, page: int, rows: int) -> DataFrame:
    """Missing values come first ascending and last descending."""
    needle = text.lower()
    hit = F.lower("incident_id").contains(needle) | F.lower("title").contains(needle)
    order = F.asc_nulls_first(sort_by) if ascending else F.desc_nulls_last(sort_by)
    return df.where(hit).orderBy(order, "incident_id").offset(page * rows).limit(rows)


STATUSES = list(fx.INCIDENT_TRANSITIONS)


def _counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(f"{s}_incidents") for s in STATUSES] + [
        F.count_if(F.col("severity") == s).alias(f"{s}_incidents") for s in reversed(fx.LOG_SEVERITIES)
    ]


def dashboard_summary(incidents: DataFrame, logs: DataFrame) -> DataFrame:
    """Eight conditional counts in one pass, and the number of logs."""
    one = incidents.agg(*_counts()).withColumn(
        "total_incidents", sum((F.col(f"{s}_incidents") for s in STATUSES[1:]), F.col(f"{STATUSES[0]}_incidents"))
    )
    # both sides are exactly one row
    return one.crossJoin(F.broadcast(logs.agg(F.count("*").alias("total_logs"))))


def incident_charts(incidents: DataFrame) -> DataFrame:
    """Non-zero slices of the severity and status charts."""
    by = lambda name, values: (
        incidents.where(F.col(name).isin(values))
        .groupBy(F.lit(name).alias("chart"), F.col(name).alias("slice"))
        .agg(F.count("*").alias("value"))
    )
    return by("severity", fx.LOG_SEVERITIES).unionByName(by("status", STATUSES))


def latest_incidents(incidents: DataFrame, n: int = 5) -> DataFrame:
    return incidents.orderBy(F.desc("created_at"), "incident_id").limit(n)


