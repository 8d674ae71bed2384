"""Notifications as table jobs: who must be told, when, at which level. Nothing is sent from here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import fixed_values as fx
from vigil.functions.exprs import DAY, HOUR, MINUTE, map_literal, or_else
from vigil.operators.kernels import fold_states, suppress
from vigil.streaming.storage import written

POLICIES = (
    "policy_name string, severity string, initial_role string, escalation_role string, escalation_minutes int, "
    "second_escalation_role string, second_escalation_minutes int, is_active boolean"
)


def default_policies(spark) -> DataFrame:
    return spark.createDataFrame([(*p, True) for p in fx.DEFAULT_POLICIES], POLICIES)


def in_quiet_hours(hour: Column) -> Column:
    return (hour >= 22) | (hour < 8)


def hour_of(t: Column) -> Column:
    return F.floor(F.pmod(t, F.lit(DAY)) / (60 * MINUTE)).cast("int")


def suppress_notifications(alert_events: DataFrame, width: int = 5 * MINUTE) -> DataFrame:
    """Repeats inside [created, created + width) belong to the first notification; later ones replace it."""
    return suppress(
        alert_events, F.col("alert_fingerprint"), F.col("event_id"), F.col("t"), F.col("t") + (width - 1), reach=width
    )


def notifications(alert_events: DataFrame, policies: DataFrame, width: int = 5 * MINUTE) -> DataFrame:
    """Notifications created by alert events (event_id, t, alert_fingerprint, severity), with their repeat counts.

    Quiet hours silence everything but critical. A repeat turns a delivered, suppressed or pending notification into
    a suppressed one; other states may not move there and ignore repeats.
    """
    runs = suppress_notifications(alert_events, width)
    counts = runs.groupBy(F.col("anchor").alias("event_id")).agg(
        F.count("*").alias("occurrence_count"), F.max("t").alias("last_seen")
    )
    fresh = with_policy(alert_events.join(counts, "event_id"), policies)
    quiet = in_quiet_hours(hour_of(F.col("t"))) & (F.col("severity") != "critical")
    start = F.when(quiet, "suppressed").when(F.col("severity").isin("high", "critical"), "delivered").otherwise("pending")
    return fresh.select(
        "event_id", "alert_fingerprint", "severity", "recipient_group", "initial_role", F.col("t").alias("created_at"),
        "last_seen", "occurrence_count", start.alias("first_status"),
        F.when(F.col("occurrence_count") > 1, "suppressed").otherwise(start).alias("status"),
    )


def with_policy(df: DataFrame, policies: DataFrame) -> DataFrame:
    """Active policy per severity, of several the one whose name is the smallest, or the defaults."""
    columns = [c for c in policies.columns if c not in ("is_active", "severity", "policy_name")]
    best = F.min(F.struct("policy_name", *columns)).alias("_best")
    active = policies.where("is_active").groupBy("severity").agg(best).select("severity", "_best.*")
    return df.join(active, "severity", "left").withColumns(
        {
            "initial_role": F.coalesce("initial_role", F.lit("analyst")),
            "recipient_group": F.coalesce("policy_name", F.concat("severity", F.lit("_policy"))),
        }
    )


def route(severity: Column, hour: Column) -> Column:
    quiet = in_quiet_hours(hour) & (F.lower(severity) != "critical")
    return (
        F.when(quiet, "suppressed").when(F.lower(severity).isin("high", "critical"), "immediate").otherwise("pending")
    )


#: Recipients of a role travel in lists of so many at most.
LISTED = 1024
#: A role with more than a list of recipients meets its notifications in a product, in parts of so many recipients: a task holds up to 4,096
#: rows of a product's side as they are, more would be read back from a buffer for each notification.
CROSSED = 4000
#: So many roles at most, those that give the most rows, are products; the others go by lists.
CROSSED_ROLES = 16


def expand_recipients(df: DataFrame, recipients: DataFrame, role: str = "initial_role") -> DataFrame:
    """One row per active recipient of the role; notifications without one are marked failed.

    The result is as large as notifications times recipients, so what counts is the cost of a row. A role with many recipients is a product
    of its notifications, written once, and its recipients: a row is put together from two that lie ready. The recipients of all other roles
    are sent to every task in short lists, and rows come out of a list one after the other. No notification is shuffled by its role.
    """
    kept = [role, *[c for c in df.columns if c != role]]
    active = recipients.where("is_active").select(F.col("role").alias(role), "recipient_name")
    many = active.groupBy(role).agg(F.count("*").alias("_recipients")).where(F.col("_recipients") > LISTED)
    if df.isStreaming or many.isEmpty():
        return _listed(df, active, role, kept)
    notes = written(df.select(kept), "notified")
    crossed = _largest(many.join(notes.groupBy(role).agg(F.count("*").alias("_notes")), role))
    rest = ~F.coalesce(F.col(role).isin([name for name, _ in crossed]), F.lit(False))
    out = _listed(notes.where(rest), active.where(rest), role, kept)
    for name, n in crossed:
        told = active.where(F.col(role) == name).select("recipient_name", _delivery_status()).repartition(-(-n // CROSSED))
        out = out.unionAll(notes.where(F.col(role) == name).crossJoin(told.hint("shuffle_replicate_nl")))
    return out


def _largest(roles: DataFrame) -> list[tuple]:
    """The roles that give the most rows, each with its number of recipients."""
    rows = roles.orderBy(F.desc(F.col("_recipients") * F.col("_notes")), roles.columns[0]).limit(CROSSED_ROLES)
    return [(r[0], r["_recipients"]) for r in rows.collect()]


def _delivery_status() -> Column:
    return F.when(F.col("recipient_name").isNull(), "No active recipients").otherwise("queued").alias("delivery_status")


def _listed(df: DataFrame, active: DataFrame, role: str, kept: list[str]) -> DataFrame:
    dealt = active.withColumn("_list", F.floor(F.monotonically_increasing_id() / LISTED))
    # a list drops nulls, a struct with a null in it stays
    names = F.transform(F.collect_list(F.struct("recipient_name")), lambda r: r["recipient_name"])
    lists = dealt.groupBy(role, "_list").agg(names.alias("_names")).drop("_list")
    joined = df.join(F.broadcast(lists), role, "left")
    return joined.select(*kept, F.explode_outer("_names").alias("recipient_name")).select("*", _delivery_status())


def channel_outcome(attempts: DataFrame) -> DataFrame:
    """Per notification the first channel (in fixed order) on which every recipient was reached.

    Later channels are not tried, so only attempts up to the successful channel count as history.
    """
    order = map_literal({c: i for i, c in enumerate(fx.CHANNELS)})
    per_channel = attempts.groupBy("notification_id", "channel").agg(
        F.bool_and("ok").alias("all_ok"), F.count("*").alias("recipients"), F.max("t").alias("t")
    ).withColumn("ord", F.try_element_at(order, F.col("channel")))
    win = per_channel.groupBy("notification_id").agg(
        F.min(F.when(F.col("all_ok"), F.col("ord"))).alias("won"),
        F.collect_list(F.struct("ord", "channel", "recipients", "t")).alias("tried"),
    )
    used = F.filter("tried", lambda c: F.col("won").isNull() | (c["ord"] <= F.col("won")))
    channel = F.get(F.array(*map(F.lit, fx.CHANNELS)), F.col("won"))
    return win.select(
        "notification_id",
        channel.alias("channel_used"),
        F.when(channel.isNull(), "failed").otherwise("delivered").alias("status"),
        F.coalesce(F.concat(F.lit("delivered_via_"), F.lower(channel)), F.lit("all_channels_failed")).alias(
            "delivery_status"
        ),
        F.aggregate(used, F.lit(0).cast("bigint"), lambda a, c: a + c["recipients"]).alias("history_rows"),
        F.array_max(F.transform(used, lambda c: c["t"])).alias("last_delivery_attempt"),
    )


def apply_transitions(changes: DataFrame, block: int = HOUR) -> DataFrame:
    """Replay status changes (notification_id, t, seq, action = wanted status); the same status is always allowed."""
    moves = {s: {**{n: n for n in targets}, s: s} for s, targets in fx.NOTIFICATION_TRANSITIONS.items()}
    return fold_states(
        changes, F.col("notification_id"), F.col("t"), F.col("seq"), F.col("action"), "pending", moves, block
    ).withColumnRenamed("key", "notification_id")


def not_stopped(notifications: DataFrame, alerts: DataFrame) -> DataFrame:
    """Notifications whose escalation is neither flagged as stopped nor ended by the state of their alert."""
    ended = alerts.where(F.col("status").isin(fx.STOPPING_ALERT_STATUSES)).select("alert_id")
    return notifications.where(~F.coalesce("escalation_stopped", F.lit(False))).join(ended, "alert_id", "left_anti")


def due_escalations(
    notifications: DataFrame, policies: DataFrame, alerts: DataFrame, done: DataFrame, as_of: int
) -> DataFrame:
    """Escalations due at ``as_of``. ``done`` (notification_id, escalation_level) are already triggered.

    A ``sent`` notification may not become escalated, so it is left out.
    """
    active = notifications.where(F.col("status").isin("delivered", "escalated", "suppressed"))
    open_ = not_stopped(active, alerts).drop("initial_role", "recipient_group")
    known = with_policy(open_, policies).where("policy_name is not null")
    level = F.coalesce("escalation_level", F.lit(0))
    target = F.when(level == 0, F.col("escalation_role")).when(level == 1, F.col("second_escalation_role"))
    minutes = F.when(level == 0, F.col("escalation_minutes")).when(level == 1, F.col("second_escalation_minutes"))
    due = known.withColumns({"_target": target, "_minutes": minutes, "_level": level + 1}).where(
        F.col("_target").isNotNull() & (F.lit(as_of) >= F.col("created_at") + F.col("_minutes").cast("bigint") * MINUTE)
    )
    reason = F.concat(
        F.lit("Level-"), F.col("_level").cast("string"), F.lit(" escalation: unacknowledged for "),
        F.col("_minutes").cast("string"), F.lit(" minutes"),
    )
    rows = due.select(
        "notification_id", "alert_id", F.col("_level").alias("escalation_level"),
        F.col("_target").alias("escalation_target"), reason.alias("escalation_reason"),
    )
    return rows.join(done.select("notification_id", "escalation_level"), ["notification_id", "escalation_level"], "left_anti")


def retry_set(notifications: DataFrame, alerts: DataFrame, as_of: int, max_attempts: int = 3, wait: int = 5 * MINUTE):
    ready = (
        (F.col("status") == "failed")
        & (F.col("delivery_attempts") < max_attempts)
        & (F.col("last_delivery_attempt").isNull() | (F.col("last_delivery_attempt") <= as_of - wait))
    )
    return not_stopped(notifications.where(ready), alerts)


def batch_queue(notifications: DataFrame, alerts: DataFrame, severities=("low", "medium")) -> DataFrame:
    return not_stopped(
        notifications.where((F.col("status") == "pending") & F.col("severity").isin(list(severities))), alerts
    )


def daily_metrics(history: DataFrame) -> DataFrame:
    """Per UTC day: counts by outcome (outcome, t, delivery_seconds) and mean delivery time of sent ones."""
    return history.groupBy(F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd").alias("metric_date")).agg(
        *[
            F.count_if(F.col("outcome") == o).alias(f"total_{o}")
            for o in ("sent", "failed", "suppressed", "escalated", "retried")
        ],
        F.coalesce(F.avg(F.when(F.col("outcome") == "sent", F.col("delivery_seconds"))), F.lit(0.0)).alias(
            "avg_delivery_time_seconds"
        ),
    )


def duration_text(seconds: Column) -> Column:
    """``1d 2h 3m 4s`` without empty parts; negative is ``0s``."""
    s = F.greatest(seconds, F.lit(0))
    parts = [(F.floor(s / 86400), "d"), (F.floor(s % 86400 / 3600), "h"), (F.floor(s % 3600 / 60), "m"), (s % 60, "s")]
    shown = [F.when(v > 0, F.concat(v.cast("bigint").cast("string"), F.lit(u))) for v, u in parts]
    return or_else(F.concat_ws(" ", *shown), F.lit("0s"))


def message_context(notifications: DataFrame, alerts: DataFrame, as_of: int) -> DataFrame:
    """The facts of a notification message: subject, level tag, age, rules, reasons, related events."""
    level = F.coalesce("escalation_level", F.lit(0))
    tag = F.when(level == 0, "NEW").when(level >= 3, "SOC MANAGER").otherwise("ESCALATED")
    joined = notifications.join(
        alerts.select(
            "alert_id", "alert_title", "host", F.col("status").alias("alert_status"), "rule_matches",
            "correlation_matches",
        ),
        "alert_id",
        "left",
    )
    # rules and correlations of one alert are bounded by the rule set, not by its events
    names = F.transform("rule_matches", lambda m: or_else(m["rule_name"], m["rule_code"], F.lit("Unknown")))
    reasons = F.filter(F.transform("rule_matches", lambda m: m["reason"]), lambda r: F.length(r) > 0)
    types = F.transform("correlation_matches", lambda m: m["correlation_type"])
    events = F.aggregate("correlation_matches", F.lit(0).cast("bigint"), lambda a, m: a + m["event_count"])
    listed = lambda array, sep: or_else(F.array_join(array, sep), F.lit("N/A"))
    subject = F.concat(
        F.lit("["), F.upper(F.coalesce("severity", F.lit("medium"))), F.lit("][L"), level.cast("string"), F.lit("]["),
        tag, F.lit("] "), or_else(F.col("alert_title"), F.concat(F.lit("Alert "), F.col("alert_id"))),
        F.coalesce(F.concat(F.lit(" on "), or_else(F.col("host"))), F.lit("")),
    )
    return joined.select(
        "notification_id", "alert_id", tag.alias("tag"), subject.alias("subject"),
        duration_text(F.floor((F.lit(as_of) - F.col("created_at")) / 1_000_000)).alias("time_since"),
        F.upper(or_else(F.col("alert_status"), F.lit("open"))).alias("alert_status"),
        listed(names, ", ").alias("rule_name"),
        listed(reasons, "; ").alias("detection_reason"),
        listed(types, ", ").alias("correlation_rule"),
        F.when(F.size("correlation_matches") > 0, events.cast("string")).otherwise("N/A").alias("related_events"),
        F.when(F.col("occurrence_count") > 1, "Yes").otherwise("No").alias("is_duplicate"),
    )
