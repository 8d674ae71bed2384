"""Host-side records (browser, windows, containers) to raw events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import fixed_values as fx
from vigil.functions.exprs import contains_any, map_literal, or_else, strip

PROFILE_SPAN = 100_000_000


def webkit_time(us: Column, default: Column) -> Column:
    """Microseconds since 1601; zero, negative or pre-1970 values give the default."""
    unix = us - fx.WEBKIT_EPOCH_OFFSET_US
    return F.when((us > 0) & (unix >= 0), F.timestamp_micros(unix)).otherwise(default)


def transition_name(transition: Column) -> Column:
    core = transition.bitwiseAND(F.lit(0xFF)).cast("int")
    named = F.get(F.array(*map(F.lit, fx.TRANSITION_NAMES)), core)
    return F.coalesce(named, F.concat(F.lit("Other ("), core.cast("string"), F.lit(")")))


def browser_visits(visits: DataFrame, urls: DataFrame, terms: DataFrame, since_id: int, profile: int, now: Column):
    """Visits newer than ``since_id`` with their url and, where the url came from a search, the search term."""
    fresh = visits.where(F.col("id") > since_id).select(
        F.col("id").alias("visit_id"), F.col("url").alias("url_id"), "visit_time", "transition"
    )
    u = urls.select(F.col("id").alias("url_id"), "url", "title", "visit_count", "typed_count")
    joined = fresh.join(u, "url_id").join(terms.select("url_id", "term"), "url_id", "left")
    searched = or_else(F.col("term"))
    return joined.select(
        (F.lit(profile * PROFILE_SPAN) + F.col("visit_id")).alias("record_number"),
        F.when(searched.isNotNull(), "browser.search").otherwise("browser.url_visit").alias("event_type"),
        F.when(
            searched.isNotNull(), F.concat(F.lit("Search query: '"), searched, F.lit("' on URL: "), F.col("url"))
        ).otherwise(F.concat(F.lit("Visited URL: "), F.col("url"))).alias("message"),
        webkit_time(F.col("visit_time"), now).alias("ts"),
        transition_name(F.col("transition")).alias("transition_name"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.when(F.coalesce("visit_count", F.lit(0)) == 0, 1).otherwise(F.col("visit_count")).alias("visit_count"),
        F.coalesce("typed_count", F.lit(0)).alias("typed_count"),
        searched.alias("search_term"),
    )


def browser_downloads(downloads: DataFrame, since_id: int, profile: int, now: Column) -> DataFrame:
    path = or_else(F.col("target_path"), F.col("current_path"), F.lit("unknown_file"))
    name = F.substring_index(path, "/", -1)
    tab = F.coalesce("tab_url", F.lit(""))
    return downloads.where(F.col("id") > since_id).select(
        (F.lit(profile * PROFILE_SPAN) + F.col("id")).alias("record_number"),
        F.lit("browser.download").alias("event_type"),
        F.concat(F.lit("Downloaded file: "), name, F.lit(" from "), tab, F.lit(" to "), path).alias("message"),
        webkit_time(F.col("start_time"), now).alias("ts"),
        name.alias("file_name"),
        path.alias("file_path"),
        F.coalesce("received_bytes", F.lit(0)).alias("received_bytes"),
        F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"),
    )


# numeric event types: 1 error, 2 warning, 4 information, 8 audit success, 16 audit failure
def windows_severity(kind: Column) -> Column:
    return F.when(kind.isin(1, 16), "high").when(kind == 2, "warning").otherwise("info")


def windows_events(events: DataFrame, last_seen: DataFrame) -> DataFrame:
    """Records newer than the channel's last seen number; a channel whose numbers fell was cleared and starts over.

    ``last_seen`` (channel, last_record) has one row per channel; channels without one are skipped.
    """
    newest = events.groupBy("channel").agg(F.max("record_number").alias("_newest"))
    start = last_seen.join(newest, "channel").select(
        "channel", F.when(F.col("_newest") < F.col("last_record"), 0).otherwise(F.col("last_record")).alias("_from")
    )
    formatted = or_else(strip(F.col("text")))
    inserts = F.filter("inserts", lambda s: s.isNotNull())
    generated = F.concat(
        F.lit("Windows Event ID "), F.col("event_id").cast("string"), F.lit(" generated by "), F.col("provider")
    )
    message = F.coalesce(
        formatted, F.when(F.size(inserts) > 0, strip(F.array_join(inserts, " | "))), generated
    )
    return events.join(start, "channel").where(F.col("record_number") > F.col("_from")).select(
        "channel", "record_number", F.col("event_id").cast("string").alias("event_id"), "provider",
        F.lit("windows-event-viewer").alias("source"), F.lit("windows_event").alias("event_type"),
        windows_severity(F.col("event_kind")).alias("severity"), message.alias("message"),
    )


def container_lifecycle(events: DataFrame) -> DataFrame:
    """Lifecycle events (action, container_id, name, exit_code, exec_cmd); other actions are dropped."""
    action = F.col("action")
    kind = F.try_element_at(map_literal(fx.CONTAINER_EVENT_TYPES), action)
    name = F.coalesce("name", F.lit("unknown"))
    who = F.concat(name, F.lit(" ("), F.substring("container_id", 1, 12), F.lit(")"))
    code = F.coalesce("exit_code", F.lit("0"))
    stopped_badly = action.isin("stop", "die") & (code != "0")
    severity = (
        F.when(action == "oom", "high").when(action.isin("exec_create", "exec_start") | stopped_badly, "warning")
        .otherwise("info")
    )
    message = (
        F.when(action == "oom", F.concat(F.lit("Container "), who, F.lit(" was terminated due to Out Of Memory (OOM) error")))
        .when(
            action.isin("exec_create", "exec_start"),
            F.concat(F.lit("Security Event: Command execution attempted inside container "), who, F.lit(": "),
                     F.coalesce("exec_cmd", F.lit("unknown"))),
        )
        .when(stopped_badly, F.concat(F.lit("Container "), who, F.lit(" stopped with non-zero exit code: "), code))
        .otherwise(F.concat(F.lit("Container "), who, F.lit(" action: "), action))
    )
    return events.where("container_id is not null and container_id <> ''").withColumn("event_type", kind).where(
        "event_type is not null"
    ).withColumns({"severity": severity, "message": message, "source": F.lit("docker")})


def container_log_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``timestamp message`` lines; a line without a blank is all message."""
    text = F.col(line)
    parts = F.split(text, " ", 2)
    message = F.regexp_replace(F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(text), r"[\r\n]+$", "")
    low = F.lower(F.col("message"))
    return lines.where(F.length(strip(text)) > 0).withColumns(
        {"time_text": F.when(F.size(parts) == 2, F.get(parts, F.lit(0))), "message": message}
    ).withColumn(
        "severity",
        F.when(contains_any(low, ["error", "failed", "exception"]), "high").when(low.contains("warn"), "warning")
        .otherwise("info"),
    )
