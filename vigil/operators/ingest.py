"""Validation, routing, normalization, duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import fixed_values as fx
from vigil.functions.exprs import blank_to_null, event_time, is_ip, once, or_else, strip
from vigil.sources.stored import KeyedTable

MAP = "map<string,string>"


def with_fields(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Open-schema JSON text to a ``fields`` map; nested values stay JSON text, non-objects become an empty map."""
    empty = F.when(F.try_parse_json(raw).isNotNull(), F.from_json(F.lit("{}"), MAP))
    return df.withColumn("fields", once(F.coalesce(F.from_json(raw, MAP), empty)))


def pick_value(field: str, fields: str = "fields") -> Column:
    """First alias that is present and not null."""
    return F.coalesce(*[F.col(fields)[a] for a in fx.ALIASES[field]])


def pick(field: str, fields: str = "fields") -> Column:
    """Like ``pick_value``, trimmed; a blank winner gives null and does not fall through."""
    return blank_to_null(pick_value(field, fields))


def validate(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds status, errors, warnings and stage. Expects ``fields`` of ``with_fields``."""
    text = strip(F.col(raw))
    empty = F.col(raw).isNull() | (F.length(text) == 0) | F.coalesce(
        F.forall(F.map_values("fields"), lambda v: v.isNull()) & text.startswith("{"), F.lit(False)
    )
    payload_error = (
        F.when(empty, F.lit("Empty payload"))
        .when(F.octet_length(text) > fx.MAX_PAYLOAD_BYTES, F.lit("Oversized payload"))
        .when(F.col("fields").isNull(), F.lit("Malformed JSON payload"))
    )
    when, ip = F.col("_when"), F.col("_ip")
    no_type = F.col("_type").isNull()
    errors = F.array(
        F.when(no_type, F.lit("Missing required event_type")),
        F.when(
            when.isNotNull() & event_time(when).isNull(), F.concat(F.lit("Invalid timestamp format: "), when)
        ),
        F.when(no_type, F.lit("Missing critical fields required for SOC processing (event_type)")),
    )
    warnings = F.array(
        F.when(pick("source").isNull(), F.lit("Missing source")),
        F.when(pick("message").isNull(), F.lit("Missing message")),
        F.when(~F.lower(strip(pick_value("severity"))).isin(fx.LOG_SEVERITIES), F.lit("Non-standard severity value")),
        F.when(ip.isNotNull() & ~is_ip(ip), F.lit("Invalid source_ip format")),
    )
    none, bad = F.array().cast("array<string>"), F.col("_payload").isNotNull()
    picked = df.withColumns(
        {
            "_payload": payload_error, "_when": once(pick_value("timestamp")), "_ip": once(pick("source_ip")),
            "_type": pick("event_type"),
        }
    )
    # a step of their own: what stands inside array_compact is not compiled
    tested = picked.withColumns({"_errors": once(F.when(~bad, errors)), "_warnings": once(F.when(~bad, warnings))})
    checked = tested.withColumns(
        {
            "errors": once(F.when(bad, F.array("_payload")).otherwise(F.array_compact("_errors"))),
            "warnings": once(F.when(bad, none).otherwise(F.array_compact("_warnings"))),
            "stage": F.when(bad, F.lit("payload_check")).otherwise("field_check"),
        }
    )
    status = F.when(F.size("errors") > 0, "INVALID").when(F.size("warnings") > 0, "WARNING").otherwise("VALID")
    return checked.withColumn("status", status).drop("_payload", "_when", "_ip", "_type", "_errors", "_warnings")


def route(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passed on, quarantined)."""
    return validated.where("status <> 'INVALID'"), validated.where("status = 'INVALID'")


def resolve_severity(severity: Column, event_type: Column) -> Column:
    given, kind = F.lower(strip(severity)), F.lower(strip(event_type))
    return (
        F.when(given.isin(fx.LOG_SEVERITIES), given)
        .when(kind.isin(fx.HIGH_EVENT_TYPES), "high")
        .when(kind.isin(fx.MEDIUM_EVENT_TYPES), "medium")
        .otherwise("low")
    )


def _event_data() -> Column:
    """Windows event data, nested in metadata or at top level."""
    return F.coalesce(
        F.from_json(F.col("meta")["event_data"], MAP), F.from_json(F.col("fields")["event_data"], MAP)
    )


def enrich_windows(df: DataFrame) -> DataFrame:
    """Fill source_ip and user from event data; put the event id into a generic windows event type."""
    data, top = F.col("_data"), F.col("fields")
    ip = or_else(data["IpAddress"], data["Ipaddress"], data["ipAddress"])
    who = or_else(data["SubjectUserName"], data["Subjectusername"], data["subjectUserName"])
    event_id = or_else(F.col("meta")["event_id"], data["EventID"], data["Eventid"], top["EventID"], top["event_id"])
    generic = F.lower(strip("event_type")).isin("windows_event", "windows_raw", "windows")
    return (
        df.withColumn("_data", once(_event_data()))
        .withColumn("source_ip", F.coalesce("source_ip", strip(ip), strip(top["IpAddress"])))
        .withColumn("user", F.coalesce("user", strip(who), strip(top["SubjectUserName"])))
        .withColumn(
            "event_type",
            F.when(
                generic & event_id.isNotNull(), F.concat(F.lit("windows_event_"), strip(event_id))
            ).otherwise(F.col("event_type")),
        )
        .drop("_data")
    )


def _extras(also_reserved: list[str]) -> Column:
    reserved = [a for group in fx.ALIASES.values() for a in group] + also_reserved
    return F.map_filter("fields", lambda k, v: ~k.isin(reserved) & v.isNotNull())


def fallback_message() -> Column:
    extras = _extras(["metadata", "id", "ingested_at"])
    return F.when(
        F.size(extras) > 0, F.concat(F.lit("Unparsed log event: "), F.to_json(extras))
    ).otherwise("Unparsed log event")


def build_metadata() -> Column:
    """Explicit metadata overlaid by every top-level key that is not a standard field."""
    extras = _extras(["metadata"])
    kept = F.map_filter("meta", lambda k, v: ~F.array_contains(F.map_keys(extras), k))
    return F.map_concat(kept, extras)


def normalize(df: DataFrame, default_time: Column, keep: list[str] | None = None) -> DataFrame:
    """Open ``fields`` to the fixed event schema. Rows without an event type are dropped (validation rejects them)."""
    empty = F.from_json(F.lit("{}"), MAP)
    picked = df.withColumn("meta", once(F.coalesce(F.from_json(F.col("fields")["metadata"], MAP), empty))).select(
        *(keep or []),
        "fields",
        "meta",
        default_time.alias("_default_time"),
        *[pick(f).alias(f) for f in ("source", "host", "event_type", "message", "source_ip", "user")],
        pick_value("severity").alias("_severity"),
        once(pick_value("timestamp")).alias("_time"),
    ).where("event_type is not null")
    rich = enrich_windows(picked)
    meta_number = F.col("meta")["record_number"].try_cast("bigint")
    return rich.select(
        *(keep or []),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        "host",
        F.lower(strip("event_type")).alias("event_type"),
        F.coalesce("message", fallback_message()).alias("message"),
        resolve_severity(F.col("_severity"), F.col("event_type")).alias("severity"),
        F.when(F.col("_time").isNull(), F.col("_default_time")).otherwise(event_time(F.col("_time"))).alias("ts"),
        "source_ip",
        "user",
        build_metadata().alias("metadata"),
        F.coalesce(F.col("fields")["record_number"].try_cast("bigint"), meta_number).alias("record_number"),
    )


def drop_duplicate_events(df: DataFrame, order: list[str]) -> DataFrame:
    """First event per (source, host, event_type, record_number); events without a number are all kept.

    The earliest row is found with a map-side combined minimum, so a record that was delivered millions of times
    does not gather its copies in one task. Missing keys compare equal, and rows without an order come first. The same
    event delivered again is one row.
    """
    numbered = df.where("record_number is not null")
    row = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    first = numbered.groupBy("source", "host", "event_type", "record_number").agg(row).select("_row.*")
    return first.unionByName(df.where("record_number is null"))


def container_event_key(action: Column, event_id: Column, nanos: Column, seconds: Column) -> Column:
    return F.concat_ws("_", action, event_id, F.coalesce(F.when(nanos != 0, nanos), seconds).cast("string"))


def drop_duplicate_container_events(df: DataFrame) -> DataFrame:
    """One event per (action, container_id, time); nanoseconds when known, else seconds."""
    key = container_event_key(F.col("action"), F.col("container_id"), F.col("time_nano"), F.col("time"))
    return df.withColumn("event_key", key).dropDuplicates(["event_key"])


# --------------------------------------------------------------------------- quarantine and unknown logs
def quarantine_hash() -> Column:
    parts = [pick("source"), pick("event_type"), pick("message"), pick_value("timestamp")]
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), 256)


def quarantine(invalid: DataFrame, order: list[str], raw: str = "raw", ranked: bool = False) -> DataFrame:
    """One row per distinct rejected payload: the first rejection, and how often it came.

    ``ranked`` adds ``first_order``, where the first one stands in ``order``: what ``merge_counts`` needs to go on in a later run.
    """
    meta = F.from_json(F.col("fields")["metadata"], MAP)
    first = F.struct(
        pick("source").alias("source"),
        F.col(raw).alias("raw_payload"),
        "errors",
        "warnings",
        "stage",
        F.coalesce(F.get("errors", F.lit(0)), F.lit("Invalid log")).alias("rejection_reason"),
        or_else(pick("source"), meta["collector_name"], meta["collector"]).alias("collector_name"),
    )
    return (
        invalid.withColumn("quarantine_hash", quarantine_hash())
        .groupBy("quarantine_hash")
        .agg(F.min_by(first, F.struct(*order)).alias("f"), F.count("*").alias("quarantined_count"), F.min(F.struct(*order)).alias("first_order"))
        .select("quarantine_hash", "quarantined_count", "f.*", *(["first_order"] if ranked else []))
    )


def unknown_collector(source: Column) -> Column:
    low = F.lower(F.coalesce(source, F.lit("")))
    slug = F.regexp_replace(low, "[- ]", "_")
    named = F.when(low.contains("chrome"), "chrome_browser_collector")
    for word in ("docker", "windows", "syslog", "firewall"):
        suffix = "_event_collector" if word == "windows" else "_collector"
        named = named.when(low.contains(word), word + suffix)
    return (
        named.when(slug == "", "unknown_collector")
        .when(slug.endswith("_collector"), slug)
        .otherwise(F.concat(slug, F.lit("_collector")))
    )


def unknown_hash() -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("source", "message", "event_type")]
    return F.sha2(F.concat(*parts), 256)


def unknown_logs(df: DataFrame, order: list[str], ranked: bool = False) -> DataFrame:
    """One row per distinct unclassified event. Expects classification and parse columns and ``ts``. ``ranked`` as for ``quarantine``."""
    first = F.struct(
        "source",
        unknown_collector(F.col("source")).alias("collector_name"),
        F.coalesce("detected_format", F.lit("text")).alias("detected_format"),
        F.coalesce((F.col("parsing_confidence") * 100).cast("int"), F.lit(100)).alias("parser_confidence"),
        F.col("confidence").alias("detection_confidence"),
        F.col("reason").alias("classification_reason"),
    )
    return (
        df.where("log_type = 'unknown'")
        .withColumn("unknown_hash", unknown_hash())
        .groupBy("unknown_hash")
        .agg(
            F.min_by(first, F.struct(*order)).alias("f"),
            F.count("*").alias("occurrence_count"),
            F.min("ts").alias("first_seen"),
            F.min(F.struct(*order)).alias("first_order"),
        )
        .select("unknown_hash", "occurrence_count", "first_seen", "f.*", *(["first_order"] if ranked else []))
    )


def merge_counts(stored: DataFrame, new: DataFrame, key: str, count: str, order: str) -> DataFrame:
    """Upsert by recomputation: stored and new rows folded to one per key, counts added, earliest row kept."""
    both = stored.unionByName(new)
    rest = [c for c in both.columns if c not in (key, count)]
    return (
        both.groupBy(key)
        .agg(F.sum(count).alias(count), F.min_by(F.struct(*rest), order).alias("f"))
        .select(key, count, "f.*")
    )


class StoredCounts:
    """A quarantine or unknown-log table that runs add to: counts add up, the earliest row stays, a run counts once."""

    def __init__(self, spark: SparkSession, path: str, rows: DataFrame, key: str, count: str, buckets: int = 64):
        self.key, self.count = key, count
        self.table = KeyedTable(spark, path, rows.schema, [key], buckets)

    def add(self, rows: DataFrame, run: str) -> bool:
        """``rows`` of ``quarantine`` or ``unknown_logs`` with ``ranked``. False when the run has been added before."""
        return self.table.upsert(rows, lambda both: merge_counts(both, both.limit(0), self.key, self.count, "first_order"), run)

    def rows(self) -> DataFrame:
        return self.table.read().drop("first_order")
