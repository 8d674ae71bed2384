"""Port traffic: connection windows, anomalies, interval records, reports, address classes.

Connections have t (epoch microseconds), port, remote_ip, remote_port, state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions import fixed_values as fx
from vigil.functions.exprs import MINUTE, in_blocks, ipv4_to_long, is_private_v4, map_literal
from vigil.operators.kernels import suppress

SECOND = 1_000_000


def connections(df: DataFrame, ports: list[int] | None = None) -> DataFrame:
    return df.where(F.col("port").isin(ports or fx.DEFAULT_PORTS))


def window_start(width: int) -> Column:
    return (F.floor(F.col("t") / width) * width).cast("bigint")


def connection_windows(conns: DataFrame, width: int = 60 * SECOND) -> DataFrame:
    """Per window and port: events, distinct (address, port) pairs, distinct addresses, and the traffic metric.

    Distinct counts are plain counts over groups that were made distinct step by step, so a busy port is reduced by many tasks
    before its rows meet.
    """
    pairs = conns.groupBy(window_start(width).alias("win"), "port", "remote_ip", "remote_port").agg(
        F.count("*").alias("n")
    )
    ips = pairs.groupBy("win", "port", "remote_ip").agg(F.sum("n").alias("n"), F.count("*").alias("pairs"))
    return ips.groupBy("win", "port").agg(
        F.sum("n").alias("event_count"), F.sum("pairs").alias("unique_pairs"), F.count("*").alias("unique_ips")
    ).withColumn("connection_count", F.greatest("event_count", "unique_pairs"))


def top_source_ips(conns: DataFrame, width: int = 60 * SECOND, top: int = 10) -> DataFrame:
    """The busiest addresses per window and port, ties by address.

    Addresses are ranked inside hash slices first and only the slices' winners meet, so a port with millions of addresses
    is not sorted in one task.
    """
    ips = conns.groupBy(window_start(width).alias("win"), "port", "remote_ip").agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.asc("remote_ip")]
    part = Window.partitionBy("win", "port", F.pmod(F.xxhash64("remote_ip"), F.lit(64))).orderBy(*order)
    whole = Window.partitionBy("win", "port").orderBy(*order)
    best = ips.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    return best.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)


def state_counts(conns: DataFrame, width: int = 60 * SECOND) -> DataFrame:
    return conns.groupBy(window_start(width).alias("win"), "port", "state").agg(F.count("*").alias("n"))


def port_anomalies(conns: DataFrame, threshold: int = 500, width: int = 60 * SECOND) -> DataFrame:
    """Windows strictly above the threshold, with their top address and state counts, as raw events."""
    hot = connection_windows(conns, width).where(F.col("connection_count") > threshold)
    tops = top_source_ips(conns, width)
    best = tops.groupBy("win", "port").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("remote_ip", "n")))).alias("top_source_ips"),
        F.min_by("remote_ip", "rank").alias("source_ip"),
    )
    states = state_counts(conns, width).groupBy("win", "port").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("connection_states")
    )
    message = F.concat(
        F.lit("Abnormal traffic volume detected: "), F.col("connection_count").cast("string"),
        F.lit(" connection attempts on port "), F.col("port").cast("string"),
        F.lit(f" in {width // SECOND}s (threshold: {threshold})"),
    )
    return hot.join(best, ["win", "port"]).join(states, ["win", "port"]).select(
        (F.col("win") + width).alias("t"), F.lit("os_network").alias("source"),
        F.lit("unauthorized_port_traffic").alias("event_type"), F.lit("high").alias("severity"), message.alias("message"),
        "source_ip", "port", "connection_count", "unique_ips", "top_source_ips", "connection_states",
    )


def port_cooldown(anomalies: DataFrame, cooldown: int = 300 * SECOND) -> DataFrame:
    """After an emitted anomaly its port stays silent until ``t + cooldown``. One row per port and window goes in."""
    runs = suppress(
        anomalies, F.col("port").cast("string"), F.col("t"), F.col("t"), F.col("t") + (cooldown - 1), reach=cooldown
    )
    kept = runs.where("fires").select(F.col("key").cast("int").alias("port"), "t")
    return anomalies.join(kept, ["port", "t"], "left_semi")


def new_connections(snapshots: DataFrame) -> DataFrame:
    """Connections of a snapshot that the previous snapshot did not have. Snapshots are numbered without gaps."""
    key = ["remote_ip", "remote_port", "local_port"]
    before = snapshots.select((F.col("snapshot_id") + 1).alias("snapshot_id"), *key)
    return snapshots.join(before, ["snapshot_id", *key], "left_anti")


def traffic_history(conns: DataFrame, width: int = 60 * SECOND) -> DataFrame:
    """Interval records: one per port, address and window."""
    return conns.groupBy(
        F.col("port").alias("monitored_port"), F.col("remote_ip").alias("source_ip"), window_start(width).alias("first_seen")
    ).agg(F.count("*").alias("activity_count")).withColumns(
        {
            "last_seen": F.col("first_seen") + width,
            "observed_duration_seconds": F.lit(width / SECOND),
        }
    )


# --------------------------------------------------------------------------- reports over interval records
def records_in_window(records: DataFrame, port: int, start: int, end: int) -> DataFrame:
    """Records of the port whose monitoring window touches [start, end], both ends included."""
    return records.where(
        (F.col("monitored_port") == port) & (F.col("window_end") >= start) & (F.col("window_start") <= end)
    )


def _span(first: str, last: str) -> Column:
    return F.greatest(F.lit(0.0), (F.col(last) - F.col(first)) / SECOND)


def ip_breakdown(records: DataFrame, *by: str) -> DataFrame:
    return records.groupBy(*by, "source_ip").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("activity_count").alias("activity_count"),
    ).withColumn("observed_duration_seconds", _span("first_seen", "last_seen"))


def ranked_breakdown(records: DataFrame) -> DataFrame:
    return ip_breakdown(records).orderBy(F.desc("activity_count"), "source_ip")


def suspicious_ips(alerts: DataFrame, logs: DataFrame) -> DataFrame:
    """Addresses seen in an alert or in a suspicious log."""
    both = alerts.select("source_ip").unionByName(logs.where("is_suspicious").select("source_ip"))
    return both.where("source_ip is not null").distinct()


def classify_ips(df: DataFrame, suspicious: DataFrame) -> DataFrame:
    """Adds classification and evidence to rows with ``source_ip``."""
    flagged = df.join(suspicious.select("source_ip", F.lit(True).alias("_sus")), "source_ip", "left")
    number, ip = ipv4_to_long(F.col("source_ip")), F.col("source_ip")
    subnet = F.lit("Private IP Range")
    for block in ("192.168.0.0/16", "172.16.0.0/12", "10.0.0.0/8"):
        subnet = F.when(in_blocks(number, [block]), block).otherwise(subnet)
    cases = [
        (ip.isin(fx.BLACKLISTED_IPS), "BLACKLISTED", F.lit("Matched in DetectionService threat blacklist rules")),
        (F.col("_sus"), "SUSPICIOUS", F.lit("Searchable source IP matched existing alert/correlation record")),
        (
            in_blocks(number, ["127.0.0.0/8"]) | F.coalesce(F.lower(ip).isin("::1", "0:0:0:0:0:0:0:1"), F.lit(False)),
            "INTERNAL / LOOPBACK",
            F.lit("Loopback Address (127.0.0.0/8)"),
        ),
        (is_private_v4(number), "INTERNAL", F.concat(F.lit("RFC 1918 Private IP Range ("), subnet, F.lit(")"))),
    ]
    kind, why = F, F
    for condition, label, evidence in cases:
        kind, why = kind.when(condition, label), why.when(condition, evidence)
    return flagged.withColumns(
        {
            "classification": kind.otherwise("UNKNOWN / OBSERVED"),
            "evidence": why.otherwise("Observed port activity; no matching blacklist or alert evidence"),
        }
    ).drop("_sus")


def _turns(records: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """What changes per address at the start of a bucket (``_b``, counted from ``start``): activity and records that begin there less those
    that ended before it, the first sighting of those that ended, the last of those that begin.

    A record is two rows however many buckets it overlaps, and an address has at most one row per bucket, whatever its share of all records.
    Records without a first or last sighting overlap nothing; a missing activity counts 0; records without an address are one address.
    """
    buckets = max(0, -(-(end - start) // step))
    low = F.greatest(F.floor((F.col("first_seen") - start) / step), F.lit(0))
    high = F.least(F.floor((F.col("last_seen") - start) / step), F.lit(buckets - 1))
    hit = records.where(F.col("first_seen").isNotNull() & (F.col("last_seen") >= start) & (low <= high))
    count, none = F.coalesce("activity_count", F.lit(0)).cast("bigint"), F.lit(None).cast("bigint")
    marks = F.array(
        F.struct(low.alias("_b"), count.alias("_x"), F.lit(1).alias("_k"), none.alias("_first"), F.col("last_seen").alias("_last")),
        F.struct((high + 1).alias("_b"), (-count).alias("_x"), F.lit(-1).alias("_k"), F.col("first_seen").alias("_first"), none.alias("_last")),
    )
    return hit.select("source_ip", F.inline(marks)).groupBy("source_ip", "_b").agg(
        F.sum("_x").alias("_x"), F.sum("_k").alias("_k"), F.min("_first").alias("_first"), F.max("_last").alias("_last"),
    )


def _running(order: Window) -> dict[str, Column]:
    """What holds from a turn to the next one. Records that lie wholly behind a bucket have later first sightings than those that overlap it, and
    records wholly before it earlier last ones, so extremes over all that end later or began before are those of the overlapping records."""
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = order.rowsBetween(1, Window.unboundedFollowing)
    return {
        "activity_count": F.sum("_x").over(so_far),
        "_open": F.sum("_k").over(so_far),
        "first_seen": F.min("_first").over(behind),
        "last_seen": F.max("_last").over(so_far),
    }


def timeline_ips(records: DataFrame, start: int, end: int, step: int = 5 * MINUTE) -> DataFrame:
    """Activity per bucket and address. A record counts whole in every bucket of [start, end) it overlaps.

    Running sums per address over the buckets in which something changes; only the result lists every bucket.
    """
    order = Window.partitionBy("source_ip").orderBy("_b")
    held = _turns(records, start, end, step).withColumns({**_running(order), "_next": F.lead("_b").over(order)}).where("_open > 0")
    return held.withColumn("_b", F.explode(F.sequence(F.col("_b"), F.col("_next") - 1))).select(
        (F.lit(start) + F.col("_b") * step).cast("bigint").alias("bucket"), "source_ip", "activity_count", "first_seen", "last_seen",
    )


def timeline(records: DataFrame, start: int, end: int, step: int = 5 * MINUTE) -> DataFrame:
    """All buckets, empty ones included.

    Records that overlap many buckets aren't listed in each: their beginnings and ends are summed per address and bucket, an address counts
    where its open records rise from none or fall to none, and running sums over the buckets give the rest. Only the last step, one row per
    bucket of the report, is a single sorted pass.
    """
    turns = _turns(records, start, end, step)
    order = Window.partitionBy("source_ip").orderBy("_b")
    open_ = F.sum("_k").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = (open_ > 0).cast("int") - (open_ - F.col("_k") > 0).cast("int")
    changes = turns.withColumn("_ips", seen).groupBy("_b").agg(
        F.sum("_x").alias("_x"), F.sum("_k").alias("_k"), F.sum("_ips").alias("_ips"), F.min("_first").alias("_first"), F.max("_last").alias("_last"),
    )
    buckets = max(0, -(-(end - start) // step))
    # one more than the report has: there the records end that last until its end
    grid = records.sparkSession.range(buckets + 1).select(F.col("id").alias("_b"))
    whole = Window.orderBy("_b")
    so_far = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = grid.join(changes, "_b", "left").withColumns({**_running(whole), "active_ips": F.sum("_ips").over(so_far)})
    busy = F.coalesce(F.col("_open") > 0, F.lit(False))
    return held.where(F.col("_b") < buckets).select(
        (F.lit(start) + F.col("_b") * step).cast("bigint").alias("bucket"),
        F.coalesce("activity_count", F.lit(0)).alias("connection_count"),
        F.coalesce("active_ips", F.lit(0)).alias("active_ips"),
        F.when(busy, _span("first_seen", "last_seen")).otherwise(0.0).alias("observed_duration_seconds"),
    )


def service_name(port: Column) -> Column:
    named = F.try_element_at(map_literal(fx.SERVICE_NAMES), port.cast("int"))
    return F.coalesce(named, F.concat(F.lit("Port "), port.cast("string"), F.lit(" Service")))


def report_summary(records: DataFrame, port: int, start: int, end: int) -> DataFrame:
    per_ip = ip_breakdown(records_in_window(records, port, start, end))
    return per_ip.agg(
        F.coalesce(F.sum("activity_count"), F.lit(0)).alias("total_activity_count"),
        F.count("*").alias("unique_source_ips"),
        F.coalesce(F.max("observed_duration_seconds"), F.lit(0.0)).alias("total_observed_duration_seconds"),
    ).select(
        F.lit(port).alias("port"), service_name(F.lit(port)).alias("service_name"),
        F.lit(max(0, end - start) / SECOND).alias("duration_seconds"), "*",
    )


def monitored_ports(records: DataFrame) -> DataFrame:
    recorded = records.select(F.col("monitored_port").cast("int").alias("port"))
    defaults = records.sparkSession.createDataFrame([(p,) for p in fx.DEFAULT_PORTS], "port int")
    return recorded.unionByName(defaults).distinct().orderBy("port")


def port_status(sockets: DataFrame, records: DataFrame, as_of: int, hours: float = 6.0) -> DataFrame:
    """Socket state (local_port, status) joined with the activity of the last hours, one row per monitored port."""
    since = as_of - int(hours * 60 * MINUTE)
    now = sockets.groupBy(F.col("local_port").alias("port")).agg(
        F.bool_or(F.col("status") == "LISTEN").alias("listening"),
        F.count_if(F.col("status").isin("ESTABLISHED", "SYN_RECV", "SYN_SENT")).alias("active"),
    )
    past = records.where((F.col("window_end") >= since) & (F.col("window_start") <= as_of))
    activity = ip_breakdown(past, "monitored_port").groupBy(F.col("monitored_port").cast("int").alias("port")).agg(
        F.sum("activity_count").alias("total_activity_count"),
        F.count("*").alias("unique_source_ips"),
        F.min("first_seen").alias("first_activity"),
        F.max("last_seen").alias("last_activity"),
    )
    joined = monitored_ports(records).join(now, "port", "left").join(activity, "port", "left")
    active, listening = F.coalesce("active", F.lit(0)), F.coalesce("listening", F.lit(False))
    status = F.when(active > 0, "OPEN_AND_ACTIVE").when(listening, "OPEN_IDLE").otherwise("CLOSED")
    return joined.select(
        "port", service_name(F.col("port")).alias("service_name"), status.alias("current_status"),
        active.alias("current_active_connections"),
        F.coalesce("total_activity_count", F.lit(0)).alias("total_activity_count"),
        F.coalesce("unique_source_ips", F.lit(0)).alias("unique_source_ips"),
        "first_activity", "last_activity",
        F.coalesce(_span("first_activity", "last_activity"), F.lit(0.0)).alias("observed_duration_seconds"),
    )


def search_ports(status: DataFrame, text: str = "", state: str = "ALL") -> DataFrame:
    hit = F.lower("service_name").contains(text.lower()) | F.col("port").cast("string").contains(text)
    found = status.where(hit)
    if state == "ONLINE":
        return found.where(F.col("current_status").isin("OPEN_AND_ACTIVE", "OPEN_IDLE"))
    if state == "OFFLINE":
        return found.where(F.col("current_status") == "CLOSED")
    return found
