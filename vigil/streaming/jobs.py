"""Structured Streaming jobs: native windows and duplicate removal, and detectors over a look-back table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigil.functions.exprs import DAY, HOUR, MINUTE
from vigil.operators import correlate
from vigil.operators.kernels import suppress
from vigil.streaming.storage import read_batch, read_batches, write_batch


def connection_windows_stream(conns: DataFrame, width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Tumbling connection windows (column ``ts`` timestamp). Exact distinct counts from a chain of plain counts:
    one state row per pair, then per address, then per port, instead of a growing set per port."""
    pairs = conns.withWatermark("ts", late).groupBy(F.window("ts", width), "port", "remote_ip", "remote_port").agg(
        F.count("*").alias("n")
    )
    ips = pairs.groupBy("window", "port", "remote_ip").agg(F.sum("n").alias("n"), F.count("*").alias("pairs"))
    ports = ips.groupBy("window", "port").agg(
        F.sum("n").alias("event_count"), F.sum("pairs").alias("unique_pairs"), F.count("*").alias("unique_ips")
    )
    return ports.select(
        F.col("window.start").alias("win"), "port", "event_count", "unique_pairs", "unique_ips",
        F.greatest("event_count", "unique_pairs").alias("connection_count"),
    )


def drop_duplicate_events_stream(events: DataFrame, late: str = "24 hours") -> DataFrame:
    """First event per (source, host, event_type, record_number) within the watermark; unnumbered events pass."""
    numbered = events.where("record_number is not null").withWatermark("ts", late)
    first = numbered.dropDuplicatesWithinWatermark(["source", "host", "event_type", "record_number"])
    return first.unionByName(events.where("record_number is null"))


def suppress_stream(matches: DataFrame, ttl_ms: int = DAY // 1000) -> DataFrame:
    """Suppression as keyed state: matches (key, id, t, d, ts) in, the ones that fire out. Idle keys are forgotten."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (armed,) = state.get if state.exists else (-(1 << 62),)
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        fired = []
        for i, t, d in zip(rows["id"], rows["t"], rows["d"]):
            if t > armed:
                armed = int(d)
                fired.append((key[0], int(i), int(t)))
        state.update((armed,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + ttl_ms)
        yield pd.DataFrame(fired, columns=["key", "id", "t"])

    return (
        matches.withWatermark("ts", "10 minutes")
        .groupBy("key")
        .applyInPandasWithState(
            step, "key string, id bigint, t bigint", "armed bigint", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def correlate_batch(
    spark: SparkSession, batch: DataFrame, batch_id: int, folder: str, detectors: dict[str, Callable], widths: dict[str, int],
    look_back: int = HOUR, late: int | None = None,
) -> None:
    """One micro-batch: append the events, run the batch detectors from the look-back on, emit what its events change.

    ``look_back`` is raised to the longest window. Events may be older than those of earlier batches: everything from the oldest new
    event on is judged again, so after each batch the outcome is that of one run over all events so far. ``matches`` has the new matches and
    those that an older event changed (the later batch holds), ``fired`` those that fire now, ``withdrawn`` those that no longer do.
    Three tables continue the work: the time span of each batch, and ``found`` and ``active``, all matches and those that fire from
    the batch's oldest event on, which hold up to the oldest event of any later batch. ``late`` is how far events may lie behind
    the newest; what only older ones would need is forgotten. Without it nothing is, and there is one span per batch.
    Every write is a folder of this batch, so running a batch again gives the same result.
    """
    span_schema, active_schema = "batch bigint, first bigint, last bigint", "key string, id bigint, t bigint, d bigint, batch bigint"
    look_back = max(look_back, 5 * MINUTE, *widths.values())
    write_batch(batch, f"{folder}/events", batch_id)
    new = read_batch(spark, f"{folder}/events", batch.schema, batch_id)
    spans = read_batch(spark, f"{folder}/spans", span_schema, batch_id - 1)
    start, end = new.agg(F.min("t"), F.max("t")).first()
    if start is None:
        write_batch(spans, f"{folder}/spans", batch_id)
        return
    old = sorted(spans.collect())
    until = _held_until(old)

    def held(name: str, schema) -> DataFrame:
        """Rows of the table that no later batch replaced, as far back as the look-back."""
        limits = [(b, u) for b, u in until.items() if u > start - look_back]
        if not limits:
            return spark.createDataFrame([], schema)
        rows = read_batches(spark, f"{folder}/{name}", schema, [b for b, _ in limits])
        limit = F.broadcast(spark.createDataFrame(limits, "batch bigint, until bigint"))
        return rows.join(limit, "batch").where((F.col("t") < F.col("until")) & (F.col("t") >= start - look_back)).select(*rows.columns)

    batches = [r.batch for r in old if r.last >= start - look_back] + [batch_id]
    known = read_batches(spark, f"{folder}/events", batch.schema, batches).where(F.col("t") >= start - look_back)
    found = None
    for name, detector in detectors.items():
        part = detector(known, width=widths[name])
        found = part if found is None else found.unionByName(part)
    own = F.lit(batch_id).cast("bigint")
    found = found.where(F.col("t") >= start).withColumns({"key": correlate.correlation_key(), "batch": own})
    write_batch(found, f"{folder}/found", batch_id)
    stored = read_batch(spark, f"{folder}/found", found.schema, batch_id)
    earlier = held("found", found.schema).where(F.col("t") >= start)
    write_batch(stored.drop("batch").exceptAll(earlier.drop("batch")), f"{folder}/matches", batch_id)

    window = correlate.suppression_window(widths, F.col("correlation_type"))
    now = stored.select("key", F.col("event_id").cast("bigint").alias("id"), "t", (F.col("first_seen") + window).alias("d"))
    fires = held("active", active_schema).drop("batch")
    last = F.max_by(F.struct("id", "t", "d"), F.struct("t", "id")).alias("x")
    before = fires.where(F.col("t") < start).groupBy("key").agg(last).select("key", "x.*")
    reach = correlate.suppression_window(widths, F.substring_index("key", ":", 1))
    runs = suppress(before.unionByName(now), F.col("key"), F.col("id"), F.col("t"), F.col("d"), reach=reach)
    active = runs.where("fires").select("key", "id").join(now, ["key", "id"]).dropDuplicates(["key", "id"])
    write_batch(active.select("key", "id", "t", "d", own.alias("batch")), f"{folder}/active", batch_id)
    after = read_batch(spark, f"{folder}/active", active_schema, batch_id).drop("batch")
    fires = fires.where(F.col("t") >= start)
    write_batch(after.join(fires, ["key", "id"], "left_anti"), f"{folder}/fired", batch_id)
    write_batch(fires.join(after, ["key", "id"], "left_anti"), f"{folder}/withdrawn", batch_id)

    spans = [*map(tuple, old), (batch_id, start, end)]
    if late is not None:
        cut, until = max(r[2] for r in spans) - late - look_back, _held_until(spans)
        spans = [r for r in spans if r[2] >= cut or until[r[0]] > cut]
    write_batch(spark.createDataFrame(spans, span_schema), f"{folder}/spans", batch_id)


def _held_until(spans: list) -> dict[int, int]:
    """For each batch the oldest event of any later one: from there on its tables are replaced. ``spans`` are in order."""
    out, oldest = {}, 1 << 62
    for b, first, _ in reversed(spans):
        out[b] = oldest
        oldest = min(oldest, first)
    return out


def correlate_stream(
    spark: SparkSession, events: DataFrame, folder: str, detectors: dict[str, Callable], widths: dict[str, int],
    look_back: int = HOUR, late: int | None = None, **trigger,
):
    """Start the look-back job on a stream of snapshots; ``{folder}/fired``, ``withdrawn`` and ``matches`` are its output."""
    return (
        events.writeStream.foreachBatch(
            lambda batch, i: correlate_batch(spark, batch, i, folder, detectors, widths, look_back, late)
        )
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
