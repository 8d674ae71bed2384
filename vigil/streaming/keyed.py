"""Detectors and suppression as keyed state that is told in event time.

A row waits in its key's state until the watermark has passed it; then nothing earlier can come, and the key's rows are replayed in the order of
their times, whatever order they came in. So the stream's outcome is that of one batch run over all rows that were not too late.
Rows behind the watermark are not lost: they come out with ``too_late`` set, and the file sink puts them into a table of their own.

State of a key, all bounded by time and none of it by a number of events:

* ``waiting``  a map from time slot and part to the rows that wait (``parts``: how many parts a slot has). Rows come in by parts of ``HELD`` at most,
  and a replay goes slot by slot, so that Python holds the rows of one slot, never all that are due
* ``window``   a map from time slot to the contributions that may still count; slots leave as a whole
* ``timer``    when the key is looked at next. One timer a key: the earliest waiting row, or the end of the last window; then all state goes

A batch reads its own rows and the state of the keys that it touches or whose timer is due, so its cost doesn't grow with the history.
``transformWithState`` keeps state in RocksDB: ``use_rocksdb`` sets the provider.
"""

from __future__ import annotations

import json
from collections import Counter, deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from vigil.functions.exprs import MINUTE, all_of, once
from vigil.operators import correlate
from vigil.operators.kernels import NEVER

MILLI = 1_000
#: Rows of a key that Python holds before it puts them into the state.
HELD = 20_000


def use_rocksdb(spark: SparkSession) -> None:
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)


def with_watermark(rows: DataFrame, late: int) -> DataFrame:
    """Column ``t`` (epoch microseconds) drives the watermark; rows may lie ``late`` microseconds behind the newest.

    The watermark stands on a column that doesn't go on, so that Spark drops nothing itself: what is too late is told by the state.
    Filters behind it stay behind it: all rows move the time on, also those that nobody asks about.
    """
    timed = rows.withColumn("_ts", F.timestamp_micros("t")).withWatermark("_ts", f"{late} microseconds")
    return timed.select(*[once(F.col(c)).alias(c) if c == "t" else F.col(c) for c in rows.columns])


class Replay(StatefulProcessor):
    """Rows (``t``, ``body``: JSON) of a key in the order of their times, each as soon as nothing earlier can come.

    ``slot`` is the length of a slot of ``waiting``. Subclasses say what a row does.
    """

    columns: list[str]

    def __init__(self, slot: int):
        self.slot = max(1, slot)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot bigint, part bigint", "rows string")
        self.parts = handle.getMapState("parts", "slot bigint", "n bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    # what a row does
    def told(self, key: tuple, slots: Iterator[list[tuple[int, dict]]]) -> Iterator[list[tuple]]:
        """Output for rows in order, slot by slot; only called with rows."""
        raise NotImplementedError

    def refused(self, key: tuple, t: int, body: dict) -> tuple:
        """Output for a row that is too late."""
        raise NotImplementedError

    def needed_until(self) -> int:
        """The time up to which the key's state may matter to later rows."""
        raise NotImplementedError

    def forget(self) -> None:
        """Drop the key's state."""
        raise NotImplementedError

    def order(self, t: int, body: dict):
        return t

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * MILLI
        new, n, first = {}, 0, None
        for batch in rows:
            late = []
            for t, body in zip(batch["t"].tolist(), batch["body"].tolist()):
                if t <= limit:
                    late.append(self.refused(key, t, json.loads(body)))
                else:
                    new.setdefault(t // self.slot, []).append(f"[{t},{body}]")
                    first, n = t if first is None else min(first, t), n + 1
            if n >= HELD:
                self._wait(new)
                new, n = {}, 0
            if late:
                yield pd.DataFrame(late, columns=self.columns)
        self._wait(new)
        if first is not None:
            self._wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * MILLI
        self.timer.clear()
        slots = sorted(k for (k,) in self.parts.keys())
        due = [k for k in slots if k * self.slot <= limit]
        later = [slots[len(due)] * self.slot if len(due) < len(slots) else None]  # a slot's begin is early enough to look again
        if due:
            for out in self.told(key, self._due(due, limit, later)):
                if out:
                    yield pd.DataFrame(out, columns=self.columns)
        if later[0] is not None:
            self._wake(max(later[0], limit + 1))
        elif self.needed_until() <= limit:
            self.forget()
        else:
            self._wake(self.needed_until())

    def _due(self, slots: list[int], limit: int, later: list) -> Iterator[list[tuple[int, dict]]]:
        """The rows up to ``limit`` in order, slot by slot. What is left of the last slot waits on; its first time goes to ``later``."""
        for slot in slots:
            rows = self._taken(slot)
            rest = [r for r in rows if r[0] > limit]
            if rest:
                self._wait({slot: [json.dumps(r) for r in rest]})
                later[0] = min(t for t, _ in rest)
                rows = [r for r in rows if r[0] <= limit]
            rows.sort(key=lambda r: self.order(*r))
            if rows:
                yield rows

    def _wait(self, new: dict[int, list[str]]) -> None:
        """Another part for each slot: the parts before it are not read again."""
        for slot, rows in new.items():
            n = self.parts.getValue((slot,))[0] if self.parts.containsKey((slot,)) else 0
            self.waiting.updateValue((slot, n), ("[" + ",".join(rows) + "]",))
            self.parts.updateValue((slot,), (n + 1,))

    def _taken(self, slot: int) -> list:
        """The rows that waited in a slot; they wait no longer."""
        (n,), rows = self.parts.getValue((slot,)), []
        for part in range(n):
            rows += json.loads(self.waiting.getValue((slot, part))[0])
            self.waiting.removeKey((slot, part))
        self.parts.removeKey((slot,))
        return rows

    def close(self) -> None:
        pass

    @staticmethod
    def _get(state, slot: int) -> list:
        return json.loads(state.getValue((slot,))[0]) if state.containsKey((slot,)) else []

    @staticmethod
    def _put(state, slot: int, rows: list) -> None:
        state.updateValue((slot,), (json.dumps(rows),))

    def _wake(self, t: int) -> None:
        """Look at the key as soon as the watermark has reached ``t``."""
        at = -(-t // MILLI)
        if self.timer.exists():
            (old,) = self.timer.get()
            if old <= at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))


# --------------------------------------------------------------------------- trailing windows
_RAW = "detector string, k1 string, k2 string, t bigint, keep string, found string, too_late boolean"


class Windows(Replay):
    """``kernels.trailing_window`` as state: sums, first and last sightings and distinct values over ``[t - width, t]``."""

    columns = ["detector", "k1", "k2", "t", "keep", "found", "too_late"]

    def __init__(self, specs: dict[str, dict], slot: int):
        super().__init__(slot)
        self.specs = specs

    def init(self, handle) -> None:
        super().init(handle)
        self.window = handle.getMapState("window", "slot bigint", "rows string")
        self.last = handle.getValueState("last", "until bigint")

    def refused(self, key, t, body):
        return (*key, t, json.dumps(body["keep"]), None, True)

    def needed_until(self) -> int:
        return self.last.get()[0] if self.last.exists() else NEVER

    def forget(self) -> None:
        self.window.clear()
        self.last.clear()

    def told(self, key, slots):
        spec = self.specs[key[0]]
        width, size = spec["width"], max(1, spec["width"] // 8)
        held = {slot: self._get(self.window, slot) for slot in sorted(k for (k,) in self.window.keys())}
        stored, changed, last = set(held), set(), None
        inside, same = _Inside(spec), {}
        for contribution in sorted((c for slot in held.values() for c in slot), key=lambda c: c[0]):
            inside.add(*contribution)
        for rows in slots:
            out, begin = [], 0
            while begin < len(rows):
                now, end = rows[begin][0], begin
                while end < len(rows) and rows[end][0] == now:  # rows of one time see each other
                    body = rows[end][1]
                    if any(body["s"]) or any(body["p"]) or any(body["d"]):
                        if len(same) > HELD:
                            same.clear()
                        given = (tuple(body["s"]), tuple(body["p"]), tuple(map(tuple, body["d"])))
                        contribution = (now, *same.setdefault(given, given))  # most rows contribute alike: one object for them
                        inside.add(*contribution)
                        held.setdefault(now // size, []).append(contribution)
                        changed.add(now // size)
                    end += 1
                inside.drop_before(now - width)
                found = None
                for _, body in rows[begin:end]:
                    if body["q"]:
                        found = found or json.dumps(inside.found())
                        out.append((*key, now, json.dumps(body["keep"]), found, False))
                begin = end
            last = rows[-1][0]
            for slot in [k for k in held if (k + 1) * size <= last - width]:
                del held[slot]
                changed.discard(slot)
                if slot in stored:
                    self.window.removeKey((slot,))
            yield out
        for slot in changed:
            self._put(self.window, slot, held[slot])
        if last is not None:
            self.last.update((last + width,))


class _Inside:
    """What the window holds, as rows enter and leave it in order."""

    def __init__(self, spec: dict):
        self.spec = spec
        self.rows: deque = deque()
        self.sums = [0] * len(spec["sums"])
        self.spans = [deque() for _ in spec["spans"]]
        self.values = [Counter() for _ in spec["distinct"]]

    def add(self, t, sums, flags, values) -> None:
        self.rows.append((t, sums, flags, values))
        self.sums = [a + b for a, b in zip(self.sums, sums)]
        for times, flag in zip(self.spans, flags):
            if flag:
                times.append(t)
        for count, new in zip(self.values, values):
            count.update(set(new))

    def drop_before(self, t) -> None:
        while self.rows and self.rows[0][0] < t:
            _, sums, flags, values = self.rows.popleft()
            self.sums = [a - b for a, b in zip(self.sums, sums)]
            for times, flag in zip(self.spans, flags):
                if flag:
                    times.popleft()
            for count, old in zip(self.values, values):
                count.subtract(set(old))
                for v in set(old):
                    if not count[v]:
                        del count[v]

    def found(self) -> dict:
        out = dict(zip(self.spec["sums"], self.sums)) | {n: len(c) for n, c in zip(self.spec["distinct"], self.values)}
        for name, times in zip(self.spec["spans"], self.spans):
            out |= {f"{name}_first": times[0] if times else None, f"{name}_last": times[-1] if times else None}
        return out


class _Recorder:
    """Stands for ``trailing_window``: takes down what a detector asks for, or hands it what the state found."""

    def __init__(self, found: DataFrame | None = None):
        self.found = found

    def __call__(self, df, keys, t, width, query, keep=None, sums=None, spans=None, distinct=None, block=None) -> DataFrame:
        keep, sums, spans, distinct = keep or {}, sums or {}, spans or {}, distinct or {}
        kept = df.select(*[c.alias(n) for n, c in keep.items()]).schema
        self.spec = {"width": width, "sums": list(sums), "spans": list(spans), "distinct": list(distinct)}
        numbers = [*sums, *distinct, *[f"{n}_{e}" for n in spans for e in ("first", "last")]]
        if self.found is None:
            body = F.struct(
                F.coalesce(query, F.lit(False)).alias("q"),
                F.struct(*[c.alias(n) for n, c in keep.items()]).alias("keep"),
                F.array(*[F.coalesce(c, F.lit(0)).cast("bigint") for c in sums.values()]).alias("s"),
                F.array(*[F.coalesce(c, F.lit(False)) for c in spans.values()]).alias("p"),
                F.array(*[F.coalesce(F.array_compact(c), F.array().cast("array<string>")) for c in distinct.values()]).alias("d"),
            )
            names = [*[c.alias(f"k{i + 1}") for i, c in enumerate(keys.values())], *[F.lit("").alias(f"k{i}") for i in range(len(keys) + 1, 3)]]
            self.rows = df.select(*names, t.alias("t"), F.to_json(body, {"ignoreNullFields": "false"}).alias("body")).where(
                F.col("t").isNotNull() & all_of([F.col("k1").isNotNull(), F.col("k2").isNotNull()])
            )
            self.found = df.sparkSession.createDataFrame([], _RAW)
        fields = ", ".join(f"`{n}` bigint" for n in numbers)
        return self.found.select(
            *[F.col(f"k{i + 1}").alias(n) for i, n in enumerate(keys)], "t",
            *[F.from_json("keep", kept)[n].alias(n) for n in keep], *[F.from_json("found", fields)[n].alias(n) for n in numbers],
        )


def _recorded(detectors: dict[str, Callable], events: DataFrame) -> dict[str, _Recorder]:
    out = {}
    for name, detector in detectors.items():
        out[name] = _Recorder()
        detector(events, windows=out[name])
    return out


def window_rows(events: DataFrame, detectors: dict[str, Callable], late: int) -> DataFrame:
    """A stream of snapshots to one row per question of a detector (``detector``, keys, ``t``, ``keep`` and ``found`` as JSON), in the order of event
    time, and one row per event that came too late for a detector (``too_late``). ``matches`` judges them.

    ``detectors``: name to a function of (events, windows=…), for instance ``partial(correlate.reconnaissance, width=HOUR)``.
    """
    use_rocksdb(events.sparkSession)
    recorded = _recorded(detectors, with_watermark(events, late))
    rows = None
    for name, seen in recorded.items():
        part = seen.rows.select(F.lit(name).alias("detector"), "k1", "k2", "t", "body")
        rows = part if rows is None else rows.unionByName(part)
    processor = Windows({name: seen.spec for name, seen in recorded.items()}, max(MINUTE, late // 8))
    return rows.groupBy("detector", "k1", "k2").transformWithStateInPandas(processor, _RAW, "append", "eventTime")


def matches(raw: DataFrame, events_schema, detectors: dict[str, Callable]) -> DataFrame:
    """Matches among the rows of ``window_rows``, streaming or stored: what the detectors return in batch."""
    empty, out = raw.sparkSession.createDataFrame([], events_schema), None
    for name, detector in detectors.items():
        found = raw.where((F.col("detector") == name) & ~F.col("too_late"))
        part = detector(empty, windows=_Recorder(found))
        out = part if out is None else out.unionByName(part)
    return out


def late_events(raw: DataFrame) -> DataFrame:
    """Events that no detector could count any more: ``event_id``, ``t`` and the detector."""
    return raw.where("too_late").select(F.get_json_object("keep", "$.event_id").cast("bigint").alias("event_id"), "t", "detector")


# --------------------------------------------------------------------------- suppression
class Suppression(Replay):
    """``kernels.suppress`` as state: a row fires when its key is armed and silences it up to its deadline; a control re-arms the key."""

    columns = ["key", "id", "t", "anchor", "fires", "too_late"]

    def init(self, handle) -> None:
        super().init(handle)
        self.entry = handle.getValueState("entry", "deadline bigint, anchor bigint")

    def order(self, t, body):
        return t, body["ctl"], body["id"]

    def refused(self, key, t, body):
        return (key[0], body["id"], t, None, False, True)

    def needed_until(self) -> int:
        return self.entry.get()[0] if self.entry.exists() else NEVER

    def forget(self) -> None:
        self.entry.clear()

    def told(self, key, slots):
        deadline, anchor = self.entry.get() if self.entry.exists() else (NEVER, -1)
        for rows in slots:
            out = []
            for t, body in rows:
                if body["ctl"]:
                    deadline = NEVER
                    continue
                fires = t > deadline
                if fires:
                    deadline, anchor = body["d"], body["id"]
                out.append((key[0], body["id"], t, anchor, fires, False))
            yield out
        self.entry.update((deadline, anchor))


_KEPT = "key string, id bigint, t bigint, anchor bigint, fires boolean, too_late boolean"


def suppress_rows(rows: DataFrame, late: int, control: DataFrame | None = None) -> DataFrame:
    """A stream of rows (``key``, ``id``, ``t``, deadline ``d``) to key, id, t, ``anchor``, ``fires`` and ``too_late``; ``control`` (``key``, ``t``)
    is a stream that re-arms keys. A control without a key only moves the time on."""
    use_rocksdb(rows.sparkSession)
    own = rows.select("key", "t", F.to_json(F.struct(F.col("id").cast("bigint").alias("id"), F.col("d").cast("bigint").alias("d"), F.lit(0).alias("ctl"))).alias("body"))
    if control is not None:
        mark = F.to_json(F.struct(F.lit(-1).alias("id"), F.lit(0).alias("d"), F.lit(1).alias("ctl")))
        own = own.unionByName(control.select("key", "t", mark.alias("body")))
    timed = with_watermark(own, late).where("key is not null")
    return timed.groupBy("key").transformWithStateInPandas(Suppression(max(MINUTE, late // 8)), _KEPT, "append", "eventTime").where("id >= 0")


# --------------------------------------------------------------------------- queries over folders
def _sink(df: DataFrame, folder: str, **trigger):
    """Exactly once, too-late rows in a part of the table of their own."""
    return (
        df.writeStream.format("parquet").partitionBy("too_late").option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    )


def detect_stream(events: DataFrame, folder: str, detectors: dict[str, Callable], late: int, **trigger):
    """Start the detectors on a stream of snapshots. ``{folder}/rows`` is read with ``stored_matches`` and ``stored_late``."""
    return _sink(window_rows(events, detectors, late), folder, **trigger)


def _rows(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(_RAW).parquet(f"{folder}/rows")


def stored_matches(spark: SparkSession, folder: str, events_schema, detectors: dict[str, Callable], stream: bool = False) -> DataFrame:
    return matches(_rows(spark, folder, stream), events_schema, detectors)


def stored_late(spark: SparkSession, folder: str) -> DataFrame:
    return late_events(_rows(spark, folder))


def stored_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What ``suppress_matches_stream`` wrote; without a match it wrote no file, so the schema is given."""
    return spark.read.schema(_KEPT).parquet(f"{folder}/rows")


def suppress_matches_stream(
    found: DataFrame, folder: str, late: int, windows: dict[str, int] | None = None, control: DataFrame | None = None, **trigger
):
    """Start the suppression of repeats on a stream of matches; ``{folder}/rows`` has every match and whether it ``fires``, and is read with ``stored_kept``."""
    until = F.col("first_seen") + correlate.suppression_window(windows, F.col("correlation_type"))
    rows = found.select(correlate.correlation_key().alias("key"), F.col("event_id").alias("id"), "t", until.alias("d"))
    return _sink(suppress_rows(rows, late, control), folder, **trigger)
