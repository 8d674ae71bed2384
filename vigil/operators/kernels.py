"""Time kernels.

All four kernels split a key's history into time blocks, so that one busy key
is spread over many tasks, and none of them gathers a whole key in one place.
Times are epoch microseconds (bigint).

* ``trailing_window``  aggregates over ``[t - w, t]`` evaluated at each event
* ``suppress``         fire, stay silent until a deadline, re-arm
* ``numbered``         dense numbering of rows within a group
* ``fold_states``      replay of a state machine over a change log
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.exprs import any_of
from vigil.streaming.storage import written

NEVER = -(1 << 62)


# --------------------------------------------------------------------------- trailing window
def trailing_window(
    df: DataFrame,
    keys: dict[str, Column],
    t: Column,
    width: int,
    query: Column,
    keep: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    spans: dict[str, Column] | None = None,
    distinct: dict[str, Column] | None = None,
    block: int | None = None,
) -> DataFrame:
    """Aggregate over the inclusive trailing window ``[t - width, t]`` per key.

    ``query``     rows that want an answer (the others only contribute)
    ``keep``      columns carried along on query rows
    ``sums``      name -> number contributed by each row
    ``spans``     name -> flag; adds ``<name>_first`` / ``<name>_last``: the time of the earliest
                  and latest flagged row inside the window (meaningful when one exists)
    ``distinct``  name -> array of strings; counts distinct values in the window

    A moving frame re-reads the whole window for every row. Here every contribution becomes a
    ``+x`` row at ``t`` and a ``-x`` row at ``t + width``, so ordinary running sums give the
    answer in one sorted pass, however dense the window is. Rows whose effect outlives their time block
    are repeated in the next block, so (key, block) is the unit of work, not the key. A block with more than its share
    of all rows is cut into sub-blocks of about that share, and the running sums go on from the totals before them
    (``_sub_blocks``): a key with half of all rows inside one window is spread over all tasks.
    """
    keep, sums, spans, distinct = keep or {}, sums or {}, spans or {}, distinct or {}
    block = block or 4 * width
    if block < width:
        raise ValueError("block must be at least as long as the window")
    key_names = list(keys)

    base = df.select(
        *[c.alias(n) for n, c in keys.items()],
        t.alias("_t"),
        F.coalesce(query, F.lit(False)).alias("_q"),
        F.struct(*([c.alias(n) for n, c in keep.items()] or [F.lit(0).alias("_")])).alias("_keep"),
        *[F.coalesce(c, F.lit(0)).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.coalesce(c, F.lit(False)).alias(f"_p_{n}") for n, c in spans.items()],
        *[c.alias(f"_d_{n}") for n, c in distinct.items()],
    ).where(F.col("_t").isNotNull() & ~any_of(F.col(k).isNull() for k in key_names))

    counts = any_of([F.col(f"_s_{n}") != 0 for n in sums] + [F.col(f"_p_{n}") for n in spans])
    own = F.floor(F.col("_t") / block)
    leaves = F.floor((F.col("_t") + width) / block) > own

    def mark(blk, at, kind, sign, q):
        return F.struct(
            blk.alias("_blk"), at.alias("_at"), F.lit(kind).alias("_kind"), F.lit(sign).alias("_sign"), q.alias("_ask")
        )

    start, end, no = F.col("_t"), F.col("_t") + width, F.lit(False)
    marks = F.array_compact(
        F.array(
            F.when(counts | F.col("_q"), mark(own, start, 0, 1, F.col("_q"))),
            F.when(counts, mark(own, end, 1, -1, no)),
            F.when(counts & leaves, mark(own + 1, start, 0, 1, no)),
            F.when(counts & leaves, mark(own + 1, end, 1, -1, no)),
        )
    )
    moved = base.select("*", F.explode(marks).alias("_m")).select(
        *key_names,
        "_m.*",
        F.when(F.col("_m._ask"), F.col("_keep")).alias("_keep"),
        *[(F.col(f"_s_{n}") * F.col("_m._sign")).alias(f"_s_{n}") for n in sums],
        *[F.when(F.col(f"_p_{n}") & (F.col("_m._kind") == 0), F.col("_t")).alias(f"_l_{n}") for n in spans],
        *[F.when(F.col(f"_p_{n}") & (F.col("_m._kind") == 1), F.col("_t")).alias(f"_f_{n}") for n in spans],
        *[F.lit(0).alias(f"_d_{n}") for n in distinct],
    )
    for name in distinct:
        moved = moved.unionByName(_presence(base, key_names, name, width, own, leaves), allowMissingColumns=True)

    by = [*key_names, "_blk"]
    placed = _sub_blocks(base, moved, by, own, leaves, width, block, list(sums), list(distinct), list(spans))
    up = Window.partitionBy(*by, "_sub").orderBy("_at", "_kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = (
        Window.partitionBy(*by, "_sub")
        .orderBy(F.desc("_at"), F.desc("_kind"))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def before(name):
        return F.coalesce(F.col(f"_off.{name}"), F.lit(0))

    out = placed.select(
        *key_names,
        "_at",
        "_ask",
        "_keep",
        *[(F.sum(f"_s_{n}").over(up) + before(f"_s_{n}")).alias(n) for n in sums],
        *[(F.sum(f"_d_{n}").over(up) + before(f"_d_{n}")).alias(n) for n in distinct],
        *[F.greatest(F.max(f"_l_{n}").over(up), F.col(f"_off._l_{n}")).alias(f"{n}_last") for n in spans],
        # the next row to leave the window is the oldest one still inside it
        *[F.least(F.min(f"_f_{n}").over(down), F.col(f"_off._f_{n}")).alias(f"{n}_first") for n in spans],
    ).where("_ask")
    aggregates = [*sums, *distinct, *[f"{n}_{e}" for n in spans for e in ("first", "last")]]
    return out.select(*key_names, F.col("_at").alias("t"), *[F.col(f"_keep.{n}").alias(n) for n in keep], *aggregates)


#: A block is looked at in so many cells where it is cut.
CELLS = 1024
#: Rows of a partition of the window pass on average at most: more rows make more partitions, not larger ones.
SHARE = 100_000


def _sub_blocks(base, moved, by, own, leaves, width, block, sums, distinct, spans) -> DataFrame:
    """``moved`` with the sub-block (``_sub``) of each row and what its running sums start from (``_off``, null: nothing).

    1. Blocks with more rows than a partition's share. There can't be more of them than partitions. The counts are written: how many rows there are
       says into how many partitions they go.
    2. Of these blocks, rows and totals per cell: an aggregate that is combined before the shuffle.
    3. Cells in order are put together to sub-blocks of a share each; prefix sums over the cells give where each one starts from.
    4. The cuts of all blocks, two for each partition at most, go to every task. Rows are shuffled once, by (key, block, sub-block), into the
       session's shuffle partitions or as many as it takes for ``SHARE`` rows each.

    Cuts follow from the rows alone, so every task and every repeated task makes the same. Without a crowded block the second pass has
    nothing to read. Rows of one cell stay together: the window needs rows of one time in one place.
    """
    keys = by[:-1]
    n = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = base.select(*keys, F.explode(F.array_compact(F.array(own, F.when(leaves, own + 1)))).alias("_blk")).groupBy(*by).agg(F.count("*").alias("_n"))
    counts = written(counts, "counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    parts = max(n, -(-total // SHARE))
    target = F.lit(max(total / parts, 1.0))
    crowded = counts.where(F.col("_n") > target)

    place = (F.col("_at") - F.col("_blk") * block + width) * F.lit(CELLS) / (block + 2 * width)
    moved = moved.withColumn("_cell", F.floor(place).cast("int"))
    cells = moved.join(F.broadcast(crowded.select(*by)), by).groupBy(*by, "_cell").agg(
        F.count("*").alias("_n"),
        *[F.sum(f"_s_{x}").alias(f"_s_{x}") for x in sums],
        *[F.sum(f"_d_{x}").alias(f"_d_{x}") for x in distinct],
        *[F.max(f"_l_{x}").alias(f"_l_{x}") for x in spans],
        *[F.min(f"_f_{x}").alias(f"_f_{x}") for x in spans],
    )
    ordered = Window.partitionBy(*by).orderBy("_cell")
    prior, rest = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(1, Window.unboundedFollowing)
    edges = cells.select(
        *by, "_cell", F.floor(F.coalesce(F.sum("_n").over(prior), F.lit(0)) / target).alias("_sub"),
        *[F.sum(f"_{k}_{x}").over(prior).alias(f"_{k}_{x}") for k, names in (("s", sums), ("d", distinct)) for x in names],
        *[F.max(f"_l_{x}").over(prior).alias(f"_l_{x}") for x in spans],
        *[F.min(f"_f_{x}").over(rest).alias(f"_f_{x}") for x in spans],
    )
    # a sub-block goes on from what stands before its first cell, and looks ahead to what stands behind its last one
    ahead = [*[f"_s_{x}" for x in sums], *[f"_d_{x}" for x in distinct], *[f"_l_{x}" for x in spans]]
    subs = edges.groupBy(*by, "_sub").agg(
        F.min("_cell").alias("_from"), *[F.min_by(c, "_cell").alias(c) for c in ahead], *[F.max_by(f"_f_{x}", "_cell").alias(f"_f_{x}") for x in spans]
    )
    entry = F.struct("_from", *ahead, *[f"_f_{x}" for x in spans])
    cuts = subs.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("_cuts"))
    reached = F.filter("_cuts", lambda c: c["_from"] <= F.col("_cell"))
    placed = (
        moved.join(F.broadcast(cuts), by, "left").withColumn("_off", F.try_element_at(reached, F.lit(-1)))
        .withColumn("_sub", F.coalesce("_off._from", F.lit(0))).drop("_cuts", "_cell")
    )
    return placed.repartition(parts, *by, "_sub") if parts > n else placed


def _presence(base, key_names, name, width, own, leaves) -> DataFrame:
    """+1 where a value enters the window, -1 where its last sighting leaves it."""
    seen = (
        base.select(
            *key_names,
            "_t",
            F.explode(F.array_distinct(f"_d_{name}")).alias("_v"),
            F.array_compact(F.array(own, F.when(leaves, own + 1))).alias("_blks"),
        )
        .where(F.col("_v").isNotNull())
        .select(*key_names, "_t", "_v", F.explode("_blks").alias("_blk"))
    )
    # sightings less than a width apart are one presence, so of those within one width only the first and the last matter
    seen = seen.groupBy(*key_names, "_v", "_blk", F.floor(F.col("_t") / max(width, 1)).alias("_cell")).agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    w = Window.partitionBy(*key_names, "_v", "_blk").orderBy("_cell")
    before, after = F.lag("_hi").over(w), F.lead("_lo").over(w)
    runs = seen.select(
        *key_names,
        "_blk",
        "_lo",
        "_hi",
        (before.isNull() | (F.col("_lo") - before > width)).alias("_enter"),
        (after.isNull() | (after - F.col("_hi") > width)).alias("_leave"),
    ).where("_enter or _leave")
    step = F.array_compact(
        F.array(
            F.when(F.col("_enter"), F.struct(F.col("_lo").alias("_at"), F.lit(0).alias("_kind"), F.lit(1).alias("_n"))),
            F.when(
                F.col("_leave"),
                F.struct((F.col("_hi") + width).alias("_at"), F.lit(1).alias("_kind"), F.lit(-1).alias("_n")),
            ),
        )
    )
    return runs.select(*key_names, "_blk", F.explode(step).alias("_m")).select(
        *key_names,
        "_blk",
        F.col("_m._at").alias("_at"),
        F.col("_m._kind").alias("_kind"),
        F.lit(False).alias("_ask"),
        F.col("_m._n").alias(f"_d_{name}"),
    )


def values_in_window(
    asked: DataFrame, df: DataFrame, keys: dict[str, Column], t: Column, value: Column, width: int, id_col: str
) -> DataFrame:
    """Sorted distinct values in ``[t - width, t]`` for each row of ``asked`` (key columns, ``t``, id).

    Sightings within one width are one run (an aggregate that is combined before the shuffle), so the join
    compares a row with at most two runs of a value instead of with every event of the key.
    """
    key_names = list(keys)
    own = F.floor(F.col("_t") / width)
    seen = (
        df.select(*[c.alias(n) for n, c in keys.items()], t.alias("_t"), value.alias("_v"))
        .where(F.col("_v").isNotNull())
        .join(asked.select(*key_names).distinct(), key_names, "left_semi")
        .select(*key_names, "_t", "_v", F.explode(F.array(own, own + 1)).alias("_blk"))
    )
    runs = seen.groupBy(*key_names, "_v", "_blk", F.floor(F.col("_t") / width).alias("_cell")).agg(F.min("_t").alias("_from"), (F.max("_t") + width).alias("_to"))
    probe = asked.select(*key_names, "t", id_col, F.floor(F.col("t") / width).alias("_blk"))
    hit = probe.join(runs, [*key_names, "_blk"]).where(F.col("t").between(F.col("_from"), F.col("_to")))
    return hit.groupBy(*key_names, "t", id_col).agg(F.array_sort(F.collect_set("_v")).alias("values"))


# --------------------------------------------------------------------------- blocked replay
def _whole_blocks(batches):
    """Re-cut sorted batches so that no (key, blk) run is split; only the last, possibly unfinished run is held back."""
    held = []
    for pdf in batches:
        if not len(pdf):
            continue
        key, blk = pdf["key"].to_numpy(), pdf["blk"].to_numpy()
        same = (key == key[-1]) & (blk == blk[-1])
        cut = len(key) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut == 0 and held and (held[-1]["key"].iloc[-1], held[-1]["blk"].iloc[-1]) == (key[-1], blk[-1]):
            held.append(pdf)
            continue
        if cut or held:
            yield pd.concat([*held, pdf.iloc[:cut]]) if held else pdf.iloc[:cut]
        held = [pdf.iloc[cut:]]
    if held:
        yield pd.concat(held)


def _runs(pdf):
    """Start and end positions of the (key, blk) runs, and the run number of each row."""
    key, blk = pdf["key"].to_numpy(), pdf["blk"].to_numpy()
    fresh = np.r_[True, (key[1:] != key[:-1]) | (blk[1:] != blk[:-1])]
    start = np.flatnonzero(fresh)
    return start, np.r_[start[1:], len(key)], np.cumsum(fresh) - 1


#: A crowded block is cut into so many at most.
FINEST = 1024


def _time_blocks(rows: DataFrame, length: Column) -> DataFrame:
    """``rows`` (key, t, …) with their time block: its start (``blk``) and its length (``len``).

    A block with more than a partition's share of all rows is cut into as many equal parts of its time as it has shares, so a
    busy stretch of one key makes many blocks. There are no more such blocks than partitions, and which they are follows from the rows alone.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.withColumn("len", length.cast("bigint")).withColumn("blk", F.col("t") - F.pmod("t", "len"))
    counts = cut.groupBy("key", "blk").agg(F.count("*").alias("_n"))
    share = counts.agg(F.greatest(F.coalesce(F.sum("_n"), F.lit(0)) / n, F.lit(1.0))).scalar()
    parts = F.least(F.lit(FINEST), F.pow(F.lit(2.0), F.ceil(F.log2(4 * F.col("_n") / share)))).cast("bigint")
    crowded = counts.where(F.col("_n") > share).select("key", "blk", parts.alias("_parts"))
    fine = F.greatest(F.lit(1), F.ceil(F.col("len") / F.coalesce("_parts", F.lit(1)))).cast("bigint")
    placed = cut.join(F.broadcast(crowded), ["key", "blk"], "left").withColumn("len", fine).drop("_parts")
    return placed.withColumn("blk", F.col("blk") + F.expr("(t - blk) div len") * F.col("len"))


def _per_block(rows: DataFrame, order: list[str], summarise, summary_schema, walk, entry_schema, replay,
               out_schema) -> DataFrame:
    """Sequential replay per key, run in parallel over time blocks.

    1. ``summarise`` reduces each (key, blk) run to a few rows: its effect on any entry state
    2. ``walk`` streams over the summaries of a key in block order and yields each block's entry state
    3. ``replay`` runs each block again, now from its known entry state

    The window puts a block's rows together and in order, and keeps adaptive execution from splitting them.
    Steps 1 and 3 share its exchange. They work on whole blocks, many small ones or one large one at a time.
    """
    together = Window.partitionBy("key", "blk").orderBy(*order)
    placed = rows.withColumn("pos", F.row_number().over(together))

    def over_blocks(step):
        return lambda batches: (step(pdf) for pdf in _whole_blocks(batches))

    summaries = placed.mapInPandas(over_blocks(summarise), summary_schema)
    entries = summaries.repartition("key").sortWithinPartitions("key", "blk", "lo").mapInPandas(walk, entry_schema)
    known = placed.join(entries, ["key", "blk"]).withColumn("pos", F.row_number().over(together))
    return known.mapInPandas(over_blocks(replay), out_schema)


# --------------------------------------------------------------------------- suppression
class _Blocks:
    """Suppression inside blocks, for all blocks of a data frame at once.

    ``at`` orders the rows of all blocks on one axis (block number times ``step`` plus time inside the block), so one binary
    search finds every row's successor.
    """

    def __init__(self, pdf):
        start, _, run = _runs(pdf)
        self.key, self.blk = pdf["key"].to_numpy()[start], pdf["blk"].to_numpy()[start]
        length, reach = (pdf[c].to_numpy("int64")[start] for c in ("len", "reach"))
        zero = self.blk
        self.step = int((length + reach).max()) + 2
        self.base = np.arange(len(start)) * self.step
        t, ctl = pdf["t"].to_numpy("int64"), pdf["ctl"].to_numpy() != 0
        place = self.base[run] + (t - zero[run])
        control = place[ctl]
        row = ~ctl
        self.run, self.t, self.id, self.at = run[row], t[row], pdf["id"].to_numpy("int64")[row], place[row]
        self.n = len(self.t)
        d = np.minimum(pdf["d"].to_numpy("int64")[row] - zero[self.run], self.step - 1) + self.base[self.run]
        # the first control of each block, or the end of the block's axis
        pos = np.searchsorted(control, self.base)
        far = np.r_[control, self.base[-1] + self.step]
        self.first_control = np.minimum(far[pos], self.base + self.step)
        self.has_control = self.first_control < self.base + self.step
        # a control re-arms the key for rows later than itself
        pos = np.searchsorted(control, self.at)
        self.d = np.minimum(d, far[pos])
        self.begin = np.searchsorted(self.run, np.arange(len(start)))
        self.end = np.searchsorted(self.run, np.arange(len(start)), side="right")
        self.zero = zero
        self.next = np.maximum(np.searchsorted(self.at, self.d, side="right"), np.arange(1, self.n + 1))
        self.leaves = self.next >= self.end[self.run]
        # entry deadlines reach at most this far into a block
        self.limit = np.minimum(self.base + reach, self.first_control)

    def time(self, place, run):
        return place - self.base[run] + self.zero[run]

    def enter(self, armed):
        """First firing row per block for entry deadlines ``armed``."""
        low = np.clip(armed - self.zero, -1, self.step - 1) + self.base
        return np.searchsorted(self.at, np.minimum(low, self.first_control), side="right")


def suppress(
    df: DataFrame, key: Column, id_: Column, t: Column, deadline: Column, reach: int | Column, block: int | None = None,
    control: DataFrame | None = None,
) -> DataFrame:
    """Keep a row when its key is armed; it then silences the key for all ``t <= deadline``.

    ``deadline`` is a value of the row that fires (anchor time plus window); ``reach`` is an upper bound of
    ``deadline - t``, the same for all rows of a key. A key is split into blocks of twice its reach, crowded ones more finely. ``control``
    (columns key, t, and reach when that is a column) re-arms keys at once. Returns key, id, t, ``anchor`` (the id of
    the row that fired last) and ``fires``.
    """
    span = reach if isinstance(reach, Column) else F.lit(reach)
    rows = df.select(
        key.alias("key"), id_.cast("bigint").alias("id"), t.alias("t"), deadline.alias("d"), F.lit(0).alias("ctl"),
        span.cast("bigint").alias("reach"),
    )
    if control is not None:
        zero = F.lit(0).cast("bigint")
        own = F.col("reach") if isinstance(reach, Column) else F.lit(reach)
        marks = control.select("key", zero.alias("id"), "t", zero.alias("d"), F.lit(1).alias("ctl"),
                               own.cast("bigint").alias("reach"))
        rows = rows.unionByName(marks)
    length = F.lit(block) if block else F.greatest(2 * F.col("reach"), F.lit(1))
    rows = _time_blocks(rows.where("key is not null and t is not null"), length)

    def summarise(pdf):
        b = _Blocks(pdf)
        i = np.arange(b.n)
        last = np.where(b.leaves, i, b.next) if b.n else i
        while b.n and (last[last] != last).any():
            last = last[last]
        opens = i == b.begin[b.run]
        before = np.r_[0, b.at[:-1]] if b.n else b.at
        changed = np.r_[True, last[1:] != last[:-1]] if b.n else opens
        piece = np.flatnonzero(opens | (changed & (before <= b.limit[b.run])))
        to = last[piece]
        lo = np.where(opens[piece], NEVER, np.r_[0, b.t[:-1]][piece]) if b.n else piece
        fires = pd.DataFrame({"run": b.run[piece], "lo": lo, "kind": 0, "d": b.time(b.d[to], b.run[to]), "anchor": b.id[to]})
        # the entry state may outlive every row of the block; a control ends it
        some = b.end > b.begin
        tail = np.where(some, b.end - 1, 0)
        survives = ~some | (b.at[tail] <= b.limit) if b.n else ~some
        quiet = np.flatnonzero(survives)
        lo = np.where(some[quiet], b.t[tail[quiet]] if b.n else NEVER, NEVER)
        passes = pd.DataFrame(
            {"run": quiet, "lo": lo, "kind": np.where(b.has_control[quiet], 2, 1), "d": NEVER, "anchor": -1}
        )
        out = pd.concat([fires, passes])
        out.insert(0, "key", b.key[out["run"]])
        out.insert(1, "blk", b.blk[out["run"]])
        return out.drop(columns="run")

    def walk(batches):
        now, entry, leave = None, (NEVER, -1), (1, NEVER, -1)
        for pdf in batches:
            out = []
            for k, b, lo, kind, d, anchor in zip(*[pdf[c].tolist() for c in ("key", "blk", "lo", "kind", "d", "anchor")]):
                if now != (k, b):
                    if now is None or now[0] != k:
                        entry = (NEVER, -1)
                    elif leave[0] != 1:
                        entry = leave[1:]
                    now, leave = (k, b), (1, NEVER, -1)
                    out.append((k, b, *entry))
                if lo <= entry[0]:
                    leave = (kind, d, anchor)
            yield pd.DataFrame(out, columns=["key", "blk", "armed", "entry"])

    def replay(pdf):
        b = _Blocks(pdf)
        start = _runs(pdf)[0]
        armed, entry = pdf["armed"].to_numpy("int64")[start], pdf["entry"].to_numpy("int64")[start]
        fires = np.zeros(b.n, dtype=bool)
        front = b.enter(armed)
        front = front[front < b.end]
        while len(front):
            fires[front] = True
            front = b.next[front[~b.leaves[front]]]
        at = np.maximum.accumulate(np.where(fires, np.arange(b.n), -1)) if b.n else np.zeros(0, int)
        own = at >= b.begin[b.run]
        anchor = np.where(own, b.id[np.maximum(at, 0)], entry[b.run]) if b.n else b.id
        return pd.DataFrame({"key": b.key[b.run], "id": b.id, "t": b.t, "anchor": anchor, "fires": fires})

    return _per_block(
        rows,
        ["t", "ctl", "id"],
        summarise,
        "key string, blk bigint, lo bigint, kind int, d bigint, anchor bigint",
        walk,
        "key string, blk bigint, armed bigint, entry bigint",
        replay,
        "key string, id bigint, t bigint, anchor bigint, fires boolean",
    )


# --------------------------------------------------------------------------- state machines
def fold_states(
    df: DataFrame, key: Column, t: Column, seq: Column, action: Column, initial: str, moves: dict[str, dict[str, str]],
    block: int,
) -> DataFrame:
    """Apply actions in (t, seq) order; ``moves[state][action]`` is the next state, absent means rejected.

    Returns key, seq, t, action, ``before``, ``after``, ``accepted``. A block of changes acts on the finite set of
    states as a function, so blocks are reduced to that function and composed.
    """
    states = list(moves)
    index = {s: i for i, s in enumerate(states)}
    code = {a: i for i, a in enumerate(sorted({a for targets in moves.values() for a in targets}))}
    # table[action, state]: next state, the state itself where rejected; unknown actions are rejected everywhere
    table = np.tile(np.arange(len(states)), (len(code) + 1, 1))
    allowed = np.zeros((len(code) + 1, len(states)), dtype=bool)
    for s, targets in moves.items():
        for a, target in targets.items():
            table[code[a], index[s]], allowed[code[a], index[s]] = index[target], True
    rows = df.select(
        key.alias("key"), t.alias("t"), seq.cast("bigint").alias("seq"), action.alias("action")
    ).where("key is not null")
    rows = _time_blocks(rows, F.lit(block)).drop("len")

    def in_step(pdf):
        """Walk all blocks together, one change of each per round; yields (row positions, runs, actions)."""
        start, end, _ = _runs(pdf)
        actions = pdf["action"].map(code).fillna(len(code)).to_numpy("int64")
        by_length = np.argsort(start - end, kind="stable")
        lengths = (end - start)[by_length]
        for p in range(int(lengths[0])):
            runs = by_length[: np.searchsorted(-lengths, -p)]
            yield start[runs] + p, runs, actions[start[runs] + p]

    def summarise(pdf):
        start = _runs(pdf)[0]
        ends = np.tile(np.arange(len(states)), (len(start), 1))
        for _, runs, actions in in_step(pdf):
            ends[runs] = table[actions[:, None], ends[runs]]
        return pd.DataFrame(
            {"key": pdf["key"].to_numpy()[start], "blk": pdf["blk"].to_numpy()[start], "lo": 0,
             "ends": [",".join(map(str, e)) for e in ends.tolist()]}
        )

    def walk(batches):
        owner, state = None, index[initial]
        for pdf in batches:
            out = []
            for k, ends in zip(pdf["key"].tolist(), pdf["ends"].tolist()):
                if owner != k:
                    owner, state = k, index[initial]
                out.append(state)
                state = int(ends.split(",")[state])
            yield pd.DataFrame({"key": pdf["key"], "blk": pdf["blk"], "entry": out})

    def replay(pdf):
        state = pdf["entry"].to_numpy("int64")[_runs(pdf)[0]].copy()
        before, after = np.zeros(len(pdf), int), np.zeros(len(pdf), int)
        accepted = np.zeros(len(pdf), bool)
        for at, runs, actions in in_step(pdf):
            before[at] = state[runs]
            accepted[at] = allowed[actions, state[runs]]
            state[runs] = table[actions, state[runs]]
            after[at] = state[runs]
        names = np.array(states, dtype=object)
        out = pdf[["key", "seq", "t", "action"]].copy()
        out["before"], out["after"], out["accepted"] = names[before], names[after], accepted
        return out

    return _per_block(
        rows,
        ["t", "seq"],
        summarise,
        "key string, blk bigint, lo bigint, ends string",
        walk,
        "key string, blk bigint, entry int",
        replay,
        "key string, seq bigint, t bigint, action string, before string, after string, accepted boolean",
    )


# --------------------------------------------------------------------------- numbering and running sums
def running_count(df: DataFrame, keys: list[str], t: str, order: list[str], flag: Column, out: str, block: int):
    """Number of flagged rows of the key up to and including each row, in ``order``.

    ``t`` must be the leading order column. Totals of earlier blocks are one small row per (key, block).
    """
    rows = df.withColumn("_blk", F.floor(F.col(t) / block)).withColumn("_flag", F.when(flag, 1).otherwise(0))
    prior = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        rows.groupBy(*keys, "_blk")
        .agg(F.sum("_flag").alias("_sum"))
        .select(*keys, "_blk", F.coalesce(F.sum("_sum").over(prior), F.lit(0)).alias("_prior"))
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.join(totals, [*keys, "_blk"])
        .withColumn(out, F.col("_prior") + F.sum("_flag").over(inside))
        .drop("_blk", "_flag", "_prior")
    )


def numbered(df: DataFrame, keys: list[str], t: str, order: list[str], out: str, block: int, counters: DataFrame | None = None) -> DataFrame:
    """1, 2, 3 … within the key in ``order``; a busy key is numbered block by block. ``counters`` (the keys and ``last``, one row a
    key) has the numbers given out before: a key goes on behind its last one."""
    ranked = running_count(df, keys, t, order, F.lit(True), out, block)
    if counters is None:
        return ranked
    known = counters.select(*keys, F.col("last").alias("_last"))
    return ranked.join(known, keys, "left").withColumn(out, F.col(out) + F.coalesce("_last", F.lit(0))).drop("_last")
