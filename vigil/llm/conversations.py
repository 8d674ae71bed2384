"""Repair of the role structure of conversations, by weighted parsing of intervals.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``. The grammar is in Chomsky normal form: a nonterminal is a
pair of states (p, q), the span that leads the sequence of roles from p to q. Binary rules are ``(p, q) -> (p, r) (r, q)``, terminal rules what an
edit makes of one row, and the closure under insertions is part of every cell: any number of inserted turns may stand before a row.
A cell of the chart holds the least (cost, audit) of its span; audits are compared as strings.

These binary rules give the same cell wherever a span is split (the least of a product is associative, and of equal cost no audit is the
beginning of another: each insertion costs). So the chart needs one split per span, and is filled bottom-up by span length 1, 2, 4, 8, …: n - 1
products for n rows, and no span has to lie in one task.

In Spark: equal rows are counted together, rows are dealt out by ranges of (conversation, turn, role, text), so a conversation of any size spreads over
many tasks; each task fills the chart of its stretch of a conversation, one cell row per stretch goes on, and the stretches are combined in
order. Only the digest of the repaired text, a running SHA-256, has to see a conversation's rows one after the other; it holds one row at a time.

Defined cases: null role and text are one space, a null conv_id or turn is one space in the key of the damage; a null conv_id is a
conversation of its own; null turns come first, rows of one turn are ordered by role and text; an empty role has no initial, so it can't be
kept; equal rows are each other's duplicates; conversations without rows have zeros; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import partitions, short_batches, table
from vigil.llm.registry import query
from vigil.streaming.storage import written

#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. A sequence may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
#: Pairs of neighbouring initials that are in order.
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}

#: A cell row of the chart: least (cost, audit) of each nonterminal.
Cells = dict[tuple[int, int], tuple[int, str]]


def joined(left: Cells, right: Cells) -> Cells:
    """The binary rules: cells of a span from those of its two halves."""
    out: Cells = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            if (other := right.get((r, q))) is None:
                continue
            total, best = cost + other[0], out.get((p, q))
            if best is None or total < best[0] or (total == best[0] and audit + other[1] < best[1]):
                out[p, q] = (total, audit + other[1])
    return out


def _closure() -> Cells:
    """What insertions alone can do, any number of them."""
    one = {(p, p): (0, "") for p in range(4)} | {(p, q): (INSERT, "I") for (p, role), q in STEPS.items() if role in ROLES}
    out = one
    while (more := joined(out, one)) != out:
        out = more
    return out


INSERTED = _closure()


@functools.cache
def leaf(initial: str, must_go: bool, truncated: bool) -> Cells:
    """Cells of one row, with insertions before it."""
    own: Cells = {(p, p): (DELETE, "D") for p in range(4)}
    if not must_go:
        more = TRUNCATED if truncated else 0
        for (p, role), q in STEPS.items():
            if role == initial:
                own[p, q] = (more, "K")
            elif role in ROLES:
                own[p, q] = (REROLE + more, "R")
    return joined(INSERTED, own)


def chart(cells: list[Cells]) -> Cells:
    """Spans of length 1, 2, 4, … up to the whole."""
    while len(cells) > 1:
        pairs = [joined(cells[i], cells[i + 1]) for i in range(0, len(cells) - 1, 2)]
        cells = pairs + cells[len(cells) - len(cells) % 2 :]
    return cells[0] if cells else {(p, p): (0, "") for p in range(4)}


def cheapest(cells: Cells) -> tuple[int, str]:
    whole = joined(cells, INSERTED)
    return min(whole[START, q] for q in ENDS if (START, q) in whole)


_SOMETHING = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")


def fault(text: str, seen: bool) -> str:
    """The first of a row's faults: b blank, d duplicate, t truncated, or none."""
    if not _SOMETHING.search(text):
        return "b"
    if seen:
        return "d"
    return "" if _LAST.search(text)[1] in ".!?" else "t"


def output_roles(audit: str) -> list[str]:
    """The initial of each turn that is left: the edits alone determine it."""
    n = len(audit) - audit.count("D")
    return (["s"] if n % 2 else []) + ["u", "a"] * (n // 2)


# ---- Spark


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the number of copies ``n`` after the damage; the damage follows from the row's key."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *said)) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.where(kind != 0).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("n"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number ``n``, and whether role and text occur in an earlier turn (``seen``)."""
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    once = once.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    turn = F.struct(F.col("turn").isNotNull().alias("x"), "turn")
    first = once.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    a, b = once.alias("a"), first.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest"))
    earlier = F.struct(F.col("a.turn").isNotNull().alias("x"), F.col("a.turn")) > F.col("first")
    return a.join(b, same, "left").select("a.conv_id", "a.turn", "a.role", "a.text", "n", F.coalesce(earlier, F.lit(False)).alias("seen"))


_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
_SEGMENT = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("low", pa.int64()), ("high", pa.int64()),
     ("first", pa.string()), ("last", pa.string()), ("spans", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)
_SEGMENT_DDL = (
    "conv_id long, part long, " + ", ".join(f"{c} long" for c in _COUNTS)
    + ", low long, high long, first string, last string, spans array<int>, costs array<long>, audits array<string>"
)


class Stretch:
    """Consecutive rows of a conversation: counts, edges and the chart's cells."""

    #: Cells of so many rows are combined at once.
    ROWS = 1 << 14

    def __init__(self, conv_id: int | None):
        self.conv_id, self.low, self.high, self.first, self.last = conv_id, None, None, None, None
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.leaves: list[Cells] = []

    def add(self, turn: int | None, role: str, text: str, n: int, seen: bool) -> None:
        c, initial = self.counts, role[:1]
        for found, times in ((fault(text, seen), 1), (fault(text, True), n - 1)):
            if times:
                self.leaves += [leaf(initial, found in ("b", "d"), found == "t")] * times
                for name, letter in (("blank", "b"), ("duplicate", "d"), ("truncated", "t")):
                    c[name] += times * (found == letter)
        c["rows"] += n
        c["illegal"] += (self.last is not None and self.last + initial not in LEGAL) + (n - 1) * (initial * 2 not in LEGAL)
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            c["turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if len(self.leaves) > self.ROWS:
            self.leaves = [chart(self.leaves)]

    def append(self, other: dict) -> None:
        """The stretch that follows."""
        if not other["rows"]:
            return
        for name in _COUNTS:
            self.counts[name] += other[name]
        self.counts["illegal"] += self.last is not None and self.last + other["first"] not in LEGAL
        self.first, self.last = other["first"] if self.first is None else self.first, other["last"]
        if other["low"] is not None:
            self.counts["turns"] -= other["low"] == self.high
            self.low, self.high = other["low"] if self.low is None else self.low, other["high"]
        self.leaves.append({(s // 4, s % 4): (c, a) for s, c, a in zip(other["spans"], other["costs"], other["audits"], strict=True)})

    def row(self, part: int) -> tuple:
        cells = chart(self.leaves)
        spans = [p * 4 + q for p, q in cells]
        costs, audits = ([x[i] for x in cells.values()] for i in (0, 1))
        return (self.conv_id, part, *self.counts.values(), self.low, self.high, self.first, self.last, spans, costs, audits)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _emitted(rows, schema: pa.Schema, size: int = 1_000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def stretches(ordered: DataFrame) -> DataFrame:
    """One row per conversation and task; ``ordered`` has the task's number ``part``, its rows in order."""

    def fill(batches):
        def rows():
            now, part = None, 0
            for batch in batches:
                for row in batch.to_pylist():
                    if now is None or row["conv_id"] != now.conv_id:
                        if now is not None:
                            yield now.row(part)
                        now = Stretch(row["conv_id"])
                    part = row["part"]
                    now.add(row["turn"], row["role"], row["text"], row["n"], row["seen"])
            if now is not None:
                yield now.row(part)

        return _emitted(rows(), _SEGMENT)

    return ordered.mapInArrow(fill, _SEGMENT_DDL)


_RESULT = pa.schema(
    [("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())]
)
_RESULT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def parsed(segments: DataFrame) -> DataFrame:
    """One row per conversation from its stretches in order."""

    def combine(batches):
        def result(found: Stretch) -> tuple:
            c = found.counts
            gaps = 0 if found.low is None else found.high - found.low + 1 - c["turns"]
            return (found.conv_id, gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], *cheapest(chart(found.leaves)))

        def rows():
            now = None
            for batch in batches:
                for row in batch.to_pylist():
                    if now is None or row["conv_id"] != now.conv_id:
                        if now is not None:
                            yield result(now)
                        now = Stretch(row["conv_id"])
                    now.append(row)
            if now is not None:
                yield result(now)

        return _emitted(rows(), _RESULT)

    by_conversation = segments.repartition(partitions(segments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    return by_conversation.mapInArrow(combine, _RESULT_DDL)


def edited(turns, audit: str):
    """(role, text) of each turn that is left. ``turns`` yields (role, text) in order."""
    edits, roles, done = iter(audit), output_roles(audit), 0
    for role, text in turns:
        edit = next(edits)
        while edit == "I":
            yield ROLES[roles[done]], ""
            done, edit = done + 1, next(edits)
        if edit != "D":
            yield role if edit == "K" else ROLES[roles[done]], text
            done += 1
    for _ in edits:
        yield ROLES[roles[done]], ""
        done += 1


_TURN = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _by_conversation(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order."""
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("n"))
    own = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "n")
    return heads.union(own).repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")


def _conversations(batches):
    """(conv_id, iterator of the repaired turns) of each conversation; the iterator has to be used up before the next one."""
    rows = (row for batch in batches for row in batch.to_pylist())
    head = next(rows, None)
    while head is not None:
        conv_id, audit, after = head["conv_id"], head["text"], []

        def turns(after=after):
            for row in rows:
                if row["kind"] == 0:
                    after.append(row)
                    return
                for _ in range(row["n"]):
                    yield row["role"], row["text"]

        yield conv_id, edited(turns(), audit)
        head = after[0] if after else None


def structure(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The marked rows of conversations, and per conversation its counts, least cost and audit. ``rows`` as ``damaged`` returns them."""
    short_batches(rows.sparkSession)
    own = written(marked(rows), "turns")
    n = partitions(rows.sparkSession)
    order = ["conv_id", "turn", "role", "text"]
    ordered = own.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    return own, stretches(ordered)


def repaired(rows: DataFrame) -> DataFrame:
    """The turns that are left: conv_id, place (from 0), role, text. Roles of ``rows`` (conv_id, turn, role, text) are put in order
    at least cost; nulls are one space."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    own, segments = structure(rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role, text, F.lit(1).alias("n")))

    def edit(batches):
        return _emitted(((conv, i, *turn) for conv, turns in _conversations(batches) for i, turn in enumerate(turns)), _TURN)

    return _by_conversation(own, parsed(segments)).mapInArrow(edit, "conv_id long, place long, role string, text string")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    def digest(batches):
        def out():
            for conv_id, turns in _conversations(batches):
                total = hashlib.sha256()
                for i, (role, text) in enumerate(turns):
                    total.update(f"{chr(10) if i else ''}{role}:{text}".encode())
                yield conv_id, total.hexdigest()

        return _emitted(out(), _DIGEST)

    return _by_conversation(rows, found).mapInArrow(digest, "conv_id long, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Per conversation of the table: faults after the damage, the cheapest repair and the digest of what it leaves."""
    own, segments = structure(damaged(conversations))
    empty = conversations.select(F.col("conv_id").cast("long")).distinct().select(
        "conv_id", *(F.lit(0).cast("long").alias(c) for c in ("part", *_COUNTS)), *(F.lit(None).cast("long").alias(c) for c in ("low", "high")),
        *(F.lit(None).cast("string").alias(c) for c in ("first", "last")), F.array().cast("array<int>").alias("spans"),
        F.array().cast("array<long>").alias("costs"), F.array().cast("array<string>").alias("audits"),
    )
    found = written(parsed(segments.union(empty)), "repairs")
    left = digests(own, found).withColumnRenamed("conv_id", "id")
    same = F.col("conv_id").eqNullSafe(F.col("id"))
    return found.join(left, same).drop("id")


#: The damage and the faults as SQL has them, then one step per row: the least (cost, audit) that ends in each state.
_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) AS h FROM conversations),
crc AS (
  SELECT *, (4294967295 - list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || h[(2 * i - 1)::int:(2 * i)::int])::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM crc WHERE kind <> 0),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
numbered AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS nth FROM placed),
faulty AS (
  SELECT *, role[1] AS first, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd'
    WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN '' ELSE 't' END AS fault,
    lag(role[1]) OVER (PARTITION BY c ORDER BY i) AS before FROM numbered),
inserted(p, q, cost, audit) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (2, 3, 5, 'I'), (3, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')),
steps(p, letter, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits AS (
  SELECT c, i, p, q, CASE WHEN first = letter THEN 0 ELSE 1 END + CASE WHEN fault = 't' THEN 5 ELSE 0 END AS cost, CASE WHEN first = letter THEN 'K' ELSE 'R' END AS edit
  FROM faulty, steps WHERE fault IN ('', 't') AND (first = letter OR letter <> 's')
  UNION ALL SELECT c, i, p, p, 2, 'D' FROM faulty, (SELECT unnest(range(4)) AS p)),
moves AS (
  SELECT c, i, n.p, e.q, (n.cost + e.cost)::bigint AS cost, n.audit || e.edit AS audit FROM edits e JOIN inserted n ON n.q = e.p),
best(c, i, state, b) AS (
  SELECT DISTINCT c, 0::bigint, 0, {'cost': 0::bigint, 'audit': ''} FROM faulty
  UNION ALL
  SELECT m.c, m.i, m.q, min({'cost': b.cost + m.cost, 'audit': b.audit || m.audit}) FROM best JOIN moves m ON m.c = best.c AND m.i = best.i + 1 AND m.p = best.state GROUP BY ALL),
sizes AS (
  SELECT c, any_value(conv_id) AS conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || first NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY c),
ended AS (
  SELECT s.*, (min({'cost': b.cost + n.cost, 'audit': b.audit || n.audit})) AS w FROM sizes s JOIN best ON best.c = s.c AND best.i = s.n JOIN inserted n ON n.p = best.state AND n.q IN (0, 3) GROUP BY ALL),
letters AS (SELECT c, w.audit AS audit, unnest(range(1, length(w.audit) + 1)) AS j FROM ended),
outputs AS (
  SELECT c, j, audit[j] AS letter, count(*) FILTER (audit[j] <> 'I') OVER (PARTITION BY c ORDER BY j) AS i, count(*) FILTER (audit[j] <> 'D') OVER (PARTITION BY c ORDER BY j) AS t,
    count(*) FILTER (audit[j] <> 'D') OVER (PARTITION BY c) % 2 AS lead FROM letters),
said AS (
  SELECT o.c, j, CASE WHEN letter = 'K' THEN f.role WHEN (t - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END AS line
  FROM outputs o LEFT JOIN faulty f ON f.c = o.c AND f.i = o.i WHERE letter <> 'D'),
hashed AS (SELECT c, sha256(string_agg(line, chr(10) ORDER BY j)) AS repaired_sha256 FROM said GROUP BY c)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(w.cost, 0) AS cost, coalesce(w.audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN hashed h ON h.c = e.c
"""


@query("op12_conversation_repair", _SQL)
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's faults, cheapest repair and digest."""
    return repair_report(table(spark, sf_dir, "conversations"))
