"""Packing of tokenized documents into sequences of fixed capacity, by linear grouping.

Documents longer than the capacity are cut into full pieces behind a shorter first one. Only the number of pieces of each length matters
for the plan, so the driver sees one count per length:

1. *Grouping.* Lengths over ``capacity / SMALL`` are large. In descending order they are cut into groups of equal cardinality, and every
   length is rounded up to the longest of its group.
2. *Configurations.* With so few sizes, a linear program over the ways to fill a sequence is solved by column generation
   (the dual prices go into a knapsack, which gives the next column). Its solution is rounded down.
3. *Substitution.* Actual lengths take the places of their group, longest first. Where that leaves more room than the small lengths can
   fill, the sequence is given up again; how much room is allowed is tried out.
4. *Best fit.* What is left over, and then the small lengths, go where they leave the least room; new sequences only when nothing fits.

A plan is a list of runs, (lengths in a sequence, number of such sequences). Pieces are numbered within each length and find
run, sequence and offset from their number.

Defined cases: a null or empty text is the end token alone; equal rows are packed as often as they occur; a null id stays null; an
empty table gives no sequences; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import own_id, partitions, table, texts
from vigil.llm.registry import query
from vigil.streaming.storage import written

CAPACITY = 1024
END = 2
SMALL = 8
GROUPS = 48
#: Room that rounding may leave in a sequence, in tokens; sequences with more are given up to best fit. Each of these is tried.
WASTE = (0, 1, 2, 4, 8, 16, 32, 128)

# ---- tokens

# fixed value: how byte-level BPE splits a text before it merges
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A word starts at a blank between two signs that are not white space, whatever stands around.
WORD = re.compile(r"(?<=\S) (?=\S)")
GAP = re.compile(r"\s\s")
#: Words whose tokens a task remembers.
REMEMBERED = 400_000


class Tokens:
    """Token ids of texts, as little-endian bytes of unsigned 32-bit numbers.

    Byte-level BPE never merges across the start of a word, so a text is cut there and each different word is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.by_word = (
            spec["model"]["type"] == "BPE" and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["normalizer"]
            and spec["pre_tokenizer"].get("use_regex", True) and not spec["pre_tokenizer"]["add_prefix_space"]
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        self.words: dict[str, bytes] = {}
        self.encode = self._ranked(spec) if self.by_word else self._whole

    def _whole(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _ranked(self, spec: dict):
        """The same vocabulary with merges as ranks, where the ids are in the order of the merges."""
        import tiktoken

        vocabulary, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocabulary[a + b] for a, b in merges]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            return self._whole
        sign = _byte_signs()
        ranks = {bytes(sign[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        encoding = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: encoding.encode(text, allowed_special="all")

    def __call__(self, text: str) -> bytes:
        if not self.by_word:
            return np.array(self._whole(text), dtype="<u4").tobytes()
        parts = WORD.split(text) if GAP.search(text) else text.split(" ")
        known, out = self.words, [np.array(self.encode(parts[0]), dtype="<u4").tobytes()]
        for part in parts[1:]:
            found = known.get(part)
            out.append(found if found is not None else self._word(part))
        return b"".join(out)

    def _word(self, part: str) -> bytes:
        found = np.array(self.encode(" " + part), dtype="<u4").tobytes()
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        self.words[part] = found
        return found


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if it can be printed, else the next one after 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Each document's pieces: ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, the ``ids``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    last = np.array([end], dtype="<u4").tobytes()

    def cut(batches):
        tokens = Tokens(tokenizer)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = tokens(text) + last
                n = len(ids) // 4
                first = n % capacity or capacity
                for k, stop in enumerate(range(first, n + 1, capacity)):
                    start = max(0, stop - capacity) if k else 0
                    own = ids[4 * start : 4 * stop]
                    rows.append((doc, k, start, stop - start, zlib.crc32(own), *([np.frombuffer(own, dtype="<i4")] if with_ids else [])))
            columns = list(zip(*rows, strict=True)) or [()] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.mapInArrow(cut, schema)


# ---- plan


def grouped(counts: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The group's longest length for each length that occurs (0 elsewhere): groups of equal cardinality, longest first."""
    lengths = np.flatnonzero(counts)[::-1]
    before = np.cumsum(counts[lengths]) - counts[lengths]
    group = before * groups // max(1, counts.sum())
    top = np.zeros(len(counts), dtype=np.int64)
    for g in np.unique(group):
        top[lengths[group == g]] = lengths[group == g].max()
    return top


def best_filling(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each size so that the prices add up to the most (unbounded knapsack)."""
    worth, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        value = worth[room - sizes[fits]] + prices[fits]
        i = value.argmax()
        worth[room], took[room] = max((value[i], fits[i]), (worth[room - 1], -1), key=lambda x: x[0])
    filling, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            filling[took[room]] += 1
            room -= sizes[took[room]]
    return filling


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Ways to fill a sequence and how often each is used: the linear program's solution, rounded down."""
    n = len(sizes)
    columns = [np.where(np.arange(n) == i, capacity // sizes[i], 0) for i in range(n)]
    for _ in range(40 * n):
        basis = np.stack(columns, axis=1).astype(float)
        amounts = np.linalg.solve(basis, demand.astype(float))
        prices = np.linalg.solve(basis.T, np.ones(n))
        new = best_filling(sizes, prices, capacity)
        if new @ prices <= 1 + 1e-9:
            break
        change = np.linalg.solve(basis, new.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = int(np.where(change > 1e-12, np.maximum(amounts, 0) / change, np.inf).argmin())
        columns[leave] = new
    amounts = np.linalg.solve(np.stack(columns, axis=1).astype(float), demand.astype(float))
    return [(c, int(a)) for c, a in zip(columns, np.floor(amounts + 1e-6), strict=True) if a >= 1]


def plan(counts: np.ndarray, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths in a sequence, number of sequences) that hold ``counts[length]`` pieces of each length: the fewest
    sequences of the plans for each allowed ``WASTE``."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    left[: len(counts)] = counts
    large = np.where((np.arange(capacity + 1) > capacity // small) & (np.arange(capacity + 1) < capacity), left, 0)
    members: dict[int, list[int]] = {}
    ways: list[tuple[list[tuple[int, int]], int]] = []
    if large.sum():
        top = grouped(large, groups)
        sizes = np.unique(top[top > 0])
        members = {int(s): [int(x) for x in np.flatnonzero(top == s)[::-1]] for s in sizes}
        demand = np.array([large[members[int(s)]].sum() for s in sizes])
        ways = [([(int(s), int(k)) for s, k in zip(sizes, use, strict=True) if k], times) for use, times in configurations(sizes, demand, capacity)]
    plans = [_filled(left.copy(), members, ways, capacity, waste) for waste in WASTE]
    return min(plans, key=lambda runs: sum(times for _, times in runs))


def _substituted(left: np.ndarray, members: dict[int, list[int]], need: list[tuple[int, int]]) -> tuple[list[int], int]:
    """Actual lengths in the places of one configuration, the longest of each group first, and how often these lengths last."""
    chosen, most = [], int(left.sum())
    for size, k in need:
        for x in members[size]:
            take = min(k, int(left[x]))
            if take:
                most = min(most, int(left[x]) // take) if take == k else 1
                chosen += [x] * take
                k -= take
    return chosen, most


def _filled(left: np.ndarray, members: dict, ways: list, capacity: int, waste: int) -> list[tuple[tuple[int, ...], int]]:
    open_: dict[int, dict[tuple[int, ...], int]] = {}  # room: lengths: number of sequences

    def add(lengths: tuple[int, ...], times: int) -> None:
        at = open_.setdefault(capacity - sum(lengths), {})
        at[lengths] = at.get(lengths, 0) + times

    back = np.zeros_like(left)
    for need, times in ways:
        while times > 0:
            chosen, most = _substituted(left, members, need)
            if not chosen:
                break
            most = min(most, times)
            good = capacity - sum(chosen) <= waste
            for x in set(chosen):
                left[x] -= most * chosen.count(x)
                back[x] += 0 if good else most * chosen.count(x)
            if good:
                add(tuple(sorted(chosen, reverse=True)), most)
            times -= most
    left += back  # lengths of sequences that would have more room left than is allowed
    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                per = capacity // length
                if todo >= per:
                    add((length,) * per, todo // per)
                    todo %= per
                if todo:
                    add((length,) * todo, 1)
                break
            lengths, times = open_[room].popitem()
            if not open_[room]:
                del open_[room]
            used = min(times, todo)
            if used < times:
                add(lengths, times - used)
            add((*lengths, length), used)
            todo -= used
    return [(lengths, times) for room in sorted(open_) for lengths, times in open_[room].items()]


class Places:
    """Sequence and offset of the i-th piece of each length."""

    def __init__(self, runs: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY):
        rows: dict[int, list[tuple[int, int, list[int]]]] = {}
        base = 0
        for lengths, times in runs:
            offsets = np.cumsum((0, *lengths[:-1])).tolist()
            for length in set(lengths):
                rows.setdefault(length, []).append((times, base, [o for o, x in zip(offsets, lengths, strict=True) if x == length]))
            base += times
        self.rows = {
            length: (
                np.cumsum([0] + [t * len(o) for t, _, o in found])[:-1], np.array([b for _, b, _ in found], dtype=np.int64),
                np.array([len(o) for *_, o in found], dtype=np.int64), np.cumsum([0] + [len(o) for *_, o in found])[:-1],
                np.array([x for *_, o in found for x in o], dtype=np.int64),
            )
            for length, found in rows.items()
        }

    def __call__(self, length: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, base, per, at, offsets = self.rows[length]
        run = np.searchsorted(first, number, side="right") - 1
        place = number - first[run]
        return base[run] + place // per[run], offsets[at[run] + place % per[run]]


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``cut`` is read twice: write it first."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(64, partitions(cut.sparkSession)))).alias("block")
    marked = cut.withColumn("block", block)
    sizes = written(marked.groupBy("length", "block").agg(F.count("*").alias("n")), "lengths")
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length
        counts[row.length] = row.n
    places = Places(plan(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = marked.withColumn("number", F.row_number().over(inside) - 1).join(starts, ["length", "block"]).withColumn("number", F.col("number") + F.col("before"))

    def place(batches):
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length).tolist():
                own = length == x
                sequence[own], offset[own] = places(x, number[own])
            kept = batch.drop_columns(["number"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    return numbered.select(*cut.columns, "number").mapInArrow(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from packed pieces that have ``ids``: at most one capacity's worth a group."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    cut = written(pieces(texts(docs), tokenizer or default_tokenizer(), capacity, end), "pieces")
    return packed(cut, capacity).select(own_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
