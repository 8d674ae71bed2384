"""Passages of ``WINDOW`` words that stand in an earlier document, found by matching statistics on compressed FM-indexes.

An FM-index (class ``FMIndex``) holds the Burrows-Wheeler transform of its texts as a wavelet matrix: one bit per symbol and level, packed, with a
count per 64 bits. Backward search extends a match to the left by one rank per level; where it can't go on, the interval is widened to that
of a shorter prefix with the help of the longest common prefixes. That gives, for every position of a streamed text, the length of
the longest match that starts there and that occurs in a text of a smaller owner: its matching statistics. Positions with at least
``WINDOW`` are the result.

Sharding: an index over a part of the documents would have to see every document. Here the content decides what meets: the *digit* of a window is
the ``DIGIT``-word string with the smallest hash in it (the leftmost of equal ones), so equal windows have equal digits, and
neighbouring windows share theirs: a *stretch*. A shard holds all stretches of some digits; their number grows with the rows that are
asked about. Before that

* a digit that only one document has ends there: its windows are unique,
* equal stretches are one text in the index, that of the smallest doc_id; in others they are repeats as a whole. A task sends each of its
  distinct stretches once, so no passage, however common, makes a large group,
* the smallest document of a digit needs no search, the largest no place in the index,
* a digit with more than ``CROWD`` different stretches (a common phrase in ever different company) is dealt out by whole windows: each window
  goes by its own 128 bits to where the smallest doc_id is found by an aggregate. So a shard stays bounded and nothing is left out.

Words are compared by 64-bit hashes inside a shard, whole stretches and windows by 128 bits.

Defined cases: a null text has no words; documents of fewer words than a window have no repeats; rows with equal id and text are one document, and each
gets its result; different texts under one id are not earlier than each other; rows without an id are neither earlier nor later than
others, so nothing goes from them or because of them; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import NO_ID, as_bytes, between, byte_sums, mix, own_id, partitions, sums, table, texts, windows
from vigil.llm.registry import query
from vigil.streaming.storage import written

WINDOW = 50
DIGIT = 20
#: Different stretches of one digit that an index takes.
CROWD = 4_096
#: Words in a shard, about.
SHARD = 1 << 19
#: Bytes of text that a task sorts at once before it sends.
CHUNK = 32 << 20

#: What separates words. Fixed values.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


# ---- the index


#: Masks of the bits below a place in 64.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    """``rank(c, i)``: how often symbol c stands in front of place i. Bits packed by 64, a count before each 64."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level) & 1
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, dtype=np.uint8)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

        # where each symbol starts behind the last level
        self.starts = self._down(np.arange(1 << self.levels), np.zeros(1 << self.levels, dtype=np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, counts, zeros in zip(reversed(range(self.levels)), self.bits, self.counts, self.zeros, strict=True):
            word = i >> 6
            ones = counts[word] + np.bitwise_count(bits[word] & _BELOW[i & 63])
            i = np.where((c >> level) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._down(c, i) - self.starts[c]


class _Least:
    """Minimum of any stretch of an array."""

    def __init__(self, x: np.ndarray):
        rows = [x]
        while 2 << (len(rows) - 1) <= len(x):
            half = 1 << (len(rows) - 1)
            last = rows[-1].copy()
            last[:-half] = np.minimum(rows[-1][:-half], rows[-1][half:])
            rows.append(last)
        self.table = np.stack(rows)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over ``a:b``, which must not be empty."""
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        return np.minimum(self.table[k, a], self.table[k, b - (1 << k)])


class FMIndex:
    """Compressed index of texts (arrays of symbols of at least 1) with an owner each."""

    def __init__(self, found: list[np.ndarray], owners: np.ndarray):
        sizes = np.array([len(x) + 1 for x in found], dtype=np.int64)
        s = np.zeros(int(sizes.sum()), dtype=np.int64)
        ends = np.cumsum(sizes) - 1
        inside = np.ones(len(s), dtype=bool)
        inside[ends] = False
        s[inside] = np.concatenate(found) if found else s[:0]
        self.n, self.sigma = len(s), int(s.max(initial=0)) + 1
        # suffixes in order, by doubling; each text ends with a sign of its own, so a comparison never leaves it
        rank = s + len(found) - 1
        rank[ends] = np.arange(len(found))
        rank = np.unique(rank, return_inverse=True)[1]
        ranks = [rank.astype(np.int32)]
        order = np.argsort(rank, kind="stable")
        while rank[order[-1]] < self.n - 1:
            step = 1 << (len(ranks) - 1)
            behind = np.zeros(self.n, dtype=np.int64)
            behind[: self.n - step] = rank[step:] + 1
            key = rank * (self.n + 1) + behind
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
            rank = np.empty(self.n, dtype=np.int64)
            rank[order] = new
            ranks.append(rank.astype(np.int32))
        # longest common prefix with the suffix before
        lcp = np.zeros(self.n + 1, dtype=np.int32)
        x, y = order[:-1].copy(), order[1:].copy()
        for j in reversed(range(len(ranks))):
            same = (ranks[j][x] == ranks[j][y]).astype(np.int64) << j
            lcp[1 : self.n] += same.astype(np.int32)
            x += same
            y += same
        lcp[[0, self.n]] = -1
        self.lcp, self.least_lcp = lcp, _Least(lcp)
        self.least_owner = _Least(np.repeat(owners, sizes)[order].astype(np.int32))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=self.sigma))))
        self.bwt = WaveletMatrix(s[order - 1], self.sigma)

    def widened(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the first ``length`` symbols of what the suffixes ``low:high`` share."""
        low, high = low.copy(), high.copy()
        for k in reversed(range(len(self.least_lcp.table))):
            size = 1 << k
            can = low >= size
            at = np.where(can, low - size + 1, 0)
            low -= np.where(can & (self.least_lcp.table[k, at] >= length), size, 0)
            can = high + size <= self.n
            at = np.where(can, high, 0)
            high += np.where(can & (self.least_lcp.table[k, at] >= length), size, 0)
        return low, high

    def extended(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the interval with one symbol more in front."""
        found = self.bwt.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return self.before[symbol] + found[: len(low)], self.before[symbol] + found[len(low) :]

    def matching_statistics(self, streamed: list[np.ndarray], owners: np.ndarray, most: int) -> list[np.ndarray]:
        """For each place of each text the length, at most ``most``, of the longest match that starts there and occurs in an indexed text of
        a smaller owner. Symbols that the index doesn't have are 0. All texts go from right to left, and in each round each of them makes one
        step: a symbol more, or a shorter match."""
        sizes = np.array([len(x) for x in streamed], dtype=np.int64)
        owners = np.asarray(owners)
        flat = np.concatenate(streamed) if len(streamed) else np.zeros(0, np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        out = np.zeros(len(flat), dtype=np.int32)
        # of the texts that are not through: where they stand, their interval and its length
        at, first, owner = starts[1:] - 1, starts[:-1], owners
        low, high, length = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n, np.int64), np.zeros(len(sizes), np.int64)
        while True:
            going = at >= first
            if not going.all():
                at, first, owner, low, high, length = (x[going] for x in (at, first, owner, low, high, length))
            if not len(at):
                break
            symbol = flat[at]
            a, b = self.extended(symbol, low, high)
            good = (a < b) & (symbol > 0)
            some = np.flatnonzero(good)
            good[some] = self.least_owner(a[some], b[some]) < owner[some]
            low, high, length = np.where(good, a, low), np.where(good, b, high), length + good
            lost = ~good & (symbol == 0)
            low[lost], high[lost], length[lost] = 0, self.n, 0
            shorter = ~good & (length > 0)
            change = np.flatnonzero(shorter | (length > most))
            if len(change):
                parent = np.maximum(0, np.maximum(self.lcp[low[change]], self.lcp[high[change]]))
                length[change] = np.where(shorter[change], parent, most)
                low[change], high[change] = self.widened(low[change], high[change], length[change])
            moved = ~shorter
            out[at[moved]] = length[moved]
            at = at - moved
        return np.split(out, starts[1:-1]) if len(streamed) else []


# ---- words and stretches


class Words:
    """A text's words: hashes and, joined by one space, their bytes."""

    def __init__(self, text: bytes):
        data = np.frombuffer(text, dtype=np.uint8)
        step = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
        start, end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        self.n = len(start)
        size = end - start
        self.place = np.concatenate(([0], np.cumsum(size + 1)))
        joined = np.full(self.place[-1], 0x20, dtype=np.uint8)
        inside = np.ones(len(joined), dtype=bool)
        inside[self.place[1:] - 1] = False
        joined[inside] = data[~_SPACE[data]]
        self.flat = joined.tobytes()
        self.hashes = mix(between(byte_sums(joined), self.place[:-1], self.place[1:] - 1) + size.astype(np.uint64)) if self.n else np.zeros(0, np.uint64)

    def stretch(self, start: int, end: int) -> bytes:
        return self.flat[self.place[start] : self.place[end] - 1]


def stretches_of(words: np.ndarray, window: int, digit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and digit of each run of windows that share their digit."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = mix(windows(sums(words), digit))
    least, where = hashes.copy(), np.arange(len(hashes))
    span, reach = window - digit + 1, 1
    while reach < span:
        step = min(reach, span - reach)
        right = least[step:] < least[:-step]  # of equal ones the left one
        where = np.where(right, where[step:], where[:-step])
        least = np.where(right, least[step:], least[:-step])
        reach += step
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    return first, np.diff(np.concatenate((first, [len(where)]))), least[first]


def whole(x: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(x)).view(np.int64))


# ---- Spark

#: A stretch of windows: digit, hash of the whole, document, number of windows, places in the document, whether a smaller document of the task has it.
_ROWS = pa.schema(
    [("h", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("crc", pa.int64()), ("size", pa.int32()), ("starts", pa.list_(pa.int32())), ("again", pa.bool_())]
)
_ROWS_DDL = "h long, c long, doc_id long, crc long, size int, starts array<int>, again boolean"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (h, c, doc_id, crc, size, start) of a task, each document's equal ones as one."""
    h, c, doc, crc, size, start = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((start, crc, doc, c, h))
    h, c, doc, crc, size, start = (x[order] for x in (h, c, doc, crc, size, start))
    other = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
    new = other | np.concatenate(([True], (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1])))
    least = doc[np.maximum.accumulate(np.where(other, np.arange(len(other)), 0))]
    at = np.flatnonzero(new)
    once = np.concatenate(([True], new[1:] | (start[1:] != start[:-1])))  # the same place of an equal row counts once
    offsets = np.concatenate((np.concatenate(([0], np.cumsum(once)))[at], [int(once.sum())]))
    starts = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(start[once].astype(np.int32)))
    columns = [pa.array(x[at]) for x in (h, c, doc, crc)] + [pa.array(size[at].astype(np.int32)), starts, pa.array((doc > least)[at])]
    return pa.RecordBatch.from_arrays(columns, schema=_ROWS)


def _gathered(found):
    rows, held = [], 0
    for size, new in found:
        if len(new[0]):
            rows.append(new)
        held += size
        if held >= CHUNK and rows:
            yield _sent(rows)
            rows, held = [], 0
    if rows:
        yield _sent(rows)


def _same(text: bytes, doc: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full(n, doc, dtype=np.int64), np.full(n, zlib.crc32(text), dtype=np.int64)


def stretches(docs: DataFrame, window: int, digit: int) -> DataFrame:
    def find(batches):
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                words = Words(text)
                start, size, h = stretches_of(words.hashes, window, digit)
                ends = (start + size + window - 1).tolist()
                c = np.array([whole(words.stretch(a, b)) for a, b in zip(start.tolist(), ends, strict=True)], dtype=np.int64)
                yield len(text), (h.view(np.int64), c, *_same(text, doc, len(start)), size, start)

    return docs.mapInArrow(lambda batches: _gathered(find(batches)), _ROWS_DDL)


def decided(rows: DataFrame, n: int) -> DataFrame:
    """Whether a smaller document has the same stretch, over all tasks: one row a task and stretch has to meet, at most."""
    first = F.min("doc_id").over(Window.partitionBy("h", "c"))
    new = rows.where("not again").repartition(n, "h", "c").withColumn("again", F.col("doc_id") > first)
    return new.unionByName(rows.where("again"), allowMissingColumns=True)


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``crc`` and the text as one Zstandard frame: texts are dealt out by document, and only the tasks that cut them read them."""

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            plain = as_bytes(batch.column("text"))
            columns = [batch.column("doc_id"), pa.array([zlib.crc32(x) for x in plain], pa.int64()), pa.array([press.compress(x) for x in plain], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "crc", "packed"])

    return docs.mapInArrow(pack, "doc_id long, crc long, packed binary")


def _plain(batch: pa.RecordBatch) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(x) for x in batch.column("packed").to_pylist()]


_ASKED = ("h", "c", "size", "starts", "shard", "role")
#: Whether a stretch is searched for, indexed, or both.
SEARCHED, INDEXED = 1, 2


def _with_texts(asked: DataFrame, dealt: DataFrame) -> DataFrame:
    lists = asked.groupBy("doc_id", "crc").agg(F.collect_list(F.struct(*_ASKED)).alias("asked"))
    return dealt.join(lists, ["doc_id", "crc"])


def _asked(batches):
    for batch in batches:
        for text, doc, asked in zip(_plain(batch), batch.column("doc_id").to_pylist(), batch.column("asked").to_pylist(), strict=True):
            yield doc, text, asked


def single_windows(asked: DataFrame, window: int) -> DataFrame:
    """The windows of these stretches, each by its own hash."""

    def find(batches):
        for doc, text, found in _asked(batches):
            words = Words(text)
            at = np.unique(np.concatenate([np.arange(a, a + x["size"]) for x in found for a in x["starts"]]))
            digests = b"".join([xxhash.xxh3_128_digest(words.stretch(a, a + window)) for a in at.tolist()])
            both = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
            yield 64 * len(at), (both[:, 0], both[:, 1], *_same(text, doc, len(at)), np.ones(len(at), np.int32), at)

    return asked.mapInArrow(lambda batches: _gathered(find(batches)), _ROWS_DDL)


def texts_of_stretches(asked: DataFrame, window: int) -> DataFrame:
    def cut(batches):
        for doc, text, found in _asked(batches):
            words, crc = Words(text), zlib.crc32(text)
            for k in range(0, len(found), 1_000):
                some = found[k : k + 1_000]
                plain = [words.stretch(x["starts"][0], x["starts"][0] + x["size"] + window - 1) for x in some]
                own = [[x[c] for x in some] for c in ("shard", "role", "starts")]
                kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()))
                columns = [pa.array(x, t) for x, t in zip(own, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([doc] * len(some), pa.int64()), pa.array([crc] * len(some), pa.int64()), pa.array(plain, pa.binary())], ["shard", "role", "starts", "doc_id", "crc", "words"]
                )

    return asked.mapInArrow(cut, "shard long, role int, starts array<int>, doc_id long, crc long, words binary")


def _hashes(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and whose they are."""
    flat = np.frombuffer(b" ".join([x["words"] for x in rows]) + b" ", dtype=np.uint8)
    end = np.flatnonzero(flat == 0x20)
    start = np.concatenate(([0], end[:-1] + 1))
    counts = [x["words"].count(b" ") + 1 for x in rows]
    return between(byte_sums(flat), start, end), np.repeat(np.arange(len(rows)), counts)


def search(rows: list[dict], window: int) -> list[tuple[int, int, int, int]]:
    """One shard: (doc_id, crc, first window, windows) of what stands in earlier documents."""
    roles = np.array([x["role"] for x in rows])
    indexed, searched = np.flatnonzero(roles & INDEXED), np.flatnonzero(roles & SEARCHED)
    if not len(indexed) or not len(searched):
        return []
    hashes, of = _hashes(rows)
    known = np.unique(hashes[(roles & INDEXED > 0)[of]])
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    symbols = np.split(np.where(known[at] == hashes, at + 1, 0), np.flatnonzero(np.diff(of)) + 1)
    owners = np.unique(np.array([x["doc_id"] for x in rows], dtype=np.int64), return_inverse=True)[1]
    index = FMIndex([symbols[i] for i in indexed], owners[indexed])
    found = index.matching_statistics([symbols[i] for i in searched], owners[searched], window)
    out = []
    for i, lengths in zip(searched.tolist(), found, strict=True):
        edge = np.diff(np.concatenate(([0], lengths >= window, [0])).astype(np.int8))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            out += [(rows[i]["doc_id"], rows[i]["crc"], start + a, b - a) for start in rows[i]["starts"]]
    return out


def searched(stretched: DataFrame, tasks: int, window: int) -> DataFrame:
    """Index and search shard by shard."""

    def run(batches):
        now, held = None, []

        def result():
            columns = list(zip(*search(held, window), strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["doc_id", "crc", "place", "size"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != now:
                    if held:
                        yield result()
                    now, held = row["shard"], []
                held.append(row)
        if held:
            yield result()

    return stretched.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(run, "doc_id long, crc long, place int, size int")


def repeated_windows(docs: DataFrame, window: int = WINDOW, digit: int = DIGIT, crowd: int = CROWD, shard: int = SHARD) -> DataFrame:
    """``docs`` (doc_id, text, from ``texts``) as doc_id, crc, ``packed`` text and ``places``, ``sizes``: runs of windows that a smaller
    document has too, by their first word; null where there are none."""
    n = partitions(docs.sparkSession)
    rows = written(stretches(docs.where(F.col("doc_id") != NO_ID), window, digit), "stretches")
    digits = rows.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.when(~F.col("again"), 1)).alias("k")).where("low < high")
    met = rows.where("not again").join(digits, "h").unionByName(rows.where("again"), allowMissingColumns=True)
    known = written(decided(met, n), "decided")

    role = F.when(F.col("doc_id") > F.col("low"), SEARCHED).otherwise(0) + F.when(F.col("doc_id") < F.col("high"), INDEXED).otherwise(0)
    new = known.where("not again").withColumn("role", role)
    total = new.where(F.col("k") <= crowd).agg(F.sum(F.col("size") + window - 1)).first()[0] or 0
    shards = max(1, -(-total // shard))
    asked = new.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    # one plan from here on: the texts are dealt out by document once and read three times
    dealt = packed(docs)
    by_index = searched(texts_of_stretches(_with_texts(asked.where(F.col("k") <= crowd), dealt), window), int(max(n, min(shards, 100 * n))), window)
    crowded = decided(single_windows(_with_texts(asked.where(F.col("k") > crowd), dealt), window), n)
    repeats = known.where("again").unionByName(crowded.where("again"), allowMissingColumns=True)
    runs = repeats.select("doc_id", "crc", F.explode("starts").alias("place"), "size").union(by_index)
    lists = runs.groupBy("doc_id", "crc").agg(F.collect_list(F.struct("place", "size")).alias("runs"))
    return dealt.join(lists, ["doc_id", "crc"], "left").select("doc_id", "crc", "packed", F.col("runs.place").alias("places"), F.col("runs.size").alias("sizes"))


def kept_words(n: int, places: list[int] | None, sizes: list[int] | None, window: int) -> np.ndarray:
    """Which of n words no run of windows covers."""
    if not places:
        return np.ones(n, dtype=bool)
    place, size = np.array(places, dtype=np.int64), np.array(sizes, dtype=np.int64)
    change = np.bincount(place, minlength=n + 1) - np.bincount(place + size + window - 1, minlength=n + 1)
    return np.cumsum(change)[:n] == 0


def _left(batch: pa.RecordBatch, window: int):
    """(words, which of them stay) of each row."""
    for text, places, sizes in zip(_plain(batch), batch.column("places").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
        words = Words(text)
        yield words, kept_words(words.n, places, sizes, window)


def _said(words: Words, kept: np.ndarray) -> bytes:
    """The words that stay, joined by one space."""
    edge = np.diff(np.concatenate(([0], kept, [0])).astype(np.int8))
    return b" ".join([words.stretch(a, b) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)])


def without_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and text of ``docs`` without the passages of ``window`` words or more that a smaller document has; words joined by one space."""

    def cut(batches):
        for batch in batches:
            left = [_said(*x).decode() for x in _left(batch, window)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(left, pa.string())], ["doc_id", "text"])

    return repeated_windows(texts(docs), window).mapInArrow(cut, "doc_id long, text string").select(own_id(), "text")


_SQL = r"""
WITH worded AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spans AS (SELECT row, doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM worded WHERE len(w) >= 50 AND doc_id IS NOT NULL),
hashed AS (SELECT row, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM spans),
earlier AS (SELECT row, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least FROM hashed) WHERE doc_id > least),
gone AS (SELECT DISTINCT row, unnest(range(i, i + 50)) AS i FROM earlier),
lists AS (SELECT row, list(i) AS g FROM gone GROUP BY row),
kept AS (SELECT doc_id, len(w) AS n_words, CASE WHEN g IS NULL THEN 0 ELSE len(g) END AS n_removed,
    CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END AS k FROM worded LEFT JOIN lists ON lists.row = worded.row)
SELECT doc_id, n_words::bigint AS n_words, n_removed::bigint AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""


@query("op11_fm_substring_dedup", _SQL)
def fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, removed words, and the SHA-256 of what is left."""

    def digest(batches):
        for batch in batches:
            n, gone, kept = [], [], []
            for words, stay in _left(batch, WINDOW):
                n.append(words.n)
                gone.append(words.n - int(stay.sum()))
                kept.append(hashlib.sha256(_said(words, stay)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    found = repeated_windows(texts(table(spark, sf_dir, "documents"))).mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return found.select(own_id(), "n_words", "n_removed", "kept_sha256")
