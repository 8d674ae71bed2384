"""Passages of a benchmark in documents, by q-gram counts in diagonal bands and banded alignment.

An item of m characters occurs in a document with at most k = ``ERRORS`` * m edits only if the two share at least
t = m + 1 - q - k * q of their q-grams (q-gram lemma), all of them on diagonals (place in the document minus place in the item)
within k of each other. So diagonals are cut into bands 2 * (k + 1) wide that overlap by half; each such range lies in one band. A
band with t different item q-grams is a region that may hold the item, and an alignment within the band's
diagonals tells whether it does, and where. k is lowered for short items so that t is at least 1.

Texts and items are compared in lower case, with each stretch of white space as one blank. Documents are read once and not shuffled. The
items are collected in slices of at most ``SLICE`` characters; the index of a slice goes to the tasks, and each further slice is
one more step over the same rows.

Items of fewer than q characters are looked for in the same pass as whole words, without edits: neither end lies within a word.

Defined cases: null and empty texts contain nothing; items without text are not looked for; equal
items are found under each of their ids; several occurrences of an item in a document give a row each, unless they overlap;
equal rows give equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import mix, own_id, short_batches, sums, table, texts, windows
from vigil.llm.registry import query

Q = 12
ERRORS = 0.06
#: Characters of benchmark text in one index.
SLICE = 4_000_000
#: Characters of a document that are looked up at once.
BLOCK = 1 << 20

_SLOTS = 22
_START = re.compile(r"\b\w|[^\w\s]")
_WITHIN = re.compile(r"\w\w")


def plain(text: str) -> tuple[str, np.ndarray | None]:
    """The text as it is compared, and the place in the original of each of its characters (None: the same)."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower()[:1] or c for c in text)
    if "  " not in low and not any(c in low for c in "\t\n\r\x0b\x0c\xa0\x85  　"):
        return low, None
    blank = np.array([c.isspace() for c in low], dtype=bool) if not low.isascii() else np.isin(np.frombuffer(low.encode(), np.uint8), (9, 10, 11, 12, 13, 28, 29, 30, 31, 32))
    stays = ~(blank & np.concatenate(([False], blank[:-1])))
    signs = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    signs[blank] = 32
    return signs[stays].tobytes().decode("utf-32-le", "surrogatepass"), np.flatnonzero(stays)


def grams(text: str, q: int) -> np.ndarray:
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return windows(sums(mix(signs + np.uint64(1))), q)


class Index:
    """The q-grams of some items. ``items``: (id, text as it is compared)."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, errors: float = ERRORS):
        self.items, self.q = [x for x in items if len(x[1]) >= q], q
        # items shorter than a q-gram, behind the others
        self.short: dict[str, list[int]] = {}
        short = [x for x in items if 0 < len(x[1]) < q]
        for i, (_, t) in enumerate(short, len(self.items)):
            self.short.setdefault(t, []).append(i)
        self.lengths = sorted({len(t) for t in self.short})
        size = np.array([len(t) for _, t in self.items], dtype=np.int64)
        self.budget = np.minimum((size * errors).astype(np.int64), (size - q) // q)
        self.least = size + 1 - q - self.budget * q
        found = [grams(t, q) for _, t in self.items]
        hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(found)), [len(x) for x in found]) if found else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(x)) for x in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.start, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.slots = np.zeros(1 << _SLOTS, dtype=bool)
        self.slots[self._slot(self.grams)] = True
        self.items = self.items + short

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def hits(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the item, place in the text) of each q-gram that the two share."""
        parts = []
        for begin in range(0, max(1, len(text) - self.q + 1), BLOCK):
            found = grams(text[begin : begin + BLOCK + self.q - 1], self.q)
            at = np.flatnonzero(self.slots[self._slot(found)]) if len(self.grams) else np.zeros(0, np.int64)
            row = np.minimum(np.searchsorted(self.grams, found[at]), max(0, len(self.grams) - 1))
            if len(at):
                same = self.grams[row] == found[at]
                at, row = at[same], row[same]
            n = self.count[row] if len(at) else np.zeros(0, np.int64)
            entry = np.repeat(self.start[row], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) if len(at) else np.zeros(0, np.int64)
            parts.append((self.item[entry], self.place[entry], np.repeat(at, n) + begin))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def occurrences(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) in the text as it is compared."""
        return self._long(text) + self._short(text)

    def _short(self, text: str) -> list[tuple[int, int, int, int]]:
        found, free = [], {}
        for m in _START.finditer(text) if self.short else ():
            for n in self.lengths:
                start, end = m.start(), m.start() + n
                if end > len(text):
                    break
                if _WITHIN.match(text, end - 1):
                    continue
                for i in self.short.get(text[start:end], ()):
                    if free.get(i, 0) <= start:
                        found.append((i, start, end, 0))
                        free[i] = end
        return found

    def _long(self, text: str) -> list[tuple[int, int, int, int]]:
        item, place, at = self.hits(text)
        if not len(item):
            return []
        enough = np.bincount(item, minlength=len(self.items))[item] >= self.least[item]
        item, place, at = item[enough], place[enough], at[enough]
        half = self.budget[item] + 1
        band = (at - place) // half
        rows = np.concatenate((np.stack((item, band, place)), np.stack((item, band - 1, place))), axis=1).T
        regions, shared = np.unique(np.unique(rows, axis=0)[:, :2], axis=0, return_counts=True)
        found = []
        for (i, b), n in zip(regions.tolist(), shared.tolist(), strict=True):
            if n < self.least[i]:
                continue
            step = int(self.budget[i]) + 1
            hit = align(self.items[i][1], text, b * step, (b + 2) * step - 1, int(self.budget[i]))
            if hit and not any(j == i and s < hit[1] and hit[0] < e for j, s, e, _ in found):
                found.append((i, *hit))
        return found


def align(item: str, text: str, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """The best place of ``item`` in ``text`` on diagonals ``low .. high``, if it takes at most ``budget`` edits."""
    exact = text.find(item, max(0, low), max(0, high) + len(item))
    if exact >= 0:
        return exact, exact + len(item), 0
    # widened by the budget on both sides: an alignment may leave the diagonals of its q-grams by its edits
    low, high = low - budget, high + budget
    width, far = high - low + 1, len(item) + len(text) + 1
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    step = np.arange(width)
    # cost[d] after i characters of the item: the text read up to i + low + d
    cost = np.where((low + step >= 0) & (low + step <= len(text)), 0, far)
    begin = low + step
    for i, sign in enumerate(np.frombuffer(item.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)):
        at = i + low + step  # the text's character that this diagonal reads
        inside = (at >= 0) & (at < len(text))
        swap = cost + np.where(inside, signs[np.clip(at, 0, max(0, len(text) - 1))] != sign, far)
        skip = np.concatenate((cost[1:], [far])) + 1  # the item's character has no counterpart
        skip[(at + 1 < 0) | (at + 1 > len(text))] = far
        best = np.where(swap <= skip, swap, skip)
        origin = np.where(swap <= skip, begin, np.concatenate((begin[1:], [0])))
        # characters of the text without counterpart: along the row, from the left
        run = np.minimum.accumulate(best - step)
        from_ = np.maximum.accumulate(np.where(best - step == run, step, 0))
        cost, begin = np.where(inside | (at == len(text)), run + step, far), origin[from_]
        cost = np.minimum(cost, far)
        if cost.min() > budget:
            return None
    d = int(cost.argmin())
    return int(begin[d]), len(item) - 1 + low + d + 1, int(cost[d])


def slices(benchmark: DataFrame, size: int = SLICE) -> Iterator[list[tuple[int, str]]]:
    held, items = 0, []
    for row in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        text = plain(row.text)[0].strip()
        items.append((row.item_id, text))
        held += len(text)
        if held >= size:
            yield items
            held, items = 0, []
    if items:
        yield items


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``start``, ``end`` (characters of the document) and ``edits`` of each occurrence."""
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start long, end long, edits int")
    for items in slices(benchmark):
        out = out.union(_matches(docs, Index(items)))
    return out


def _matches(docs: DataFrame, index: Index) -> DataFrame:
    def find(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                low, place = plain(text)
                for i, start, end, edits in index.occurrences(low):
                    if place is not None:
                        start, end = int(place[start]), int(place[end - 1]) + 1
                    rows.append((doc, index.items[i][0], start, end, edits))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start", "end", "edits"])

    return docs.mapInArrow(find, "doc_id long, item_id long, start long, end long, edits int")


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with all their columns."""
    short_batches(docs.sparkSession)
    for items in slices(benchmark):
        docs = _uncontaminated(docs, Index(items))
    return docs


def _uncontaminated(docs: DataFrame, index: Index) -> DataFrame:
    def keep(batches):
        for batch in batches:
            found = pc.fill_null(batch.column("text"), "").to_pylist()
            yield batch.filter(pa.array([not index.occurrences(plain(t)[0]) for t in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


@query("op3_decontaminate")
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages in the documents."""
    return matches(texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")).select(own_id(), "item_id", "start", "end", "edits")
