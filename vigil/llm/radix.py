"""Repeated strings of ``DEPTH`` bytes, by a radix sort of suffixes that goes no deeper than that.

The suffixes are those that have ``DEPTH`` bytes left. Their digits are not single bytes. The first digit of a suffix is the
``DIGIT``-byte string that has the smallest hash within the suffix's first ``DEPTH`` bytes (the leftmost of equal ones), with its
place in it: equal suffixes have equal first digits, and neighbouring suffixes share theirs, so a stretch of suffixes travels as one row.

Pass 1 deals stretches out by first digit and sorts them. A digit that occurs once ends there: its suffixes are unique. Within a
digit, a stretch that occurs again as a whole is repeated, all but its first occurrence. The first occurrences of different
stretches with one digit go on. Pass 2 does the same with a longer digit: of the bytes around the first one, a suffix has at least half before
it or half behind it, so each stretch goes on as two, with those bytes added to the digit. Pass 3 takes all ``DEPTH`` bytes of single
suffixes; groups of equal ones are the repeated strings, and all but the first suffix of a group are repeats. Digits and what
follows them are compared by 64-bit hashes each, so equal means equal in 128 bits.

A task first sorts what it has itself: of equal stretches or suffixes it sends only the first, and a digit that it has with
several stretches is dealt out by stretch, with one mark under the digit. So no passage, however common, makes a
large group: each task sends a row of it at most.

Order: smaller doc_id, then the CRC-32 of the text, then place. Defined cases: a null text is empty; texts shorter than ``DEPTH`` have no
repeats; rows with equal id and text are one document, and each of them gets its result; different texts under one id are different
documents; rows without an id come first; further columns are ignored; an empty table gives an empty result.
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

from vigil.llm.common import NO_ID, as_bytes, byte_sums, mix, own_id, partitions, short_batches, table, texts, windows
from vigil.llm.registry import query
from vigil.streaming.storage import written

DEPTH = 100
DIGIT = 32
#: A long text is taken in blocks of so many suffixes.
BLOCK = 1 << 20
#: Bytes of text that a task sorts at once before it sends.
CHUNK = 32 << 20

_PLACE = np.uint64((1 << 24) - 1)
#: What neighbouring rows share stands together, and so does what they don't: ``head`` is kind of row and CRC of the text, ``spot`` the
#: place in the text, size of the stretch and place of its digit.
_COLUMNS = ["doc_id", "head", "digit", "rest", "spot"]
_SCHEMA = "doc_id long, head long, digit long, rest long, spot long"
#: In a task: the size of the stretch below this, the place of its digit above it.
_SIZE = 1 << 16
_KIND = 32
_LOW = (1 << 32) - 1
#: kinds of rows: a stretch under its digit, one dealt out by stretch, a mark, a repeat that the task found itself
STRETCH, DEALT, MARK, REPEAT = 0, 1, 2, 3


def stretches(text: bytes, depth: int, digit: int):
    """(start, end, place of the digit, hash of the digit) of the suffixes ``start .. end`` that share a first digit."""
    for begin in range(0, len(text) - depth + 1, BLOCK):
        data = np.frombuffer(text, dtype=np.uint8)[begin : begin + BLOCK + depth - 1]
        hashes = windows(byte_sums(data), digit)
        # the smallest hash of each suffix's digits, and where it stands: places make equal hashes rank from the left
        least = (mix(hashes) & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        span, reach = depth - digit + 1, 1
        while reach < span:
            step = min(reach, span - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        place = (least & _PLACE).astype(np.int64)
        start = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        end = np.concatenate((start[1:], [len(place)])) - 1
        yield start + begin, end + begin, place[start] + begin, hashes[place[start]]


def _hashes(text: bytes, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """128-bit hash of each ``start:end``, as two columns."""
    digest = xxhash.xxh3_128_digest
    found = b"".join([digest(text[a:b], s) for a, b, s in zip(start.tolist(), end.tolist(), seed.tolist(), strict=True)])
    return np.frombuffer(found, dtype=np.int64).reshape(-1, 2)


def _send(rows: list[tuple], depth: int) -> pa.RecordBatch:
    """Sort a task's own rows (digit, rest, doc_id, at, size): repeats within it are known, what else there is is dealt out."""
    digit, rest, doc, at, size = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((at, doc, rest, digit))
    digit, rest, doc, at, size = (x[order] for x in (digit, rest, doc, at, size))
    other = np.concatenate(([True], digit[1:] != digit[:-1]))
    new = other | np.concatenate(([True], rest[1:] != rest[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    once = new | (doc != doc[first]) | (at != at[first])  # the same place of an equal row is no repeat
    digit, rest, doc, at, size, other, new = (x[once] for x in (digit, rest, doc, at, size, other, new))
    group = np.cumsum(other) - 1
    several = (np.bincount(group, weights=new) > 1)[group]
    kind = np.where(~new, REPEAT, np.where(several, DEALT, STRETCH))
    head = (kind << _KIND) + (at >> 32) + (1 << 31)
    spot = ((at & _LOW) * (depth + 1) + size % _SIZE) * (depth + 1) + size // _SIZE
    marked = digit[other & several]
    zero = np.zeros(len(marked), dtype=np.int64)
    # sent in the order of the texts: neighbouring ids and places compress well
    back = np.argsort(order[once])
    parts = ((doc, zero), (head, zero + (MARK << _KIND)), (digit, marked), (rest, zero), (spot, zero))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate((x[back], y))) for x, y in parts], _COLUMNS)


def _gathered(found, depth: int):
    """Send rows in chunks; ``found`` yields (bytes of text, rows)."""
    rows, held = [], 0
    for size, new in found:
        rows += new
        held += size
        if held >= CHUNK and rows:
            yield _send(rows, depth)
            rows, held = [], 0
    if rows:
        yield _send(rows, depth)


def _at(text: bytes, place: np.ndarray) -> np.ndarray:
    """Place in the order within an id: CRC-32 of the text, then the place in it."""
    return (np.int64(zlib.crc32(text) - (1 << 31)) << 32) + place


def first_digits(docs: DataFrame, depth: int, digit: int) -> DataFrame:
    def find(batches):
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                rows = []
                for start, end, place, hashes in stretches(text, depth, digit):
                    rest = _hashes(text, start, end + depth, place - start)
                    size = end - start + 1 + (place - start) * _SIZE
                    rows.append((hashes.view(np.int64), rest[:, 0], np.full(len(start), doc, dtype=np.int64), _at(text, start), size))
                yield len(text), rows

    return docs.mapInArrow(lambda batches: _gathered(find(batches), depth), _SCHEMA)


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``crc`` and the text as one Zstandard frame: texts are dealt out by document, and only the tasks that cut them read them."""

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            plain = as_bytes(batch.column("text"))
            crc, frames = [zlib.crc32(x) - (1 << 31) for x in plain], [press.compress(x) for x in plain]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(crc, pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "crc", "packed"])

    return docs.mapInArrow(pack, "doc_id long, crc long, packed binary")


def _plain(batch: pa.RecordBatch) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(x) for x in batch.column("packed").to_pylist()]


def _asked(batches):
    """(doc_id, text, starts, sizes, places of the digit behind the starts)."""
    for batch in batches:
        lists = (batch.column(c).to_pylist() for c in ("doc_id", "places", "sizes"))
        for text, doc, places, sizes in zip(_plain(batch), *lists, strict=True):
            shape = np.array(sizes, dtype=np.int64)
            yield doc, text, np.array(places, dtype=np.int64), shape % _SIZE, shape // _SIZE


def longer_digits(asked: DataFrame, depth: int, digit: int) -> DataFrame:
    """The stretches that go on, in two: suffixes with at least half of what is around the digit before it, and the others."""
    around = depth - digit
    half = around // 2

    def find(batches):
        for doc, text, start, size, behind in _asked(batches):
            place, end, rows = start + behind, start + size - 1, []
            for side, (low, high, a, b) in enumerate(
                ((start, np.minimum(end, place - half), place - half, place + digit), (np.maximum(start, place - half + 1), end, place, place + digit + around - half))
            ):
                some = low <= high
                low, high, a, b, at = low[some], high[some], a[some], b[some], place[some]
                more = _hashes(text, a, b, np.full(len(a), side))
                rest = _hashes(text, low, high + depth, at - low)
                rows.append((more[:, 0], rest[:, 0], np.full(len(low), doc, dtype=np.int64), _at(text, low), high - low + 1))
            yield len(start) * 160, rows

    return asked.mapInArrow(lambda batches: _gathered(find(batches), depth), _SCHEMA)


def suffixes(asked: DataFrame, depth: int) -> DataFrame:
    """Single suffixes of the stretches that go on."""

    def find(batches):
        for doc, text, places, sizes, _ in _asked(batches):
            start = np.concatenate([np.arange(p, p + n) for p, n in zip(places.tolist(), sizes.tolist(), strict=True)])
            s = _hashes(text, start, start + depth, np.zeros_like(start))
            yield len(start) * 32, [(s[:, 0], s[:, 1], np.full(len(start), doc, dtype=np.int64), _at(text, start), np.ones(len(start), dtype=np.int64))]

    return asked.mapInArrow(lambda batches: _gathered(find(batches), depth), _SCHEMA)


def decided(sent: DataFrame, n: int, depth: int) -> DataFrame:
    """Of each stretch: whether it is a ``repeat``; those that are neither that nor unique go on."""
    digit = Window.partitionBy("key", "digit").orderBy("rest", "doc_id", "at")
    whole = digit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    equal = Window.partitionBy("key", "digit", "rest").orderBy("doc_id", "at")
    kind, base = F.shiftright("head", _KIND), depth + 1
    key = F.when(kind == DEALT, F.col("rest")).when(kind == REPEAT, F.xxhash64("doc_id", "spot")).otherwise(F.col("digit"))
    # a row travels without what follows from the rest of it
    dealt = sent.repartition(n, key, "digit").select(
        "doc_id", "digit", "rest", key.alias("key"), kind.alias("kind"),
        (F.shiftleft(F.col("head").bitwiseAND(F.lit(_LOW)) - F.lit(1 << 31), 32) + F.expr(f"spot div {base * base}L")).alias("at"),
        (F.expr(f"spot div {base}L") % base + F.col("spot") % base * _SIZE).cast("int").alias("size"),
    )
    kind = F.col("kind")
    found = (
        dealt.withColumn("rank", F.rank().over(equal))
        .withColumn("several", F.first("rest").over(whole) != F.last("rest").over(whole))
        .where(kind != MARK).withColumn("repeat", (kind == REPEAT) | (F.col("rank") > 1))
        .where(F.col("repeat") | F.col("several") | (kind == DEALT))
    )
    return found.select("doc_id", F.shiftright("at", 32).alias("crc"), F.col("at").bitwiseAND(F.lit(_LOW)).alias("place"), "size", "repeat")


def per_text(rows: DataFrame) -> DataFrame:
    both = F.collect_list(F.shiftleft("place", 32) + F.col("size"))
    lists = rows.groupBy("doc_id", "crc").agg(both.alias("both"))
    return lists.select(
        "doc_id", "crc", F.transform("both", lambda x: F.shiftright(x, 32)).alias("places"),
        F.transform("both", lambda x: x.bitwiseAND(F.lit(_LOW)).cast("int")).alias("sizes"),
    )


def packed_repeats(docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT) -> DataFrame:
    """``docs`` (doc_id, text, from ``texts``), texts ``packed``, with ``places`` and ``sizes`` of the stretches of suffixes that also
    start earlier; null where there are none."""
    n = partitions(docs.sparkSession)
    one = written(decided(first_digits(docs, depth, digit), n, depth), "stretches")
    # one plan from here on: the texts are dealt out by document once and read three times
    dealt = packed(docs)

    def going_on(rows: DataFrame) -> DataFrame:
        return dealt.join(per_text(rows.where("not repeat")), ["doc_id", "crc"])

    two = decided(longer_digits(going_on(one), depth, digit), n, depth)
    three = decided(suffixes(going_on(two), depth), n, depth)
    found = one.union(two).union(three).where("repeat").withColumn("size", (F.col("size") % F.lit(_SIZE)).cast("int"))
    return dealt.join(per_text(found), ["doc_id", "crc"], "left").select("doc_id", "packed", "places", "sizes")


def repeats(docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT) -> DataFrame:
    """``packed_repeats`` with the texts as such: doc_id, text, places, sizes."""

    def unpack(batches):
        for batch in batches:
            text = pa.array([x.decode() for x in _plain(batch)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text, batch.column("places"), batch.column("sizes")], ["doc_id", "text", "places", "sizes"])

    return packed_repeats(docs, depth, digit).mapInArrow(unpack, "doc_id long, text string, places array<long>, sizes array<int>")


def covered(places: list[int] | None, sizes: list[int] | None, depth: int) -> list[tuple[int, int]]:
    """The bytes that the strings of these stretches cover, as maximal runs."""
    if not places:
        return []
    order = np.argsort(places, kind="stable")
    start = np.array(places, dtype=np.int64)[order]
    end = np.maximum.accumulate(start + np.array(sizes, dtype=np.int64)[order] - 1 + depth)
    first = np.concatenate(([True], start[1:] > end[:-1]))
    return list(zip(start[first].tolist(), end[np.concatenate((np.flatnonzero(first)[1:] - 1, [len(end) - 1]))].tolist(), strict=True))


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for start, end in runs:
        kept.append(text[at:start])
        at = end
    return b"".join((*kept, text[at:]))


def whole_signs(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the parts of characters at their ends."""
    out = []
    for start, end in runs:
        while start < end and start < len(text) and text[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        if start < end:
            out.append((start, end))
    return out


@query("op10_radix_dedup")
def radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, and the SHA-256 of what is left."""

    def digest(batches):
        for batch in batches:
            size, gone, runs, kept = [], [], [], []
            for text, places, sizes in zip(_plain(batch), batch.column("places").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                found = covered(places, sizes, DEPTH)
                size.append(len(text))
                gone.append(sum(b - a for a, b in found))
                runs.append(len(found))
                kept.append(hashlib.sha256(without(text, found)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(kept, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    found = packed_repeats(texts(table(spark, sf_dir, "documents"))).mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return found.select(own_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their texts cut; ``n_chars``, where there is such a column, counts what is left.

    A repeated string goes as far as whole characters go. A null text stays null.
    """
    short_batches(docs.sparkSession)

    def cut(batches):
        for batch in batches:
            left, n = [], []
            for text, places, sizes in zip(_plain(batch), batch.column("places").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                kept = without(text, whole_signs(text, covered(places, sizes, DEPTH))).decode()
                left.append(kept)
                n.append(zlib.crc32(text) - (1 << 31))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(left, pa.string())], ["doc_id", "crc", "left"])

    found = packed_repeats(texts(docs)).where("places is not null").mapInArrow(cut, "doc_id long, crc long, left string").distinct()
    rows = docs.select(
        F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) - F.lit(1 << 31)).alias("crc"),
    ).join(found, ["doc_id", "crc"], "left")
    new = {"text": F.coalesce("left", "row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("left").isNotNull(), F.length("left")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
