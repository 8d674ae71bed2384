"""Phrases that occur more often than their parts would make them, counted by prefix-free parsing.

A text is a row of words, cut into pieces at punctuation. A *trigger* is a pair of words whose hash is divisible by ``EVERY``; so whether a
place is one depends on nothing but the words there. Chunks go from trigger to trigger: a chunk owns the words from its trigger up to
the next one and, as overlap behind a mark, as many of the following words as a phrase that starts in it can reach. Texts that share a
passage share its chunks, wherever the passage stands. The distinct chunks with the number of times the parse uses them are the
dictionary. Phrases are counted inside distinct chunks only, weighted by that number; a phrase belongs to the chunk that owns its first
word, so what lies in an overlap counts once.

Counting: a task takes a batch of the dictionary, reduces its phrases to sorted (hash, count) and sends one fragment per range of hashes. Phrases
are told apart by 96 bits. Each range is added up in one task, of about the same size for all; a phrase however common is one entry per
batch. The ranges grow in number with the dictionary. Only phrases that reach the least count get their words back: they are
looked up in the first batch that has them. From there on it is joins and windows over candidates.

Defined cases: a null text is empty, a null ``lang`` is ``und``; bytes other than the separators belong to words; equal rows count as often as they
occur; ties go as the contract says, phrases in order of UTF-8 bytes; ids and further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import as_bytes, between, byte_sums, mix, partitions, short_batches, sums, table
from vigil.llm.registry import query
from vigil.streaming.storage import new_folder

LONGEST = 3
LEAST = 10
SHARE = 50
TOP = 2_000
#: One pair of words in so many is a trigger.
EVERY = 32
#: Bytes of text that a task parses at once.
PARSED = 2 << 20
#: Bytes of chunks that a task counts at once.
BATCH = 2 << 20
#: Entries in a range of hashes, about.
RANGE = 1 << 20

#: What a byte is: 0 part of a word, 1 between words, 2 between pieces. Fixed values.
_KIND = np.zeros(256, dtype=np.int8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: In a chunk: between words, between pieces, before the overlap, behind the chunk. No word holds one of them.
SPACE, BREAK, MARK, END = b" ", b"\n", b"\x0b", b"\x0c"
#: A second hash of the same words.
_CHECK = np.random.Generator(np.random.PCG64(13)).integers(0, 2**64, 256, dtype=np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)


def _edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    word = np.concatenate(([0], _KIND[data] == 0, [0])).astype(np.int8)
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = (end - start).astype(np.uint64)
    return mix(between(byte_sums(data), start, end) + size), mix(between(sums(_CHECK[data]), start, end) + size)


def _then(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase with one word more."""
    return mix(h * _M + word)


def parse(texts: list[bytes], longest: int = LONGEST, every: int = EVERY) -> list[tuple[int, bytes, int]]:
    """(text, chunk, words the chunk owns) of all chunks of a batch of texts."""
    data = _LOWER[np.frombuffer(END.join(texts) + END, dtype=np.uint8)]
    start, end = _edges(data)
    if not len(start):
        return []
    n = len(start)
    # the text of each word and whether a piece or a text ends in front of it
    sizes = np.array([len(x) + 1 for x in texts])
    of = np.searchsorted(np.cumsum(sizes), start, side="right")
    breaks = np.concatenate(([0], np.cumsum(_KIND[data] == 2)))
    apart = np.ones(n + 1, dtype=bool)
    apart[1:n] = breaks[start[1:]] > breaks[end[:-1]]
    new = np.ones(n, dtype=bool)
    new[1:] = of[1:] != of[:-1]
    words = _hashes(data, start, end)[0]
    trigger = new.copy()
    trigger[:-1] |= _then(words[:-1], words[1:]) % np.uint64(every) == 0
    # words joined by one separator each
    size = end - start
    place = np.concatenate(([0], np.cumsum(size + 1)))
    joined = np.full(place[-1], SPACE[0], dtype=np.uint8)
    inside = np.ones(place[-1], dtype=bool)
    inside[place[1:] - 1] = False
    joined[inside] = data[np.repeat(start - place[:-1], size) + np.flatnonzero(inside)]
    joined[place[1:] - 1] = np.where(apart[1:], BREAK[0], SPACE[0])
    flat = joined.tobytes()
    first = np.flatnonzero(trigger)
    last = np.concatenate((first[1:], [n]))
    # the overlap: words behind the chunk in the piece of its last word
    over = last.copy()
    going = np.ones(len(last), dtype=bool)
    for _ in range(longest - 1):
        going &= ~apart[over]
        over += going
    begin, stop, reach = place[first], place[last] - 1, place[over] - 1
    return [
        (t, flat[a:b] + MARK + flat[b + 1 : c] if c > b else flat[a:b], k)
        for t, a, b, c, k in zip(of[first].tolist(), begin.tolist(), stop.tolist(), reach.tolist(), (last - first).tolist(), strict=True)
    ]


class Phrases:
    """The phrases of a batch of chunks: hashes, weights and where they stand."""

    def __init__(self, text: bytes, weights: np.ndarray, longest: int = LONGEST, salt: int = 0):
        data = np.frombuffer(text, dtype=np.uint8)
        word = np.isin(data, np.frombuffer(SPACE + BREAK + MARK + END, dtype=np.uint8), invert=True)
        step = np.diff(np.concatenate(([0], word, [0])).astype(np.int8))
        self.data, self.start, self.end = data, np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        n = len(self.start)
        cuts = np.concatenate(([0], np.cumsum((data == BREAK[0]) | (data == END[0]))))
        ends = np.concatenate(([0], np.cumsum(data == END[0])))
        marks = np.concatenate(([0], np.cumsum(data == MARK[0])))
        chunk = ends[self.start]
        # a chunk owns the words in front of its mark
        at_end = np.flatnonzero(data == END[0])
        before = marks[np.concatenate(([0], at_end + 1))][chunk]
        owned = marks[self.start] == before
        piece = cuts[self.start]
        h, g = _hashes(data, self.start, self.end)
        h, g = mix(h + np.uint64(salt)), g.copy()
        found = []
        now = (h.copy(), g.copy(), np.arange(n))
        for k in range(1, longest + 1):
            hs, gs, first = now
            own = owned[first]
            found.append((hs[own], gs[own], first[own], np.full(int(own.sum()), k)))
            if k == longest:
                break
            more = first + k < n
            more[more] = piece[first[more] + k] == piece[first[more]]
            first = first[more]
            now = (_then(hs[more], h[first + k]), _then(gs[more], g[first + k]), first)
        self.h, g, self.first, self.k = (np.concatenate(x) for x in zip(*found, strict=True))
        self.g = (g >> np.uint64(32)).astype(np.uint32)
        self.weight = weights[chunk[self.first]] if n else np.zeros(0, np.int64)

    def words(self, at: np.ndarray) -> list[str]:
        plain = self.data.tobytes()
        begin, stop = self.start[self.first[at]], self.end[self.first[at] + self.k[at] - 1]
        return [plain[a:b].replace(MARK, SPACE).decode() for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]


def added(h: np.ndarray, g: np.ndarray, n: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of ``n`` over equal (h, g), sorted by them, and the least of each further column."""
    if not len(h):
        return h, g, n, *more
    order = np.argsort(h, kind="stable")
    if ((h[order][1:] == h[order][:-1]) & (g[order][1:] != g[order][:-1])).any():
        order = np.lexsort((g, h))
    h, g = h[order], g[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
    return h[first], g[first], np.add.reduceat(n[order], first), *(np.minimum.reduceat(x[order], first) for x in more)


def _press(x: np.ndarray) -> bytes:
    """Sorted hashes as differences, counts as they are: both as columns of their bytes, empty columns left out."""
    parts = x.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = max([i + 1 for i in range(8) if parts[i].any()], default=1)
    return bytes([used]) + parts[:used].tobytes()


def _plain(data: bytes) -> np.ndarray:
    used = data[0]
    parts = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(used, -1)
    out = np.zeros((parts.shape[1], 8), dtype=np.uint8)
    out[:, :used] = parts.T
    return out.reshape(-1).view("<u8")


# ---- Spark


def chunks(docs: DataFrame, longest: int = LONGEST, every: int = EVERY) -> DataFrame:
    """lang, chunk and owned words of every chunk; equal ones of a batch as one with their number ``f``."""

    def run(batches):
        def send(langs, texts):
            count: dict[tuple[str, bytes, int], int] = {}
            for t, chunk, k in parse(texts, longest, every):
                key = (langs[t], chunk, k)
                count[key] = count.get(key, 0) + 1
            if count:
                lang, chunk, k = zip(*count, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang, pa.string()), pa.array(chunk, pa.binary()), pa.array(k, pa.int64()), pa.array(list(count.values()), pa.int64())], ["lang", "chunk", "words", "f"]
                )

        langs, held, size = [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True):
                langs.append(lang)
                held.append(text)
                size += len(text)
                if size >= PARSED:
                    yield from send(langs, held)
                    langs, held, size = [], [], 0
        if held:
            yield from send(langs, held)

    return docs.mapInArrow(run, "lang string, chunk binary, words long, f long")


def dictionary(docs: DataFrame, longest: int = LONGEST, every: int = EVERY) -> DataFrame:
    """The distinct chunks with their frequencies, packed: a row is a batch of one language (``no``, ``lang``, ``chunks``, ``f``, ``total`` of all
    owned words, weighted). ``docs``: lang and text, no nulls. A written table: what refers to ``no`` finds the same batch again."""
    distinct = chunks(docs, longest, every).groupBy("lang", "chunk", "words").agg(F.sum("f").alias("f"))

    def pack(batches):
        held: dict[str, tuple[list, list, list]] = {}
        sizes: dict[str, int] = {}

        def send(lang):
            own, f, total = held.pop(lang)
            sizes.pop(lang)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang], pa.string()), pa.array([END.join(own) + END], pa.binary()), pa.array([np.array(f, dtype=np.int64).tobytes()], pa.binary()), pa.array([sum(total)], pa.int64())],
                ["lang", "chunks", "f", "total"],
            )

        for batch in batches:
            for lang, chunk, k, f in zip(*(batch.column(c).to_pylist() for c in ("lang", "chunk", "words", "f")), strict=True):
                own = held.setdefault(lang, ([], [], []))
                for x, y in zip(own, (chunk, f, k * f), strict=True):
                    x.append(y)
                sizes[lang] = sizes.get(lang, 0) + len(chunk)
                if sizes[lang] >= BATCH:
                    yield send(lang)
            while sum(sizes.values()) >= 4 * BATCH:
                yield send(max(sizes, key=sizes.get))
        for lang in list(held):
            yield send(lang)

    spark = docs.sparkSession
    path = new_folder(spark, "dictionary")
    packed = distinct.mapInArrow(pack, "lang string, chunks binary, f binary, total long").select(F.monotonically_increasing_id().alias("no"), "*")
    packed.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(packed.schema).parquet(path)


def _salt(lang: str) -> int:
    """Phrases of different languages are different phrases."""
    return int(mix(sums(_CHECK[np.frombuffer(lang.encode() + b"\0", dtype=np.uint8)])[-1:])[0])


def _one_by_one(batches):
    """Rows that are large: one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _phrases(row: dict, longest: int) -> Phrases:
    return Phrases(row["chunks"], np.frombuffer(row["f"], dtype=np.int64), longest, _salt(row["lang"]))


_FRAGMENT = "part long, no long, h binary, g binary, n binary"
_FOUND = "no long, h long, g long, n long"


def fragments(packed: DataFrame, parts: int, longest: int = LONGEST) -> DataFrame:
    """Each batch's counts, one row per range of hashes."""

    def run(batches):
        for row in _one_by_one(batches):
            p = _phrases(row, longest)
            h, g, n = added(p.h, p.g, p.weight)
            del p
            part = (h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            rows = [
                (int(part[a]), row["no"], _press(np.diff(h[a:b], prepend=np.uint64(0))), g[a:b].tobytes(), _press(n[a:b].astype(np.uint64)))
                for a, b in zip(edges, edges[1:], strict=False) if b > a
            ]
            for k in range(0, len(rows), 256):
                columns = zip(*rows[k : k + 256], strict=True)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["part", "no", "h", "g", "n"])

    return packed.mapInArrow(run, _FRAGMENT)


def frequent(sent: DataFrame, tasks: int, least: int = LEAST) -> DataFrame:
    """Phrases that occur ``least`` times, with the first batch that has them."""

    def run(batches):
        def total(held):
            h, g, n, no = (np.concatenate(x) for x in zip(*held, strict=True))
            h, g, n, no = added(h, g, n, no)
            often = n >= least
            columns = (no[often], h[often].view(np.int64), g[often].astype(np.int64), n[often])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["no", "h", "g", "n"])

        now, held, new = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != now:
                    if held:
                        yield total(held)
                    now, held, new = row["part"], [], 0
                h = np.cumsum(_plain(row["h"]), dtype=np.uint64)
                held.append((h, np.frombuffer(row["g"], dtype=np.uint32), _plain(row["n"]).astype(np.int64), np.full(len(h), row["no"])))
                new += len(h)
                if new > len(held[0][0]) + 2 * RANGE:  # what is equal so far becomes one entry
                    held, new = [added(*(np.concatenate(x) for x in zip(*held, strict=True)))], 0
        if held:
            yield total(held)

    return sent.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(run, _FOUND)


def named(packed: DataFrame, found: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, number of words and count of the phrases found."""
    asked = found.groupBy("no").agg(F.collect_list(F.struct("h", "g", "n")).alias("asked"))
    asked = asked.select("no", F.col("asked.h").alias("h"), F.col("asked.g").alias("g"), F.col("asked.n").alias("n"))

    def run(batches):
        for row in _one_by_one(batches):
            p = _phrases(row, longest)
            h, g, n = np.array(row["h"], np.int64).view(np.uint64), np.array(row["g"], np.int64).astype(np.uint32), np.array(row["n"], np.int64)
            order = np.lexsort((g, h))
            h, g, n = h[order], g[order], n[order]
            left, right = np.searchsorted(h, p.h), np.searchsorted(h, p.h, side="right")
            first = np.full(len(h), -1, dtype=np.int64)
            at = np.flatnonzero(right > left)
            for step in range(int((right - left).max(initial=0))):  # more than one only where 64 bits are equal by chance
                at = at[left[at] + step < right[at]]
                same = at[g[left[at] + step] == p.g[at]]
                first[left[same] + step] = same
            words, k = p.words(first), p.k[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["lang"]] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(k.astype(np.int32)), pa.array(n)], ["lang", "phrase", "k", "a"]
            )

    return packed.join(asked, "no").select("lang", "chunks", packed.f.alias("f"), "h", "g", "n").mapInArrow(run, "lang string, phrase string, k int, a long")


def _cut(phrase: Column, k: int, words: int) -> tuple[Column, Column]:
    return F.substring_index(phrase, " ", k), F.substring_index(phrase, " ", k - words)


def scored(counted: DataFrame, longest: int = LONGEST, share: int = SHARE) -> DataFrame:
    """Candidates with the lowest-scoring cut (``l``, ``r``, ``score``), without those that a longer one makes up for.

    ``counted``: lang, phrase, k, a of all phrases of up to ``longest`` words that reach the least count; their parts reach it too.
    """
    candidates = counted.where("k > 1")
    cuts = None
    for words in range(2, longest + 1):
        for k in range(1, words):
            left, right = _cut(F.col("phrase"), k, words)
            one = candidates.where(F.col("k") == words).select("lang", "phrase", "k", "a", F.lit(k).alias("cut"), left.alias("left"), right.alias("right"))
            cuts = one if cuts is None else cuts.union(one)
    parts = counted.select("lang", "phrase", "a")
    cuts = (
        cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
        .join(parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    )
    # a <= l and a <= r: the score is at most a million, the product fits as long as a stays below 10**16
    score = F.expr("cast((cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000BD) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as long)")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inner = None
    for words in range(3, longest + 1):
        for size in range(2, words):
            for skip in range(words - size + 1):
                part = F.substring_index(F.substring_index(F.col("phrase"), " ", skip + size), " ", -size)
                one = candidates.where(F.col("k") == words).select("lang", part.alias("phrase"), F.col("a").alias("longer"))
                inner = one if inner is None else inner.union(one)
    if inner is not None:
        longer = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        lowest = lowest.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    return lowest.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, every: int = EVERY) -> DataFrame:
    """lang, phrase, a, l, r, n, score of all phrases that are left."""
    spark = docs.sparkSession
    short_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    packed = dictionary(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")), longest, every)
    totals = packed.groupBy("lang").agg(F.sum("total").alias("n"))
    size = packed.agg(F.sum(F.length("chunks"))).first()[0] or 0
    parts = max(partitions(spark), -(-size // (2 * RANGE)))  # about one entry for two bytes of dictionary
    found = frequent(fragments(packed, parts, longest), partitions(spark), least)
    path = new_folder(spark, "phrases")
    named(packed, found, longest).write.parquet(path)
    counted = spark.read.schema("lang string, phrase string, k int, a long").parquet(path)
    return scored(counted, longest, share).join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT lang, text, row_number() OVER () AS doc FROM documents)),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
counted AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::bigint AS n FROM counted WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.a, j, l.a AS l, r.a AS r, ((1000000::hugeint * c.a * c.a) // (l.a::hugeint * r.a))::bigint AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c
  JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ') AND l.k = j
  JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ') AND r.k = c.k - j),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT s.*, n, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, encode(s.phrase)) AS rank FROM lowest s JOIN totals t ON t.lang = s.lang
  LEFT JOIN longer x ON x.lang = s.lang AND x.phrase = s.phrase AND s.k = 2 WHERE x.a IS NULL OR 100 * x.a < 50 * s.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM kept WHERE rank <= 2000
"""


@query("op13_phrase_collocations", _SQL)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first phrases by score."""
    found = collocations(table(spark, sf_dir, "documents"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase")))
    # each task sends its own first rows only: the limit stands right on the rank and is within what the optimizer carries down
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(TOP))
    first = found.withColumn("rank", rank).where(F.col("rank") <= TOP)
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
