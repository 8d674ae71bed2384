"""Exact join of documents on the Jaccard similarity of their word shingles, as a join in a metric space.

Jaccard distance, 1 - similarity, is a metric; two documents link when it is at most ``RADIUS`` = 1/4.

*Regions.* Most documents share nothing with any given document, so document pivots would leave nearly all of them at distance 1,
where the triangle inequality says nothing. The first pivots are therefore one-shingle sets: a document of n shingles is at
distance 1 - 1/n from the pivots that it contains and at 1 from all others, and the order of the pivots (common shingles last,
else by hash) breaks the ties: its own region is that of its first shingle. A document within the radius has at least 3/4 of the
n shingles, so both are in the region of one of the first n - ceil(3n/4) + 1 pivots of each: the window into which a
document is replicated. Each region then has a document pivot, its smallest member.

*Windows.* All members are measured against the pivot. Those within the radius of it are linked. For the others d(x, p) - d(y, p)
bounds d(x, y) from below, so only pairs whose distances to the pivot differ by no more than the radius are left, and only
those that links don't connect already. Of a region's components the largest waits; each other member asks its ``NEAREST`` members of other
components, nearest sketches first, what is found is contracted, and the next round asks ``FURTHER`` times as many, until no member has one left that it
has not asked and that is not in its component by then. A region of more than ``LEAF`` members is dealt in blocks: the first round
looks inside a block, later ones let whoever is still outside the largest component ask all blocks. Nothing is capped: the result is exact.

*Cost.* The order of shingles comes from counts over the whole corpus in a table of fixed size. Before two sets are
fetched, parity sketches of at least twice as many bits bound their symmetric difference from below. Equal sets are one class from the start, and a task
sends each class once. The members of a region that the counts show to be large are dealt over several tasks with a pivot each; the
pivots of its parts are measured against each other.

Defined cases: a null or empty text, or one of white space, has no shingles and no links; with fewer than five words the whole
sequence is the one shingle; equal rows are in one class; rows without an id keep a null id and take part; a component without any id
has a null component_id; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import NO_ID, as_bytes, mix, own_id, partitions, short_batches, table, texts, word_hashes
from vigil.llm.components import components
from vigil.llm.registry import query
from vigil.streaming.storage import written

WORDS = 5
#: similar when 100 * intersection >= PERCENT * union
PERCENT = 75
RADIUS = 1 - PERCENT / 100
COUNTER_BITS = 20
COUNTERS = 1 << COUNTER_BITS
#: Counters that travel and are summed together.
SUMMED = 1 << 12
#: A sketch has so many bits at least.
SKETCH_BITS = 1024
#: Members of a region that are looked through in one place, about.
LEAF = 4_096
#: Members of other components that a member asks in the first round, and how many times as many in each further one.
NEAREST = 16
FURTHER = 256
#: Sets that are measured against a pivot in one place, about.
TOGETHER = 500
#: Members of a region that go to one task, about, when the counts show that it is large.
PART = 2_000
#: A member of a region names so many of its other regions at most: a pair that meets in one of them before is left to that one.
NAMED = 64

#: A region goes by the hash of its shingle without so many low bits: two shingles that share a name share a region, which loses no pair.
NAME_BITS = np.uint64(24)

_M = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = min(WORDS, len(words))
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        total = mix(total * _M + words[i : len(words) - n + 1 + i])
    return np.unique(total)


def sketch(found: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of at least twice as many cells, a power of two."""
    bits = max(SKETCH_BITS, 1 << (2 * len(found) - 1).bit_length()) if len(found) else SKETCH_BITS
    cells = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(cells.astype(np.uint8)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Cells in which two sketches differ: no more than there are shingles in one set only. The longer one is folded."""
    a, b = sorted((np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def shortened(data: bytes) -> bytes:
    """A sketch folded to ``SKETCH_BITS``."""
    x = np.frombuffer(data, dtype=np.uint8)
    return np.bitwise_xor.reduce(x.reshape(-1, SKETCH_BITS // 8), axis=0).tobytes()


def class_id(found: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes()))))


def levels(counters: np.ndarray, mean: float) -> np.ndarray:
    """How many times twice the mean count each counter holds, as a power of two: 0 for all but common shingles."""
    return np.floor(np.log2(np.maximum(1.0, counters / mean))).astype(np.uint8)


def counter_of(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def prefix(found: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The pivots into whose regions a document goes."""
    n = len(found)
    place = (level[counter_of(found)].astype(np.uint64) << np.uint64(58)) | (found >> np.uint64(6))
    return found[np.argsort(place, kind="stable")[: n - (-(-PERCENT * n // 100)) + 1]]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


# ---- sets


def measured(docs: DataFrame) -> DataFrame:
    """One row per document (part -1: its class, size, sketch and the hash of its text) and the counters of each task's shingles, ``SUMMED`` a row."""

    def measure(batches):
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            sizes, classes, marks, seen = [], [], [], []
            for text in as_bytes(batch.column("text")):
                found = shingles(text)
                seen.append(found)
                sizes.append(len(found))
                classes.append(class_id(found))
                marks.append(sketch(found))
            if seen:
                total += np.bincount(counter_of(np.concatenate(seen)), minlength=COUNTERS)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1] * len(sizes), pa.int32()), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(marks, pa.binary()), pa.array([shortened(x) for x in marks], pa.binary()), batch.column("h")],
                ["part", "doc_id", "n", "c", "data", "short", "h"],
            )
        blocks = [x.tobytes() for x in total.reshape(-1, SUMMED)]
        zero = pa.array([0] * len(blocks), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(blocks)), pa.int32()), zero, zero, zero, pa.array(blocks, pa.binary()), pa.array([b""] * len(blocks), pa.binary()), zero],
            ["part", "doc_id", "n", "c", "data", "short", "h"],
        )

    return docs.withColumn("h", F.xxhash64("text")).mapInArrow(measure, "part int, doc_id long, n long, c long, data binary, short binary, h long")


def common(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """From the counters of ``measured``: the level of each counter, and into how many parts (as a power of two) its regions are
    dealt. The sums stay in the tasks; only the counters with a level come to the driver, six bytes each."""

    def add(batches):
        total = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(data, dtype=np.int64)
        columns = [pa.array(list(total), pa.int32()), pa.array([int(x.sum()) for x in total.values()], pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "n", "data"])

    sums = written(seen.where("part >= 0").select("part", "data").repartition(partitions(seen.sparkSession), "part").mapInArrow(add, "part int, n long, data binary"), "counters")
    mean = max(1.0, (sums.agg(F.sum("n")).first()[0] or 0) / COUNTERS)

    def above(batches):
        for batch in batches:
            slots, high, spread = [], [], []
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                counters = np.frombuffer(data, dtype=np.int64)
                level = levels(counters, mean)
                at = np.flatnonzero(level)
                slots.append((at + part * SUMMED).astype(np.int32).tobytes())
                high.append(level[at].tobytes())
                # powers of two: members that share a part of one large region share those of others, and so their pivots
                spread.append(np.floor(np.log2(np.clip(counters[at] // PART, 1, 32_768))).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (slots, high, spread)], ["slots", "level", "spread"])

    level, spread = np.zeros(COUNTERS, dtype=np.uint8), np.zeros(COUNTERS, dtype=np.uint8)
    for row in sums.mapInArrow(above, "slots binary, level binary, spread binary").collect():
        at = np.frombuffer(row.slots, dtype=np.int32)
        level[at], spread[at] = np.frombuffer(row.level, dtype=np.uint8), np.frombuffer(row.spread, dtype=np.uint8)
    return level, spread


def memberships(docs: DataFrame, level: np.ndarray, parts: np.ndarray) -> DataFrame:
    """``s`` (the pivot), ``part`` of its region (of two to the power of ``parts``), whether it has several (``dealt``), and the class: once per task and class."""

    def spread(batches):
        sent = set()
        for batch in batches:
            rows = []
            for text in as_bytes(batch.column("text")):
                found = shingles(text)
                if not len(found) or (c := class_id(found)) in sent:
                    continue
                sent.add(c)
                rows.append((prefix(found, level), c))
                if len(rows) == 200:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)

    def packed(rows):
        s = np.concatenate([r[0] for r in rows])
        c = np.repeat(np.array([r[1] for r in rows], dtype=np.int64), [len(r[0]) for r in rows])
        of = np.uint64(1) << parts[counter_of(s)].astype(np.uint64)
        part = mix(c.view(np.uint64)) % of
        return pa.RecordBatch.from_arrays([signed(s >> NAME_BITS), pa.array(part.astype(np.int32)), pa.array(of > 1), pa.array(c)], ["s", "part", "dealt", "c"])

    return docs.mapInArrow(spread, "s long, part int, dealt boolean, c long")


# ---- distances


def sizes_fit(n: str, m: str):
    """Sets whose sizes alone don't keep them apart."""
    return 100 * F.least(F.col(n), F.col(m)) >= PERCENT * F.greatest(F.col(n), F.col(m))


def near_sketches(pairs: DataFrame) -> DataFrame:
    """Pairs whose symmetric difference can be small enough: at most (n + m) * (1 - t) / (1 + t)."""

    def keep(batches):
        for batch in batches:
            apart = np.array([differing(x, y) for x, y in zip(batch.column("data").to_pylist(), batch.column("other").to_pylist(), strict=True)], dtype=np.int64)
            total = batch.column("n").to_numpy(zero_copy_only=False) + batch.column("m").to_numpy(zero_copy_only=False)
            fits = (100 + PERCENT) * apart <= (100 - PERCENT) * total
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return pairs.mapInArrow(keep, "a long, b long")


def distances(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of classes ``a``, ``b`` that sizes and sketches don't tell apart: their distance ``d`` and whether they ``link``.

    ``classes``: c, n, data and the id of a document of each. The sets are computed again, from the texts of the documents
    that are still in question, and sent to where the pivot ``a`` goes: one place, or several if many are to be
    measured against it.
    """
    # sizes first: sketches travel only for pairs that fit
    one = classes.select(F.col("c").alias("a"), "n")
    two = classes.select(F.col("c").alias("b"), F.col("n").alias("m"))
    fitting = pairs.join(one, "a").join(two, "b").where(sizes_fit("n", "m"))
    sized = fitting.join(classes.select(F.col("c").alias("a"), "data"), "a").join(classes.select(F.col("c").alias("b"), F.col("data").alias("other")), "b")
    asked = written(near_sketches(sized), "pairs")
    places = F.ceil(F.col("k") / TOGETHER).cast("int")
    pivots = written(asked.groupBy("a").agg(F.count("*").alias("k")).select("a", places.alias("places")), "pivots")
    others = asked.join(pivots, "a").select(F.col("b").alias("c"), "a", F.pmod(F.xxhash64("b"), "places").cast("int").alias("place"))
    selves = pivots.select(F.col("a").alias("c"), "a", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))
    sent = others.union(selves).groupBy("c").agg(F.collect_set(F.struct("a", "place")).alias("to"))
    # the document that stands for a class, by id and text: rows without an id, or several texts of one id, are told apart
    sent = sent.join(classes.select("c", "of"), "c").select("of.doc_id", "of.h", F.col("to.a").alias("pivots"), F.col("to.place").alias("places"))
    sent = written(sent, "sent")

    def sets(batches):
        for batch in batches:
            for text, to, at in zip(as_bytes(batch.column("text")), batch.column("pivots").to_pylist(), batch.column("places").to_pylist(), strict=True):
                found = shingles(text)
                c, data = class_id(found), found.tobytes()
                for k in range(0, len(to), 100):
                    p = to[k : k + 100]
                    columns = [pa.array(p, pa.int64()), pa.array(at[k : k + 100], pa.int32()), pa.array([x == c for x in p], pa.bool_()), pa.array([c] * len(p), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([data] * len(p), pa.binary())], ["a", "place", "self", "b", "set"])

    def compare(batches):
        pivot, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, self, b, data in zip(*(batch.column(x).to_pylist() for x in ("a", "self", "b", "set")), strict=True):
                found = np.frombuffer(data, dtype=np.uint64)
                if self:
                    pivot, own = a, found
                elif a == pivot:
                    both = np.concatenate((own, found))
                    both.sort(kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    union = len(both) - shared
                    out.append((a, b, 1 - shared / union, 100 * shared >= PERCENT * union))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["a", "b", "d", "link"])

    return (
        docs.withColumn("h", F.xxhash64("text")).join(sent, ["doc_id", "h"]).select("text", "pivots", "places").mapInArrow(sets, "a long, place int, self boolean, b long, set binary")
        .repartition(partitions(docs.sparkSession), "a", "place").sortWithinPartitions("a", "place", F.desc("self"))
        .mapInArrow(compare, "a long, b long, d double, link boolean")
    )


# ---- join


def asking(regions: DataFrame, whole: bool) -> DataFrame:
    """Members of regions (``s``, its ``size`` and largest component ``most``, of which ``out`` members are outside) in blocks of about
    ``LEAF``: in each a member can be asked (``home``), asks (``asks``) or both. Inside its own block only, or ``whole``: each
    member outside the largest component asks all blocks, in groups of about ``LEAF``."""
    regions = regions.withColumn("others", F.filter("others", lambda x: x < F.col("s"))).withColumn("asks", F.col("label") != F.col("most"))
    blocks, groups = F.ceil(F.col("size") / LEAF).cast("int"), F.ceil(F.col("out") / LEAF).cast("int")
    own = regions.select("*", F.lit(True).alias("home"), F.pmod(F.xxhash64("c"), blocks).cast("int").alias("block"), F.lit(0).alias("group"))
    if not whole:
        return own
    large = regions.where(F.col("size") > LEAF)
    asked = large.withColumn("asks", F.lit(False)).select("*", F.lit(True).alias("home"), F.pmod(F.xxhash64("c"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), groups - 1)).alias("group"))
    ask = large.where("asks").withColumn("group", F.pmod(F.xxhash64("c", F.lit(1)), groups).cast("int"))
    ask = ask.select(*regions.columns, F.lit(False).alias("home"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "group")
    return own.where(F.col("size") <= LEAF).union(asked).union(ask)


def joined_regions(members: DataFrame, n: int, nearest: int) -> DataFrame:
    """Pairs of members of a region's block (``s``, ``block``, ``group``) that are in different components and that neither sizes, nor the
    distances to their pivot, nor the short sketches tell apart: the ``nearest`` of each member that asks, and whether it has ``more``.
    A pair with several regions in common goes out from the first of them (``others`` are a member's regions before this one; a pair that
    meets beyond those named may go out twice)."""

    def pairs(region: dict[str, np.ndarray]) -> list[tuple]:
        c, n, label, d, p = (region[x] for x in ("c", "n", "label", "d", "p"))
        marks = np.frombuffer(b"".join(region["short"]), dtype=np.uint64).reshape(len(c), -1)
        before = [set(x) for x in region["others"]]
        home = np.flatnonzero(region["home"])
        asks = np.flatnonzero(region["asks"])
        found = []
        for begin in range(0, len(asks), 16):
            i = asks[begin : begin + 16]
            fits = label[i][:, None] != label[home][None, :]
            fits &= 100 * np.minimum(n[i][:, None], n[home][None, :]) >= PERCENT * np.maximum(n[i][:, None], n[home][None, :])
            with np.errstate(invalid="ignore"):
                fits &= ~((p[i][:, None] == p[home][None, :]) & (np.abs(d[i][:, None] - d[home][None, :]) > RADIUS + 1e-9))
            x, y = np.nonzero(fits)
            x, y = i[x], home[y]
            apart = np.bitwise_count(marks[x] ^ marks[y]).sum(axis=1, dtype=np.int64)
            total = n[x] + n[y]
            near = (100 + PERCENT) * apart <= (100 - PERCENT) * total
            x, y, far = x[near], y[near], apart[near] / total[near]
            order = np.lexsort((far, x))
            asked, last = 0, -1
            for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
                asked, last = (asked if a == last else 0), a
                if asked <= nearest and before[a].isdisjoint(before[b]):
                    asked += 1
                    if asked <= nearest:
                        found.append([region["s"][0], c[a], c[b], False])
                    else:
                        found[-1][3] = True
        return found

    def join(batches):
        names = ["s", "block", "group", "c", "n", "label", "d", "p", "home", "asks"]
        held = None
        for batch in batches:
            columns = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in names}
            for x in ("short", "others"):
                columns[x] = np.empty(batch.num_rows, dtype=object)
                for k, value in enumerate(batch.column(x).to_pylist()):
                    columns[x][k] = value
            if held is not None:
                columns = {x: np.concatenate((held[x], columns[x])) for x in columns}
            new = np.any([columns[x][1:] != columns[x][:-1] for x in ("s", "block", "group")], axis=0)
            edges = [0, *(np.flatnonzero(new) + 1).tolist()]
            for a, b in zip(edges, edges[1:], strict=False):
                yield from packed(pairs({x: v[a:b] for x, v in columns.items()}))
            held = {x: v[edges[-1] :] for x, v in columns.items()}
        if held is not None and len(held["s"]):
            yield from packed(pairs(held))

    def packed(found):
        if found:
            s, a, b, more = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(more, pa.bool_())], ["s", "a", "b", "more"])

    dealt = members.select("s", "block", "group", "c", "n", "label", "d", "p", "home", "asks", "short", "others")
    return dealt.repartition(n, "s", "block", "group").sortWithinPartitions("s", "block", "group").mapInArrow(join, "s long, a long, b long, more boolean")


def ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def similarity_classes(docs: DataFrame) -> DataFrame:
    """Each row's id, number of shingles, component (the smallest id that links lead to) and hash of the text. ``docs`` come from ``texts``."""
    spark = docs.sparkSession
    seen = written(measured(docs), "measured")
    level, parts = common(seen)
    own = seen.where("part = -1")
    # one document stands for all of a class
    classes = written(own.where("n > 0").groupBy("c").agg(F.first("n").alias("n"), F.min(F.struct("doc_id", "h")).alias("of"), F.first("data").alias("data"), F.first("short").alias("short")), "classes")

    part = Window.partitionBy("s", "part")
    members = (
        memberships(docs, level, parts).repartition(partitions(spark), "s", "part")
        .withColumn("p", F.min("c").over(part)).withColumn("last", F.max("c").over(part)).withColumn("size", F.count("*").over(part))
        .where("p <> last or dealt").select("s", "part", "c", "p", "dealt", (F.col("dealt") | (F.col("size") > 2)).alias("open"))
    )
    # a class that several tasks have sent lies in one part: with ``part`` among the columns its rows meet without another shuffle
    members = written(members.distinct().drop("part"), "members")
    # each member with the pivot of its part, and the pivots of a region's parts with the smallest of them
    heads = members.where("dealt").select("s", "p").distinct()
    first = heads.groupBy("s").agg(F.min("p").alias("head"))
    stars = written(members.select("c", "p").union(heads.join(first, "s").select(F.col("p").alias("c"), F.col("head").alias("p"))).where("c <> p").distinct(), "stars")
    # near copies share most of their regions: first one pivot for each member, then only what that left apart
    nearest = stars.groupBy("c").agg(F.min("p").alias("p")).select(*ordered("c", "p")).distinct()
    tested = written(distances(nearest, classes, docs), "distances")
    labels = components(tested.where("link").select("a", "b"))
    left, right = (labels.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in ("c", "p"))
    apart = stars.join(left, "c", "left").join(right, "p", "left").where(F.coalesce("of_c", "c") != F.coalesce("of_p", "p"))
    rest = apart.select(*ordered("c", "p")).distinct().join(tested, ["a", "b"], "left_anti")
    found = written(distances(rest, classes, docs), "distances")
    tested = tested.union(found)
    labels = further(labels, found.where("link").select("a", "b"))
    # a region of two has been done with: one of them was its pivot
    left = _unconnected(members.where("open").select("s", "c", "p"), labels)
    to_pivot = tested.select(F.col("a").alias("c"), F.col("b").alias("p"), "d").union(tested.select("b", "a", "d")).dropDuplicates(["c", "p"])
    asked = tested.select("a", "b")
    nearest, whole = NEAREST, False
    while not left.isEmpty():
        size = left.groupBy("s", "label").agg(F.count("*").alias("k")).groupBy("s").agg(
            F.sum("k").alias("size"), (F.sum("k") - F.max("k")).alias("out"), F.max(F.struct("k", "label")).getField("label").alias("most"),
        )
        others = left.groupBy("c").agg(F.slice(F.sort_array(F.collect_set("s")), 1, NAMED).alias("others"))
        sized = written(
            left.join(to_pivot, ["c", "p"], "left").withColumn("d", F.when(F.col("c") == F.col("p"), 0.0).otherwise(F.col("d")))
            .join(size, "s").join(classes.select("c", "n", "short").join(others, "c"), "c"), "regions",
        )
        near = written(joined_regions(asking(sized, whole), partitions(spark), nearest), "near")
        new = near.select(*ordered("a", "b")).distinct().join(asked, ["a", "b"], "left_anti")
        found = written(distances(new, classes, docs), "distances")
        asked = asked.union(near.select(*ordered("a", "b")))
        labels = further(labels, found.where("link").select("a", "b"))
        # a region is done with when its members have asked all blocks and none had more to ask
        again = near.where("more").select("s")
        if not whole:
            again = again.union(size.where(F.col("size") > LEAF).select("s"))
        left = _unconnected(left.select("s", "c", "p").join(again.distinct(), "s", "left_semi"), labels, least=2)
        nearest, whole = FURTHER * nearest, True

    ids = own.select("c", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("i")).groupBy("c").agg(F.min("i").alias("i"))
    named = written(ids.join(labels.withColumnRenamed("node", "c"), "c", "left").select("c", "i", F.coalesce("component", "c").alias("label")), "named")
    smallest = named.groupBy("label").agg(F.min("i").alias("component_id"))
    found = named.join(smallest, "label").select("c", "component_id")
    return own.join(found, "c").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))).alias("component_id"), "h",
    )


def further(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after further links ``a``, ``b``: only the components that they join are looked at."""
    of_a, of_b = (labels.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in ("a", "b"))
    between = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    between = written(between.where("a <> b").distinct(), "links")
    if between.isEmpty():
        return labels
    roots = components(between)
    new = roots.select("node").join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    roots = roots.select(F.col("node").alias("component"), F.col("component").alias("root"))
    return written(labels.union(new).join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")


def _unconnected(regions: DataFrame, labels: DataFrame, least: int = 3) -> DataFrame:
    """Members (``s``, ``c``, pivot ``p``) of regions with members of several components, with their ``label``. A region of
    two has been done with when one of them was its pivot. Of regions with the same members one is enough."""
    known = regions.join(labels.select(F.col("node").alias("c"), "component"), "c", "left").withColumn("label", F.coalesce("component", "c")).drop("component")
    known = written(known, "regions")
    of = known.groupBy("s").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("k"),
        F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"),
    )
    open_ = of.where(F.col("low") != F.col("high")).where(F.col("k") >= least).groupBy("k", "x", "y").agg(F.min("s").alias("s"))
    return written(known.join(open_.select("s"), "s"), "regions")


@query("op6_jaccard_join")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of shingles and its component."""
    found = similarity_classes(texts(table(spark, sf_dir, "documents")))
    return found.select(own_id(), "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the rows with the smallest id stay.
    Rows without an id have no rank among others; they all stay. Of an id with several texts, each is decided alone."""
    short_batches(docs.sparkSession)
    gone = similarity_classes(texts(docs)).where((F.col("doc_id") != NO_ID) & (F.col("doc_id") != F.col("component_id"))).select("doc_id", "h").distinct()
    rows = docs.select(
        F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")
    )
    return rows.join(gone, ["doc_id", "h"], "left_anti").select("row.*")
