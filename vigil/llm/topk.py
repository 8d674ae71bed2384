"""Exact search of the k largest inner products, block at a time.

Components are integers, floor(256 * x). Vectors stand in blocks of ``ROWS`` neighbours by id. A block knows the largest and the smallest value of
each term (component), so the sum over the terms of the larger of q * max and q * min bounds every score in it for query q. Per
query the blocks are ordered by that bound. The first blocks are scored through their forward index (the block's matrix), which
gives the k-th score so far; then all blocks whose bound doesn't fall below it. Blocks below it can't hold a result, so the
answer is exact.

Queries travel in blocks as well, and are a stated set: ids that are multiples of ``EVERY``. Scores tie to the smaller id.
Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without id; components
that a vector doesn't have count 0; rows with the query's id are not among its candidates; other equal ids are candidates each;
equal queries are one; with fewer candidates all are returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import table
from vigil.llm.registry import query
from vigil.streaming.storage import written

SCALE = 256
EVERY = 50
K = 5
#: Vectors in a block, and queries in a block.
ROWS = 2_048
QUERIES = 256
#: Blocks that each query scores first.
FIRST = 1


def vectors(embeddings: DataFrame) -> DataFrame:
    """Id and integer components of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("v")
    )


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """``block``: ids and matrix of neighbouring rows, with the terms' maxima and minima. Dealt by range of id, so a block is a range."""

    def gather(batches):
        ids, vs = [], []
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            vs += batch.column("v").to_pylist()
            while len(ids) >= size:
                yield packed(ids[:size], vs[:size])
                ids, vs = ids[size:], vs[size:]
        if ids:
            yield packed(ids, vs)

    def packed(ids, vs):
        width = max(map(len, vs))
        m = np.array([v + [0] * (width - len(v)) for v in vs], dtype=np.int64)
        name = f"{ids[0]}-{ids[-1]}-{len(ids)}-{zlib.crc32(m.tobytes())}"
        columns = [[name], [np.array(ids, dtype=np.int64).tobytes()], [m.tobytes()], [width], [m.max(axis=0).tobytes()], [m.min(axis=0).tobytes()]]
        kinds = [pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "ids", "m", "width", "high", "low"])

    return rows.mapInArrow(gather, "block string, ids binary, m binary, width int, high binary, low binary")


def _matrix(data: bytes, width: int, to: int) -> np.ndarray:
    m = np.frombuffer(data, dtype=np.int64).reshape(-1, width)
    return m if width >= to else np.pad(m, ((0, 0), (0, to - width)))


def bounds(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """The blocks' bounds for all queries of a query block: (query block, block, bounds). Only term maxima are met here."""
    pairs = queries.select(F.col("block").alias("qblock"), F.col("m").alias("q"), F.col("width").alias("qwidth")).join(
        docs.select("block", "width", "high", "low"), F.lit(True)
    )

    def bound(batches):
        for batch in batches:
            out = []
            for q, qw, w, high, low in zip(*(batch.column(c).to_pylist() for c in ("q", "qwidth", "width", "high", "low")), strict=True):
                width = max(qw, w)
                a = _matrix(q, qw, width)
                h, s = _matrix(high, w, width)[0], _matrix(low, w, width)[0]
                out.append((np.maximum(a, 0) @ h + np.minimum(a, 0) @ s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("qblock"), batch.column("block"), pa.array(out, pa.binary())], ["qblock", "block", "bound"])

    return pairs.mapInArrow(bound, "qblock string, block string, bound binary")


def scored(asked: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The k best of each asked block for the queries that ask for it. ``asked``: qblock, block, and the queries' places."""
    full = asked.join(queries.select(F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("m").alias("q"), F.col("width").alias("qwidth")), "qblock").join(
        docs.select("block", "ids", "m", "width"), "block"
    )

    def score(batches):
        for batch in batches:
            for places, qids, q, qw, ids, m, w in zip(*(batch.column(c).to_pylist() for c in ("places", "qids", "q", "qwidth", "ids", "m", "width")), strict=True):
                width = max(qw, w)
                own = np.frombuffer(qids, dtype=np.int64)[places]
                names = np.frombuffer(ids, dtype=np.int64)
                s = _matrix(q, qw, width)[places] @ _matrix(m, w, width).T
                rows, columns = [], []
                for i in range(len(own)):
                    among = np.flatnonzero(names != own[i])
                    order = among[np.lexsort((names[among], -s[i, among]))[:k]]
                    rows.append(np.full(len(order), i))
                    columns.append(order)
                r, c = np.concatenate(rows), np.concatenate(columns)
                yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(names[c]), pa.array(s[r, c])], ["query_id", "vec_id", "score"])

    return full.mapInArrow(score, "query_id long, vec_id long, score long")


def best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(rows: DataFrame, asked: DataFrame, k: int = K) -> DataFrame:
    """For each row of ``asked`` its k best of ``rows`` (both vec_id, v)."""
    ordered = lambda x: x.repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    docs = written(blocks(ordered(rows), ROWS), "blocks")
    queries = written(blocks(ordered(asked.dropDuplicates(["vec_id", "v"])), QUERIES), "queries")
    bound = written(bounds(queries, docs), "bounds")

    def first(batches):
        """The blocks with the largest bounds, of one query block."""
        for batch in batches:
            for qblock, names, found in zip(*(batch.column(c).to_pylist() for c in ("qblock", "blocks", "bounds")), strict=True):
                b = np.stack([np.frombuffer(x, dtype=np.int64) for x in found])
                order = np.argsort(-b, axis=0, kind="stable")[:FIRST]
                want: dict[int, list[int]] = {}
                for place in range(b.shape[1]):
                    for row in order[:, place].tolist():
                        want.setdefault(row, []).append(place)
                yield _asked(qblock, [(names[r], p) for r, p in want.items()])

    def rest(batches):
        for batch in batches:
            for qblock, names, found, qids, ids, kth in zip(*(batch.column(c).to_pylist() for c in ("qblock", "blocks", "bounds", "qids", "known", "kth")), strict=True):
                least = dict(zip(ids or [], kth or [], strict=True))
                limit = np.array([least.get(i, np.iinfo(np.int64).min) for i in np.frombuffer(qids, dtype=np.int64).tolist()])
                b = np.stack([np.frombuffer(x, dtype=np.int64) for x in found])
                done = np.argsort(-b, axis=0, kind="stable")[:FIRST]
                open_ = b >= limit
                np.put_along_axis(open_, done, False, axis=0)
                yield _asked(qblock, [(names[r], np.flatnonzero(open_[r]).tolist()) for r in range(len(names)) if open_[r].any()])

    def _asked(qblock, pairs):
        return pa.RecordBatch.from_arrays(
            [pa.array([qblock] * len(pairs), pa.string()), pa.array([x for x, _ in pairs], pa.string()), pa.array([x for _, x in pairs], pa.list_(pa.int32()))],
            ["qblock", "block", "places"],
        )

    # one row per query block: its bounds, eight bytes a query and block
    sorted_ = F.sort_array(F.collect_list(F.struct("block", "bound")))
    gathered = bound.groupBy("qblock").agg(sorted_.alias("x")).select("qblock", F.col("x.block").alias("blocks"), F.col("x.bound").alias("bounds"))
    schema = "qblock string, block string, places array<int>"
    start = written(scored(gathered.mapInArrow(first, schema), queries, docs, k), "scores")
    kth = best(start, k).where(F.col("rank") == k).select("query_id", "score")

    def of(batches):
        for batch in batches:
            for name, ids in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                own = np.frombuffer(ids, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(own)], ["qblock", "query_id"])

    limits = (
        queries.select("block", "ids").mapInArrow(of, "qblock string, query_id long").join(kth, "query_id")
        .groupBy("qblock").agg(F.collect_list(F.struct("query_id", "score")).alias("y")).select("qblock", F.col("y.query_id").alias("known"), F.col("y.score").alias("kth"))
    )
    more = gathered.join(limits, "qblock", "left").join(queries.select(F.col("block").alias("qblock"), F.col("ids").alias("qids")), "qblock").mapInArrow(rest, schema)
    return best(start.union(scored(more, queries, docs, k)), k)


@query("op7_block_max_search")
def block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of each query vector."""
    rows = vectors(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))
