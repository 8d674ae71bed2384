"""Quality classifier by importance resampling.

Two bags of hashed words and word pairs are counted: one of the target (a bounded sample of documents labelled as good) and
one of the raw corpus (every document). A document's log weight is the logarithm of the ratio of its likelihoods under the
two, per n-gram, times ``TEMPER``: tempering keeps long documents from having weights without limit. Gumbel noise is added,
and the k documents with the largest sums are a sample without replacement in proportion to the weights. k is the number of
documents whose weight is at least the cut that separates the labelled sample best.

Defined cases: a null or empty text, or one of white space, has log weight 0 and no key, passes, and counts in no k; without labels of both kinds nothing is rejected;
rows with equal id and text stand or fall together; documents whose sums equal the k-th largest one all stay; an empty table
gives an empty result; other columns are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import NO_ID, as_bytes, kth_largest, short_batches, summed, table, texts, token_hashes
from vigil.llm.registry import query
from vigil.streaming.storage import written

BUCKETS = 1 << 16
#: So many n-grams' worth of evidence at most.
TEMPER = 64.0
#: Labelled rows that the target model and the cut are taken from, at most.
SAMPLE_ROWS = 20_000
SEED = 9

_PAIR = np.uint64(0x9E3779B97F4A7C15)
_AGAIN = 1
_TOP = np.uint64(48)


def ngrams(text: bytes) -> np.ndarray:
    """Buckets of a text's tokens and pairs of neighbours. A pair of equal words counts as one special pair."""
    tokens, word = token_hashes(text)
    pairs = tokens[:-1] * _PAIR + tokens[1:]
    pairs ^= pairs >> np.uint64(29)
    pairs *= _PAIR
    pairs >>= _TOP
    pairs[(tokens[:-1] == tokens[1:]) & word[1:]] = _AGAIN
    return np.concatenate((tokens >> _TOP, pairs)).astype(np.int64)


@dataclass
class Model:
    ratio: np.ndarray
    cut: float = -np.inf

    def log_weight(self, text: bytes) -> float:
        found = ngrams(text)
        return float(self.ratio[found].mean() * TEMPER) if len(found) else 0.0


def gumbel(doc_id: int, text: bytes, seed: int) -> float:
    u = ((xxhash.xxh3_64_intdigest(text, seed ^ (doc_id & 0xFFFFFFFF)) >> 11) + 0.5) / 2.0**53
    return -float(np.log(-np.log(u)))


def counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all of the texts."""

    def count(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            found = [ngrams(text) for text in as_bytes(batch.column("text"))]
            total += np.bincount(np.concatenate(found), minlength=BUCKETS) if found else 0
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    return summed(docs.select("text").mapInArrow(count, "v binary"), "v", BUCKETS)


def log_ratio(target: np.ndarray, raw: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    if not target.sum():
        return np.zeros(BUCKETS)
    # the same smoothing mass in proportion to the sizes: a bucket with the raw share has ratio 0
    share = target.sum() / max(1, raw.sum())
    p, q = target + smooth * share, raw + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the widest stretch of cuts that put the fewest of the labelled documents on the wrong side."""
    if not len(good) or not len(bad):
        return -np.inf
    at = np.unique(np.concatenate((good, bad)))
    cuts = (at[1:] + at[:-1]) / 2
    if not len(cuts):
        return -np.inf
    wrong = np.searchsorted(np.sort(good), cuts) + len(bad) - np.searchsorted(np.sort(bad), cuts)
    width = np.where(wrong == wrong.min(), at[1:] - at[:-1], -1)
    return float(cuts[width.argmax()])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """``docs``: doc_id and text; ``labels``: doc_id and quality (1 good, 0 bad)."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    sample = written(docs.join(F.broadcast(chosen), "doc_id").select("text", "quality"), "labelled")
    model = Model(log_ratio(counts(sample.where("quality = 1")), counts(docs)))

    def score(batches):
        for batch in batches:
            weights = [model.log_weight(t) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(weights, pa.float64())], ["quality", "w"])

    known = sample.mapInArrow(score, "quality int, w double").toPandas()
    model.cut = best_cut(known.w[known.quality == 1].to_numpy(), known.w[known.quality == 0].to_numpy())
    return model


def scores(docs: DataFrame, model: Model, seed: int = SEED) -> DataFrame:
    """Log weight and its sum with the Gumbel noise for each document; no sum for those without words."""

    def score(batches):
        for batch in batches:
            ids, data = batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))
            weights = [model.log_weight(t) for t in data]
            keys = [w + gumbel(i, t, seed) if t.strip() else None for i, t, w in zip(ids, data, weights, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(weights, pa.float64()), pa.array(keys, pa.float64())], ["doc_id", "log_weight", "key"]
            )

    return docs.mapInArrow(score, "doc_id long, log_weight double, key double")


def last_key(scored: DataFrame, cut: float) -> float:
    """The k-th largest key, k being the number of documents with words whose weight is at least the cut."""
    k = scored.where(F.col("key").isNotNull() & (F.col("log_weight") >= F.lit(cut))).count()
    last = kth_largest(scored, "key", k)
    return np.inf if last is None else last


def resample(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns."""
    plain = texts(docs)
    model = fit(plain, labels)
    last = last_key(written(scores(plain, model, seed), "scores"), model.cut)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pc.fill_null(batch.column("doc_id").cast(pa.int64()), NO_ID).to_pylist()
            data = [t or b"" for t in as_bytes(batch.column("text"))]
            yield batch.filter(pa.array([not t.strip() or model.log_weight(t) + gumbel(i, t, seed) >= last for i, t in zip(ids, data, strict=True)], pa.bool_()))

    return docs.mapInArrow(drawn, docs.schema)


@query("op9_quality_resampling")
def quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are drawn, with their log weight."""
    docs = texts(table(spark, sf_dir, "documents"))
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = written(scores(docs, model), "scores")
    last = last_key(scored, model.cut)
    return scored.where(F.col("key").isNull() | (F.col("key") >= F.lit(last))).select("doc_id", "log_weight", "key")
