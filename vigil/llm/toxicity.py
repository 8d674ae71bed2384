"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed words. Its score is the logistic function of a bias, a weight for each term, and for each pair of terms the
inner product of their factors: the pairs learn what no sum of single weights can, such as an insult together with the mention of
a group. The sum over all pairs costs no more than one pass over the terms. A term counts the same in a long text and a short one; terms that
don't tell toxic documents of the sample from others take no part.

The model is fitted on a bounded sample: at most ``SAMPLE_ROWS`` labelled documents outside the held-out third, by hash of their ids, and
``SAMPLE_TERMS`` different terms of each (all texts are scored whole). Labels, language, source and id are no inputs.

Defined cases: a null or empty text, or one without words, has the score of the bias; repeated labels of a document count as toxic if
any does; without labels of both kinds every score is the share of toxic ones (0.5 without any); equal texts have equal
scores; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import as_bytes, own_id, table, texts, token_hashes
from vigil.llm.registry import query

SLOTS = 1 << 18
FACTORS = 8
SAMPLE_ROWS = 20_000
SAMPLE_TERMS = 4_096
#: A term takes part if it occurs in so many different documents of the sample, and with toxic ones more or less often than by chance:
#: by so many standard deviations. Of the very many rare words, some would else seem to tell by accident.
LEAST = 4
SIGNIFICANT = 3.5
EPOCHS = 20
BATCH = 256
RATE = 0.05
DECAY = 1e-5
PREDICTED = 0.7


def terms(text: bytes) -> np.ndarray:
    """Slots of a text's different words."""
    tokens, word = token_hashes(text)
    return np.unique(tokens[word] >> np.uint64(64 - 18)).astype(np.int32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, found: np.ndarray) -> float:
        v = self.factors[found]
        total = v.sum(axis=0)
        return self.bias + float(self.weights[found].sum()) + 0.5 * float((total * total).sum() - (v * v).sum())

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(terms(text)), -30, 30))))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_TERMS) -> tuple[list[np.ndarray], np.ndarray]:
    """Terms and labels of the sample. The driver holds at most ``rows`` times ``most`` numbers."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )

    def gather(batches):
        for batch in batches:
            found = []
            for text in as_bytes(batch.column("text")):
                own = terms(text)
                # of a very long text, terms spread over all of it
                found.append(own[np.linspace(0, len(own) - 1, most).astype(int)].tobytes() if len(own) > most else own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "terms"])

    known = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").mapInArrow(gather, "doc_id long, toxic int, terms binary").toPandas()
    known = known.sort_values(["doc_id", "terms"], kind="stable")
    return [np.frombuffer(x, dtype=np.int32) for x in known.terms], known.toxic.to_numpy(dtype=np.float64)


def telling(found: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """The terms that occur with toxic documents more or less often than by chance. Equal documents count once."""
    first = {x.tobytes(): i for i, x in reversed(list(enumerate(found)))}
    kept = sorted(first.values())
    share = toxic[kept].mean()
    often = np.bincount(np.concatenate([found[i] for i in kept]), minlength=SLOTS)
    toxic_ones = [found[i] for i in kept if toxic[i]]
    bad = np.bincount(np.concatenate(toxic_ones), minlength=SLOTS) if toxic_ones else np.zeros(SLOTS)
    apart = np.abs(bad - often * share) / np.sqrt(np.maximum(often * share * (1 - share), 1e-9))
    return np.flatnonzero((often >= LEAST) & (apart >= SIGNIFICANT))


def fit(found: list[np.ndarray], toxic: np.ndarray, seed: int = 5) -> Machine:
    """Logistic loss, Adam with decay, in batches of documents."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(toxic.mean(), 0.001, 0.999)) if len(toxic) else 0.5
    bias = float(np.log(share / (1 - share)))
    full_w, full_v = np.zeros(SLOTS), np.zeros((SLOTS, FACTORS))
    if not len(toxic) or toxic.min() == toxic.max():
        return Machine(bias, full_w, full_v)
    used = telling(found, toxic)
    place = np.full(SLOTS, -1)
    place[used] = np.arange(len(used))
    rows = [p[p >= 0] for p in (place[x] for x in found)]
    w, v = np.zeros(len(used)), rng.normal(0, 0.01, (len(used), FACTORS))
    state = {"w": [np.zeros_like(w), np.zeros_like(w)], "v": [np.zeros_like(v), np.zeros_like(v)]}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        rate = RATE * 0.85**epoch
        for begin in range(0, len(order), BATCH):
            part = order[begin : begin + BATCH]
            size = np.array([len(rows[i]) for i in part])
            x = np.concatenate([rows[i] for i in part])
            doc = np.repeat(np.arange(len(part)), size)
            vx = v[x]
            total = np.stack([np.bincount(doc, vx[:, f], len(part)) for f in range(FACTORS)], axis=1)
            square = np.bincount(doc, (vx * vx).sum(axis=1), len(part))
            raw = bias + np.bincount(doc, w[x], len(part)) + 0.5 * ((total * total).sum(axis=1) - square)
            wrong = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - toxic[part]
            step += 1
            bias -= rate * float(wrong.mean())
            touched, back = np.unique(x, return_inverse=True)
            each = wrong[doc] / len(part)
            grad_w = np.bincount(back, each, len(touched)) + DECAY * w[touched]
            grad_v = np.stack([np.bincount(back, each * (total[doc, f] - vx[:, f]), len(touched)) for f in range(FACTORS)], axis=1) + DECAY * v[touched]
            for values, grad, (first, second) in ((w, grad_w, state["w"]), (v, grad_v, state["v"])):
                first[touched] = 0.9 * first[touched] + 0.1 * grad
                second[touched] = 0.99 * second[touched] + 0.01 * grad * grad
                values[touched] -= rate * (first[touched] / (1 - 0.9**step)) / (np.sqrt(second[touched] / (1 - 0.99**step)) + 1e-4)
    full_w[used], full_v[used] = w, v
    return Machine(bias, full_w.astype(np.float32), full_v.astype(np.float32))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id`` and ``score`` of every text. The model has a fixed size and goes to the tasks as one broadcast value."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches):
        own = shared.value
        for batch in batches:
            found = [own.score(t) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(score, "doc_id long, score double")


@query("op5_factorization_toxicity")
def factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's score by a machine that learned from the labels outside the held-out third."""
    docs = texts(table(spark, sf_dir, "documents"))
    found = scored(docs, fit(*sample(docs, table(spark, sf_dir, "labels"))))
    own = found.select(own_id(), "score")
    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"))
