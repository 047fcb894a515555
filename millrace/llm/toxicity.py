"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed features is trained with numpy from texts
confirmed toxic and unlabelled texts. With the class prior p, the share of
toxic texts among unlabelled ones, the risk on negatives is estimated as that
of unlabelled texts taken as negative less p times that of toxic texts taken
as negative; where this estimate falls below zero the step goes the other way,
so that the classifier cannot drive it down by overfitting (Kiryo et al. 2017).

Features are words and runs of five and six letters with word edges, in 2**22
hash buckets; the ones that are significantly commoner in toxic texts than in
unlabelled texts are used, each as present or absent in the whole text.

Learning uses bounded samples of the labelled rows: of the confirmed toxic ones
(at most about ``fit_toxic``), and of all labelled ones with their labels
hidden (``fit_unlabelled``), which are the unlabelled texts. They are drawn by
a hash of doc_id; their features are found, counted and compared by Spark, and
the driver gets the ``most`` chosen features and which of them the sampled rows
have. The class prior alone uses labels of both kinds. Scoring covers every
row's whole text in one pass without a shuffle.

Defined cases: null or empty text scores as a text without features; without
toxic rows to learn from every score is 0; labels that repeat a doc_id count
as toxic if any says so, null labels are ignored; repeated rows are each
scored; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import save
from millrace.llm.text_stream import SPREAD, grams, letters

BITS = 22
RUNS = (5, 6)


def features(text: str | None) -> np.ndarray:
    """Buckets of all features of a text, with repeats."""
    x = letters(text)
    if not len(x):
        return np.zeros(0, np.int64)
    edges = np.flatnonzero(x == 0)
    # a word's code is the sum of its letters' codes, each spread by its place in the word
    place = np.arange(len(x)) - np.repeat(edges, np.diff(np.append(edges, len(x))))
    spread = (x + np.uint64(131)) * (SPREAD[1] * (2 * place.astype(np.uint64) + np.uint64(1)) ^ (x << np.uint64(32)))
    words = np.add.reduceat(spread, edges)[:-1] if len(edges) > 1 else spread[:0]
    words ^= words >> np.uint64(31)
    return np.concatenate([((words * SPREAD[2]) >> np.uint64(64 - BITS)).astype(np.int64), *(grams(x, n, BITS) for n in RUNS)])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, p, u): in how many toxic and unlabelled texts of this task each feature occurs."""
    total = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[1 - toxic, np.unique(features(text))] += 1
    some = np.flatnonzero(total.any(0))
    for at in range(0, len(some), 100_000):
        part = some[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[0, part], pa.int64()), pa.array(total[1, part], pa.int64())], names=["bucket", "p", "u"])


def _hits(batches: Iterator[pa.RecordBatch], chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(toxic, hits): places in chosen of the features of each text."""
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    for batch in batches:
        found = [np.unique(p[p >= 0]) for p in (place[features(x)] for x in batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "hits"])


@dataclass
class Model:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the features present)))."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        weight = np.zeros(1 << BITS, np.float64)
        weight[self.chosen] = self.weights
        used = weight != 0
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            f = features(text)
            out[k] = self.bias + weight[np.unique(f[used[f]])].sum()
        return np.zeros(len(texts)) if self.prior == 0 else 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit_nnpu(toxic: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, ridge: float = 1e-4, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with the logistic loss (Adam, full batches)."""
    p, u = (np.hstack([m, np.ones((len(m), 1))]).astype(np.float32) for m in (toxic, unlabelled))
    w = np.zeros(p.shape[1], np.float32)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # of the loss of unlabelled and toxic texts taken as negative
        of_negative = su @ u / len(u) - prior * (sp @ p) / len(p)
        grad = prior * ((sp - 1) @ p) / len(p) + of_negative if negative >= -beta else -of_negative
        grad = grad + ridge * np.append(w[:-1], np.float32(0))
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1].astype(np.float64), float(w[-1])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, fit_toxic: int = 4096, fit_unlabelled: int = 8192, most: int = 1024, least_z: float = 4.0, least_texts: int = 3) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), neither from held-out rows.

    The class prior is the share of toxic ones among the labelled rows to learn
    from. Features that ``least_texts`` toxic texts have are ranked by how much
    commoner they are there (a z score of ``least_z`` or more); the ``most``
    first ones are the model's.
    """
    told = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_told, n_toxic = told.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0))).first()
    empty = Model(np.zeros(0, np.int64), np.zeros(0), -500.0, 0.0)
    if not n_toxic:
        return empty
    prior = min(max(n_toxic / n_told, 1e-4), 0.5)
    known = docs.select("doc_id", F.col("text").cast("string")).where(~held_out(F.col("doc_id")))
    # shares of a hash of the id; a second hash so that the two draws do not depend on each other
    share = lambda seed: F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    confirmed = known.join(told.where("toxic = 1").where(share(1) < fit_toxic / n_toxic).select("doc_id"), "doc_id").select(F.lit(1).alias("toxic"), "text")
    others = known.join(told.where(share(2) < fit_unlabelled / n_told).select("doc_id"), "doc_id").select(F.lit(0).alias("toxic"), "text")
    sample = save(confirmed.union(others).repartition(max(8, min(64, (fit_toxic + fit_unlabelled) // 256))), "toxic-sample")

    n_p, n_u = (sample.where(f"toxic = {k}").count() for k in (1, 0))
    if not n_p or not n_u:
        return empty
    counts = sample.select("toxic", "text").mapInArrow(_document_counts, "bucket long, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    p, u = F.col("p") + 0.5, F.col("u") + 0.5
    z = (F.log(p / (n_p + 1)) - F.log(u / (n_u + 1))) / F.sqrt(1 / p + 1 / u)
    best = counts.where(F.col("p") >= least_texts).withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "bucket").limit(most)
    chosen = np.array([r.bucket for r in best.select("bucket").collect()], np.int64)
    if not len(chosen):
        return empty
    rows = sample.select("toxic", "text").mapInArrow(lambda it: _hits(it, chosen), "toxic int, hits array<int>").toPandas()
    matrix = np.zeros((len(rows), len(chosen)), np.float32)
    for k, hits in enumerate(rows["hits"]):
        matrix[k, hits] = 1
    is_toxic = rows["toxic"].to_numpy() == 1
    # in a fixed order, so that reruns agree
    parts = [m[np.lexsort(m.T[:64])] for m in (matrix[is_toxic], matrix[~is_toxic])]
    weights, bias = fit_nnpu(*parts, prior)
    return Model(chosen, weights, bias, prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
