"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its ``profile`` most frequent n-grams
(runs of one to three letters, word edges included), counted over the whole
texts of all rows to learn from. A document's own list is compared to every
profile by the out-of-place distance: the sum over its n-grams of how far
apart the two ranks are, and ``profile`` where the language lacks it.

N-grams are counted in 2**15 hash buckets, so a count is an array addition;
n-grams that share a bucket count as one. A profile fills ``profile`` buckets,
so at the default of 300 a foreign n-gram meets one of a language's own by
chance in one case of a hundred, at a random rank. Counts are summed per task
and then by Spark, and only the profiles (at most ``profile`` rows a language)
reach the driver.

Defined cases: null text, or text without a letter, is ``und`` with score 0;
without any row to learn from every row is ``und``; equal distances go to the
first language in code-point order; equal counts to the smaller bucket;
repeated rows are each learned from and predicted; an empty table gives no
rows. Extra columns, whatever their names, are kept by :func:`accept`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.text_stream import grams, letters

BITS = 15
UNKNOWN = "und"


def counts(text: str | None) -> np.ndarray | None:
    """How often each bucket's n-grams occur; None if there is no letter."""
    x = letters(text)
    if not len(x):
        return None
    inner = x != 0
    one = grams(x, 1, BITS)[inner]
    two = grams(x, 2, BITS)
    # three: not across a word edge
    three = grams(x, 3, BITS)[inner[1:-1]]
    return np.bincount(np.concatenate([one, two, three]), minlength=1 << BITS)


def ranked(count: np.ndarray, profile: int) -> np.ndarray:
    """The most frequent buckets, most frequent first."""
    some = np.flatnonzero(count)
    return some[np.argsort(-count[some], kind="stable")][:profile]


def _count_by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (c := counts(text)) is not None:
                total[lang] = total[lang] + c if lang in total else c
    for lang, c in total.items():
        some = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(c[some], pa.int64())], names=["lang", "bucket", "n"])


def learn(rows: DataFrame, profile: int = 300) -> dict[str, list[int]]:
    """Profiles from (lang, text): for each language its n-gram buckets by falling count."""
    found = rows.where("lang is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    summed = found.mapInArrow(_count_by_lang, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    top = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "bucket"))).where(f"rank <= {profile}")
    out: dict[str, list[int]] = {}
    for lang, bucket, _ in sorted(((r.lang, r.bucket, r.rank) for r in top.collect()), key=lambda r: (r[0], r[2])):
        out.setdefault(lang, []).append(bucket)
    return out


class Ranks:
    """Profiles as one table of ranks."""

    def __init__(self, profiles: dict[str, list[int]], profile: int = 300) -> None:
        self.profile = profile
        self.langs = sorted(profiles, key=lambda s: s.encode("utf-8", "surrogatepass"))
        self.rank = np.full((len(self.langs), 1 << BITS), profile, np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[k, profiles[lang]] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is the softmax of the languages' distances, of which 0.05 divides by e."""
        c = counts(text)
        if c is None or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(c, self.profile)
        far = np.abs(self.rank[:, own] - np.arange(len(own))).sum(1) / (len(own) * self.profile)
        near = np.exp(-(far - far.min()) / 0.05)
        best = int(np.argmin(far))
        return self.langs[best], float(near[best] / near.sum())


def _predict(batches: Iterator[pa.RecordBatch], profiles: dict[str, list[int]], profile: int, at: int) -> Iterator[pa.RecordBatch]:
    ranks = Ranks(profiles, profile)
    for batch in batches:
        found = [ranks.predict(x) for x in batch.column(at).to_pylist()]
        columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "lang_pred", "score"])


def identify(docs: DataFrame, profiles: dict[str, list[int]], profile: int = 300) -> DataFrame:
    """docs with lang_pred and score; columns of those names are replaced. text must be among the columns."""
    docs = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _predict(it, profiles, profile, at), f"{schema}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accept(docs: DataFrame, languages: list[str] | None = None, profile: int = 300) -> DataFrame:
    """The rows of docs whose language can be told and is among languages (all learned ones if None)."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"), profile)
    # the whole row is one column, so that no name of a column of docs can clash
    found = identify(docs.select(F.col("text"), F.struct("*").alias("row")), profiles, profile).where(F.col("lang_pred") != UNKNOWN)
    if languages is not None:
        found = found.where(F.col("lang_pred").isin(languages))
    return found.select("row.*")
