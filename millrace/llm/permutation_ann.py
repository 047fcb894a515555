"""Approximate nearest neighbours by inner product with a permutation index.

A vector is represented by its ``prefix`` nearest of ``pivots`` pivots, nearest
first, and posted in the inverted file of each of them with its rank there. A
query walks the files of its own nearest pivots and adds up the footrule
distance (sum of rank differences, a pivot one side lacks counting as rank
``prefix``); the nearest by footrule are ranked again by the exact inner
product in double precision.

Inner products are turned into angles inside bands of similar norm: with M the
upper edge of a band, x goes to (x, sqrt(M*M - |x|*|x|)) / M and a query to
(q, 0), so that inside a band the largest inner product is the smallest angle.

Rows are dealt by hash to shards of some ``shard_rows`` vectors of one band.
A task takes its shards one after the other: a shard's vectors come first and
are put into its inverted files once, then every query streams past them and
sends on its ``k`` best, so memory holds one shard, whatever the size of the
table. Queries are copied once per shard; vectors are never copied. Pivots are a
bounded sample; every row is indexed.

How much is ranked again, in each shard: the nearest by footrule, ``rerank``
times k and a share ``share`` of the shard, and all whose footrule distance is
under ``near`` times the mean, which takes crowds of near copies whole, however
many they are. The rule is the same at every size. Random unit vectors of 64
dimensions are the hardest case: their nearest neighbours are hardly nearer than
the rest, so recall falls with less (README has figures).

Defined cases: rows with a null vec_id and vectors that are null, zero, of
another length than most, or hold null or non-finite components take no part;
of rows that repeat a vec_id each is searched for and found on its own; equal
scores go to the smaller vec_id; with fewer candidates than k all are returned;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import save
from millrace.llm.vectors import matrix, sample, usable


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For every row the pivots with the largest inner products, largest first; ties to the earlier pivot."""
    like = x @ pivots.T
    some = np.argpartition(-like, min(prefix, like.shape[1]) - 1, axis=1)[:, :prefix]
    order = np.lexsort((some, -np.take_along_axis(like, some, 1)), axis=1)
    return np.take_along_axis(some, order, 1)


def spread_out(x: np.ndarray, most: int, alike: float = 0.8) -> np.ndarray:
    """At most ``most`` rows of x, in order, without one whose cosine with an earlier one is above ``alike``."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    kept: list[int] = []
    for k in range(len(u)):
        if len(kept) < most and not (kept and (u[kept] @ u[k]).max() > alike):
            kept.append(k)
    return x[kept]


class InvertedFiles:
    """The postings of one shard: for each pivot its vectors and the pivot's rank in each."""

    def __init__(self, ranked: np.ndarray, pivots: int) -> None:
        self.n, self.prefix = ranked.shape
        flat = ranked.ravel()
        order = np.argsort(flat, kind="stable")
        self.vector = (order // self.prefix).astype(np.int32)
        self.rank = (order % self.prefix).astype(np.int32)
        self.start = np.searchsorted(flat[order], np.arange(pivots + 1))

    def footrule(self, ranked: np.ndarray) -> np.ndarray:
        """Distance of every vector of the shard to a query's pivots."""
        # with no pivot in common: both lists' ranks count in full
        gain = np.zeros(self.n, np.int32)
        for r, p in enumerate(ranked):
            at = slice(self.start[p], self.start[p + 1])
            rank = self.rank[at]
            gain[self.vector[at]] += (self.prefix - r) + (self.prefix - rank) - np.abs(rank - r)
        return self.prefix * (self.prefix + 1) - gain


class Shard:
    """One shard's vectors, indexed once, for any number of queries."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray, band: int, pivots: np.ndarray, prefix: int) -> None:
        order = np.lexsort((row, ids))
        self.row, self.ids, self.x = row[order], ids[order], x[order]
        self.pivots, self.prefix = pivots, prefix
        edge = 2 ** ((band + 0.5) / 4)
        tail = np.sqrt(np.maximum(edge**2 - (self.x**2).sum(1), 0))
        self.index = InvertedFiles(nearest_pivots(np.column_stack([self.x, tail]) / edge, pivots, prefix), len(pivots))

    def ask(self, row: np.ndarray, x: np.ndarray, k: int, rerank: int, share: float, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, place of the vector, score) of each query's k best of what is ranked again."""
        n = len(self.ids)
        ranked = nearest_pivots(np.column_stack([x, np.zeros(len(x))]), self.pivots, self.prefix)
        most = min(n, rerank * k + int(np.ceil(share * n)))
        slack = 1e-9 * np.sqrt((self.x**2).sum(1).max()) * np.sqrt((x**2).sum(1))
        out = []
        for q in range(len(row)):
            far = self.index.footrule(ranked[q])
            take = far <= max(np.partition(far, most - 1)[most - 1], near * far.mean())
            some = np.flatnonzero(take & (self.row != row[q]))
            score = self.x[some] @ x[q]
            if len(some) > k:
                some = some[score >= np.partition(score, -k)[-k] - slack[q]]
            score = np.einsum("ij,j->i", self.x[some], x[q])
            best = np.lexsort((self.ids[some], -score))[:k]
            out.append((np.full(len(best), q), some[best], score[best]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3


def _search(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, prefix: int, k: int, rerank: int, share: float, near: float) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, a shard's own rows (role 0) before its queries (role 1)."""
    held: list[pa.RecordBatch] = []
    now, shard = None, None
    for batch in batches:
        keys = np.column_stack([batch.column(c).to_numpy() for c in (0, 1, 2)])
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
        for lo, hi in zip(starts, [*starts[1:], len(keys)], strict=False):
            part, (band, number, role) = batch.slice(lo, hi - lo), keys[lo]
            if (band, number) != now:
                now, shard, held = (band, number), None, []
            if role == 0:
                held.append(part)
                continue
            if not held and shard is None:
                continue
            if shard is None:
                whole = pa.Table.from_batches(held)
                shard, held = Shard(whole["row"].to_numpy(), whole["vec_id"].to_numpy(), matrix(whole["embedding"]), int(band), pivots, prefix), []
            row, ids = part.column("row").to_numpy(), part.column("vec_id").to_numpy()
            q, v, score = shard.ask(row, matrix(part.column("embedding")), k, rerank, share, near)
            yield pa.RecordBatch.from_arrays([pa.array(row[q], pa.int64()), pa.array(ids[q], pa.int64()), pa.array(shard.ids[v], pa.int64()), pa.array(score, pa.float64())], names=["query", "query_id", "vec_id", "score"])


def search(rows: DataFrame, is_query, k: int = 20, pivots: int = 512, prefix: int = 128, rerank: int = 4, share: float = 0.04, near: float = 0.3, shard_rows: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which is_query(vec_id) holds."""
    good = usable(rows.where("vec_id is not null").select(F.col("vec_id").cast("long"), "embedding"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    banded = good.withColumn("band", F.round(4 * F.log2(norm)).cast("int")).withColumn("row", F.monotonically_increasing_id())
    good = save(banded, "vectors")
    # bands are as many as quarter powers of two that norms span
    sizes = {r.band: r.n for r in good.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return good.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # near copies among pivots would order other vectors' lists by chance
    anchors = spread_out(sample(good, 4 * pivots), pivots)
    # pivots are taken as vectors of the edge of their own band
    edges = 2 ** ((np.round(4 * np.log2(np.linalg.norm(anchors, axis=1))) + 0.5) / 4)
    tail = np.sqrt(np.maximum(edges**2 - (anchors**2).sum(1), 0))
    anchors = np.column_stack([anchors, tail]) / edges[:, None]
    used = min(prefix, len(anchors))

    shards = {b: -(-n // shard_rows) for b, n in sizes.items()}
    count = F.create_map(*(F.lit(x) for pair in shards.items() for x in pair))
    columns = ["row", "vec_id", "embedding"]
    own = good.select("band", F.pmod(F.xxhash64("row"), count[F.col("band")]).cast("int").alias("shard"), F.lit(0).alias("role"), *columns)
    asked = good.where(is_query(F.col("vec_id"))).select(F.explode(F.array(*(F.lit(b) for b in sizes))).alias("band"), *columns)
    asked = asked.select("band", F.explode(F.sequence(F.lit(0), count[F.col("band")].cast("int") - 1)).alias("shard"), F.lit(1).alias("role"), *columns)
    dealt = own.unionByName(asked).repartition(sum(shards.values()), "band", "shard").sortWithinPartitions("band", "shard", "role")
    found = dealt.mapInArrow(lambda it: _search(it, anchors, used, k, rerank, share, near), "query long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
