"""Nearest vectors by cosine through signed random projections in several tables.

Beside the exact mode (:func:`millrace.operators.matching.semantic`): every
vector is put in one bucket of each table by the signs of its projections; a
query looks into the buckets whose signs differ from its own where its
projections are small, the least margin first. Vectors of the buckets looked
into are compared exactly, in double precision, so scores are those of the exact
mode and only rows can be missing. How many buckets are looked into is a share
of all, so the work saved falls as vectors that are asked for get farther apart;
measured recall and shares are in the README.

Buckets are dealt to parts of bounded size by a hash of the row, so a bucket of
many copies is several groups; queries go to all parts of their buckets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART_ROWS = 8192


def _planes(table: int, bits: int, width: int) -> np.ndarray:
    return np.random.default_rng([table, bits, width]).normal(size=(width, bits))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _buckets(x: np.ndarray, table: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bucket and the projections."""
    seen = x @ _planes(table, bits, x.shape[1])
    return ((seen > 0) << np.arange(bits)).sum(1), seen


def _probes(seen: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """Sets of signs to turn, as bits, least margin first: rows x probes."""
    every = np.arange(1 << bits)
    cost = (seen**2) @ ((every[:, None] >> np.arange(bits)) & 1).T.astype(float)
    near = np.argpartition(cost, probes - 1, axis=1)[:, :probes] if probes < len(every) else np.tile(every, (len(seen), 1))
    return near


def _placed(batches, tables: int, bits: int, probes: int | None):
    """Rows (id, embedding) with a row for each table and bucket: their own, or with probes those to look into."""
    for batch in batches:
        x = _matrix(batch.column(1))
        for t in range(tables if len(x) else 0):
            own, seen = _buckets(x, t, bits)
            to = own[:, None] if probes is None else own[:, None] ^ _probes(seen, bits, probes)
            row = np.repeat(np.arange(len(x)), to.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(np.full(len(row), t, np.int32)), pa.array(to.ravel().astype(np.int32))], names=["id", "embedding", "table", "bucket"])


def _compared(queries: pa.Table, rows: pa.Table, least: float, most: int) -> pa.Table:
    """Of one part of a bucket: each query's best rows."""
    out = [[], [], []]
    if len(queries) and len(rows):
        q, v = _matrix(queries["embedding"]), _matrix(rows["embedding"])
        unit = lambda x: x / np.sqrt((x * x).sum(1))[:, None]
        ids, own = queries["id"].to_numpy(), rows["id"].to_numpy()
        v = unit(v)
        for at in range(0, len(q), 256):
            score = unit(q[at : at + 256]) @ v.T
            score[ids[at : at + 256][:, None] == own[None, :]] = -2.0
            # all that are as near as the last one stay, so that ties are told apart later
            bar = np.partition(score, -most, axis=1)[:, -most] if score.shape[1] > most else np.full(len(score), -2.0)
            k, j = np.nonzero((score >= np.maximum(bar, least - 1e-12)[:, None] - 1e-12))
            out[0].append(ids[at + k])
            out[1].append(own[j])
            out[2].append(score[k, j])
    joined = [np.concatenate(x) if x else np.zeros(0) for x in out]
    return pa.table({"query_id": pa.array(joined[0].astype(np.int64)), "vec_id": pa.array(joined[1].astype(np.int64)), "score": pa.array(joined[2])})


def search(queries: DataFrame, vectors: DataFrame, least: float = 0.3, most: int = 20, tables: int = 6, share: float = 0.15, bucket_rows: int = 40, part_rows: int = PART_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the vectors found, but the query's own, with a cosine of least or more, best first.

    queries, vectors: vec_id long, embedding of one length. share: of each table's buckets that a query looks into.
    bucket_rows: how many rows a bucket has on average; more rows give more bits, 12 at most. Vectors that are null,
    zero or hold null or non-finite components take no part.
    """
    value = F.col("embedding")
    whole = value.isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(value, lambda x: x != 0)
    q, v = (rows.where(whole).select(F.col("vec_id").alias("id"), value.cast("array<double>").alias("embedding")) for rows in (queries, vectors))
    n = max(1, v.count())
    bits = min(12, max(3, round(math.log2(n / bucket_rows)))) if n > bucket_rows else 3
    probes = max(4, round(share * 2**bits))
    schema = "id long, embedding array<double>, table int, bucket int"
    placed = v.mapInArrow(lambda it: _placed(it, tables, bits, None), schema)
    # at most tables * 2**bits rows
    parts = placed.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    rows = placed.join(F.broadcast(parts), ["table", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    asked = q.mapInArrow(lambda it: _placed(it, tables, bits, probes), schema).join(F.broadcast(parts.withColumnRenamed("parts", "of")), ["table", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    key = ["table", "bucket", "part"]
    found = asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(lambda a, b: _compared(a, b, least, most), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")
