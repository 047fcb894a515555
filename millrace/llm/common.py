"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own if unset (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner", total: int | None = None, heavy: int = 64) -> DataFrame:
    """rows joined with table (one row a key; weight: how many rows share the key), safe from hot keys.

    Entries of the table whose weight is over ``heavy`` and over 1/4096 of all
    are at most 4096, whatever the size of the tables: these are broadcast, so
    rows with such a key stay where they are. All others are joined by a
    shuffle in which no key has more rows than that share. A null key finds
    nothing. The table's key and weight are not among the columns returned.
    total: of all weights, if known. how: inner or left.
    """
    names = [c for c in table.columns if c not in (key, weight)]
    if total is None:
        total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    least = max(heavy, total // 4096)
    few = table.where(F.col(weight) > least).select(F.col(key).alias("_key"), F.struct(*names).alias("_hot"))
    many = table.where(F.col(weight) <= least).select(F.col(key).alias("_key"), F.struct(*names).alias("_cold"))
    marked = rows.join(F.broadcast(few), F.col(key) == F.col("_key"), "left").drop("_key")
    hot = marked.where("_hot is not null").select(*rows.columns, F.col("_hot").alias("_found"))
    rest = marked.where("_hot is null").drop("_hot")
    cold = rest.join(many, F.col(key) == F.col("_key"), how).select(*rows.columns, F.col("_cold").alias("_found"))
    return hot.union(cold).select(*rows.columns, *(F.col(f"_found.{c}").alias(c) for c in names))


def keep_first(docs: DataFrame, key: Column, named: DataFrame) -> DataFrame:
    """One row of docs of each component: that with the least doc_id (nulls last), then the least text hash.

    key stands for a row's text; named (hash, component) has the keys that share a component with others. Of rows
    that repeat both doc_id and text one stays. Columns of docs may have any names.
    """
    # one text of 128 bits stands for doc_id and text: rows are joined and told apart by it in a single shuffle
    told = F.md5(F.concat_ws("\x00", F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("")), F.coalesce(F.concat(F.lit("t"), F.col("text").cast("string")), F.lit(""))))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "told")).alias("best")
    keyed = docs.select("doc_id", key.alias("hash"), F.xxhash64("text").alias("text_hash"), told.alias("told"))
    kept = (
        keyed.groupBy("hash").agg(best).join(named, "hash", "left")
        .groupBy(F.coalesce("component", "hash").alias("component")).agg(F.min("best").alias("best"))
        .select(F.col("best.told").alias("told"))
    )
    rows = docs.select(told.alias("told"), F.struct("*").alias("row"))
    return rows.join(kept, "told", "left_semi").dropDuplicates(["told"]).select("row.*")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so when the driver's heap is collected."""
    gc.collect()
    spark._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Delete a table written by :func:`save` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): returns (node, component), the least node reachable.

    Alternates the large-star and small-star steps on grouped minima, so each
    round is two hash aggregations and joins; the number of rounds grows with
    the logarithm of the longest path. A star's centre, which may have as many
    edges as there are rows, is looked up by broadcast (see :func:`lookup`).
    Every round is written to the shared folder, and the round before it
    deleted. No edges: no rows. Loops and repeated edges are harmless.
    """
    now = save(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        total = 2 * mark[0]
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = lookup(both, least, "u", "n", total=total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = save(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = lookup(large, least, "u", "n", total=total).select(F.explode(F.expr("array(struct(u, m as v), struct(v as u, m as v))")).alias("e"))
        before, now = now, save(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        forget(before)
        forget(large)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
