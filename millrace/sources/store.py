"""What is kept between runs: the catalogue, the feedback log and the history of quotes.

All are Parquet folders that Spark writes and reads. The log is partitioned by
batch and the history by a hash of the quote, and writing replaces whole
partitions (Spark's dynamic partition overwrite), so a batch that is written
again is there once, and a change rewrites only the partitions that hold its
quotes. Only numbers of partitions pass the driver. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.operators.catalog import import_catalog
from millrace.operators.feedback import evolve
from millrace.streaming.runs import saved

#: Columns of the log that count as flags, kept as 0 and 1.
FLAGS = ("template_hit", "with_product_image", "mapping_changed")
PARTS = 64
BAD = "_bad_line"


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all CSV files below a folder, with a header, in UTF-8, all as text, and rejects (line): lines with too few or too many cells or an open quote.

    Files are read once. All have the first file's header; its cells are trimmed of spaces and the mark of the encoding.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("recursiveFileLookup", True).option("escape", '"')
    columns = reader.csv(path).columns
    schema = StructType([StructField(c, StringType()) for c in (*columns, BAD)])
    # a line is judged by all its cells, so none may be pruned before it is written
    told = saved(reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("enforceSchema", True).csv(path), "csv")
    named = [F.col(f"`{c}`").alias(c.replace("﻿", "").strip()) for c in columns]
    return told.where(F.col(BAD).isNull()).select(*named), told.where(F.col(BAD).isNotNull()).select(F.col(BAD).alias("line"))


def upload_catalog(spark: SparkSession, path: str, home: str) -> tuple[DataFrame, DataFrame]:
    """Import a catalogue's CSV files; it becomes the current catalogue and the last uploaded one. Returns it, and the rejects."""
    rows, rejects = read_csv(spark, path)
    catalog = import_catalog(rows)
    catalog.write.mode("overwrite").parquet(f"{home}/last_uploaded")
    kept = spark.read.schema(catalog.schema).parquet(f"{home}/last_uploaded")
    kept.write.mode("overwrite").parquet(f"{home}/current")
    return spark.read.schema(catalog.schema).parquet(f"{home}/current"), rejects


def append_feedback(new: DataFrame, log: str, batch: int, now: Column | None = None) -> None:
    """Add a batch of confirmations to the log. A batch that comes again replaces itself.

    Rows without a time get now (the server's time if it is not given), columns that are missing their defaults; flags are 0 or 1.
    """
    rows = evolve(new)
    time = F.coalesce(F.col("created_at").cast("timestamp"), now) if "created_at" in rows.columns and now is not None else now
    if time is None:
        time = F.coalesce(F.col("created_at").cast("timestamp"), F.current_timestamp()) if "created_at" in rows.columns else F.current_timestamp()
    flags = {c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in FLAGS if c in rows.columns}
    rows.withColumn("created_at", time).withColumns(flags).withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(log)


def read_feedback(spark: SparkSession, log: str) -> DataFrame:
    """The whole log; batches written before a column was added have its default."""
    return evolve(spark.read.option("mergeSchema", True).parquet(log)).drop("batch")


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col("quote_id").cast("string")), F.lit(parts)).cast("int")


def _touched(quotes: DataFrame, parts: int) -> list[int]:
    return [r[0] for r in quotes.select(_part(parts).alias("part")).distinct().collect()]


def _rewrite(spark: SparkSession, folder: str, gone: DataFrame, new: DataFrame | None, touched: list[int], parts: int) -> None:
    """Replace the touched partitions: their rows of other quotes than gone, and the new rows."""
    old = None
    if exists(spark, folder):
        old = spark.read.parquet(folder).where(F.col("part").isin(touched)).join(gone.select("quote_id").distinct(), "quote_id", "left_anti")
    rows = new.withColumn("part", _part(parts)) if new is not None else None
    whole = rows if old is None else old if rows is None else old.unionByName(rows, allowMissingColumns=True)
    if whole is None:
        return
    # written aside first: what is read here is replaced below
    whole = saved(whole, "history")
    whole.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(folder)
    left = {r[0] for r in whole.select("part").distinct().collect()}
    for part in set(touched) - left:
        _remove(spark, f"{folder}/part={part}")


def save_history(headers: DataFrame, details: DataFrame, home: str, parts: int = PARTS) -> None:
    """Add quotes to the history, or replace them: a quote's header and its detail rows. Details first: a header stands for a whole quote."""
    spark, touched = headers.sparkSession, _touched(headers, parts)
    for name, frame in (("details", details), ("headers", headers)):
        _rewrite(spark, f"{home}/{name}", headers, frame, touched, parts)


def delete_history(deleted: DataFrame, home: str, parts: int = PARTS) -> None:
    """Take quotes (quote_id) out of the history, their details first."""
    spark, touched = deleted.sparkSession, _touched(deleted, parts)
    for name in ("details", "headers"):
        _rewrite(spark, f"{home}/{name}", deleted, None, touched, parts)


def read_history(spark: SparkSession, home: str) -> tuple[DataFrame, DataFrame]:
    """Headers and details; reading one quote prunes to its partition when the part is asked for by :func:`one_quote`."""
    return tuple(spark.read.parquet(f"{home}/{n}").drop("part") for n in ("headers", "details"))


def one_quote(spark: SparkSession, home: str, quote_id, parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """A quote's header and details, from its partition alone."""
    key = F.pmod(F.xxhash64(F.lit(quote_id).cast("string")), F.lit(parts)).cast("int")
    part = spark.range(1).select(key).first()[0]
    return tuple(spark.read.parquet(f"{home}/{n}").where((F.col("part") == part) & (F.col("quote_id") == quote_id)).drop("part") for n in ("headers", "details"))
