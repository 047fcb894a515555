"""Running a stream over all that is there now, and where its files go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only in local mode without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: for what several later steps read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """A Parquet file of a folder as a stream; files that come later under that name are read too."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def append_all(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream over all input that is there, and read what it wrote."""
    spark, home = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start(f"{home}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")


def batches_all(stream: DataFrame, name: str, mode: str, turn: Callable[[DataFrame], DataFrame] = lambda b: b) -> DataFrame:
    """Run a stream by batches, each turned into a table of its own; in complete mode only the last one counts, in update mode rows have their batch.

    A batch that is run again overwrites its own table, so that retries don't double rows.
    """
    spark, home = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    last: list = []

    def write(batch: DataFrame, batch_id: int) -> None:
        out = turn(batch)
        out = out.withColumn("batch", F.lit(batch_id)) if mode == "update" else out
        out.write.mode("overwrite").parquet(f"{home}/rows/batch={batch_id}")
        last[:] = [batch_id, out.schema]

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], turn(spark.createDataFrame([], stream.schema)).schema)
    at = f"{home}/rows/batch={last[0]}" if mode == "complete" else f"{home}/rows/*"
    return spark.read.schema(last[1]).parquet(at)
