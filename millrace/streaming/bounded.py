"""Running totals whose state is let go: a signature that is quiet for longer than a horizon starts anew.

Needs Spark's RocksDB state store, which can hold more state than memory; see
:func:`use_rocksdb`.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

KEYS = ["query_signature", "action"]
OUT = "query_signature string, action string, n long, weight decimal(18,4), last_at timestamp"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Totals(StatefulProcessor):
    """Rows and weights of a key since it was last quiet for the horizon; a timer at the end of the horizon drops them."""

    def __init__(self, horizon_ms: int) -> None:
        self.horizon = horizon_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "n long, weight decimal(18,4), last_at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, weight, last = self.total.get() if self.total.exists() else (0, Decimal(0), None)
        for batch in rows:
            n += len(batch)
            weight += sum((w for w in batch["weight"] if w is not None), Decimal(0))
            newest = batch["created_at"].max()
            if not pd.isna(newest):
                last = newest if last is None else max(pd.Timestamp(last), newest)
        self.total.update((int(n), weight, None if last is None else pd.Timestamp(last).to_pydatetime()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last is not None:
            self.handle.registerTimer(int(pd.Timestamp(last).timestamp() * 1000) + self.horizon)
        yield pd.DataFrame({"query_signature": [key[0]], "action": [key[1]], "n": [int(n)], "weight": [weight], "last_at": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.total.clear()
        yield pd.DataFrame({"query_signature": pd.Series(dtype=str), "action": pd.Series(dtype=str), "n": pd.Series(dtype="int64"), "weight": pd.Series(dtype=object), "last_at": pd.Series(dtype="datetime64[ns]")})

    def close(self) -> None:
        pass


def running_totals(log: DataFrame, horizon: str = "90 days", late: str = "1 day") -> DataFrame:
    """A row for each signature and action whenever it changes (update mode): its totals so far.

    Rows later than the watermark are left out; rows without a time count with those of their batch.
    """
    millis = int(pd.Timedelta(horizon).total_seconds() * 1000)
    timed = log.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    rows = timed.select(*KEYS, F.col("feedback_weight").cast("decimal(18,4)").alias("weight"), "created_at")
    return rows.groupBy(*KEYS).transformWithStateInPandas(Totals(millis), OUT, "Update", "EventTime")


def newest_totals(updates: DataFrame) -> DataFrame:
    """The table that updates (with their batch) make: the last row of each signature and action."""
    last = Window.partitionBy(*KEYS).orderBy(F.desc("batch"))
    return updates.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
