"""The feedback log, confirmations, share views and request lines as streams.

Each function takes and returns a streaming DataFrame; the same expressions
run on batch frames. Rows with a null event time never leave a windowed
aggregate. Times without a zone count in the session's zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(rows: DataFrame, time: str, late: str) -> DataFrame:
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def ingest(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Each log row once by its id, as long as its repeats come within ``late``."""
    return _timed(log, "created_at", late).dropDuplicatesWithinWatermark(["id"])


def running_totals(log: DataFrame) -> DataFrame:
    """Rows and weights of each signature and action so far; state grows with their number."""
    weight = F.col("feedback_weight").cast("decimal(18,4)")
    return log.groupBy("query_signature", "action").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).cast("double").alias("weight"))


def windowed_counts(log: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Actions in tumbling windows; a window leaves when the watermark passes its end, later rows are dropped."""
    counted = _timed(log, "created_at", late).groupBy(F.window("created_at", width), "action").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "action", "n")


def work_sessions(confirms: DataFrame, by: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of confirmations with no pause longer than ``gap``."""
    marked = _timed(confirms, "confirmed_at", late)
    found = marked.groupBy(F.session_window("confirmed_at", gap), by).agg(F.count(F.lit(1)).alias("n"), F.max("confirmed_at").alias("last_at"))
    return found.select(by, F.col("session_window.start").alias("first_at"), "last_at", "n")


def live_views(views: DataFrame, shares: DataFrame) -> DataFrame:
    """Views of each share up to and with its expiry; unknown shares have none."""
    return views.join(shares, "share_id").where("viewed_at <= expire_at").groupBy("share_id").agg(F.count(F.lit(1)).alias("views"))
