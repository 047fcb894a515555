"""Streaming queries, each run over the whole events or orders tables by an availableNow trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.rematching import Prepared
from millrace.plans.bindings import VIEWS, bind, with_views
from millrace.plans.query import ORACLES, QUERIES
from millrace.streaming import feedback as S
from millrace.streaming.runs import append_all, batches_all, read_table


def _events(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    events = bind(spark, sf_dir, "events")
    return spark.sql(VIEWS[view], events=read_table(spark, sf_dir, "events", events.schema))


def _plain(rows: DataFrame) -> DataFrame:
    """Times without a zone, as the events have them."""
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in rows.dtypes if kind == "timestamp"})


def stream_ingest(spark, sf_dir):
    return _plain(append_all(S.ingest(_events(spark, sf_dir, "feedback").select("id", "created_at", "action")), "ingest"))


def stream_running_totals(spark, sf_dir):
    return batches_all(S.running_totals(_events(spark, sf_dir, "feedback")), "totals", "complete")


def stream_windowed_counts(spark, sf_dir):
    return _plain(append_all(S.windowed_counts(_events(spark, sf_dir, "feedback")), "windows"))


def stream_work_sessions(spark, sf_dir):
    return _plain(append_all(S.work_sessions(_events(spark, sf_dir, "confirms"), "template_name"), "sessions"))


def _shares(views: DataFrame) -> DataFrame:
    """Made on the first view, open for ten days."""
    return views.groupBy("share_id").agg((F.min("viewed_at") + F.expr("INTERVAL 10 DAYS")).alias("expire_at"))


def stream_live_views(spark, sf_dir):
    return batches_all(S.live_views(_events(spark, sf_dir, "shares"), _shares(bind(spark, sf_dir, "shares"))), "views", "complete")


def stream_matched_lines(spark, sf_dir):
    """New request rows matched to the static catalogue, batch by batch, by the matcher of tables."""
    part = bind(spark, sf_dir, "part")
    asked = read_table(spark, sf_dir, "part", part.schema).select(F.col("p_partkey").alias("line_id"), F.concat(F.lit(" "), F.upper("p_name")).alias("raw_name"))
    blank = F.lit("")
    products = bind(spark, sf_dir, "catalog").select("catalog_idx", F.lower("name").alias("name"), blank.alias("model"), blank.alias("brand"))

    prepared = Prepared(products)

    def turn(batch: DataFrame) -> DataFrame:
        lines = batch.select("line_id", F.lower(F.trim("raw_name")).alias("name"))
        best = prepared.match(lines.select("name", blank.alias("spec"), blank.alias("brand")), most=1)
        return lines.join(best.select("name", "catalog_idx"), "name").select("line_id", "catalog_idx")

    return batches_all(asked, "matched", "append", turn)


SQL = {
    "stream_ingest": "SELECT id, created_at, action FROM {feedback} QUALIFY row_number() OVER (PARTITION BY id) = 1",
    "stream_running_totals": "SELECT query_signature, action, count(*) AS n, CAST(sum(CAST(feedback_weight AS DECIMAL(18,4))) AS DOUBLE) AS weight FROM {feedback} GROUP BY ALL",
    "stream_windowed_counts": """SELECT window_start, action, count(*) AS n FROM (SELECT date_trunc('hour', created_at) AS window_start, action FROM {feedback})
        WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(created_at) - INTERVAL 1 DAY FROM {feedback}) GROUP BY ALL""",
    "stream_work_sessions": """WITH s AS (SELECT *, CASE WHEN confirmed_at - lag(confirmed_at) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM {confirms} WINDOW w AS (PARTITION BY template_name ORDER BY confirmed_at)),
        r AS (SELECT *, sum(opens) OVER (PARTITION BY template_name ORDER BY confirmed_at) AS run FROM s)
        SELECT template_name, min(confirmed_at) AS first_at, max(confirmed_at) AS last_at, count(*) AS n FROM r GROUP BY template_name, run
        HAVING max(confirmed_at) + INTERVAL 30 MINUTE <= (SELECT max(confirmed_at) - INTERVAL 1 DAY FROM {confirms})""",
    "stream_live_views": """SELECT share_id, count(*) AS views FROM {shares} AS v JOIN (SELECT share_id, min(viewed_at) + INTERVAL 10 DAY AS expire_at FROM {shares} GROUP BY 1) USING (share_id) WHERE viewed_at <= expire_at GROUP BY 1""",
    "stream_matched_lines": "SELECT p_partkey AS line_id, min(p_partkey) OVER (PARTITION BY lower(p_name)) AS catalog_idx FROM {part}",
}
for _f in (stream_ingest, stream_running_totals, stream_windowed_counts, stream_work_sessions, stream_live_views, stream_matched_lines):
    QUERIES[_f.__name__] = _f
    ORACLES[_f.__name__] = with_views(SQL[_f.__name__])
