"""Running totals with state that is let go after a horizon."""

import datetime as dt

import pytest

from millrace.streaming import bounded as B
from millrace.streaming.runs import batches_all, shared_dir

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "query_signature string, action string, feedback_weight double, created_at timestamp"


@pytest.fixture
def rocksdb(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    B.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if was is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def updates(spark, folder, parts, horizon):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    return batches_all(B.running_totals(stream, horizon), "bounded", "update")


def test_totals_within_the_horizon_are_all_and_quiet_keys_start_anew(spark, tmp_path, rocksdb):
    day = dt.timedelta(days=1)
    parts = [
        [("q", "select", 1.5, T0), ("q", "select", 0.25, T0 + day), ("r", "select", 1.0, T0)],
        [("q", "select", 2.0, T0 + 5 * day), ("q", "no_match", None, T0 + 5 * day)],
        [("s", "select", 1.0, T0 + 40 * day)],
        [("s", "select", 1.0, T0 + 41 * day)],
        [("q", "select", 7.0, T0 + 42 * day), ("r", "select", 7.0, T0 + 1 * day)],
    ]
    rows = [(r.query_signature, r.action, r.n, float(r.weight), r.batch) for r in updates(spark, tmp_path, parts, "30 days").collect()]
    last = {}
    for q, a, n, w, b in sorted(rows, key=lambda r: r[-1]):
        last[q, a] = (n, w)
    # q was quiet for 37 days, so its totals start anew; r's late row is left out
    assert last["q", "select"] == (1, 7.0) and last["s", "select"] == (2, 2.0) and last["q", "no_match"] == (1, 0.0)
    assert last["r", "select"] == (1, 1.0)
    # before that they were those of all its rows
    assert ("q", "select", 3, 3.75) in {r[:4] for r in rows}


def test_the_last_update_of_a_key_stays(spark):
    rows = spark.createDataFrame([("q", "a", 1, 0), ("q", "a", 3, 2), ("r", "a", 5, 1)], "query_signature string, action string, n long, batch int")
    assert {(r.query_signature, r.n) for r in B.newest_totals(rows).collect()} == {("q", 3), ("r", 5)}
    assert shared_dir(spark)
