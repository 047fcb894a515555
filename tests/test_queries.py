"""Every query of the library with a SQL twin gives the twin's rows, and streams drop repeats and late rows."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

from millrace.plans.bindings import BASE
from millrace.plans.registry import ORACLES, QUERIES
from millrace.streaming import feedback as S
from millrace.streaming.runs import append_all, batches_all

SF = "/root/testdata/sf0.001"
#: Twins that hold only where every page is full, which takes more rows.
NEEDS_FULL_PAGES = {"keyword_search"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if value != value else repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return str([_plain(x) for x in value])
    return None if value is None else str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(str(_plain(r[k])) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - NEEDS_FULL_PAGES))
def test_query_gives_its_twins_rows(spark, duck, name):
    found = QUERIES[name](spark, SF)
    twin = duck.execute(ORACLES[name])
    names = [d[0] for d in twin.description]
    assert sorted(found.columns) == sorted(names)
    assert _rows(found.columns, found.collect()) == _rows(names, twin.fetchall())


def _stream(spark, folder, rows, schema):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


T0 = dt.datetime(2024, 1, 1)


def test_ingest_keeps_one_row_of_an_id_over_batches(spark, tmp_path):
    rows = [[(1, T0, "select"), (1, T0, "select")], [(1, T0, "select"), (2, T0, None)]]
    found = append_all(S.ingest(_stream(spark, tmp_path, rows, "id long, created_at timestamp, action string")), "t")
    assert sorted(r.id for r in found.collect()) == [1, 2]


def test_windowed_counts_emit_closed_windows_once(spark, tmp_path):
    rows = [[(1, T0, "a"), (2, T0 + dt.timedelta(minutes=5), "a"), (3, None, "a")], [(4, T0 + dt.timedelta(days=3), "b")]]
    found = append_all(S.windowed_counts(_stream(spark, tmp_path, rows, "id long, created_at timestamp, action string")), "t")
    assert [(r.action, r.n) for r in found.collect()] == [("a", 2)]


def test_totals_over_batches_are_the_last_ones(spark, tmp_path):
    rows = [[("q", "select", 1.5)], [("q", "select", 0.25), ("q", None, None)]]
    stream = _stream(spark, tmp_path, rows, "query_signature string, action string, feedback_weight double")
    found = {r.action: (r.n, r.weight) for r in batches_all(S.running_totals(stream), "t", "complete").collect()}
    assert found == {"select": (2, 1.75), None: (1, None)}


def test_views_end_with_the_share(spark):
    views = spark.createDataFrame([("s", T0), ("s", T0 + dt.timedelta(hours=1)), ("s", T0 + dt.timedelta(hours=2)), ("x", T0), (None, T0)], "share_id string, viewed_at timestamp")
    shares = spark.createDataFrame([("s", T0 + dt.timedelta(hours=1))], "share_id string, expire_at timestamp")
    assert [tuple(r) for r in S.live_views(views, shares).collect()] == [("s", 2)]
