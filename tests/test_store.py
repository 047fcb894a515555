"""Tables kept between runs: what is written twice is there once, and a change touches only its partitions."""

from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from millrace.sources import store

HEADER = ",".join(["* 商品编码", "* 商品名称", "* 型号", "* 商品类别", "* 单位", "* 市场价", "商品品牌", "成本价"])


def test_a_catalogue_is_read_its_bad_lines_are_told_and_it_is_kept_twice(spark, tmp_path):
    (tmp_path / "up").mkdir()
    lines = ["A1,手套,M1,劳保,双,\"1,234.5\",3M,10", "A2,\"帽子, \"\"大\"\"\n两行\",M2,劳保,顶,5,,", "A3,  ,M3,劳保,顶,5,,", "short,line", "A4,口罩,M4,劳保,个,oops,,x", "a,b,c,d,e,f,g,h,i,j"]
    (tmp_path / "up" / "one.csv").write_bytes(("﻿" + HEADER + "\n" + "\n".join(lines) + "\n").encode())
    (tmp_path / "up" / "two.csv").write_text(HEADER + "\nB1,雨鞋,M5,劳保,双,7.5,,\n", encoding="utf-8")
    catalog, rejects = store.upload_catalog(spark, str(tmp_path / "up"), str(tmp_path / "home"))
    got = {r.code: (r.name, r.market_price, r.cost_price) for r in catalog.collect()}
    assert got == {"A1": ("手套", 1234.5, 10.0), "A2": ('帽子, "大"\n两行', 5.0, None), "A4": ("口罩", 0.0, None), "B1": ("雨鞋", 7.5, None)}
    assert sorted(r.line for r in rejects.collect()) == ["a,b,c,d,e,f,g,h,i,j", "short,line"]
    # a later upload takes the place of both
    (tmp_path / "up2").mkdir()
    (tmp_path / "up2" / "x.csv").write_text(HEADER + "\nC1,毛巾,,,条,1,,\n", encoding="utf-8")
    store.upload_catalog(spark, str(tmp_path / "up2"), str(tmp_path / "home"))
    for kept in ("current", "last_uploaded"):
        assert [r.code for r in spark.read.parquet(str(tmp_path / "home" / kept)).collect()] == ["C1"]


def test_a_batch_of_the_log_that_comes_twice_counts_once(spark, tmp_path):
    log = str(tmp_path / "log")
    now = F.lit("2024-05-01 10:00:00").cast("timestamp")
    old = spark.createDataFrame([(1, "select", True), (2, "no_match", None)], "id long, action string, template_hit boolean")
    new = spark.createDataFrame([(3, "select", datetime(2024, 1, 2), 2.5, "m")], "id long, action string, created_at timestamp, feedback_weight double, mapping_signature string")
    for batch, rows in ((1, old), (2, new), (1, old), (2, new)):
        store.append_feedback(rows, log, batch, now)
    got = {r.id: r for r in store.read_feedback(spark, log).collect()}
    assert set(got) == {1, 2, 3}
    assert [got[k].template_hit for k in (1, 2, 3)] == [1, 0, 0]
    assert [got[k].created_at for k in (1, 3)] == [datetime(2024, 5, 1, 10), datetime(2024, 1, 2)]
    assert [got[k].feedback_weight for k in (1, 3)] == [1.0, 2.5] and [got[k].mapping_signature for k in (1, 3)] == ["", "m"]
    store.append_feedback(old.limit(1), log, 3)
    assert store.read_feedback(spark, log).count() == 4


def history(spark, ids, price=2.0):
    headers = spark.createDataFrame([(k, f"c{k}", 2 * price) for k in ids], "quote_id long, customer string, total_amount double")
    details = spark.createDataFrame([(k, i, price) for k in ids for i in (1, 2)], "quote_id long, item_index int, price double")
    return headers, details


def files(home):
    return {str(f.relative_to(home)): f.stat().st_mtime_ns for f in Path(home).rglob("part-*.parquet")}


def test_history_is_written_replaced_and_deleted_by_its_partitions(spark, tmp_path):
    home = str(tmp_path / "history")
    store.save_history(*history(spark, range(40)), home, parts=16)
    store.save_history(*history(spark, range(38, 50), 3.0), home, parts=16)
    headers, details = store.read_history(spark, home)
    assert sorted(r.quote_id for r in headers.collect()) == list(range(50)) and details.count() == 100
    assert {r.quote_id: r.total_amount for r in headers.collect()} == {k: 6.0 if k >= 38 else 4.0 for k in range(50)}
    # a delete leaves other partitions' files as they are
    before = files(home)
    gone = spark.createDataFrame([(7,), (1000,)], "quote_id long")
    parts = {r[0] for r in gone.select(store._part(16)).collect()}
    store.delete_history(gone, home, parts=16)
    after = files(home)
    same = {f for f in before if after.get(f) == before[f]}
    assert {f for f in before if not any(f"part={p}/" in f for p in parts)} == same and same
    headers, details = store.read_history(spark, home)
    assert sorted(r.quote_id for r in headers.collect()) == [k for k in range(50) if k != 7] and details.where("quote_id = 7").count() == 0
    # so does one that empties a partition
    part = next(iter(parts))
    ids = [r.quote_id for r in headers.where(store._part(16) == part).collect()]
    if ids:
        store.delete_history(spark.createDataFrame([(k,) for k in ids], "quote_id long"), home, parts=16)
        headers, details = store.read_history(spark, home)
        assert {r.quote_id for r in headers.collect()} == set(range(50)) - {7} - set(ids)
    one, rows = store.one_quote(spark, home, 39, parts=16)
    assert [r.total_amount for r in one.collect()] == [6.0] and rows.count() == 2
    store.delete_history(gone, str(tmp_path / "none"))
