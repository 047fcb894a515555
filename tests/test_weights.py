"""What a log row weighs for a request, by how alike their normal forms are."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from millrace.functions import money as M
from millrace.operators import feedback as L

LOG = "id long, created_at timestamp, action string, query_signature string, normalized_name string, normalized_spec string, normalized_unit string, mapping_signature string, feedback_weight double"


def test_tiers_by_the_ratio_of_normal_forms(spark):
    names = ["abcdefghijklmnopqrst", "abcdefghijklmnopqrsX", "abcdefghijklmnopXXXX", "XXXXXXXXXX", "abcdefghijklmnopqr"]
    log = spark.createDataFrame([(k, None, "select", "q", n, "", " ", "m" if k % 2 else "", 2.0 if k else 0.0) for k, n in enumerate(names)], LOG)
    asked = spark.createDataFrame([(1, "q", names[0], "", "", "m")], "ask_id long, query_signature string, normalized_name string, normalized_spec string, normalized_unit string, mapping_signature string")
    found = {r.id: r.weight for r in L.weighted(L.lookup(asked, log), asked).collect()}
    for k, n in enumerate(names):
        r = SequenceMatcher(None, names[0], n).ratio()
        tier = 1.0 if r >= 0.985 else 0.8 if r >= 0.94 else 0.5 if r >= 0.85 else 0.0
        # a stored weight of 0 counts as 1
        assert abs(found[k] - (tier + (0.25 if k % 2 else 0)) * (2.0 if k else 1.0)) < 1e-12, k
    assert sorted(found) == list(range(5))


def test_amounts_in_capitals(spark):
    known = {0.0: "零元整", 0.05: "零元零伍分", 0.5: "零元伍角", 1.0: "壹元整", 10.0: "壹拾元整", 105.3: "壹佰零伍元叁角", 10001.0: "壹万零壹元整", 100000000.10: "壹亿元壹角", 1234.56: "壹仟贰佰叁拾肆元伍角陆分", 20300400.0: "贰仟零叁拾万零肆佰元整"}
    rows = spark.createDataFrame([(k,) for k in known], "x double").select("x", M.amount_in_capitals(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in rows} == known


def test_hints_and_auto_selection(spark):
    rows = [(0, 0, 0, 0.49), (2, 0, 0, 0.5), (3, 1, 0, 0.45), (4, 1, 2, 0.44)]
    frame = spark.createDataFrame(rows, "n long, hits long, changes long, score double")
    got = frame.select("n", L.hint(F.col("n"), F.col("hits"), F.col("changes")).alias("h"), L.auto_select(F.col("score"), F.col("n")).alias("a"), L.auto_select(F.col("score"), F.col("n"), True).alias("s")).orderBy("n").collect()
    assert [r.h for r in got] == ["", "已参考2条历史反馈", "已参考3条历史反馈，含模板命中经验", "已参考4条历史反馈，含模板命中经验，已识别人工修正痕迹"]
    assert [r.a for r in got] == [None, "select", "select", None] and [r.s for r in got] == [None, None, "select", None]
