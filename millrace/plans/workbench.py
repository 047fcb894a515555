"""The work desk over all quote lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import documents as D
from millrace.operators import workbench as W
from millrace.plans.query import half_up, query
from millrace.streaming.runs import shared_dir

_q = lambda x: "'" + x + "'"
HAS = "(has_selected OR n_matches > 0 OR has_alternative)"
SCORE = "CASE WHEN has_selected THEN best_score + 0.05::DOUBLE WHEN n_matches > 0 THEN best_score WHEN has_alternative THEN 0.2::DOUBLE END"
STATUS = f"CASE WHEN confirmed AND action = 'select' THEN {_q(W.CONFIRMED)} WHEN NOT confirmed AND action = 'select' AND has_selected THEN {_q(W.WAITING)} WHEN action = 'no_match' THEN {_q(W.NONE)} WHEN action = 'ask_boss' THEN {_q(W.ASK)} WHEN n_matches > 0 THEN {_q(W.OPEN)} ELSE {_q(W.NONE)} END"
PRIORITY = f"CASE WHEN action = 'ask_boss' THEN 450 WHEN action = 'no_match' AND n_matches = 0 THEN 420 WHEN NOT confirmed AND n_matches = 0 THEN 360 WHEN NOT confirmed AND coalesce({SCORE}, 0) < 0.45 THEN 280 WHEN NOT confirmed THEN 180 ELSE 0 END"


def _work(work: DataFrame) -> DataFrame:
    """The bound lines with their candidates as structs."""
    one = lambda score: F.struct("code", F.col("product_name").alias("name"), "model", F.col("product_brand").alias("brand"), "supplier", "market_price", score.alias("score"), "has_image")
    best = F.col("best_score")
    matches = F.slice(F.array(one(best), one(best - 0.1), one(best - 0.2)), F.lit(1), F.col("n_matches").cast("int"))
    return work.select(
        "quote_id", "item_index", "name", "spec", "unit", "remark", "action", "confirmed", "decided_at",
        F.when(F.col("has_selected"), one(best + 0.05)).alias("selected"), matches.alias("matches"),
        F.when(F.col("has_alternative"), F.array(one(F.lit(0.2)))).alias("alternatives"),
    )


@query("work", sql=f"SELECT quote_id, item_index, {STATUS} AS status FROM {{work}}")
def line_statuses(work):
    return _work(work).select("quote_id", "item_index", W.line_status().alias("status"))


@query("work", sql=f"SELECT quote_id, item_index, CASE WHEN {HAS} THEN code END AS code, {half_up(SCORE, 3)} AS score FROM {{work}}")
def primary_candidates(work):
    p = W.primary()
    return _work(work).select("quote_id", "item_index", p["code"].alias("code"), F.round(p["score"], 3).alias("score"))


@query("work", sql=f"""SELECT quote_id, item_index FROM {{work}} WHERE confirmed AND action IN ('no_match', 'ask_boss') AND
contains(lower(concat_ws(' ', nullif(name, ''), nullif(spec, ''), nullif(remark, ''), nullif(unit, ''), CASE WHEN {HAS} THEN concat_ws(' ', nullif(product_name, ''), nullif(model, ''), nullif(product_brand, ''), nullif(supplier, ''), nullif(code, '')) END)), 'brand#2')""")
def workbench_filter(work):
    return W.visible(_work(work), "BRAND#2", "nomatch").select("quote_id", "item_index")


@query("work", sql=f"SELECT quote_id, item_index, CAST(row_number() OVER (PARTITION BY quote_id ORDER BY coalesce({SCORE}, 0) DESC, item_index) AS INT) AS place FROM {{work}}")
def workbench_by_match(work):
    return W.sorted_places(_work(work)).select("quote_id", "item_index", "place")


@query("work", sql=f"SELECT quote_id, item_index, CAST(row_number() OVER (PARTITION BY quote_id ORDER BY CASE WHEN {HAS} THEN market_price ELSE 0 END, item_index) AS INT) AS place FROM {{work}}")
def workbench_by_price(work):
    return W.sorted_places(_work(work), "price-asc").select("quote_id", "item_index", "place")


@query("work", sql="""SELECT quote_id, section_no, CASE section_no WHEN 1 THEN 'pending' WHEN 2 THEN 'issue' ELSE 'matched' END AS section, CASE section_no WHEN 1 THEN '待人工确认' WHEN 2 THEN '异常与待问老板' ELSE '已确认可导出' END AS title, item_index
FROM (SELECT *, CASE WHEN NOT confirmed THEN 1 WHEN action IN ('no_match', 'ask_boss') THEN 2 WHEN action = 'select' THEN 3 END AS section_no FROM {work}) WHERE section_no IS NOT NULL""")
def work_sections(work):
    return W.sections(_work(work))


@query("work", sql=f"""SELECT quote_id, CAST(place AS INT) AS place, item_index, priority FROM (SELECT *, row_number() OVER (PARTITION BY quote_id ORDER BY priority DESC, item_index) AS place FROM (SELECT quote_id, item_index, {PRIORITY} AS priority FROM {{work}}) WHERE priority > 0) WHERE place <= 5""")
def priority_queue(work):
    return W.queue(_work(work))


@query("work", sql="""SELECT count(*) AS total, count(*) FILTER (confirmed AND action = 'select') AS matched, count(*) FILTER (confirmed AND action IN ('no_match', 'ask_boss')) AS unmatched,
count(*) FILTER (NOT (confirmed AND action IN ('select', 'no_match', 'ask_boss'))) AS pending FROM {work}""")
def match_statistics(work):
    return W.match_stats(_work(work))


@query("work", sql="""SELECT *, pending = 0 AND ask_boss + no_match = 0 AS ready FROM (SELECT quote_id, count(*) AS total, count(*) FILTER (confirmed AND action = 'select') AS confirmed_lines, count(*) FILTER (action = 'ask_boss') AS ask_boss,
count(*) FILTER (action = 'no_match') AS no_match, count(*) FILTER (NOT confirmed) AS pending FROM {work} GROUP BY 1)""")
def export_readiness(work):
    return W.queue_summary(_work(work))


# two decisions on every second line, the later one by the place of the line
DECIDED = """SELECT quote_id, item_index, action, code, decided_at AS told FROM {work} WHERE item_index % 2 = 0 UNION ALL
SELECT quote_id, item_index, CASE WHEN item_index % 3 = 0 THEN 'select' ELSE 'no_match' END, 'x' || code, decided_at + CASE WHEN item_index % 4 = 0 THEN 1 ELSE -1 END * INTERVAL 1 DAY FROM {work} WHERE item_index % 2 = 0"""


@query("work", sql=f"""WITH d AS (SELECT quote_id, item_index, arg_max(action, told) AS action, arg_max(code, told) AS code FROM ({DECIDED}) GROUP BY 1, 2)
SELECT w.quote_id, w.item_index, d.quote_id IS NOT NULL OR w.confirmed AS confirmed, coalesce(d.action, w.action) AS action, CASE WHEN d.quote_id IS NULL THEN CASE WHEN has_selected THEN w.code END WHEN d.action = 'select' THEN d.code END AS code FROM {{work}} AS w LEFT JOIN d ON d.quote_id = w.quote_id AND d.item_index = w.item_index""")
def confirmed_selections(work):
    # of a product only its code is asked for; a line's two decisions come from one reading of it
    chosen = lambda code: F.struct(code.alias("code"))
    full = work.select("quote_id", "item_index", "action", "confirmed", F.when(F.col("has_selected"), chosen(F.col("code"))).alias("selected"))
    later = F.col("decided_at") + F.when(F.col("item_index") % 4 == 0, F.expr("INTERVAL '1' DAY")).otherwise(F.expr("INTERVAL '-1' DAY"))
    second = F.when(F.col("item_index") % 3 == 0, "select").otherwise("no_match")
    told = lambda action, code, at: F.struct(action.alias("action"), chosen(code).alias("selected"), at.alias("at"))
    both = F.array(told(F.col("action"), F.col("code"), F.col("decided_at")), told(second, F.concat(F.lit("x"), "code"), later))
    decisions = work.where("item_index % 2 = 0").select("quote_id", "item_index", F.explode(both).alias("d")).select("quote_id", "item_index", "d.*")
    return W.confirm(full, decisions).select("quote_id", "item_index", "confirmed", "action", F.col("selected.code").alias("code"))


@query("work", sql="SELECT quote_id, item_index, n_matches = 0 OR best_score < 0.4 AS look_further, n_matches > 0 AND has_image AS image_assisted FROM {work}")
def candidate_checks(work):
    return _work(work).select("quote_id", "item_index", W.needs_alternatives().alias("look_further"), W.image_assisted().alias("image_assisted"))


ASKED = """SELECT quote_id, CASE quote_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'mall_return' WHEN 2 THEN 'nothing' ELSE 'mall_inbound' END AS template_key, CASE quote_id % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'dropdown' ELSE 'other' END AS export_format, CASE quote_id % 5 WHEN 0 THEN 'cost' WHEN 1 THEN 'adjusted' ELSE 'market' END AS price_type FROM {quotes}"""


@query("quotes", sql=f"""SELECT quote_id, coalesce(reason, '') AS reason FROM (SELECT quote_id, CASE WHEN template_key = 'nothing' THEN '所选导出模板不存在' WHEN template_key = 'mall_return' AND price_type = 'cost' THEN '当前导出模板不支持所选价格类型'
WHEN template_key = '' AND export_format = 'standard' AND price_type = 'cost' THEN '当前导出模板不支持所选价格类型' WHEN template_key = '' AND export_format = 'dropdown' AND price_type <> 'market' THEN '当前导出模板不支持所选价格类型' END AS reason FROM ({ASKED}))""")
def price_type_checks(quotes):
    k = F.col("quote_id")
    asked = quotes.select(
        "quote_id", F.when(k % 4 == 0, "").when(k % 4 == 1, "mall_return").when(k % 4 == 2, "nothing").otherwise("mall_inbound").alias("template_key"),
        F.when(k % 3 == 0, "standard").when(k % 3 == 1, "dropdown").otherwise("other").alias("export_format"), F.when(k % 5 == 0, "cost").when(k % 5 == 1, "adjusted").otherwise("market").alias("price_type"),
    )
    good, bad = W.check_price_types(asked)
    return good.select("quote_id", F.lit("").alias("reason")).union(bad.select("quote_id", "reason"))


@query("results", sql="SELECT quote_id, item_index AS line_no, CASE WHEN action = 'select' THEN product_name ELSE name END AS product, quantity, CASE WHEN action = 'select' THEN supplier END AS supplier FROM {results}")
def exported_statements(results):
    """The statement of account, written as one folder per supplier and read again."""
    sheet = D.statement_sheet(results).select("quote_id", "line_no", "product", "quantity", "supplier")
    return W.export(sheet, f"{shared_dir(results.sparkSession)}/statement-{uuid.uuid4().hex}", "supplier")
