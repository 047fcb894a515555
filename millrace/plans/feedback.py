"""The feedback log."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import feedback as L
from millrace.operators.matching import edit_ratio
from millrace.plans.query import half_up, query

ASKED = "SELECT md5(query_signature || '/' || normalized_name || '/' || normalized_spec || '/' || normalized_unit || '/' || mapping_signature) AS ask_id, * FROM {asked}"
NEWEST = "QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY created_at DESC, id DESC) <= 50"
_path = lambda keys: f"SELECT a.ask_id, l.* FROM a JOIN (SELECT * FROM {{feedback}} {NEWEST.replace('{k}', ', '.join(keys))}) AS l ON " + " AND ".join(f"a.{k} = l.{k}" for k in keys)
FOUND = f"""a AS ({ASKED}), found AS (SELECT DISTINCT * FROM ({_path(['query_signature'])} UNION ALL {_path(['normalized_name', 'normalized_spec', 'normalized_unit'])} UNION ALL {_path(['mapping_signature'])}))"""
# rows found by their very signature are alike; the others count by mapping alone
WEIGHT = "((CASE WHEN f.query_signature = a.query_signature THEN 1.0 ELSE 0.0 END) + (CASE WHEN f.mapping_signature = a.mapping_signature THEN 0.25 ELSE 0.0 END))::DOUBLE * f.feedback_weight::DOUBLE"
WEIGHTED = f"{FOUND}, w AS (SELECT f.*, {WEIGHT} AS weight FROM found f JOIN a ON a.ask_id = f.ask_id)"


def _asked(asked):
    return asked.withColumn("ask_id", F.md5(F.concat_ws("/", "query_signature", "normalized_name", "normalized_spec", "normalized_unit", "mapping_signature")))


def _weighted(asked, feedback):
    a = _asked(asked)
    log = feedback.withColumn("feedback_weight", F.col("feedback_weight").cast("double"))
    own = a.select("ask_id", F.col("query_signature").alias("qs"), F.col("mapping_signature").alias("ms"))
    return L.lookup(a, log).join(own, "ask_id").withColumn("weight", L.weight_of(F.when(F.col("query_signature") == F.col("qs"), 1.0).otherwise(0.0), F.col("mapping_signature") == F.col("ms"), F.col("feedback_weight")))


@query("asked", "feedback", sql=f"WITH {FOUND} SELECT ask_id, id, action, created_at FROM found")
def feedback_lookup(asked, feedback):
    return L.lookup(_asked(asked), feedback).select("ask_id", "id", "action", "created_at")


@query("asked", "feedback", sql=f"""WITH {WEIGHTED} SELECT ask_id, code, {half_up("sum(CASE WHEN action = 'select' THEN weight ELSE 0 END)", 4)} AS selected, {half_up("sum(CASE WHEN action = 'select' AND with_product_image THEN weight ELSE 0 END)", 4)} AS selected_image,
{half_up("sum(CASE WHEN action = 'no_match' THEN weight WHEN action = 'ask_boss' THEN weight * 0.5::DOUBLE ELSE 0 END)", 4)} AS rejected
FROM (SELECT *, CASE WHEN action = 'select' THEN nullif(selected_product_code, '') ELSE nullif(top_candidate_code, '') END AS code FROM w) WHERE weight > 0 AND code IS NOT NULL GROUP BY 1, 2""")
def feedback_by_code(asked, feedback):
    return L.by_code(_weighted(asked, feedback))


@query("asked", "feedback", sql=f"""WITH {WEIGHTED} SELECT ask_id, count(*) AS feedback_count, {half_up("sum(CASE WHEN action = 'no_match' THEN weight ELSE 0 END)")} AS no_match_count, {half_up("sum(CASE WHEN action = 'ask_boss' THEN weight ELSE 0 END)")} AS ask_boss_count,
{half_up("sum(CASE WHEN template_hit THEN weight ELSE 0 END)")} AS template_hit_count, {half_up("sum(CASE WHEN mapping_changed THEN weight ELSE 0 END)")} AS mapping_changed_count FROM w GROUP BY 1""")
def feedback_overall(asked, feedback):
    return L.overall(_weighted(asked, feedback))


@query("feedback", sql=f"""WITH n AS (SELECT * FROM {{feedback}} {NEWEST.replace('{k}', 'query_signature')}) SELECT query_signature, count(*) AS feedback_count, {half_up("sum(CASE WHEN action = 'no_match' THEN feedback_weight ELSE 0 END)")} AS no_match,
{half_up("sum(CASE WHEN action = 'ask_boss' THEN feedback_weight ELSE 0 END)")} AS ask_boss, count(*) FILTER (template_hit) AS template_hits, count(*) FILTER (mapping_changed) AS mapping_changes FROM n GROUP BY 1""")
def feedback_by_signature(feedback):
    """The newest fifty of each signature, by stored weight alone."""
    return L.by_signature(feedback)


@query("feedback", sql="SELECT action, count(*) AS n FROM {feedback} GROUP BY 1")
def action_counts(feedback):
    return L.action_counts(feedback)


@query("feedback", sql="""SELECT id, CAST(CASE WHEN action = 'select' AND selected_rank > 0 THEN round(1 + greatest(0, 4 - selected_rank) * 0.12, 2) WHEN action = 'no_match' AND top_candidate_score >= 0.55 THEN 1.15 WHEN action = 'ask_boss' THEN 0.75 ELSE 1.0 END AS DOUBLE) AS weight FROM {feedback}""")
def feedback_weights(feedback):
    return feedback.select("id", L.stored_weight(feedback).cast("double").alias("weight"))


@query("feedback", sql="SELECT id, action, feedback_weight::DOUBLE AS feedback_weight, coalesce(mapping_signature, '') AS mapping_signature, '' AS template_name FROM (SELECT id, action, CASE WHEN id % 2 = 0 THEN 1.0 ELSE feedback_weight END AS feedback_weight, CASE WHEN id % 2 = 0 THEN '' ELSE mapping_signature END AS mapping_signature FROM {feedback})")
def feedback_append(feedback):
    """An old log without some columns, and new rows with them."""
    log = feedback.withColumn("feedback_weight", F.col("feedback_weight").cast("double"))
    return L.append(log.where("id % 2 = 0").select("id", "action"), log.where("id % 2 = 1")).select("id", "action", "feedback_weight", "mapping_signature", "template_name")


# every product is a candidate for a fortieth of the requests
CAND = """SELECT a.ask_id, c.code, c.catalog_idx, c.image_url IS NOT NULL AS has_image, (300 + (c.catalog_idx * 37) % 500)::DOUBLE / 1000 AS score FROM a JOIN {catalog} AS c ON c.catalog_idx % 40 = CAST(substr(a.query_signature, 2) AS BIGINT)"""


def _candidates(asked, catalog):
    c = catalog.select("code", "catalog_idx", (F.col("catalog_idx") % 40).alias("k"), F.col("image_url").isNotNull().alias("has_image"), ((300 + (F.col("catalog_idx") * 37) % 500).cast("double") / 1000).alias("score"))
    return _asked(asked).select("ask_id", F.expr("cast(substr(query_signature, 2) as bigint)").alias("k")).join(c, "k").drop("k")


@query("asked", "feedback", "catalog", sql=f"""WITH {WEIGHTED}, bc AS (SELECT ask_id, code, {half_up("sum(CASE WHEN action = 'select' THEN weight ELSE 0 END)", 4)} AS selected, {half_up("sum(CASE WHEN action = 'select' AND with_product_image THEN weight ELSE 0 END)", 4)} AS selected_image,
{half_up("sum(CASE WHEN action = 'no_match' THEN weight WHEN action = 'ask_boss' THEN weight * 0.5::DOUBLE ELSE 0 END)", 4)} AS rejected FROM (SELECT *, CASE WHEN action = 'select' THEN nullif(selected_product_code, '') ELSE nullif(top_candidate_code, '') END AS code FROM w) WHERE weight > 0 AND code IS NOT NULL GROUP BY 1, 2),
o AS (SELECT ask_id, count(*) AS feedback_count, {half_up("sum(CASE WHEN template_hit THEN weight ELSE 0 END)")} AS t, {half_up("sum(CASE WHEN mapping_changed THEN weight ELSE 0 END)")} AS m FROM w GROUP BY 1), c AS ({CAND}),
p AS (SELECT c.ask_id, c.catalog_idx, c.score AS base_score, least(coalesce(selected, 0) * 0.08::DOUBLE, 0.28::DOUBLE) AS sb, least(coalesce(selected_image, 0) * 0.03::DOUBLE, 0.08::DOUBLE) + CASE WHEN has_image THEN 0.015::DOUBLE ELSE 0 END AS ib, least(coalesce(t, 0) * 0.008::DOUBLE, 0.04::DOUBLE) AS tb,
least(coalesce(m, 0) * 0.01::DOUBLE, 0.05::DOUBLE) AS mp, least(coalesce(rejected, 0) * 0.06::DOUBLE, 0.18::DOUBLE) AS rp, coalesce(feedback_count, 0) AS feedback_count FROM c LEFT JOIN bc USING (ask_id, code) LEFT JOIN o USING (ask_id))
SELECT ask_id, catalog_idx, base_score, {half_up('greatest(0, least(1, base_score + sb + ib + tb - rp - mp))', 3)} AS score, feedback_count, concat_ws(' / ', CASE WHEN round(sb, 3) > 0 THEN '历史确认' END, CASE WHEN round(ib, 3) > 0.02 THEN '图片辅助' END, CASE WHEN round(tb, 3) > 0 THEN '模板经验' END,
CASE WHEN round(rp, 3) > 0 THEN '曾被排除' END, CASE WHEN round(mp, 3) > 0 THEN '人工修正痕迹' END) AS reason FROM p""")
def learning_adjust(asked, feedback, catalog):
    w = _weighted(asked, feedback)
    return L.adjust(_candidates(asked, catalog), L.by_code(w), L.overall(w)).select("ask_id", "catalog_idx", "base_score", "score", "feedback_count", "reason")


@query("asked", "feedback", "catalog")
def reranked_candidates(asked, feedback, catalog):
    """Order after learning, with candidates that have an image moved up."""
    w = _weighted(asked, feedback)
    out = L.rerank(L.adjust(_candidates(asked, catalog), L.by_code(w), L.overall(w)))
    return out.select("ask_id", "place", "catalog_idx", "score", L.auto_select(F.col("score"), F.col("feedback_count")).alias("auto_action"), L.hint(F.col("feedback_count"), F.col("template_hit_count"), F.col("mapping_changed_count")).alias("hint"))


_text = lambda x: f"{x}.normalized_name || ' ' || {x}.normalized_spec || ' ' || {x}.normalized_unit"


@query("asked", "feedback", sql=f"""WITH {FOUND}, l AS (SELECT a.ask_id, f.id, f.feedback_weight::DOUBLE AS stored, f.mapping_signature = a.mapping_signature AS alike, 1 - levenshtein({_text('a')}, {_text('f')})::DOUBLE / greatest(length({_text('a')}), length({_text('f')})) AS s FROM found f JOIN a ON a.ask_id = f.ask_id)
SELECT ask_id, id, (CASE WHEN s >= 0.985 THEN 1.0::DOUBLE WHEN s >= 0.94 THEN 0.8::DOUBLE WHEN s >= 0.85 THEN 0.5::DOUBLE ELSE 0::DOUBLE END + CASE WHEN alike THEN 0.25::DOUBLE ELSE 0::DOUBLE END) * stored AS weight FROM l""")
def feedback_alike(asked, feedback):
    """What every row found weighs by how alike its normal form is to the request's, as edits tell."""
    a = _asked(asked)
    return L.weighted(L.lookup(a, feedback), a, edit_ratio).select("ask_id", "id", "weight")
