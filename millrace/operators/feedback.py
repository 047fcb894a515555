"""Learning from the log of confirmations: look-up, summaries, and what they do to candidates.

A log row: id, created_at, action, query_signature, normalized_name,
normalized_spec, normalized_unit, mapping_signature, selected_product_code,
top_candidate_code, top_candidate_score, selected_rank, template_hit,
mapping_changed, with_product_image, feedback_weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.matching import sequence_ratio, with_ratio

#: Columns a log may lack, with the values that stand for them.
DEFAULTS = {"source_type": "''", "template_name": "''", "template_hit": "false", "ocr_confidence": "0D", "feedback_weight": "1D", "mapping_signature": "''", "mapping_changed": "false"}


def newest(frame: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The newest rows of each key; equal times by falling id. Catalyst keeps only the first ones of each task."""
    order = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("id"))
    return frame.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def lookup(asked: DataFrame, log: DataFrame, most: int = 50) -> DataFrame:
    """(ask_id, log row) for the newest rows on each of three paths: query signature, normal form, mapping signature.

    The log is cut to the newest rows of each key before it meets the requests, so a busy key joins ``most`` rows.
    """
    paths = [["query_signature"], ["normalized_name", "normalized_spec", "normalized_unit"], ["mapping_signature"]]
    found = []
    for keys in paths:
        wanted = asked.select("ask_id", *keys)
        # a blank key asks for nothing
        wanted = wanted.where(" or ".join(f"{k} <> ''" for k in keys))
        found.append(wanted.join(newest(log, keys, most), keys).select("ask_id", *log.columns))
    return found[0].unionByName(found[1]).unionByName(found[2]).dropDuplicates(["ask_id", "id"])


def weight_of(similarity: Column, same_mapping: Column, stored: Column) -> Column:
    """What a log row counts for a request: by how alike they are, more if mapped alike, times its stored weight."""
    tier = F.when(similarity >= 0.985, 1.0).when(similarity >= 0.94, 0.8).when(similarity >= 0.85, 0.5).otherwise(0.0)
    return (tier + F.when(same_mapping, 0.25).otherwise(0.0)) * F.coalesce(F.nullif(stored, F.lit(0.0)), F.lit(1.0))


def by_code(weighted: DataFrame) -> DataFrame:
    """(ask_id, code, selected, selected_image, rejected): summed weights of rows (ask_id, log row, weight)."""
    picked = F.when((F.col("action") == "select") & (F.trim("selected_product_code") != ""), F.trim("selected_product_code"))
    refused = F.when(F.col("action").isin("no_match", "ask_boss") & (F.trim("top_candidate_code") != ""), F.trim("top_candidate_code"))
    return (
        weighted.where("weight > 0").withColumn("code", F.coalesce(picked, refused)).where("code is not null").groupBy("ask_id", "code")
        .agg(
            F.round(F.sum(F.when(F.col("action") == "select", F.col("weight")).otherwise(0.0)), 4).alias("selected"),
            F.round(F.sum(F.when((F.col("action") == "select") & F.col("with_product_image"), F.col("weight")).otherwise(0.0)), 4).alias("selected_image"),
            F.round(F.sum(F.when(F.col("action") == "no_match", F.col("weight")).when(F.col("action") == "ask_boss", F.col("weight") * 0.5).otherwise(0.0)), 4).alias("rejected"),
        )
    )


def overall(weighted: DataFrame) -> DataFrame:
    """One row per request: summed weights by kind, and the number of rows found, also those that weigh nothing."""
    w = F.greatest("weight", F.lit(0.0))
    over = lambda cond, name: F.round(F.sum(F.when(cond, w).otherwise(0.0)), 2).alias(name)
    return weighted.groupBy("ask_id").agg(
        F.count(F.lit(1)).alias("feedback_count"), over(F.col("action") == "no_match", "no_match_count"), over(F.col("action") == "ask_boss", "ask_boss_count"),
        over(F.col("template_hit"), "template_hit_count"), over(F.col("mapping_changed"), "mapping_changed_count"),
    )


def by_signature(log: DataFrame, most: int = 50) -> DataFrame:
    """Per query signature the newest rows, by their stored weight alone."""
    w = F.col("feedback_weight").cast("double")
    over = lambda action: F.round(F.sum(F.when(F.col("action") == action, w).otherwise(0.0)), 2)
    return newest(log, ["query_signature"], most).groupBy("query_signature").agg(
        F.count(F.lit(1)).alias("feedback_count"), over("no_match").alias("no_match"), over("ask_boss").alias("ask_boss"),
        F.count_if("template_hit").alias("template_hits"), F.count_if("mapping_changed").alias("mapping_changes"),
    )


def weighted(found: DataFrame, asked: DataFrame, ratio=sequence_ratio) -> DataFrame:
    """Rows found by :func:`lookup` with what each weighs: by the ratio of the request's normal form to the row's, and whether both are mapped alike."""
    text = lambda: F.concat_ws(" ", *(F.when(F.trim(c) != "", F.trim(c)) for c in ("normalized_name", "normalized_spec", "normalized_unit")))
    own = asked.select("ask_id", text().alias("own_text"), F.col("mapping_signature").alias("own_mapping"))
    both = with_ratio(found.join(own, "ask_id").withColumn("row_text", text()), "own_text", "row_text", ratio)
    alike = (F.col("mapping_signature") != "") & (F.col("mapping_signature") == F.col("own_mapping"))
    return both.withColumn("weight", weight_of(F.col("ratio"), F.coalesce(alike, F.lit(False)), F.col("feedback_weight").cast("double"))).drop("own_text", "own_mapping", "row_text", "ratio")


def action_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def stored_weight(log: DataFrame) -> Column:
    """The weight a confirmation is written with."""
    select = (F.col("action") == "select") & (F.col("selected_rank") > 0)
    return F.round(
        F.when(select, 1 + F.greatest(F.lit(0), 4 - F.col("selected_rank")) * 0.12)
        .when((F.col("action") == "no_match") & (F.col("top_candidate_score") >= 0.55), 1.15)
        .when(F.col("action") == "ask_boss", 0.75).otherwise(1.0), 2)


def adjust(candidates: DataFrame, codes: DataFrame, sums: DataFrame) -> DataFrame:
    """candidates (ask_id, code, has_image, score, ...) with base_score, a learned score and its parts, and the reasons."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    known = F.col("code") != ""
    out = candidates.join(codes, ["ask_id", "code"], "left").join(sums, "ask_id", "left").withColumns({
        "selection_boost": F.when(known, F.least(zero("selected") * 0.08, F.lit(0.28))).otherwise(0.0),
        "image_bonus": F.when(known, F.least(zero("selected_image") * 0.03, F.lit(0.08))).otherwise(0.0) + F.when(F.col("has_image"), 0.015).otherwise(0.0),
        "template_bonus": F.least(zero("template_hit_count") * 0.008, F.lit(0.04)),
        "mapping_penalty": F.least(zero("mapping_changed_count") * 0.01, F.lit(0.05)),
        "rejection_penalty": F.when(known, F.least(zero("rejected") * 0.06, F.lit(0.18))).otherwise(0.0),
    })
    score = F.col("score") + F.col("selection_boost") + F.col("image_bonus") + F.col("template_bonus") - F.col("rejection_penalty") - F.col("mapping_penalty")
    reasons = F.concat_ws(" / ", F.when(F.round("selection_boost", 3) > 0, "历史确认"), F.when(F.round("image_bonus", 3) > 0.02, "图片辅助"), F.when(F.round("template_bonus", 3) > 0, "模板经验"), F.when(F.round("rejection_penalty", 3) > 0, "曾被排除"), F.when(F.round("mapping_penalty", 3) > 0, "人工修正痕迹"))
    return out.withColumn("base_score", F.round("score", 3)).withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)).withColumn("reason", reasons).withColumn("feedback_count", F.coalesce("feedback_count", F.lit(0)).cast("long"))


def rerank(adjusted: DataFrame) -> DataFrame:
    """adjusted with place, from 1, per request: by score, base score and catalogue order, then one pass in which a
    candidate with an image passes the one before it without one if their scores are 0.03 apart at most.

    A row without an image may be passed by several: by the rows with one that follow it, as far as they are near it. So
    it changes places with so many of them, which rows in order tell; a request's rows are never one array.
    """
    order = Window.partitionBy("ask_id").orderBy(F.desc("score"), F.desc("base_score"), "catalog_idx")
    image = F.coalesce("has_image", F.lit(False))
    rows = adjusted.withColumn("_at", F.row_number().over(order)).withColumn("_run", F.sum(F.when(image, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("ask_id", "_run")
    head = F.min(F.struct("_at", "score", "has_image")).over(run)
    rows = rows.withColumn("_head", head)
    passes = image & (~F.col("_head.has_image")) & (F.abs(F.col("score") - F.col("_head.score")) <= 0.03)
    rows = rows.withColumn("_passes", F.coalesce(passes, F.lit(False))).withColumn("_passed", F.count_if("_passes").over(run))
    place = F.col("_at") + F.when(F.col("_passes"), -1).when(F.col("_at") == F.col("_head._at"), F.col("_passed")).otherwise(0)
    return rows.withColumn("place", place.cast("int")).drop("_at", "_run", "_head", "_passes", "_passed")


def hint(count: Column, template_hits: Column, changes: Column) -> Column:
    """A line about the feedback used; '' if there is none."""
    text = F.concat_ws("，", F.concat(F.lit("已参考"), count.cast("string"), F.lit("条历史反馈")), F.when(template_hits >= 1, "含模板命中经验"), F.when(changes >= 1, "已识别人工修正痕迹"))
    return F.when(count > 0, text).otherwise("")


def auto_select(score: Column, feedback_count: Column, semantic: bool = False) -> Column:
    """'select' where the best candidate is good enough; less is asked after three confirmations."""
    usual = 0.60 if semantic else 0.50
    return F.when(score >= F.when(feedback_count >= 3, 0.45).otherwise(usual), "select")


def evolve(log: DataFrame) -> DataFrame:
    """An old log with the columns that were added later."""
    return log.withColumns({c: F.expr(v) for c, v in DEFAULTS.items() if c not in log.columns})


def append(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new rows; columns that either lacks are filled in."""
    return evolve(log).unionByName(evolve(new), allowMissingColumns=True)
