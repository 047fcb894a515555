"""The desk on which matched lines are confirmed: labels, filters, queues, decisions and checks before export.

A work frame has one row per quote line: quote_id, item_index, the line's
fields (name, spec, unit, remark), action, confirmed, and its candidates:
selected (a struct of the chosen product, or null), matches and alternatives
(arrays of such structs, best first). A candidate has code, name, model, brand,
supplier, market_price and score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a line, sections of a quote.
CONFIRMED, WAITING, NONE, ASK, OPEN = "已确认", "待确认", "无匹配", "需问老板", "待选择"
SECTIONS = [("pending", "待人工确认"), ("issue", "异常与待问老板"), ("matched", "已确认可导出")]
# Export templates with their formats, the prices they can show, and whether they are their format's default.
TEMPLATES = [
    ("standard_default", "standard", ["market", "adjusted"], True),
    ("internal_default", "internal", ["market", "adjusted", "cost"], True),
    ("statement_default", "statement", ["market", "adjusted"], True),
    ("mall_quote_classic", "mall_quote", ["market", "adjusted"], True),
    ("mall_order_standard", "mall_quote", ["market", "adjusted"], False),
    ("mall_order_qrcode", "mall_quote", ["market", "adjusted"], False),
    ("mall_order_with_images", "mall_quote", ["market", "adjusted"], False),
    ("mall_delivery_standard", "mall_quote", ["market", "adjusted"], False),
    ("mall_delivery_with_images", "mall_quote", ["market", "adjusted"], False),
    ("mall_purchase_standard", "mall_quote", ["market", "adjusted", "cost"], False),
    ("mall_supplier_order", "mall_quote", ["market", "adjusted", "cost"], False),
    ("mall_return", "mall_quote", ["market", "adjusted"], False),
    ("mall_purchase_return", "mall_quote", ["market", "adjusted", "cost"], False),
    ("mall_inbound", "mall_quote", ["market", "adjusted", "cost"], False),
    ("mall_inbound_with_images", "mall_quote", ["market", "adjusted", "cost"], False),
    ("mall_merge_outbound", "mall_quote", ["market", "adjusted"], False),
    ("mall_order_items", "mall_quote", ["market", "adjusted", "cost"], False),
    ("dropdown_default", "dropdown", ["market"], True),
]

issue = lambda: F.col("action").isin("no_match", "ask_boss")
matched = lambda: F.col("confirmed") & (F.col("action") == "select")
_some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0


def line_status() -> Column:
    """The label of a line's state."""
    chosen = F.col("action") == "select"
    return (
        F.when(F.col("confirmed") & chosen, CONFIRMED).when(~F.col("confirmed") & chosen & F.col("selected").isNotNull(), WAITING)
        .when(F.col("action") == "no_match", NONE).when(F.col("action") == "ask_boss", ASK).when(_some("matches"), OPEN).otherwise(NONE)
    )


def primary() -> Column:
    """The candidate a line stands for: the selected one, else the first match, else the first alternative."""
    return F.coalesce(F.col("selected"), F.get("matches", 0), F.get("alternatives", 0))


def visible(work: DataFrame, text: str = "", status: str = "all") -> DataFrame:
    """Lines that hold the text in one of nine fields of the line and its primary candidate, and are pending, matched or nomatch."""
    best = primary()
    fields = [F.col(c) for c in ("name", "spec", "remark", "unit")] + [best[c] for c in ("name", "model", "brand", "supplier", "code")]
    haystack = F.lower(F.concat_ws(" ", *(F.when(c != "", c) for c in fields)))
    out = work.where(haystack.contains(text.strip().lower())) if text.strip() else work
    kinds = {"pending": ~F.col("confirmed"), "matched": matched(), "nomatch": F.col("confirmed") & issue()}
    return out.where(kinds[status]) if status in kinds else out


def sorted_places(work: DataFrame, by: str = "match-desc") -> DataFrame:
    """work with place, from 1 in every quote: by the primary candidate's score or price, up or down, then as they stand."""
    value = F.coalesce(primary()["score" if by.startswith("match") else "market_price"], F.lit(0.0))
    order = Window.partitionBy("quote_id").orderBy(value.desc() if by.endswith("desc") else value.asc(), "item_index")
    return work.withColumn("place", F.row_number().over(order))


def sections(work: DataFrame) -> DataFrame:
    """(quote_id, section_no, section, title, item_index): every line under its section; lines in none are left out."""
    number = F.when(~F.col("confirmed"), 1).when(issue(), 2).when(matched(), 3)
    out = work.select("quote_id", "item_index", number.alias("section_no")).where("section_no is not null")
    pick = lambda k: F.element_at(F.array(*(F.lit(s[k]) for s in SECTIONS)), F.col("section_no"))
    return out.select("quote_id", "section_no", pick(0).alias("section"), pick(1).alias("title"), "item_index")


def priority() -> Column:
    """How urgently a line needs a person; 0: not at all."""
    none, open_ = ~_some("matches"), ~F.col("confirmed")
    return (
        F.when(F.col("action") == "ask_boss", 450).when((F.col("action") == "no_match") & none, 420).when(open_ & none, 360)
        .when(open_ & (F.coalesce(primary()["score"], F.lit(0.0)) < 0.45), 280).when(open_, 180).otherwise(0)
    )


def queue(work: DataFrame, most: int = 5) -> DataFrame:
    """(quote_id, place, item_index, priority): the most urgent lines of each quote, equal ones as they stand."""
    order = Window.partitionBy("quote_id").orderBy(F.desc("priority"), "item_index")
    return work.select("quote_id", "item_index", priority().alias("priority")).where("priority > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("quote_id", "place", "item_index", "priority")


def match_stats(work: DataFrame) -> DataFrame:
    """One row: lines in all, and those matched, unmatched (confirmed without a product) and pending."""
    known = matched() | (F.col("confirmed") & issue())
    return work.agg(F.count(F.lit(1)).alias("total"), F.count_if(matched()).alias("matched"), F.count_if(F.col("confirmed") & issue()).alias("unmatched"), F.count_if(~F.coalesce(known, F.lit(False))).alias("pending"))


def queue_summary(work: DataFrame) -> DataFrame:
    """Per quote: lines confirmed, to ask about, without a match, not yet confirmed; and whether it can be exported."""
    out = work.groupBy("quote_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(matched()).alias("confirmed_lines"), F.count_if(F.col("action") == "ask_boss").alias("ask_boss"),
        F.count_if(F.col("action") == "no_match").alias("no_match"), F.count_if(~F.col("confirmed")).alias("pending"),
    )
    return out.withColumn("ready", F.expr("pending = 0 and ask_boss + no_match = 0"))


def confirm(work: DataFrame, decisions: DataFrame) -> DataFrame:
    """work under the last decision (quote_id, item_index, action, selected, at) on each line: confirmed, with its action, and its product if the action is select."""
    keys = ["quote_id", "item_index"]
    last = decisions.groupBy(*keys).agg(F.max_by(F.struct("action", "selected"), "at").alias("d"))
    told = work.join(last, keys, "left")
    known = F.col("d").isNotNull()
    selected = F.when(~known, F.col("selected")).when(F.col("d.action") == "select", F.col("d.selected"))
    return told.withColumns({"confirmed": F.when(known, True).otherwise(F.col("confirmed")), "action": F.when(known, F.col("d.action")).otherwise(F.col("action")), "selected": selected}).drop("d")


def needs_alternatives(matches: str = "matches") -> Column:
    """Whether a line's matches are so few or poor that other products are looked for."""
    return ~_some(matches) | (F.get(matches, 0)["score"] < 0.4)


def image_assisted(matches: str = "matches") -> Column:
    """Whether one of the first three matches has an image."""
    return F.coalesce(F.exists(F.slice(matches, 1, 3), lambda m: F.coalesce(m["has_image"], F.lit(False))), F.lit(False))


def check_price_types(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Export requests (template_key, export_format, price_type) that their template can show, with template, and the rest with a reason.

    A request without a key takes its format's default template; one whose format has none can show every price.
    """
    rows = [(k, f, p, d) for k, f, p, d in TEMPLATES]
    known = F.broadcast(requests.sparkSession.createDataFrame(rows, "t_key string, t_format string, prices array<string>, is_default boolean"))
    asked = F.trim(F.coalesce("template_key", F.lit("")))
    hit = F.when(asked != "", F.col("t_key") == asked).otherwise(F.col("is_default") & (F.col("t_format") == F.trim("export_format")))
    told = requests.join(known, hit, "left")
    reason = F.when((asked != "") & F.col("t_key").isNull(), "所选导出模板不存在").when(F.col("t_key").isNotNull() & ~F.array_contains("prices", F.col("price_type")), "当前导出模板不支持所选价格类型")
    told = told.withColumn("reason", reason)
    return (
        told.where("reason is null").select(*requests.columns, F.col("t_key").alias("template")),
        told.where("reason is not null").select(*requests.columns, "reason"),
    )


def export(frame: DataFrame, path: str, by: str, kind: str = "csv") -> DataFrame:
    """Write a sheet as one folder per value of ``by``, in files of at most a million rows, and read it back; nulls stay null.

    Tasks write the rows they have, sorted by ``by``: a large value is never one task's, and a task has one file open.
    """
    writer = frame.sortWithinPartitions(by).write.option("maxRecordsPerFile", 1000000).partitionBy(by).mode("overwrite")
    options = {"header": True, "nullValue": "\\N", "emptyValue": ""} if kind == "csv" else {}
    writer.format(kind).options(**options).save(path)
    return frame.sparkSession.read.format(kind).options(**options).schema(frame.schema).load(path).select(*frame.columns)
