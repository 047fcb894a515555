"""Document projections and totals over priced quote lines.

A results frame has one row per quote line: quote_id, item_index, the line's
own fields (name, spec, unit, quantity, budget_price, remark, color, action,
confirmed) and those of its selected product (code, product_name,
product_brand, product_unit, model, supplier, market_price, cost_price).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import money as M
from millrace.streaming.runs import saved

# Document kinds, their titles and number prefixes.
TITLES = {"quote": "报价单", "order": "订货单", "delivery": "发货单", "purchase": "采购单", "supplier_order": "供应商订单", "return": "退货单", "purchase_return": "采购退货单", "inbound": "入库单", "merge_outbound": "合并出库单", "order_items": "订单商品明细"}
PREFIXES = {"quote": "BJ", "order": "DH", "delivery": "FH", "purchase": "CG", "supplier_order": "GY", "return": "TH", "purchase_return": "CT", "inbound": "RK", "merge_outbound": "HB", "order_items": "MX"}
NO_SUPPLIER = "待补充供应商"

#: Columns of each document kind, of those of mall_lines().
LAYOUTS = {
    "quote": ["line_no", "product_code", "product_brand", "product_name", "product_spec_name", "unit_name", "order_count", "unit_price", "sum_price", "product_remark"],
    "order": ["line_no", "product_code", "product_name", "product_spec_name", "unit_name", "order_count", "unit_price", "sum_price"],
    "delivery": ["line_no", "product_code", "product_name", "product_spec_name", "unit_name", "order_count", "product_remark"],
    "purchase": ["line_no", "product_code", "product_name", "product_spec_name", "unit_name", "order_count", "unit_price", "sum_price", "supplier_name"],
    "supplier_order": ["line_no", "product_code", "product_name", "product_spec_name", "unit_name", "order_count", "unit_price", "sum_price", "supplier_name"],
    "return": ["line_no", "product_code", "product_name", "unit_name", "order_count", "unit_price", "sum_price", "product_remark"],
    "purchase_return": ["line_no", "product_code", "product_name", "unit_name", "order_count", "unit_price", "sum_price", "supplier_name"],
    "inbound": ["line_no", "product_code", "product_name", "product_spec_name", "unit_name", "order_count", "supplier_name"],
    "merge_outbound": ["line_no", "product_code", "product_name", "product_spec_name", "unit_name", "order_count"],
    "order_items": ["line_no", "product_code", "product_brand", "product_name", "product_spec_name", "unit_name", "order_count", "unit_price", "sum_price"],
}


def filename_segment(text: Column) -> Column:
    """A text as part of a file's name."""
    return F.btrim(F.regexp_replace(text, r'[<>:"/\\|?*]', "_"), F.lit(" ._"))


def _price(price_type: str, adjustment) -> Column:
    return M.export_price(F.col("action"), F.col("market_price"), F.col("cost_price"), price_type, adjustment)


def priced(results: DataFrame, price_type: str = "market", adjustment=None) -> DataFrame:
    """results with sell_price, total_price, profit and margin_pct; nulls where a document leaves a blank."""
    selected = F.col("action") == "select"
    return (
        results.withColumn("sell_price", _price(price_type, adjustment))
        .withColumn("total_price", F.when(selected, M.line_total(F.col("quantity"), F.col("sell_price"))))
        .withColumn("profit", F.when(selected, M.profit(F.col("sell_price"), F.col("cost_price"))))
        .withColumn("margin_pct", F.when(selected, M.margin(F.col("sell_price"), F.col("cost_price"))))
    )


def export_status() -> Column:
    return F.when((F.col("action") == "select") & F.col("confirmed"), "matched").when(F.col("action").isin("no_match", "ask_boss"), "nomatch").otherwise("pending")


def _match_label() -> Column:
    return F.when(F.col("action") == "select", "✅ 已匹配").when(F.col("action") == "no_match", "❌ 无匹配").otherwise("⏳ 待确认")


def _if_selected(c: str) -> Column:
    return F.when(F.col("action") == "select", F.col(c))


def _note() -> Column:
    return F.when(F.coalesce("remark", F.lit("")) != "", F.col("remark")).otherwise(F.coalesce("color", F.lit("")))


def standard_sheet(results: DataFrame, price_type: str = "market", adjustment=None) -> DataFrame:
    """The sheet for the customer: twelve columns."""
    return priced(results, price_type, adjustment).select(
        "quote_id", F.col("item_index").alias("line_no"), F.col("name").alias("item"), "quantity", "unit", "spec", _note().alias("note"),
        _if_selected("code").alias("product_code"), _if_selected("product_name").alias("product"), F.col("sell_price").alias("unit_price"), F.col("total_price").alias("line_total"),
        _if_selected("product_brand").alias("brand"), _match_label().alias("status"),
    )


def internal_sheet(results: DataFrame, price_type: str = "market", adjustment=None) -> DataFrame:
    """The sheet for the office, with costs and profit: fifteen columns."""
    return priced(results, price_type, adjustment).select(
        "quote_id", F.col("item_index").alias("line_no"), F.col("name").alias("item"), "quantity", "unit", "spec", _note().alias("note"), "budget_price",
        _if_selected("market_price").alias("market_price"), _if_selected("cost_price").alias("cost_price"), F.col("sell_price").alias("unit_price"), "profit", "margin_pct",
        F.col("total_price").alias("line_total"), _if_selected("supplier").alias("supplier"), _match_label().alias("status"),
    )


def statement_sheet(results: DataFrame, price_type: str = "market", adjustment=None) -> DataFrame:
    """The statement of account: eight columns."""
    return priced(results, price_type, adjustment).select(
        "quote_id", F.col("item_index").alias("line_no"), F.coalesce(_if_selected("product_name"), F.col("name")).alias("product"), "quantity", "unit",
        F.col("sell_price").alias("unit_price"), F.col("total_price").alias("amount"), _if_selected("supplier").alias("supplier"), _note().alias("note"),
    )


def mall_lines(results: DataFrame, price_type: str = "market", adjustment=None) -> DataFrame:
    """Selected lines renumbered from 1; product fields fall back to the line's; currency rounding half up."""
    chosen = results.where("action = 'select'")
    unit_price = M.money(_price(price_type, adjustment))
    blank = lambda a, b: F.when(F.coalesce(F.col(a), F.lit("")) != "", F.col(a)).otherwise(F.coalesce(F.col(b), F.lit("")))
    return chosen.select(
        "quote_id", F.row_number().over(Window.partitionBy("quote_id").orderBy("item_index")).alias("line_no"), F.col("code").alias("product_code"), "product_brand",
        blank("product_name", "name").alias("product_name"), F.col("name").alias("query_name"), blank("model", "spec").alias("product_spec_name"), blank("product_unit", "unit").alias("unit_name"),
        M.quantity_text(F.col("quantity")).alias("order_count"), F.col("quantity").alias("quantity_number"), unit_price.alias("unit_price"),
        F.when(F.col("quantity") > 0, M.money(F.col("quantity") * unit_price)).alias("sum_price"), _note().alias("product_remark"), F.col("supplier").alias("supplier_name"),
    )


def document(results: DataFrame, kind: str) -> DataFrame:
    """The lines of one kind of document."""
    return mall_lines(results).select("quote_id", *LAYOUTS[kind])


def document_headers(results: DataFrame, kind: str, as_of: str) -> DataFrame:
    """One row per quote that has a selected line: number, title, first supplier, total in figures and capitals."""
    lines = mall_lines(results)
    total = M.exact_sum(F.coalesce("sum_price", F.lit(0.0)))
    return (
        lines.groupBy("quote_id")
        .agg(F.count(F.lit(1)).alias("n_lines"), total.alias("total"), F.min_by("supplier_name", F.when(F.col("supplier_name") != "", F.col("line_no"))).alias("first_supplier"))
        .select(
            "quote_id", F.concat(F.lit(PREFIXES.get(kind, "DJ")), F.date_format(F.lit(as_of).cast("timestamp"), "yyyyMMddHHmmss")).alias("document_no"),
            F.lit(TITLES.get(kind, "商城单据")).alias("title"), "n_lines", "total", M.amount_in_capitals(F.col("total")).alias("capitals"),
            F.coalesce("first_supplier", F.lit(NO_SUPPLIER)).alias("supplier"),
        )
    )


def contract_lines(results: DataFrame) -> DataFrame:
    """Confirmed selections with names of at most 20 characters; the index is the line's place in the quote."""
    return results.where("confirmed and action = 'select'").select(
        "quote_id", "item_index", F.substring("product_name", 1, 20).alias("product"), "quantity", F.coalesce("market_price", F.lit(0.0)).alias("price"),
        M.money(F.coalesce("quantity", F.lit(0.0)) * F.coalesce("market_price", F.lit(0.0))).alias("subtotal"),
    )


def pdf_lines(results: DataFrame) -> DataFrame:
    """All lines, with '-' for what a line without a selection lacks."""
    dash = lambda c: F.coalesce(_if_selected(c), F.lit("-"))
    return results.select("quote_id", "item_index", "name", dash("code").alias("code"), dash("product_name").alias("product"), dash("supplier").alias("supplier"), _if_selected("market_price").alias("price"))


def totals(results: DataFrame) -> DataFrame:
    """The five definitions of a quote's total, side by side.

    history: confirmed selections, a missing or zero quantity is 1. contract:
    the same lines, missing is 0. pdf: selections, confirmed or not. mall:
    rounded per line. share: prices without quantity.
    """
    sel, sure = F.col("action") == "select", F.col("confirmed")
    q, p = F.col("quantity"), F.coalesce("market_price", F.lit(0.0))
    some = F.when(F.coalesce(q, F.lit(0.0)) == 0, 1.0).otherwise(q)
    none = F.coalesce(q, F.lit(0.0))
    over = lambda cond, x: M.exact_sum(F.when(cond, x).otherwise(0.0))
    return results.groupBy("quote_id").agg(
        over(sel & sure, some * p).alias("history_total"), over(sel & sure, none * p).alias("contract_total"), over(sel, none * p).alias("pdf_total"),
        over(sel & (none > 0), M.money(none * M.money(p))).alias("mall_total"), over(sel & sure, p).alias("share_total"),
    )


def pdf_summary(results: DataFrame) -> DataFrame:
    matched = F.count_if(F.col("action") == "select")
    return results.groupBy("quote_id").agg(F.count(F.lit(1)).alias("items"), matched.alias("matched"), F.round(matched * 100.0 / F.count(F.lit(1)), 1).alias("match_rate"))


def first_products(products: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    """products with rank, the first of each key in catalogue order: lines of equal keys have the same candidates, so these are cut before lines meet them."""
    place = Window.partitionBy(*keys).orderBy("catalog_idx")
    # kept, so that how few they are is known when lines are joined
    return saved(products.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most), "candidates")


def candidate_rows(ranked: DataFrame, most: int = 20) -> DataFrame:
    """One row per candidate of a line, best first, with its display name."""
    shown = F.concat("name", F.lit(" ["), "code", F.lit("] ¥"), F.format_string("%.2f", "market_price"))
    return ranked.where(F.col("rank") <= most).select("quote_id", "item_index", "rank", "code", shown.alias("shown"))


def save_quotes(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers and detail rows to append to the history."""
    quantity = F.when(F.coalesce("quantity", F.lit(0.0)) == 0, 1.0).otherwise(F.col("quantity"))
    kept = results.where("confirmed and action = 'select'")
    details = kept.select("quote_id", "item_index", F.col("name").alias("item_name"), quantity.alias("item_quantity"), F.col("code").alias("product_code"), F.coalesce("market_price", F.lit(0.0)).alias("price"))
    amounts = details.groupBy("quote_id").agg(M.exact_sum(F.col("item_quantity") * F.col("price")).alias("total_amount"))
    counts = results.groupBy("quote_id").agg(F.count(F.lit(1)).alias("total_items"), F.count_if(F.col("confirmed") & (F.col("action") == "select")).alias("matched_items"))
    return counts.join(amounts, "quote_id", "left").withColumn("total_amount", F.coalesce("total_amount", F.lit(0.0))), details


def history_stats(headers: DataFrame, as_of: str) -> DataFrame:
    """One row: quotes, quotes of as_of's month, their amounts, and the average match rate in percent."""
    rate = F.try_divide(F.col("matched_items"), F.col("total_items"))
    return headers.agg(
        F.count(F.lit(1)).alias("quotes"), F.count_if(F.col("created_at") >= F.date_trunc("month", F.lit(as_of).cast("timestamp"))).alias("this_month"),
        F.coalesce(M.exact_sum(F.col("total_amount")), F.lit(0.0)).alias("amount"), F.round(F.coalesce(F.avg(rate), F.lit(0.0)) * 100, 1).alias("avg_match_rate"),
    )


def newest(headers: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the history, newest first; equal times by falling id."""
    return headers.orderBy(F.desc("created_at"), F.desc("quote_id")).offset(offset).limit(limit)


def quote_detail(headers: DataFrame, details: DataFrame) -> DataFrame:
    """Headers with their detail rows beside them."""
    return headers.join(details, "quote_id")


def without_quotes(frame: DataFrame, deleted: DataFrame) -> DataFrame:
    """A header or detail frame less the deleted quotes."""
    return frame.join(deleted.select("quote_id").distinct(), "quote_id", "left_anti")
