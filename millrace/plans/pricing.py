"""Pricing, documents and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import money as M
from millrace.operators import documents as D
from millrace.plans.query import half_up, query

AS_OF = "2001-06-15 10:30:00"
CENTS = lambda x: f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"
SOLD = "CASE WHEN action = 'select' AND coalesce(market_price, 0) > 0 THEN market_price END"
SELECTED = lambda c: f"CASE WHEN action = 'select' THEN {c} END"
NOTE = "CASE WHEN remark <> '' THEN remark ELSE coalesce(color, '') END"
TOTAL = f"CASE WHEN action = 'select' THEN {half_up('quantity * market_price')} END"
LABEL = "CASE action WHEN 'select' THEN '✅ 已匹配' WHEN 'no_match' THEN '❌ 无匹配' ELSE '⏳ 待确认' END"


@query("lines", "offers", sql=f"""
WITH best AS (SELECT catalog_idx, min(price) AS price FROM {{offers}} GROUP BY 1)
SELECT quote_id, count(*) AS n_lines, {CENTS('quantity * price')} AS total FROM {{lines}} JOIN best USING (catalog_idx) WHERE action = 'select' GROUP BY 1""")
def best_offer_totals(lines, offers):
    best = offers.groupBy("catalog_idx").agg(F.min("price").alias("price"))
    return lines.where("action = 'select'").join(best, "catalog_idx").groupBy("quote_id").agg(F.count(F.lit(1)).alias("n_lines"), M.exact_sum(F.col("quantity") * F.col("price")).alias("total"))


@query("catalog", sql=f"""SELECT catalog_idx, {half_up('market_price * (1 + 12.5 / 100)')} AS markup, {half_up('market_price * (1 - 15.0 / 100)')} AS markdown,
{half_up('market_price + 9.99')} AS fixed_markup, {half_up('greatest(0.0, market_price - 1000.0)')} AS fixed_markdown FROM {{catalog}}""")
def price_adjust(catalog):
    p = F.col("market_price")
    return catalog.select("catalog_idx", M.adjusted(p, "markup", 12.5).alias("markup"), M.adjusted(p, "markdown", 15.0).alias("markdown"), M.adjusted(p, "fixed_markup", 9.99).alias("fixed_markup"), M.adjusted(p, "fixed_markdown", 1000.0).alias("fixed_markdown"))


@query("results", sql=f"""SELECT quote_id, item_index, CASE WHEN action = 'select' AND coalesce(cost_price, 0) > 0 THEN cost_price END AS at_cost,
CASE WHEN action = 'select' THEN {half_up('market_price * (1 + 10.0 / 100)')} END AS adjusted, {SOLD} AS at_market FROM {{results}}""")
def export_prices(results):
    args = F.col("action"), F.col("market_price"), F.col("cost_price")
    return results.select("quote_id", "item_index", M.export_price(*args, "cost").alias("at_cost"), M.export_price(*args, "adjusted", ("markup", 10.0)).alias("adjusted"), M.export_price(*args).alias("at_market"))


PROFIT = f"CASE WHEN action = 'select' AND cost_price > 0 THEN {half_up('market_price - cost_price')} END"


@query("results", sql=f"""WITH p AS (SELECT *, {PROFIT} AS profit FROM {{results}})
SELECT quote_id, item_index, {TOTAL} AS total_price, profit, {half_up('profit / cost_price * 100', 1)} AS margin_pct FROM p""")
def line_totals_and_margins(results):
    return D.priced(results).select("quote_id", "item_index", "total_price", "profit", "margin_pct")


@query("results", sql=f"""SELECT quote_id, item_index, {half_up('budget_price - market_price')} AS saving, budget_price >= market_price AS within_budget FROM {{results}}""")
def candidate_profit_vs_budget(results):
    return results.select("quote_id", "item_index", M.money(F.col("budget_price") - F.col("market_price")).alias("saving"), (F.col("budget_price") >= F.col("market_price")).alias("within_budget"))


@query("results", sql=f"""SELECT quote_id, item_index AS line_no, name AS item, quantity, unit, spec, {NOTE} AS note, {SELECTED('code')} AS product_code, {SELECTED('product_name')} AS product,
{SOLD} AS unit_price, {TOTAL} AS line_total, {SELECTED('product_brand')} AS brand, {LABEL} AS status FROM {{results}}""")
def standard_sheet(results):
    return D.standard_sheet(results)


@query("results", sql=f"""WITH p AS (SELECT *, {PROFIT} AS profit FROM {{results}})
SELECT quote_id, item_index AS line_no, name AS item, quantity, unit, spec, {NOTE} AS note, budget_price, {SELECTED('market_price')} AS market_price, {SELECTED('cost_price')} AS cost_price,
{SOLD} AS unit_price, profit, {half_up('profit / cost_price * 100', 1)} AS margin_pct, {TOTAL} AS line_total, {SELECTED('supplier')} AS supplier, {LABEL} AS status FROM p""")
def internal_sheet(results):
    return D.internal_sheet(results)


@query("results", sql=f"""SELECT quote_id, item_index AS line_no, coalesce({SELECTED('product_name')}, name) AS product, quantity, unit, {SOLD} AS unit_price, {TOTAL} AS amount, {SELECTED('supplier')} AS supplier, {NOTE} AS note FROM {{results}}""")
def statement_sheet(results):
    return D.statement_sheet(results)


MALL = f"""SELECT quote_id, CAST(row_number() OVER (PARTITION BY quote_id ORDER BY item_index) AS INT) AS line_no, code AS product_code, product_brand, product_name, name AS query_name, model AS product_spec_name, product_unit AS unit_name,
CASE WHEN quantity = floor(quantity) THEN CAST(CAST(quantity AS BIGINT) AS VARCHAR) ELSE CAST(quantity AS VARCHAR) END AS order_count, quantity AS quantity_number, {half_up('market_price')} AS unit_price,
CASE WHEN quantity > 0 THEN {half_up('quantity * market_price')} END AS sum_price, {NOTE} AS product_remark, supplier AS supplier_name FROM {{results}} WHERE action = 'select'"""


@query("results", sql=MALL)
def mall_lines(results):
    return D.mall_lines(results)


for _kind, _columns in D.LAYOUTS.items():

    def _document(results, kind=_kind):
        return D.document(results, kind)

    _document.__name__ = f"document_{_kind}"
    query("results", sql=f"SELECT quote_id, {', '.join(_columns)} FROM ({MALL}) AS m")(_document)


@query("results", sql=f"""WITH m AS ({MALL}) SELECT quote_id, 'BJ20010615103000' AS document_no, '报价单' AS title, count(*) AS n_lines, {CENTS('coalesce(sum_price, 0)')} AS total, arg_min(supplier_name, line_no) AS supplier FROM m GROUP BY 1""")
def document_headers(results):
    return D.document_headers(results, "quote", AS_OF).drop("capitals")


@query("results")
def document_amounts_in_capitals(results):
    """Totals in capitals; without a twin or a test yet."""
    return D.document_headers(results, "quote", AS_OF).select("quote_id", "total", "capitals")


@query("results", sql=f"""SELECT quote_id, item_index, substr(product_name, 1, 20) AS product, quantity, market_price AS price, {half_up('quantity * market_price')} AS subtotal FROM {{results}} WHERE confirmed AND action = 'select'""")
def contract_lines(results):
    return D.contract_lines(results)


DASH = lambda c: f"CASE WHEN action = 'select' THEN {c} ELSE '-' END"


@query("results", sql=f"""SELECT quote_id, item_index, name, {DASH('code')} AS code, {DASH('product_name')} AS product, {DASH('supplier')} AS supplier, {SELECTED('market_price')} AS price FROM {{results}}""")
def pdf_lines(results):
    return D.pdf_lines(results)


@query("results", sql=f"""SELECT quote_id, {CENTS("CASE WHEN action = 'select' AND confirmed THEN quantity * market_price ELSE 0 END")} AS history_total,
{CENTS("CASE WHEN action = 'select' AND confirmed THEN quantity * market_price ELSE 0 END")} AS contract_total, {CENTS("CASE WHEN action = 'select' THEN quantity * market_price ELSE 0 END")} AS pdf_total,
{CENTS(f"CASE WHEN action = 'select' AND quantity > 0 THEN {half_up('quantity * market_price')} ELSE 0 END")} AS mall_total, {CENTS("CASE WHEN action = 'select' AND confirmed THEN market_price ELSE 0 END")} AS share_total
FROM {{results}} GROUP BY 1""")
def document_totals(results):
    return D.totals(results)


@query("results", sql=f"""SELECT quote_id, count(*) AS items, count(*) FILTER (action = 'select') AS matched, {half_up("count(*) FILTER (action = 'select') * 100.0::DOUBLE / count(*)", 1)} AS match_rate FROM {{results}} GROUP BY 1""")
def pdf_summary(results):
    return D.pdf_summary(results)


SAVED = f"""SELECT quote_id, count(*) AS total_items, count(*) FILTER (confirmed AND action = 'select') AS matched_items,
{CENTS("CASE WHEN confirmed AND action = 'select' THEN quantity * market_price ELSE 0 END")} AS total_amount FROM {{results}} GROUP BY 1"""


@query("results", sql=SAVED)
def quote_save_headers(results):
    return D.save_quotes(results)[0]


@query("results", sql="""SELECT quote_id, item_index, name AS item_name, CASE WHEN coalesce(quantity, 0) = 0 THEN 1.0 ELSE quantity END AS item_quantity, code AS product_code, market_price AS price FROM {results} WHERE confirmed AND action = 'select'""")
def quote_save_details(results):
    return D.save_quotes(results)[1]


@query("results", "quotes", sql=f"""WITH s AS ({SAVED}) SELECT count(*) AS quotes, count(*) FILTER (created_at >= TIMESTAMP '2001-06-01 00:00:00') AS this_month, {CENTS('total_amount')} AS amount,
{half_up('avg(CASE WHEN total_items > 0 THEN matched_items / total_items END) * 100', 1)} AS avg_match_rate FROM s JOIN {{quotes}} USING (quote_id)""")
def history_statistics(results, quotes):
    return D.history_stats(D.save_quotes(results)[0].join(quotes.select("quote_id", "created_at"), "quote_id"), AS_OF)


@query("quotes", sql="SELECT quote_id, customer_name, created_at FROM {quotes} ORDER BY created_at DESC, quote_id DESC LIMIT 50 OFFSET 20")
def history_page(quotes):
    return D.newest(quotes.select("quote_id", "customer_name", "created_at"), 50, 20)


@query("results", "quotes", sql="SELECT quote_id, customer_name, item_index, name AS item_name, code AS product_code FROM {quotes} JOIN {results} USING (quote_id) WHERE confirmed AND action = 'select'")
def quote_detail(results, quotes):
    return D.quote_detail(quotes.select("quote_id", "customer_name"), D.save_quotes(results)[1].select("quote_id", "item_index", "item_name", "product_code"))


@query("quotes", "customer", sql="SELECT quote_id, customer_name FROM {quotes} WHERE customer_name NOT IN (SELECT c_name FROM {customer} WHERE c_acctbal < 0)")
def quote_delete(quotes, customer):
    """The quotes of customers in debt are deleted."""
    gone = quotes.join(customer.where("c_acctbal < 0").select(F.col("c_name").alias("customer_name")), "customer_name")
    return D.without_quotes(quotes.select("quote_id", "customer_name"), gone)


@query("lines", "catalog", sql="""WITH r AS (SELECT quote_id, item_index, c.code, c.name || ' [' || c.code || '] ¥' || printf('%.2f', c.market_price) AS shown, row_number() OVER (PARTITION BY quote_id, item_index ORDER BY c.catalog_idx) AS rank FROM {lines} AS l JOIN {catalog} AS c ON c.model = l.spec AND c.unit = l.unit)
SELECT quote_id, item_index, CAST(rank AS INT) AS rank, code, shown FROM r WHERE rank <= 20""")
def candidate_sheet(lines, catalog):
    """The products of each line's model and unit, twenty at most, as its candidates are shown."""
    c = catalog.select(F.col("model").alias("spec"), "unit", "code", F.col("name"), "market_price", "catalog_idx")
    ranked = lines.select("quote_id", "item_index", "spec", "unit").join(D.first_products(c, ["spec", "unit"]), ["spec", "unit"])
    return D.candidate_rows(ranked)
