"""The product catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import catalog as C
from millrace.plans.query import query
from millrace.plans.scalars import NORMAL

FLAGS = "cost_price IS NOT NULL AND cost_price <> 0 AS has_cost_price, cost_price IS NULL AS cost_price_missing, coalesce(cost_price = 0, false) AS cost_price_ambiguous"
VIEW = f"""SELECT catalog_idx, code, name, model, category, unit, brand, supplier, status, name || ' & ' || category AS intro_text, market_price, cost_price, {FLAGS},
image_url IS NOT NULL AS has_image, lower(concat_ws(' ', code, name, model, category, unit, brand, supplier, status, name || ' & ' || category)) AS search_text FROM {{catalog}}"""
UPLOAD = """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '  ' ELSE p_name END AS n, CASE p_partkey % 5 WHEN 0 THEN '--' WHEN 1 THEN '1,234.5' WHEN 2 THEN '' WHEN 3 THEN '0' ELSE CAST(p_size AS STRING) END AS c1,
CASE p_partkey % 3 WHEN 0 THEN 'x' ELSE CAST(p_size * 2 AS STRING) END AS c2, p_retailprice AS mp, p_brand AS b FROM part"""


def _upload(part):
    k = F.col("p_partkey")
    return part.select(
        k.cast("string").alias("* 商品编码"), F.when(k % 9 == 0, "  ").otherwise(F.col("p_name")).alias("* 商品名称"), F.col("p_retailprice").alias("* 市场价"), F.col("p_brand").alias("商品品牌"),
        F.when(k % 5 == 0, "--").when(k % 5 == 1, "1,234.5").when(k % 5 == 2, "").when(k % 5 == 3, "0").otherwise(F.col("p_size").cast("string")).alias("成本价"),
        F.when(k % 3 == 0, "x").otherwise((F.col("p_size") * 2).cast("string")).alias("采购价"),
    )


COST = "coalesce(TRY_CAST(replace(c1, ',', '') AS DOUBLE), TRY_CAST(replace(c2, ',', '') AS DOUBLE))"


@query("part", sql=f"SELECT CAST(p_partkey AS VARCHAR) AS code, n AS name, b AS brand, mp AS market_price, {COST} AS cost_price FROM ({UPLOAD}) WHERE trim(n) <> ''")
def catalog_import(part):
    """Import with blank names dropped and the cost picked from two columns."""
    return C.import_catalog(_upload(part)).select("code", "name", "brand", "market_price", "cost_price")


@query("part", sql=f"SELECT CAST(p_partkey AS VARCHAR) AS code, {COST} AS cost_price, {COST} IS NOT NULL AS has_cost_price, {COST} IS NULL AS cost_price_missing, false AS cost_price_ambiguous FROM ({UPLOAD}) WHERE trim(n) <> ''")
def cost_flags_uploaded(part):
    return C.cost_flags(C.import_catalog(_upload(part)), uploaded=True).select("code", "cost_price", "has_cost_price", "cost_price_missing", "cost_price_ambiguous")


@query("catalog", sql=f"SELECT catalog_idx, cost_price, {FLAGS} FROM {{catalog}}")
def cost_flags_loaded(catalog):
    return C.cost_flags(catalog).select("catalog_idx", "cost_price", "has_cost_price", "cost_price_missing", "cost_price_ambiguous")


@query("catalog", sql="SELECT catalog_idx, name FROM {catalog} WHERE market_price > 950 OR NOT EXISTS (SELECT 1 FROM {catalog} WHERE market_price > 950)")
def catalog_fallback(catalog):
    """The current catalogue if it has rows, else the last uploaded one; here the last one is larger and unused."""
    rows = catalog.select("catalog_idx", "name", "market_price")
    return C.current_or_last(rows.where("market_price > 950"), rows).select("catalog_idx", "name")


@query("catalog", sql=VIEW)
def catalog_view(catalog):
    return C.view(catalog)


@query("catalog", sql=f"SELECT catalog_idx, name FROM ({VIEW}) AS v WHERE search_text LIKE '%ring%' AND category = 'ECONOMY' AND has_image")
def catalog_filter(catalog):
    return C.where(C.view(catalog), keyword=" RING ", category="ECONOMY", image="yes").select("catalog_idx", "name")


@query("catalog", sql=f"""WITH f AS (SELECT * FROM ({VIEW}) AS v WHERE search_text LIKE '%bolt%'), n AS (SELECT count(*) AS total, count(*) FILTER (has_image) AS image_total, greatest(1, CAST(ceil(count(*) / 24.0) AS BIGINT)) AS total_pages FROM f)
SELECT catalog_idx, name, total, image_total, least(3, total_pages) AS page, total_pages FROM (SELECT *, row_number() OVER (ORDER BY catalog_idx) AS r FROM f) AS f, n WHERE r > (least(3, total_pages) - 1) * 24 AND r <= least(3, total_pages) * 24""")
def catalog_page(catalog):
    return C.page(C.where(C.view(catalog), keyword="bolt"), 3, 24).select("catalog_idx", "name", "total", "image_total", "page", "total_pages")


@query("catalog", "lines", sql="SELECT name, min(catalog_idx) AS catalog_idx FROM {catalog} WHERE name IN (SELECT name FROM {lines}) GROUP BY 1")
def product_by_key(catalog, lines):
    return C.by_key(catalog, lines, "name")


@query("catalog", sql="SELECT catalog_idx, coalesce(CASE WHEN trim(status) <> '' THEN trim(status) END, CASE WHEN trim(image_url) <> '' THEN trim(image_url) END, trim(code), '') AS effective_code, image_url IS NOT NULL AS has_image FROM {catalog}")
def effective_codes(catalog):
    return catalog.select("catalog_idx", C.effective_code("status", "image_url", "code").alias("effective_code"), C.has_image().alias("has_image"))


@query("catalog", sql="""SELECT catalog_idx, label, value FROM (SELECT catalog_idx, unnest([{'label': '商品编码', 'value': code}, {'label': '商品名称', 'value': name}, {'label': '型号', 'value': model}, {'label': '品牌', 'value': brand}, {'label': '商品类别', 'value': category},
{'label': '单位', 'value': unit}, {'label': '所属供应商', 'value': supplier}, {'label': '状态', 'value': status}, {'label': '市场价', 'value': CAST(market_price AS VARCHAR)},
{'label': '成本价', 'value': CASE WHEN cost_price IS NULL THEN '未导入' WHEN cost_price = 0 THEN '历史数据待校正' ELSE CAST(cost_price AS VARCHAR) END}], recursive := true) FROM {catalog}) WHERE value <> ''""")
def attribute_rows(catalog):
    return C.attributes(catalog)


@query("catalog", sql="SELECT CASE WHEN contains(category, 'ξ') THEN split_part(category, 'ξ', 1) ELSE split_part(category, '|', 1) END AS main_category, count(*) AS products FROM {catalog} GROUP BY 1")
def category_counts(catalog):
    return C.category_counts(catalog)


@query("lines", sql="""WITH b(band, lo, hi) AS (VALUES ('0-50元', -1e18, 50), ('50-100元', 50, 100), ('100-200元', 100, 200), ('200-500元', 200, 500), ('500元以上', 500, 1e18))
SELECT band, count(quantity) AS products FROM b LEFT JOIN {lines} ON quantity * 4 >= lo AND quantity * 4 < hi GROUP BY 1""")
def price_histogram(lines):
    return C.price_histogram(lines.select((F.col("quantity") * 4).alias("market_price")))


@query("catalog", sql="SELECT DISTINCT facet, value FROM (SELECT 'category' AS facet, category AS value FROM {catalog} UNION ALL SELECT 'supplier', supplier FROM {catalog} UNION ALL SELECT 'brand', brand FROM {catalog}) WHERE value <> ''")
def facet_values(catalog):
    return C.facets(C.view(catalog))


@query("catalog", "orders", sql=f"""WITH v AS ({VIEW}), k AS (SELECT DISTINCT o_custkey % 50 AS m, o_custkey % 3 AS u FROM {{orders}}), a AS (SELECT m, u, unnest(['ring', 'small ring', 'M' || CAST(m AS VARCHAR)]) AS term FROM k),
s AS (SELECT m, u, catalog_idx, sum(CASE WHEN lower(name) = lower(term) THEN 120 WHEN contains(lower(name), lower(term)) THEN 70 ELSE 0 END + CASE WHEN contains(lower(model), lower(term)) THEN 40 ELSE 0 END + CASE WHEN contains(code, lower(term)) THEN 80 ELSE 0 END
 + CASE WHEN contains(search_text, lower(term)) THEN 15 ELSE 0 END) + max(CASE WHEN unit = 'u' || u THEN 10 ELSE 0 END) AS score, any_value(has_image) AS im, any_value(market_price) AS mp FROM a, v GROUP BY 1, 2, 3),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m, u ORDER BY score DESC, im DESC, mp DESC, catalog_idx) AS rank FROM s WHERE score > 0) WHERE rank <= 20)
SELECT o_orderkey AS ask_id, CAST(rank AS INT) AS rank, catalog_idx, CAST(score AS BIGINT) AS score FROM {{orders}} JOIN t ON m = o_custkey % 50 AND u = o_custkey % 3""")
def search_for_lines(catalog, orders):
    """Every order asks for two terms and a model of its own."""
    asked = orders.select(
        F.col("o_orderkey").alias("ask_id"), F.array(F.lit("ring"), F.lit("small ring"), F.concat(F.lit("M"), (F.col("o_custkey") % 50).cast("string"))).alias("terms"), F.concat(F.lit("u"), (F.col("o_custkey") % 3).cast("string")).alias("unit")
    )
    return C.search_for_lines(C.view(catalog), asked)


@query("requests", sql="""WITH t AS (SELECT quote_id, item_index, [trim(regexp_replace(CASE WHEN trim(raw_name) <> '' THEN trim(raw_name) WHEN trim(raw_spec) <> '' THEN trim(raw_spec) ELSE trim(coalesce(remark, '')) END, '\\s+', ' ', 'g')), trim(regexp_replace(n, '\\s+', ' ', 'g')), trim(regexp_replace(s, '\\s+', ' ', 'g')), trim(regexp_replace(trim(raw_name), '\\s+', ' ', 'g')), trim(regexp_replace(trim(raw_spec), '\\s+', ' ', 'g'))] AS every
FROM (""" + NORMAL + """))
SELECT quote_id, item_index, CASE WHEN every[1] = '' THEN [] ELSE list_filter(every, lambda x, i: x <> '' AND list_position(every, x) = i) END AS terms FROM t""")
def line_search_terms(requests):
    return requests.select("quote_id", "item_index", C.search_terms(F.col("raw_name"), F.col("raw_spec"), F.col("remark")).alias("terms"))
