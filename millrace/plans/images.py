"""Images of products in descriptions, and product blocks of search pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import images as I
from millrace.plans.query import query

BASE, FILES = "https://shop.example", "https://files.example"
_q = lambda x: "'" + x.replace("'", "''") + "'"
FOLD = lambda x: f"regexp_replace(lower(coalesce({x}, '')), {_q(I.SKIPPED)}, '', 'g')"
TOKENS = "list_filter(list_distinct(" + "list_concat({})".format(", ".join(f"[{FOLD(c)}], list_filter(list_transform(regexp_extract_all({c}, '[A-Za-z0-9]+|[一-鿿]{{2,}}'), lambda t: {FOLD('t')}), lambda t: length(t) >= 2)" for c in ("code", "name", "model"))) + "), lambda t: t <> '')"


@query("catalog", sql=f"""SELECT catalog_idx, ['{BASE}/a/' || catalog_idx || '.png', 'http://other.example/b.jpg'] AS urls, ['{FILES}/a/' || catalog_idx || '.png', 'http://other.example/b.jpg'] AS sources FROM {{catalog}}""")
def intro_images(catalog):
    html = F.concat(F.lit("<p>&lt;img alt='x' src=\"../a/"), F.col("catalog_idx").cast("string"), F.lit(".png\" title='t'&gt;<img src='http://other.example/b.jpg'></p>"))
    return catalog.select("catalog_idx", I.image_urls(html, BASE).alias("urls")).select("catalog_idx", "urls", F.transform("urls", lambda u: I.source_url(u, BASE, FILES)).alias("sources"))


@query("catalog", sql="""SELECT catalog_idx, CASE WHEN catalog_idx % 3 = 0 THEN ['b', 'c'] ELSE ['a', 'b', 'c'] END AS kept, CASE WHEN catalog_idx % 4 = 0 THEN ['/image-proxy/by-id/' || catalog_idx, '/image-proxy/by-id/' || catalog_idx || '?index=1'] WHEN catalog_idx % 4 = 1 THEN [] ELSE ['/image-proxy/' || code, '/image-proxy/' || code || '?index=1'] END AS proxies FROM {catalog}""")
def shown_images(catalog):
    """Three of five images, less those whose title says that they show something else."""
    k = F.col("catalog_idx")
    image = lambda url, title: F.struct(F.lit(url).alias("url"), title.alias("title"))
    images = F.array(image("a", F.when(k % 3 == 0, "温馨提示图").otherwise("正面")), image("b", F.lit(None).cast("string")), image("x", F.lit("固定模板")), image("c", F.lit("")))
    kept = F.transform(I.product_images(images, 3), lambda i: i["url"])
    proxies = I.proxy_urls(F.when(k % 4 > 1, F.col("code")), F.when(k % 4 == 0, k), F.when(k % 4 == 1, 0).otherwise(2))
    return catalog.select("catalog_idx", kept.alias("kept"), proxies.alias("proxies"))


@query("catalog", sql=f"SELECT catalog_idx, {FOLD('name || brand')} AS folded, list_sort({TOKENS}) AS tokens FROM (SELECT catalog_idx, code, name || ' 防护-手套/A.1' AS name, brand, model FROM {{catalog}})")
def page_tokens(catalog):
    c = catalog.select("catalog_idx", "code", F.concat("name", F.lit(" 防护-手套/A.1")).alias("name"), "brand", "model")
    return c.select("catalog_idx", I.folded(F.concat("name", "brand")).alias("folded"), F.array_sort(I.match_tokens(F.col("code"), F.col("name"), F.col("model"))).alias("tokens"))


@query("catalog", sql="SELECT catalog_idx, catalog_idx % 5 >= 3 OR (catalog_idx % 5 = 2 AND length(model) >= 3) AS prefers FROM {catalog}")
def intro_preferences(catalog):
    k = F.col("catalog_idx")
    title = F.when(k % 5 == 0, "商品参数").when(k % 5 == 1, "12.jpg").otherwise("正面")
    said = F.when(k % 5 == 2, F.concat(F.lit("型号"), "model")).otherwise(F.upper("name"))
    intro = F.concat(F.lit("<img src='a' title='"), title, F.lit("'> "), said)
    return catalog.select("catalog_idx", I.prefers_intro(F.col("name"), F.col("model"), intro).alias("prefers"))


TEXT = """'<div class="product_item" id="productinfo_' || code || '"><b>' || name || '</b> ' || model || CASE WHEN catalog_idx % 2 = 0 THEN ' <img src="/ProductImg/' || code || '.jpg">' ELSE '' END || '</div>'"""
PAGES = f"SELECT brand || name AS key, {TEXT} AS block, CAST(row_number() OVER (PARTITION BY brand || name ORDER BY catalog_idx) - 1 AS INT) AS block_no FROM {{catalog}}"


@query("catalog", sql=f"""WITH b AS (SELECT *, {FOLD('block')} AS text FROM ({PAGES})), p AS (SELECT catalog_idx, brand || name AS key, code, name, model, {TOKENS} AS tokens FROM {{catalog}}),
s AS (SELECT catalog_idx, key, block_no, block, CASE WHEN contains(text, {FOLD('code')}) THEN 120 ELSE 0 END + CASE WHEN contains(text, {FOLD('name')}) THEN 100 ELSE 0 END + CASE WHEN length({FOLD('model')}) >= 3 AND contains(text, {FOLD('model')}) THEN 40 ELSE 0 END
 + list_sum(list_transform(tokens, lambda t: CASE WHEN contains(text, t) THEN CASE WHEN length(t) >= 4 THEN 8 ELSE 4 END ELSE 0 END)) + CASE WHEN contains(block, '/ProductImg/') THEN 5 ELSE 0 END AS score FROM p JOIN b USING (key))
SELECT catalog_idx, key, CAST(block_no AS INT) AS block_no, CAST(score AS INT) AS score, regexp_extract(block, 'src="([^"]*/ProductImg/[^"]*)"', 1) AS image, regexp_extract(block, 'productinfo_([0-9]+)', 1) AS product_id FROM s QUALIFY row_number() OVER (PARTITION BY catalog_idx ORDER BY score DESC, block_no) = 1""")
def page_blocks(catalog):
    """Every product looked for on the page of its brand and name, which shows all such products."""
    shown = catalog.select(F.concat("brand", "name").alias("key"), "catalog_idx", F.expr(TEXT).alias("block"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("catalog_idx", "block"))), lambda x: x["block"])
    pages = shown.groupBy("key").agg(F.concat(F.lit("<html>"), F.array_join(listed, ""), F.lit('<script type="text/javascript">x</script></html>')).alias("html"))
    return I.resolve(catalog.select("catalog_idx", F.concat("brand", "name").alias("key"), "code", "name", "model"), pages)


# pages without blocks: a first picture too far before the product, one near it; some show only the model, some nothing
WINDOW = """'<html><img src="/ProductImg/far.jpg">' || repeat('x', 4500) || CASE catalog_idx % 3 WHEN 0 THEN name WHEN 1 THEN model ELSE '' END || repeat('y', 700) || '<img src="/ProductImg/' || code || '.jpg" id="productinfo_' || code || '">' || repeat('z', 9000) || '<b>productinfo_7</b></html>'"""


@query("catalog", sql="SELECT catalog_idx, -1 AS block_no, 0 AS score, '/ProductImg/' || code || '.jpg' AS image, code AS product_id FROM {catalog} WHERE catalog_idx % 3 < 2")
def page_windows(catalog):
    """Products on pages without blocks, found by what stands around their first mention."""
    pages = catalog.select("catalog_idx", F.expr(WINDOW).alias("html"), F.concat(F.lit("k"), "code").alias("key"))
    asked = catalog.select("catalog_idx", F.concat(F.lit("k"), "code").alias("key"), F.lit("no such code").alias("code"), "name", "model")
    return I.resolve(asked, pages.select("key", "html")).drop("key")
