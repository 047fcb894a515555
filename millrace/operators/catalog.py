"""The product catalogue: import, cost flags, search view, filters, facets and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import rules as R
from millrace.functions.html_text import unescape
from millrace.functions.money import safe_float
from millrace.operators.overlap import containing
from millrace.streaming.runs import saved

# Headers of an uploaded catalogue and the columns they become.
HEADERS = {"* 商品编码": "code", "* 商品名称": "name", "* 型号": "model", "* 商品类别": "category", "* 单位": "unit", "* 市场价": "market_price", "商品品牌": "brand", "所属供应商": "supplier", "状态": "status", "商品介绍": "intro"}
COST_HEADERS = ["成本价", "采购价", "进货价", "参考成本价", "* 成本价", "* 采购价", "* 进货价"]
LABELS = [("code", "商品编码"), ("name", "商品名称"), ("model", "型号"), ("brand", "品牌"), ("category", "商品类别"), ("unit", "单位"), ("supplier", "所属供应商"), ("status", "状态"), ("market_price", "市场价"), ("cost_price", "成本价")]


def plain(text: Column) -> Column:
    """Trimmed, references decoded, white space runs as one space; null is ''."""
    return F.trim(F.regexp_replace(unescape(F.trim(F.coalesce(text.cast("string"), F.lit("")))), r"(?U)\s+", " "))


def strip_tags(html: Column) -> Column:
    """The text of a piece of HTML."""
    return plain(F.regexp_replace(unescape(F.coalesce(html, F.lit(""))), "<[^>]+>", " "))


def pick_cost(columns: list[str]) -> Column:
    """The first of the known cost columns that parses as a number."""
    known = [c for c in COST_HEADERS if c in columns]
    return F.coalesce(*(safe_float(F.col(f"`{c}`")) for c in known)) if known else F.lit(None).cast("double")


def import_catalog(raw: DataFrame) -> DataFrame:
    """Uploaded rows under their own headers as a catalogue; rows without a name are dropped."""
    text = lambda h: F.coalesce(F.col(f"`{h}`").cast("string"), F.lit("")) if h in raw.columns else F.lit("")
    columns = [(safe_float(text(h)) if c == "market_price" else text(h)).alias(c) for h, c in HEADERS.items()]
    out = raw.select(*columns, pick_cost(raw.columns).alias("cost_price")).withColumn("market_price", F.coalesce("market_price", F.lit(0.0)))
    return out.where(F.trim("name") != "")


def cost_flags(products: DataFrame, uploaded: bool = False) -> DataFrame:
    """products with has_cost_price, cost_price_missing, cost_price_ambiguous. A loaded 0 is ambiguous, an uploaded one is a price."""
    missing = F.col("cost_price").isNull()
    ambiguous = ~missing & (F.col("cost_price") == 0) & F.lit(not uploaded)
    if "cost_price_missing" in products.columns:  # flags that came with the rows win
        missing = missing | F.coalesce(F.col("cost_price_missing"), F.lit(False))
        ambiguous = ~missing & F.coalesce(F.col("cost_price_ambiguous"), F.lit(False))
    flagged = products.withColumn("_missing", missing).withColumn("_ambiguous", F.coalesce(ambiguous, F.lit(False)))
    return (
        flagged.withColumn("cost_price", F.when(~F.col("_missing"), F.col("cost_price")))
        .withColumn("has_cost_price", ~F.col("_missing") & ~F.col("_ambiguous"))
        .withColumn("cost_price_missing", F.col("_missing")).withColumn("cost_price_ambiguous", F.col("_ambiguous"))
        .drop("_missing", "_ambiguous")
    )


def current_or_last(current: DataFrame, last: DataFrame) -> DataFrame:
    """The current catalogue, or the last uploaded one if that is empty."""
    return current.unionByName(last.join(current.select(F.lit(1).alias("one")).limit(1), how="left_anti"))


def view(products: DataFrame) -> DataFrame:
    """The catalogue for search: clean fields, intro_text, has_image, search_text."""
    fields = ["code", "name", "model", "category", "unit", "brand", "supplier", "status"]
    out = cost_flags(products).select("catalog_idx", *(plain(F.col(c)).alias(c) for c in fields), strip_tags(F.col("intro")).alias("intro_text"), "market_price", "cost_price", "has_cost_price", "cost_price_missing", "cost_price_ambiguous", has_image().alias("has_image"))
    return out.withColumn("search_text", F.lower(F.concat_ws(" ", *fields, "intro_text")))


def has_image() -> Column:
    return F.coalesce(F.col("image_url"), F.lit("")) != ""


def effective_code(*columns: str) -> Column:
    """The first of the columns that is not blank, trimmed; '' if none."""
    return F.coalesce(*(F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string"))) for c in columns), F.lit(""))


def where(view: DataFrame, keyword: str = "", category: str = "", supplier: str = "", brand: str = "", image: str = "") -> DataFrame:
    """Rows that hold the keyword and equal the other fields given."""
    out = view.where(F.col("search_text").contains(keyword.strip().lower())) if keyword.strip() else view
    for column, value in (("category", category), ("supplier", supplier), ("brand", brand)):
        out = out.where(F.col(column) == value.strip()) if value.strip() else out
    return out.where(F.col("has_image") == (image == "yes")) if image in ("yes", "no") else out


def page(view: DataFrame, number: int, size: int) -> DataFrame:
    """One page in catalogue order, with total, image_total, page and total_pages on each row. The page is clamped.

    Places are counted per range of the sorted catalogue, not in one task: only the page is ever cut out.
    """
    size = max(1, min(size, 100))
    total, images = view.agg(F.count(F.lit(1)), F.count_if("has_image")).first()
    pages = max(1, -(-total // size))
    number = min(max(number, 1), pages)
    cut = view.orderBy("catalog_idx").offset((number - 1) * size).limit(size)
    return cut.withColumns({"total": F.lit(total).cast("long"), "image_total": F.lit(images).cast("long"), "page": F.lit(number).cast("long"), "total_pages": F.lit(pages).cast("long")})


def by_key(products: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """For each key its first product in catalogue order; keys are trimmed."""
    wanted = keys.select(F.trim(F.col(key).cast("string")).alias(key)).distinct()
    return products.withColumn(key, F.trim(F.col(key).cast("string"))).join(wanted, key).groupBy(key).agg(F.min("catalog_idx").alias("catalog_idx"))


def attributes(products: DataFrame) -> DataFrame:
    """(catalog_idx, label, value) of every field that is not blank; a missing or doubtful cost says so."""
    flagged = cost_flags(products)
    cost = F.when(F.col("cost_price_missing"), "未导入").when(F.col("cost_price_ambiguous"), "历史数据待校正").otherwise(F.col("cost_price").cast("string"))
    value = lambda c: cost if c == "cost_price" else F.col(c).cast("string") if c == "market_price" else plain(F.col(c))
    pairs = F.array(*(F.struct(F.lit(label).alias("label"), value(c).alias("value")) for c, label in LABELS))
    return flagged.select("catalog_idx", F.explode(pairs).alias("x")).select("catalog_idx", "x.*").where("coalesce(value, '') <> ''")


def category_counts(products: DataFrame) -> DataFrame:
    """Products per main category: what stands before ξ, else before |; none is 其他."""
    category = F.coalesce("category", F.lit("其他"))
    main = F.when(category.contains("ξ"), F.split_part(category, F.lit("ξ"), F.lit(1))).otherwise(F.split_part(category, F.lit("|"), F.lit(1)))
    return products.groupBy(main.alias("main_category")).agg(F.count(F.lit(1)).alias("products"))


# Price bands, from (included) to (excluded).
BANDS = [("0-50元", None, 50), ("50-100元", 50, 100), ("100-200元", 100, 200), ("200-500元", 200, 500), ("500元以上", 500, None)]


def price_histogram(products: DataFrame) -> DataFrame:
    """Products per price band, empty bands included; a null price is 0."""
    p = F.coalesce("market_price", F.lit(0.0))
    band = F.coalesce(*(F.when(p < hi, name) for name, _, hi in BANDS if hi), F.lit(BANDS[-1][0]))
    bands = products.sparkSession.createDataFrame([(b[0],) for b in BANDS], "band string")
    return bands.join(products.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")), "band", "left").select("band", F.coalesce("n", F.lit(0)).cast("long").alias("products"))


def facets(view: DataFrame) -> DataFrame:
    """(facet, value): the distinct values that are not blank."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("category", "supplier", "brand")))
    return view.select(F.explode(pairs).alias("x")).select("x.*").where("value <> ''").distinct()


def search_terms(name: Column, spec: Column, remark: Column, keyword: Column | None = None) -> Column:
    """What to search for on behalf of a request: the keyword (else the first of its fields that is not blank), its
    normalised name and specification, and both as they are; each once. Empty if there is nothing."""
    first = F.coalesce(*(F.nullif(plain(c), F.lit("")) for c in ((keyword, name, spec, remark) if keyword is not None else (name, spec, remark))), F.lit(""))
    every = F.array(first, plain(R.normalize_name(name)), plain(R.normalize_spec(spec)), plain(name), plain(spec))
    return F.when(first == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(every, lambda t: t != "")))


def search_for_lines(view: DataFrame, asked: DataFrame, most: int = 20) -> DataFrame:
    """The best products for each request (ask_id, terms, unit) by where its terms occur; one per code.

    A term that is the name scores 120, within the name 70, the model 40, the
    code 80, any text 15; an equal unit adds 10. Of a code's products that score
    the first in catalogue order counts, whatever the others score. Requests with
    equal terms and unit are searched for once; texts that hold a term are found
    by the term's rarest pair of characters. A product that has the unit alone
    scores 10, less than any with a term: the best of a unit, one per code, can be
    no more than a page of them.
    """
    view = saved(view.select("catalog_idx", "code", "name", "model", "unit", "has_image", "market_price", "search_text"), "view")
    kinds = asked.select("ask_id", F.array_sort(F.array_distinct(F.filter("terms", lambda t: t != ""))).alias("terms"), F.coalesce("unit", F.lit("")).alias("wanted")).withColumn("kind", F.xxhash64("terms", "wanted"))
    ways = kinds.select("kind", "terms", "wanted").distinct()
    terms = ways.select(F.explode("terms").alias("term")).distinct().withColumn("low", F.lower("term"))
    name, model, code = F.lower("name"), F.lower("model"), F.lower("code")
    own = F.when(name == F.col("low"), 120).when(name.contains(F.col("low")), 70).otherwise(0)
    score = own + F.when(model.contains(F.col("low")), 40).otherwise(0) + F.when(code.contains(F.col("low")), 80).otherwise(0) + 15
    texts = containing(terms, "low", view, "search_text")
    row = F.struct("catalog_idx", F.coalesce("code", F.lit("")).alias("c"), "has_image", "market_price", F.col("unit").alias("u"))
    # texts, and a unit's products, are as many as the catalogue has: none of these joins is a broadcast
    hits = view.join(texts.hint("merge"), "search_text").join(terms, "low").select("term", row.alias("row"), score.alias("score"))
    by_terms = ways.select("kind", "wanted", F.explode("terms").alias("term")).join(hits, "term").groupBy("kind", "wanted", "row").agg(F.sum("score").alias("score"))
    firsts = by_terms.groupBy("kind", "wanted", F.col("row.c").alias("c")).agg(F.min_by(F.struct("row", "score"), "row.catalog_idx").alias("hit"))
    of_unit = view.where("unit <> ''").groupBy(F.col("unit").alias("wanted"), F.coalesce("code", F.lit("")).alias("c")).agg(F.min_by(row, "catalog_idx").alias("first"))
    # a code's product that has the unit alone and comes before those with a term stands for the code
    both = firsts.join(of_unit.hint("merge"), ["wanted", "c"], "left")
    earlier = F.col("first.catalog_idx") < F.col("hit.row.catalog_idx")
    bonus = F.when((F.col("wanted") != "") & (F.col("hit.row.u") == F.col("wanted")), 10).otherwise(0)
    kept = both.select("kind", "c", F.when(earlier, F.col("first")).otherwise(F.col("hit.row")).alias("row"), F.when(earlier, F.lit(10)).otherwise(F.col("hit.score") + bonus).cast("long").alias("score"))
    kept = saved(kept, "kept")
    in_unit = [F.desc("first.has_image"), F.desc_nulls_last("first.market_price"), F.col("first.catalog_idx")]
    page = of_unit.withColumn("n", F.row_number().over(Window.partitionBy("wanted").orderBy(*in_unit))).where(F.col("n") <= most)
    by_unit = ways.select("kind", "wanted").join(page, "wanted").select("kind", "c", F.col("first").alias("row"), F.lit(10).cast("long").alias("score")).join(kept.select("kind", "c").hint("merge"), ["kind", "c"], "left_anti")
    best = Window.partitionBy("kind").orderBy(F.desc("score"), F.desc("row.has_image"), F.desc_nulls_last("row.market_price"), "row.catalog_idx")
    top = kept.unionByName(by_unit).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return kinds.select("ask_id", "kind").join(top, "kind").select("ask_id", "rank", F.col("row.catalog_idx").alias("catalog_idx"), "score")
