"""Rule tables for names, units, types and brands, and the expressions built from them.

All tables are a few dozen rows and become literals of the plan; order matters
in several of them, so they are lists or dicts in their given order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.streaming.runs import saved

# Canonical names and units with their other spellings, in order.
NAME_ALIASES = {
    "袖套": ["套袖", "手袖", "护袖"],
    "手套": ["防护手套", "劳保手套", "工作手套"],
    "布手套": ["棉手套", "线手套", "纱手套"],
    "安全帽": ["防护帽", "头盔"],
    "口罩": ["防尘口罩", "防护口罩"],
    "劳保鞋": ["安全鞋", "防护鞋"],
    "雨鞋": ["雨靴", "胶鞋", "水鞋"],
    "反光背心": ["反光马甲", "安全背心", "警示背心"],
    "防护眼镜": ["护目镜", "防尘眼镜"],
    "耳塞": ["降噪耳塞", "防噪耳塞"],
    "防毒面具": ["防护面具", "呼吸面罩"],
}
UNITS = {"公斤": ["kg", "KG", "千克"], "克": ["g", "G"], "米": ["m", "M", "公尺"], "厘米": ["cm", "CM", "公分"], "毫米": ["mm", "MM"], "升": ["l", "L"], "毫升": ["ml", "ML"], "双": ["付", "副"], "个": ["只", "PCS", "pcs"], "套": ["组"], "件": ["项"], "支": ["根"], "卷": ["盘"], "台": ["部"]}
SPEC_PATTERNS = [(r"\s+", " "), ("（", "("), ("）", ")"), ("【", "["), ("】", "]"), ("×", "x"), ("＊", "x"), ("X", "x"), ("﹣", "-"), ("—", "-"), ("－", "-"), ("／", "/"), ("，", ","), ("：", ":")]
# Product types with the words that show them.
TYPES = {
    "手套": ["手套", "防护手套", "劳保手套", "工作手套"],
    "布手套": ["布手套", "棉手套", "线手套", "纱手套"],
    "纱手套": ["纱手套", "线手套", "棉纱手套", "布手套"],
    "线手套": ["线手套", "纱手套", "棉线手套"],
    "袖套": ["袖套", "套袖", "手袖", "护袖"],
    "套袖": ["袖套", "套袖", "手袖", "护袖"],
    "手袖": ["袖套", "套袖", "手袖", "护袖"],
    "安全帽": ["安全帽", "防护帽", "头盔", "帽"],
    "口罩": ["口罩", "防尘口罩", "防护口罩", "KN95"],
    "防尘口罩": ["防尘口罩", "口罩", "KN95", "防护口罩"],
    "劳保鞋": ["劳保鞋", "安全鞋", "防护鞋", "工作鞋"],
    "安全鞋": ["安全鞋", "劳保鞋", "防护鞋"],
    "雨衣": ["雨衣", "雨披", "防雨服", "套装雨衣"],
    "雨鞋": ["雨鞋", "雨靴", "胶鞋", "水鞋"],
    "水鞋": ["水鞋", "雨鞋", "雨靴", "胶鞋"],
    "绝缘手套": ["绝缘手套", "电工手套", "高压手套"],
    "绝缘鞋": ["绝缘鞋", "电工鞋", "高压鞋"],
    "耳塞": ["耳塞", "隔音耳塞", "防护耳塞"],
    "眼镜": ["眼镜", "防护眼镜", "护目镜", "防风眼镜"],
    "防风眼镜": ["防风眼镜", "防护眼镜", "护目镜", "眼镜"],
    "电焊手套": ["电焊手套", "焊工手套", "焊接手套"],
    "滤毒盒": ["滤毒盒", "滤盒", "防毒滤盒"],
    "防毒面具": ["防毒面具", "呼吸防护", "半面罩"],
    "毛巾": ["毛巾", "面巾", "手巾"],
    "洗衣粉": ["洗衣粉", "洗衣液", "洗涤剂"],
    "反光衣": ["反光衣", "反光背心", "警示衣"],
    "救生衣": ["救生衣", "救生服", "漂浮衣"],
    "解放鞋": ["解放鞋", "帆布鞋", "工作鞋"],
    "面罩": ["面罩", "防护面罩", "面屏"],
}
# Brands with their other spellings; brand words; brand codes that lead a name.
BRANDS = {"赛正": ["赛正", "sz", "saizheng"], "星宇": ["星宇", "xy", "xingyu"], "登升": ["登升", "ds", "dengsheng"], "3m": ["3m", "3m公司"], "霍尼韦尔": ["霍尼韦尔", "honeywell", "honey well"], "安尔康": ["安尔康", "aek", "anerkang"], "稳健": ["稳健", "wj", "wenjian"], "朝美": ["朝美", "cm", "chaomei"], "海固": ["海固", "hg", "haigu"], "华信": ["华信", "hx", "huaxin"], "盾牌": ["盾牌", "dp", "dunpai"], "邦维": ["邦维", "bw", "bangwei"], "可孚": ["可孚", "kf", "kefu"], "绿盾": ["绿盾", "ld", "lvdun"]}
BRAND_WORDS = ["赛正", "星宇", "登升", "3M", "霍尼韦尔", "安尔康", "邦维", "海固", "华信", "盾牌", "稳健", "朝美", "可孚", "绿盾", "南极人", "德尔格", "梅思安", "代尔塔", "优唯斯", "洁适"]
BRAND_CODES = {"SZ": "赛正", "XY": "星宇", "DS": "登升", "AEK": "安尔康", "HG": "海固"}
CORE_BRANDS = ["星宇", "登升", "南极人", "3M", "霍尼韦尔", "安尔康", "邦维", "海固", "华信", "盾牌", "稳健", "朝美", "可孚", "绿盾"]
# Hints in a request that name product categories.
CATEGORY_HINTS = {"手套": ["劳保用品|手部防护|手套", "手套"], "安全帽": ["劳保用品|头部防护", "安全帽", "头盔"], "口罩": ["劳保用品|呼吸防护", "口罩", "防尘"], "劳保鞋": ["劳保用品|足部防护", "安全鞋", "劳保鞋"], "安全鞋": ["劳保用品|足部防护", "安全鞋", "劳保鞋"], "雨衣": ["劳保用品|防护服", "雨衣", "雨披"], "雨鞋": ["劳保用品|足部防护", "雨鞋", "雨靴"], "眼镜": ["劳保用品|眼面防护", "眼镜", "护目"], "耳塞": ["劳保用品|听力防护", "耳塞"], "反光衣": ["劳保用品|警示防护", "反光", "警示"]}

PUNCTUATION = r"[，,、/|｜（）()\[\]【】\s]+"


def token(text: Column) -> Column:
    """A text for look-up: without separators, brackets and white space, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), PUNCTUATION, ""))


def _plain(text: str) -> str:
    return "".join(c for c in text if not c.isspace() and c not in "，,、/|｜（）()[]【】").lower()


def compact(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s+", "")


def _with(x: Column, f) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), 0)


def normalize_name(text: Column, aliases: dict[str, list[str]] = NAME_ALIASES) -> Column:
    """The canonical name: of an exact alias in rule order, else of the first rule one of whose words is contained, else the text without spaces."""

    def found(low: Column) -> Column:
        exact, within = [], []
        for name, others in aliases.items():
            words = [_plain(w) for w in [name, *others]]
            exact.append(F.when(low.isin(words), name))
            some = [low.contains(w) for w in words if len(w) >= 2]
            hit = some[0]
            for x in some[1:]:
                hit = hit | x
            within.append(F.when(hit, name))
        return F.coalesce(*exact, *within)

    return F.coalesce(_with(token(text), found), compact(text))


def normalize_unit(text: Column, units: dict[str, list[str]] = UNITS) -> Column:
    found = lambda low: F.coalesce(*(F.when(low.isin([_plain(w) for w in [name, *others]]), name) for name, others in units.items()))
    return F.coalesce(_with(token(text), found), compact(text))


def normalize_spec(text: Column) -> Column:
    """A specification in one spelling: widths, dashes and crosses unified, lower case, standards as GB123-4."""
    out = F.trim(F.coalesce(text, F.lit("")))
    for pattern, by in SPEC_PATTERNS:
        out = F.regexp_replace(out, pattern if pattern == r"\s+" else f"\\Q{pattern}\\E", by)
    out = F.regexp_replace(F.lower(F.trim(out)), r"gb\s*[-/]?\s*(\d+)", "GB$1")
    # the slashes between the numbers of a standard, all of them: each has digits, dashes and slashes up to a GB before it
    out = F.regexp_replace(out, r"(?<=GB[0-9/-]{1,200})/(?=\d)", "-")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s*x\s*", "x"), r"\s+", " "))


def numeric(text: Column) -> Column:
    """The number in a text with thousands commas; null if it is none."""
    return F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), ",", "").try_cast("double")


def numeric_text(text: Column) -> Column:
    """A number as text, whole ones without decimals; the trimmed text if it is none."""
    n = numeric(text)
    return F.when(n.isNull(), F.trim(F.coalesce(text, F.lit("")))).when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string"))


def query_signature(name: Column, spec: Column, unit: Column) -> Column:
    return F.concat_ws("||", *(F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (name, spec, unit)))


def mapping_signature(source: Column, name: Column, spec: Column, unit: Column, remark: Column) -> Column:
    return F.concat_ws("||", *(F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (source, name, spec, unit, remark)))


def gb_numbers(text: Column) -> Column:
    """The standards' numbers in a text, slashes as dashes."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)GB\s*[-/]?\s*(\d+(?:[-/]\d+)*)"), 1), lambda g: F.replace(g, F.lit("/"), F.lit("-")))


def type_score(query: Column, name: Column) -> Column:
    """0.9 where the query names a type and the product any of that type's words."""
    q, n = F.lower(F.coalesce(query, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    hit = F.lit(False)
    for kind, words in TYPES.items():
        some = F.lit(False)
        for w in words:
            # words stand as they are: one in capitals never occurs in lower-case text
            some = some | n.contains(w)
        hit = hit | (q.contains(kind) & some)
    return F.when(hit, 0.9).otherwise(0.0)


def brand_score(wanted: Column, brand: Column, name: Column) -> Column:
    """The first spelling of the wanted brand that is in the product's brand (1.0) or name (0.8) decides."""
    q, b, n = F.lower(F.trim(F.coalesce(wanted, F.lit("")))), F.lower(F.trim(F.coalesce(brand, F.lit("")))), F.lower(F.coalesce(name, F.lit("")))
    group = F.coalesce(*(F.when(q.isin([main, *others]), F.array(*(F.lit(x) for x in [main, *others]))) for main, others in BRANDS.items()), F.array(q))
    said = F.filter(F.transform(group, lambda a: F.when(b.contains(a), 1.0).when(n.contains(a), 0.8).otherwise(0.0)), lambda s: s > 0)
    return F.when(q == "", 0.0).otherwise(F.coalesce(F.get(said, 0), F.lit(0.0)))


def brand_in_name(name: Column) -> Column:
    """The first brand word in a name, else the brand of a leading code of two or three capitals, else ''."""
    text = F.coalesce(name, F.lit(""))
    low = F.lower(text)
    code = F.regexp_extract(text, r"^([A-Z]{2,3})\d*", 1)
    return F.coalesce(*(F.when(low.contains(w.lower()), w) for w in BRAND_WORDS), *(F.when(code == c, b) for c, b in BRAND_CODES.items()), F.lit(""))


def core_name(name: Column) -> Column:
    """A name without brands, pack sizes and size words."""
    out = F.coalesce(name, F.lit(""))
    for brand in CORE_BRANDS:
        out = F.replace(out, F.lit(brand), F.lit(""))
    out = F.regexp_replace(out, r"\d+只装|\d+个装|\d+双|\d+件|\d+ml|\d+L|\d+g|\d+kg", "")
    return F.trim(F.regexp_replace(out, "大号|中号|小号|加大|加厚|加绒|加棉", ""))


def keywords(text: Column) -> Column:
    """The set of words of a text: runs of two or more Latin letters and digits, and pairs of neighbouring Chinese characters.

    Stands in for dictionary segmentation; any function from text to an array can take its place.
    """
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z0-9]{2,})"), 1)
    chinese = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([一-龥]{2,})"), 1)
    pairs = F.flatten(F.transform(chinese, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(runs, pairs))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def alias_table(spark: SparkSession, aliases: dict[str, list[str]]) -> DataFrame:
    """(priority, canonical, word), in rule order."""
    rows = [(k, name, w) for k, (name, others) in enumerate(aliases.items()) for w in [name, *others]]
    return spark.createDataFrame(rows, "priority int, canonical string, word string")


def merge_rules(default: DataFrame, custom: DataFrame) -> DataFrame:
    """Default rules, then custom ones; of a word repeated under one canonical name the first stays."""
    both = default.withColumn("source", F.lit(0)).unionByName(custom.withColumn("source", F.lit(1)))
    first = Window.partitionBy("canonical", "word").orderBy("source", "priority")
    return both.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def expand(words: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(id, word) rows with those of every synonym group (main, synonym) that holds one of an id's words.

    Words, not ids, meet the groups. What comes of it is looked up by the ids dealt out before that: a word becomes
    many rows, however few tasks the words' own bytes would make.
    """
    groups = synonyms.select("main", F.explode(F.array("main", "synonym")).alias("word")).distinct()
    known = words.select("word").distinct().join(groups, "word").join(groups.withColumnRenamed("word", "other"), "main").select("word", "other").distinct()
    known = saved(known.withColumn("found", F.lit(True)), "synonyms")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = words.select("id", "word").repartition(parts, "id")
    # a word in a group is among its others
    return dealt.join(known, "word", "left").select("id", F.when(F.col("found"), F.col("other")).otherwise(F.col("word")).alias("word")).distinct()


def last_written(log: DataFrame) -> DataFrame:
    """The state after a log of (word, expansion, at, deleted): each word's last entry, unless it deletes."""
    last = Window.partitionBy("word").orderBy(F.desc("at"))
    return log.withColumn("n", F.row_number().over(last)).where("n = 1 and not deleted").drop("n")
