"""Text and number normalisation over request texts, and rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import money as M
from millrace.functions import rules as R
from millrace.operators import catalog as C
from millrace.operators import documents as D
from millrace.plans.query import half_up, query

_q = lambda x: "'" + x.replace("'", "''") + "'"
TOKEN = lambda x: f"lower(regexp_replace(coalesce({x}, ''), '[，,、/|｜（）()\\[\\]【】\\s]+', '', 'g'))"
COMPACT = lambda x: f"regexp_replace(trim(coalesce({x}, '')), '\\s+', '', 'g')"


def _name_sql(x: str) -> str:
    words = {n: [R._plain(w) for w in [n, *o]] for n, o in R.NAME_ALIASES.items()}
    exact = " ".join(f"WHEN {TOKEN(x)} IN ({', '.join(map(_q, w))}) THEN {_q(n)}" for n, w in words.items())
    within = " ".join(f"WHEN {' OR '.join(f'contains({TOKEN(x)}, {_q(v)})' for v in w if len(v) > 1)} THEN {_q(n)}" for n, w in words.items())
    return f"CASE {exact} {within} ELSE {COMPACT(x)} END"


def _unit_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {TOKEN(x)} IN ({', '.join(_q(R._plain(w)) for w in [n, *o])}) THEN {_q(n)}" for n, o in R.UNITS.items()) + f" ELSE {COMPACT(x)} END"


def _spec_sql(x: str) -> str:
    out = f"trim(coalesce({x}, ''))"
    for p, by in R.SPEC_PATTERNS:
        out = f"regexp_replace({out}, '\\s+', ' ', 'g')" if p == r"\s+" else f"replace({out}, {_q(p)}, {_q(by)})"
    out = f"regexp_replace(lower(trim({out})), 'gb\\s*[-/]?\\s*(\\d+)', 'GB\\1', 'g')"
    for _ in range(4):
        out = f"regexp_replace({out}, '(GB\\d+(?:-\\d+)*)/(\\d)', '\\1-\\2', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, '\\s*x\\s*', 'x', 'g'), '\\s+', ' ', 'g'))"


NUMBER = lambda x: f"TRY_CAST(replace(trim(coalesce({x}, '')), ',', '') AS DOUBLE)"
NORMAL = f"SELECT quote_id, item_index, {_name_sql('raw_name')} AS n, {_spec_sql('raw_spec')} AS s, {_unit_sql('raw_unit')} AS u, * FROM {{requests}}"


def _normal(requests):
    return requests.select("*", R.normalize_name(F.col("raw_name")).alias("n"), R.normalize_spec(F.col("raw_spec")).alias("s"), R.normalize_unit(F.col("raw_unit")).alias("u"))


@query("requests", sql=f"SELECT quote_id, item_index, {TOKEN('raw_name')} AS tok FROM {{requests}}")
def lookup_tokens(requests):
    return requests.select("quote_id", "item_index", R.token(F.col("raw_name")).alias("tok"))


@query("requests", sql=f"""SELECT quote_id, item_index, n AS normalized_name, s AS normalized_spec, u AS normalized_unit, coalesce(nullif(raw_name, ''), n) AS name,
CASE WHEN {NUMBER('raw_quantity')} IS NULL THEN trim(raw_quantity) WHEN {NUMBER('raw_quantity')} = floor({NUMBER('raw_quantity')}) THEN CAST(CAST({NUMBER('raw_quantity')} AS BIGINT) AS VARCHAR) ELSE CAST({NUMBER('raw_quantity')} AS VARCHAR) END AS quantity FROM ({NORMAL})""")
def normalized_items(requests):
    """All of a line's fields in normal form."""
    name = F.when(F.col("raw_name") != "", F.col("raw_name")).otherwise(F.col("n"))
    return _normal(requests).select("quote_id", "item_index", F.col("n").alias("normalized_name"), F.col("s").alias("normalized_spec"), F.col("u").alias("normalized_unit"), name.alias("name"), R.numeric_text(F.col("raw_quantity")).alias("quantity"))


@query("requests", sql=f"""SELECT quote_id, item_index, lower(n) || '||' || lower(s) || '||' || lower(u) AS query_signature, 'excel||' || lower(n) || '||' || lower(s) || '||' || lower(u) || '||' || lower(trim(remark)) AS mapping_signature FROM ({NORMAL})""")
def signatures(requests):
    cols = F.col("n"), F.col("s"), F.col("u")
    return _normal(requests).select("quote_id", "item_index", R.query_signature(*cols).alias("query_signature"), R.mapping_signature(F.lit("excel"), *cols, F.col("remark")).alias("mapping_signature"))


# the references that the tables' pages hold, the one for & last
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]


def _unescape_sql(x: str) -> str:
    for name, by in ENTITIES:
        x = f"replace({x}, {_q(name)}, {_q(by)})"
    return x


@query("pages", sql=f"SELECT page_id, md5(trim(regexp_replace({_unescape_sql('trim(r)')}, '\\s+', ' ', 'g'))) AS text_md5 FROM (SELECT page_id, regexp_replace({_unescape_sql('html')}, '<[^>]+>', ' ', 'g') AS r FROM {{pages}})")
def intro_texts(pages):
    return pages.select("page_id", F.md5(C.strip_tags(F.col("html"))).alias("text_md5"))


@query("requests", sql=f"SELECT quote_id, item_index, {NUMBER('raw_quantity')} AS number, coalesce(nullif(trim(raw_quantity), ''), '') AS words FROM {{requests}}")
def safe_numbers(requests):
    return requests.select("quote_id", "item_index", M.safe_float(F.col("raw_quantity")).alias("number"), M.safe_text(F.col("raw_quantity")).alias("words"))


@query("lines", sql=f"SELECT quote_id, item_index, {half_up('budget_price * 1.005')} AS rounded FROM {{lines}}")
def currency_round(lines):
    return lines.select("quote_id", "item_index", M.money(F.col("budget_price") * 1.005).alias("rounded"))


@query("requests", sql=f"SELECT quote_id, item_index, [replace(g, '/', '-') for g in regexp_extract_all(raw_spec, '(?i)GB\\s*[-/]?\\s*(\\d+(?:[-/]\\d+)*)', 1)] AS gbs FROM {{requests}}")
def gb_numbers(requests):
    return requests.select("quote_id", "item_index", R.gb_numbers(F.col("raw_spec")).alias("gbs"))


@query("documents", sql="SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9]{2,}'))) AS n_words, list_aggregate(list_distinct(regexp_extract_all(text, '[A-Za-z0-9]{2,}')), 'min') AS least FROM {documents}")
def keyword_sets(documents):
    words = R.keywords(F.col("text"))
    return documents.select("doc_id", F.size(words).cast("long").alias("n_words"), F.array_min(words).alias("least"))


@query("conversations", sql="""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[A-Za-z0-9]{2,}')) AS k FROM {conversations}),
p AS (SELECT a.conv_id, a.turn, list_distinct(list_concat(a.k, b.k)) AS un, list_intersect(a.k, b.k) AS inter FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CASE WHEN len(un) > 0 THEN round(len(inter) / len(un), 6) ELSE 0 END AS jaccard FROM p""")
def jaccard_of_turns(conversations):
    words = conversations.select("conv_id", "turn", R.keywords(F.col("text")).alias("k"))
    after = words.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("k").alias("k2"))
    return words.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(R.jaccard(F.col("k"), F.col("k2")), 6).alias("jaccard"))


def _type_sql(q: str, n: str) -> str:
    hits = " OR ".join(f"(contains(lower({q}), {_q(k)}) AND ({' OR '.join(f'contains(lower({n}), {_q(w)})' for w in words)}))" for k, words in R.TYPES.items())
    return f"CASE WHEN {hits} THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END"


@query("requests", sql=f"SELECT quote_id, item_index, {_type_sql('raw_name', 'n')} AS type_score FROM ({NORMAL})")
def type_scores(requests):
    return _normal(requests).select("quote_id", "item_index", R.type_score(F.col("raw_name"), F.col("n")).alias("type_score"))


@query("requests", sql=f"""SELECT quote_id, item_index, coalesce({', '.join(f"CASE WHEN contains(lower(v), {_q(w.lower())}) THEN {_q(w)} END" for w in R.BRAND_WORDS)}, {', '.join(f"CASE WHEN regexp_extract(v, '^([A-Z]{{2,3}})[0-9]*', 1) = '{c}' THEN {_q(b)} END" for c, b in R.BRAND_CODES.items())}, '') AS brand
FROM (SELECT quote_id, item_index, CASE item_index % 4 WHEN 0 THEN 'SZ100 ' || raw_name WHEN 1 THEN '3m ' || raw_name WHEN 2 THEN 'AEK7' ELSE raw_name || '绿盾' END AS v FROM {{requests}})""")
def brands_in_names(requests):
    i = F.col("item_index") % 4
    v = F.when(i == 0, F.concat(F.lit("SZ100 "), "raw_name")).when(i == 1, F.concat(F.lit("3m "), "raw_name")).when(i == 2, "AEK7").otherwise(F.concat("raw_name", F.lit("绿盾")))
    return requests.select("quote_id", "item_index", R.brand_in_name(v).alias("brand"))


@query("catalog", sql="SELECT catalog_idx, CAST(CASE WHEN contains(lower(brand), lower(w)) THEN 1.0 WHEN contains(lower(name), lower(w)) THEN 0.8 ELSE 0.0 END AS DOUBLE) AS brand_score FROM (SELECT *, CASE WHEN catalog_idx % 2 = 0 THEN 'brand#1' ELSE 'RING' END AS w FROM {catalog})")
def brand_scores(catalog):
    wanted = F.when(F.col("catalog_idx") % 2 == 0, "brand#1").otherwise("RING")
    return catalog.select("catalog_idx", R.brand_score(wanted, F.col("brand"), F.col("name")).alias("brand_score"))


@query("requests", sql="SELECT quote_id, item_index, trim(regexp_replace(regexp_replace(replace(replace(v, '3M', ''), '绿盾', ''), '\\d+只装|\\d+个装|\\d+双|\\d+件|\\d+ml|\\d+L|\\d+g|\\d+kg', '', 'g'), '大号|中号|小号|加大|加厚|加绒|加棉', '', 'g')) AS core FROM (SELECT quote_id, item_index, '3M' || raw_name || '大号10只装' AS v FROM {requests})")
def core_names(requests):
    return requests.select("quote_id", "item_index", R.core_name(F.concat(F.lit("3M"), "raw_name", F.lit("大号10只装"))).alias("core"))


@query("lines", sql="SELECT quote_id, item_index, CASE WHEN action = 'select' AND confirmed THEN 'matched' WHEN action IN ('no_match', 'ask_boss') THEN 'nomatch' ELSE 'pending' END AS status FROM {lines}")
def export_statuses(lines):
    return lines.select("quote_id", "item_index", D.export_status().alias("status"))


@query("customer", sql="SELECT c_custkey, trim(regexp_replace(c_name || '/' || c_mktsegment || '?.', '[<>:\"/\\\\|?*]', '_', 'g'), ' ._') AS segment FROM {customer}")
def filename_segments(customer):
    text = F.concat("c_name", F.lit("/"), "c_mktsegment", F.lit("?."))
    return customer.select("c_custkey", D.filename_segment(text).alias("segment"))


@query("embeddings", sql="SELECT vec_id, CASE WHEN isnan(x) OR isinf(x) THEN NULL ELSE x END AS clean FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'nan'::DOUBLE WHEN vec_id % 5 = 0 THEN 'inf'::DOUBLE ELSE CAST(label AS DOUBLE) END AS x FROM {embeddings})")
def finite_or_null(embeddings):
    x = F.when(F.col("vec_id") % 3 == 0, float("nan")).when(F.col("vec_id") % 5 == 0, float("inf")).otherwise(F.col("label").cast("double"))
    return embeddings.select("vec_id", M.finite(x).alias("clean"))


@query("events", sql="SELECT word, n_changes, last_expansion FROM (SELECT word, count(*) OVER (PARTITION BY word) AS n_changes, expansion AS last_expansion, deleted, row_number() OVER (PARTITION BY word ORDER BY t DESC, id DESC) AS r FROM (SELECT event_id AS id, ts AS t, 'w' || CAST(user_id % 60 AS VARCHAR) AS word, event_type AS expansion, event_type = 'error' AS deleted FROM {events})) WHERE r = 1 AND NOT deleted")
def synonym_state(events):
    """The synonyms left after a log of writes and deletions."""
    log = events.select(F.struct("ts", "event_id").alias("at"), F.concat(F.lit("w"), (F.col("user_id") % 60).cast("string")).alias("word"), F.col("event_type").alias("expansion"), (F.col("event_type") == "error").alias("deleted"))
    counts = log.groupBy("word").agg(F.count(F.lit(1)).alias("n_changes"))
    return R.last_written(log).join(counts, "word").select("word", "n_changes", F.col("expansion").alias("last_expansion"))


@query("part", sql="""WITH w AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS word FROM {part}), s AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS main, split_part(p_name, ' ', 2) AS synonym FROM {part} WHERE p_partkey % 4 = 1),
g AS (SELECT DISTINCT main, main AS word FROM s UNION SELECT main, synonym FROM s) SELECT DISTINCT id, word FROM (SELECT id, word FROM w UNION ALL SELECT w.id, h.word FROM w JOIN g ON w.word = g.word JOIN g AS h ON h.main = g.main)""")
def synonym_expansion(part):
    parts = F.split("p_name", " ")
    words = part.select(F.col("p_partkey").alias("id"), F.explode(parts).alias("word"))
    groups = part.where("p_partkey % 4 = 1").select(F.get(parts, 0).alias("main"), F.get(parts, 1).alias("synonym")).distinct()
    return R.expand(words, groups)


@query("part", sql="""WITH d AS (SELECT CAST(p_partkey AS INT) AS priority, p_brand AS canonical, p_type AS word FROM {part} WHERE p_partkey % 2 = 0), c AS (SELECT CAST(p_partkey AS INT) AS priority, p_brand AS canonical, p_type AS word FROM {part} WHERE p_partkey % 2 = 1),
b AS (SELECT *, 0 AS source FROM d UNION ALL SELECT *, 1 FROM c) SELECT priority, canonical, word, source FROM (SELECT *, row_number() OVER (PARTITION BY canonical, word ORDER BY source, priority) AS n FROM b) WHERE n = 1""")
def rule_merge(part):
    rows = part.select(F.col("p_partkey").cast("int").alias("priority"), F.col("p_brand").alias("canonical"), F.col("p_type").alias("word"))
    return R.merge_rules(rows.where("priority % 2 = 0"), rows.where("priority % 2 = 1"))
