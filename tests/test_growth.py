"""Steps whose work must grow with the input, on small frames."""

from pyspark.sql import functions as F

from millrace.functions import html_text
from millrace.operators import documents as D
from millrace.operators import images as I
from millrace.operators import overlap
from millrace.operators import scans as S


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_are_cut_before_lines_meet_them(spark):
    from millrace.plans.pricing import candidate_sheet

    products = spark.range(300).selectExpr("id as catalog_idx", "'M1' as model", "'u' || id % 2 as unit", "'c' || id as code", "'n' as name", "1.5d as market_price")
    kept = D.first_products(products.withColumnRenamed("model", "spec"), ["spec", "unit"])
    assert kept.count() == 40
    lines = spark.range(6).selectExpr("id as quote_id", "1 as item_index", "'M1' as spec", "'u' || id % 2 as unit")
    found = candidate_sheet(lines, products)
    # no window over the lines and their candidates
    assert "quote_id" not in "".join(x for x in plan(found).splitlines() if "Window" in x)
    assert sorted((r.quote_id, r["rank"], r.code) for r in found.collect()) == sorted((q, k + 1, f"c{2 * k + q % 2}") for q in range(6) for k in range(20))


def test_pages_and_blocks_are_not_broadcast(spark):
    products = spark.range(3).selectExpr("id as catalog_idx", "'k' || id as key", "'none' as code", "'n' || id as name", "'m' as model")
    pages = spark.range(3).selectExpr("'k' || id as key", "repeat('x', 50) || 'n' || id as html")
    found = I.resolve(products, pages)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert sorted(r.catalog_idx for r in found.collect()) == [0, 1, 2]


def test_lists_of_marks_are_not_broadcast(spark, monkeypatch):
    terms, texts = spark.createDataFrame([("ring",), ("m1",)], "low string"), spark.createDataFrame([("a ring m1",), ("m10",), ("x",)], "text string")
    for few, side in ((20000, "rightHint=(strategy=broadcast)"), (0, "rightHint=(strategy=merge)")):
        monkeypatch.setattr(overlap, "FEW", few)
        found = overlap.containing(terms, "low", texts, "text")
        assert side in plan(found) or (few and "leftHint=(strategy=broadcast)" in plan(found))
        assert sorted(map(tuple, found.collect())) == [("m1", "a ring m1"), ("m1", "m10"), ("ring", "a ring m1")]


def test_a_reference_is_looked_up_in_a_short_text():
    assert max(map(len, html_text.TABLES)) < 400 and sum(map(len, html_text.TABLES)) > 20000


def test_boxes_of_a_page_are_grouped_in_batches(spark):
    """One page over many batches: a group goes on from one to the next."""
    rows = [(1, k, float(10 * k) if k % 2 else 10.0 * k + 1, 20.0) for k in range(100)] + [(2, k, 5.0, 20.0) for k in range(30)]
    frame = spark.createDataFrame(rows, "image_id long, box_no long, cy double, height double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = S.text_rows(frame)
        # rows pass in order: no page is collected
        assert "FlatMapGroups" not in plan(df) and "MapInArrow" in plan(df)
        found = {(r.image_id, r.box_no): r.row_no for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for image in (1, 2):
        members = []
        for _, k, y, _ in sorted((r for r in rows if r[0] == image), key=lambda r: (r[2], r[1])):
            near = next((g for g in members if abs(y - sum(v for _, v in g) / len(g)) <= 18), None)
            if near is None:
                members.append(near := [])
            near.append((k, y))
        assert {k: g for g, m in enumerate(members) for k, _ in m} == {k: g for (i, k), g in found.items() if i == image}


def test_cells_of_a_sheet_are_read_once(spark):
    from millrace.operators import sheets

    cells = spark.createDataFrame([(1, r, c, v) for r, row in enumerate([["名称", "数量", "单位"], ["a", "2", "u"], ["b", "3", "u"]]) for c, v in enumerate(row)], "file_id long, row_idx long, col_idx long, value string")
    assert "exists(" not in plan(sheets.row_scores(cells))
    where = sheets.regions(cells)
    # numbers are read in the aggregate, not again for each thing said of them
    assert "[+-]?" not in plan(sheets.data_patterns(cells, where)).split("Aggregate")[0]
    assert [r.detected_type for r in sheets.column_types(cells, where).orderBy("col_idx").collect()] == ["name", "quantity", "unit"]


def test_parts_of_a_sheet_are_numbered_through(spark):
    from millrace.operators import sheets

    names = ["s=a/part-00002-x.c000.csv", "s=a/part-00001-x.c000.csv", "s=a/part-00001-x.c001.csv", "s=b/part-00000-x.c000.csv"]
    cells = spark.createDataFrame([(n, r, 0, f"{k}{r}") for k, n in enumerate(names) for r in range(k + 1)], "file_id string, row_idx long, col_idx long, value string")
    found = sheets.joined_parts(cells, F.regexp_extract("file_id", "s=([^/]*)", 1)).orderBy("file_id", "row_idx").collect()
    assert [(r.file_id, r.row_idx, r.value) for r in found] == [("a", 0, "10"), ("a", 1, "11"), ("a", 2, "20"), ("a", 3, "21"), ("a", 4, "22"), ("a", 5, "00"), *(("b", k, f"3{k}") for k in range(4))]


def test_an_export_is_written_by_the_tasks_that_have_its_rows(spark, tmp_path):
    from millrace.operators import workbench

    frame = spark.range(0, 40, 1, 4).selectExpr("id", "'one' as supplier")
    assert workbench.export(frame, str(tmp_path / "out"), "supplier").count() == 40
    assert len(list((tmp_path / "out" / "supplier=one").glob("*.csv"))) == 4


def test_a_small_workbook_is_parsed_once_and_files_pass_in_batches(spark, monkeypatch):
    import pyarrow as pa

    from millrace.sources import workbook as W

    content = W.workbook_bytes([(0, 0, "a"), (2, 1, "7")])
    opened, rows = [], W.workbook_rows
    monkeypatch.setattr(W, "workbook_rows", lambda *a: opened.append(1) or rows(*a))
    batch = pa.RecordBatch.from_arrays([pa.array(["x.xlsx"]), pa.array([content])], ["path", "content"])
    read = lambda: [r for b in W._cells(iter([batch]), 0) for r in zip(*(c.to_pylist() for c in b.columns))]
    once = read()
    assert len(opened) == 1 and [r[1:4] for r in once] == [(0, 0, "a"), (0, 1, None), (1, 0, None), (1, 1, None), (2, 0, None), (2, 1, "7")]
    # what is too large to be held is read again, part by part
    monkeypatch.setattr(W, "BATCH", 1)
    monkeypatch.setattr(W, "SMALL", 1)
    assert read() == once and len(opened) == 3
    # a file's cells go on from one batch to the next
    parts = [[(None, 0, 0, "n"), (1, 0, 0, "a")], [(1, 0, 1, "b"), (1, 1, 0, None)], [(2, 0, 0, "")]]
    schema = pa.schema([("file_id", pa.int64()), ("row_idx", pa.int64()), ("col_idx", pa.int64()), ("value", pa.string())])
    made = [r for b in W._workbooks(pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*p), schema)], schema=schema) for p in parts) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert [(f, list(rows(b))) for f, b in made] == [(None, [(0, ["n"])]), (1, [(0, ["a", "b"])]), (2, [])]
    assert "FlatMapGroups" not in plan(W.workbooks(spark.createDataFrame([(1, 0, 0, "a")], "file_id long, row_idx long, col_idx long, value string")))


def test_texts_meet_and_not_requests_and_products(spark):
    from millrace.operators import matching as X

    requests = spark.createDataFrame([("large ring", "M1", f"b{k}") for k in range(6)], "name string, spec string, brand string")
    products = spark.createDataFrame([(k, "large ring", "M1", f"b{k % 6}") for k in range(60)], "catalog_idx long, name string, model string, brand string")
    asks, prods = X.prepare_requests(requests), X.prepare_products(products)
    assert (asks.count(), prods.count()) == (6, 6)
    assert X.text_pairs(*X.texts_of(asks, prods, products)).count() == 1


def test_candidates_of_a_request_are_no_array(spark):
    from millrace.operators import feedback

    rows = spark.range(30).selectExpr("1 as ask_id", "0.5d as score", "0.1d as base_score", "id as catalog_idx", "id > 0 as has_image")
    found = feedback.rerank(rows)
    assert "collect_list" not in plan(found)
    # the first is passed by all others
    assert {r.catalog_idx: r.place for r in found.collect()} == {0: 30, **{k: k for k in range(1, 30)}}


def test_products_do_not_meet_all_blocks_of_their_page(spark, monkeypatch):
    import random

    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abAB1手套") for _ in range(draw.randint(1, 4)))
    rows = [(k, f"k{k % 2}", word(), f"{word()} {word()}", word() if k % 3 else None) for k in range(40)]
    texts = {key: [" ".join([word(), *(draw.choice(r[2:]) or "" for r in draw.sample(rows, 3)), draw.choice(["", "<img src='/ProductImg/x.jpg'>"])]) for _ in range(25)] for key in ("k0", "k1")}
    html = {key: "".join(f'<div class="product_item">{t}' for t in ts) + I.ENDS[1] for key, ts in texts.items()}
    products = spark.createDataFrame(rows, "catalog_idx long, key string, code string, name string, model string")
    pages = spark.createDataFrame(list(html.items()), "key string, html string")
    fold = [(r.catalog_idx, r.key, r.f, r.tokens) for r in products.select("catalog_idx", "key", F.array(*(I.folded(F.col(c)) for c in ("code", "name", "model"))).alias("f"), I.match_tokens(F.col("code"), F.col("name"), F.col("model")).alias("tokens")).collect()]
    shown = {(r.key, r.block_no): (r.text, "/ProductImg/" in r.block) for r in I.blocks(pages).withColumn("text", I.folded(F.col("block"))).collect()}

    def score(f, tokens, text, pictured):
        gains = zip(f, (120, 100, 40), (1, 1, 3), strict=True)
        said = sum(g for x, g, least in gains if len(x) >= least and x in text) + sum(8 if len(t) >= 4 else 4 for t in tokens if t in text)
        return said + 5 * pictured

    want = {i: max((score(f, tokens, *shown[key, n]), -n) for n in range(25)) for i, key, f, tokens in fold}
    for seldom, cell in ((1, 4), (99, 5)):
        monkeypatch.setattr(I, "SELDOM", seldom)
        monkeypatch.setattr(I, "CELL", cell)
        found = I.resolve(products, pages)
        assert "contains(text" not in plan(found).lower()
        assert {r.catalog_idx: (r.score, -r.block_no) for r in found.collect()} == want
    # a page is cut once, and not once for each of its parts
    assert plan(I.blocks(pages)).count("split(") == 1


def test_vectors_are_compared_by_matrices_and_ranked_by_sums_in_order(spark, monkeypatch):
    import math
    import random

    from millrace.operators import matching as X

    monkeypatch.setattr(X, "SLICE", 7)
    draw = random.Random(2)
    vectors = [[draw.uniform(-1, 1) for _ in range(4)] for _ in range(30)]
    vectors += [vectors[3]] * 8 + [[0.0] * 4, [1.0, float("nan"), 0.0, 0.0], None, [1.0, None, 0.0, 0.0], [1.0, 0.5], [0.5, 1.0], []]
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    stored = {r.vec_id: r.embedding for r in frame.collect()}
    total = lambda x, y: __import__("functools").reduce(lambda s, p: s + p[0] * p[1], zip(x, y), 0.0)
    whole = {k: v for k, v in stored.items() if v and None not in v and total(v, v) != 0}
    want = set()
    for k in (k for k in whole if k % 3 == 0):
        cosine = lambda a, b: total(a, b) / (math.sqrt(total(a, a)) * math.sqrt(total(b, b)))
        scores = [(cosine(whole[k], v), i) for i, v in whole.items() if i != k and len(v) == len(whole[k])]
        best = sorted((-math.inf if math.isnan(s) else -s, i, s) for s, i in scores if math.isnan(s) or s >= 0.3)[:5]
        want |= {(k, i, n + 1, str(s)) for n, (_, i, s) in enumerate(best)}
    found = X.semantic(frame.where("vec_id % 3 = 0"), frame, most=5)
    assert "zip_with" not in plan(found).lower()
    assert {(r.query_id, r.vec_id, r["rank"], str(r.score)) for r in found.collect()} == want


def test_cells_of_a_sheet_are_shuffled_once(spark):
    from millrace.operators import sheets

    cells = spark.range(40).selectExpr("id div 20 as file_id", "id % 20 div 4 as row_idx", "id % 4 as col_idx", "'v' || id as value")
    grid = sheets.oriented(cells)
    found = sheets.headers(grid, sheets.regions(grid))
    assert found.count() == 8
    text = found._jdf.queryExecution().sparkPlan().toString()
    assert text.count("Join") == text.count("ShuffledHashJoin") > 0
    # no other exchange than that by file
    assert "ENSURE_REQUIREMENTS" not in found._jdf.queryExecution().executedPlan().toString()


def test_words_meet_their_synonyms_dealt_out(spark):
    from millrace.functions import rules as R

    words = spark.createDataFrame([(1, "a"), (1, "x"), (2, "b"), (3, "c"), (3, "c"), (4, None), (5, "d")], "id long, word string").coalesce(1)
    synonyms = spark.createDataFrame([("a", "b"), ("a", "d"), ("e", "d"), ("x", None)], "main string, synonym string")
    found = R.expand(words, synonyms)
    # ids are dealt by a stated number of partitions, which are not joined for their few bytes, and rows of an id stay together
    where = found.select("id", F.spark_partition_id().alias("p")).distinct()
    assert where.count() == 5 and where.select("p").distinct().count() > 1
    abd = ["a", "b", "d"]
    rows = [(1, w) for w in [*abd, None, "x"]] + [(2, w) for w in abd] + [(3, "c"), (4, None)] + [(5, w) for w in [*abd, "e"]]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str)


def test_cells_meet_the_mapping_in_their_row(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, False, ["1", " ", "手套", "2"]), (1, 2, 0.5, True, ["2", "帽", "x", None]), (1, 3, 0.5, True, ["3", None, "", "4"]), (2, 1, 0.5, True, ["名", "1"]), (3, 1, 0.5, True, ["y"])], "image_id long, line_no long, confidence double, low_confidence boolean, cells array<string>")
    mapping = spark.createDataFrame([(1, 2, "name"), (1, 1, "name"), (1, 1, "name"), (1, 3, "quantity"), (1, 0, None), (1, 9, "spec"), (2, 0, "name"), (2, 0, "spec"), (2, 1, "")], "image_id long, col_idx long, field string")
    found = S.mapped_items(rows, mapping)
    # neither a row for each cell nor a shuffle of them
    assert "Generate" not in plan(found)
    assert sorted((r.image_id, r.line_no, r.name, r.quantity, r.spec) for r in found.collect()) == [(1, 1, "手套", "2", ""), (1, 2, "帽", "", ""), (2, 1, "名", "", "名")]


def test_decisions_are_read_once_and_carry_what_is_asked_for(spark):
    from millrace.plans.workbench import confirmed_selections

    work = spark.range(1, 9).selectExpr("1L as quote_id", "id as item_index", "'c' || id as code", "id % 3 = 0 as confirmed", "id % 3 <> 1 as has_selected", "case when id % 4 = 1 then 'no_match' else 'select' end as action", "timestamp'2024-01-01 00:00:00' as decided_at", "'n' as product_name", "'m' as model", "'b' as product_brand", "'s' as supplier", "1.5d as market_price", "0.5d as best_score", "true as has_image", "id % 4 as n_matches", "false as has_alternative", "'n' as name", "'m' as spec", "'u' as unit", "'' as remark")
    found = confirmed_selections(work)
    assert plan(found).count("Range (") == 2
    want = [(1, False, "no_match", None), (2, True, "select", "c2"), (3, True, "select", "c3"), (4, True, "no_match", None), (5, False, "no_match", "c5"), (6, True, "select", "c6"), (7, False, "select", None), (8, True, "no_match", None)]
    assert sorted((r.item_index, r.confirmed, r.action, r.code) for r in found.collect()) == want


def test_a_catalogue_is_not_sent_through_the_driver(spark, monkeypatch):
    from millrace.operators import matching as X

    plans, saved = {}, X.saved
    monkeypatch.setattr(X, "saved", lambda df, name: plans.update({name: plan(df)}) or saved(df, name))
    monkeypatch.setattr(overlap, "FEW", 0)
    products = spark.createDataFrame([(k, f"防护手套 n{k}", "手部", k % 2 == 0) for k in range(8)] + [(9, "red big hat", "x", False)], "catalog_idx long, name string, category string, has_image boolean")
    found = X.alternatives(spark.createDataFrame([("手套 n1",), ("big red",)], "name string"), products)
    joins = [x for p in (plans["hinted"], plan(found)) for x in p.splitlines() if "Join Inner" in x and ("catalog_idx" in x or "category" in x or "word" in x)]
    assert joins and all("strategy=merge" in x for x in joins)
    assert [(r.catalog_idx, r.reason) for r in found.where("name = 'big red'").collect()] == [(9, "关键词相似")]
