"""Search on behalf of request lines against a loop in catalogue order, and blocks and windows of search pages."""

import random
import re

from pyspark.sql import functions as F

from millrace.operators import catalog as C
from millrace.operators import images as I
from millrace.operators import scans as O

VIEW = "catalog_idx long, code string, name string, model string, unit string, has_image boolean, market_price double, search_text string"


def view_rows(seed, n):
    rng = random.Random(seed)
    names = ["手套", "棉手套", "glove", "Red Glove", "帽", "boots"]
    rows = []
    for k in range(n):
        code, name, model, unit = rng.choice(["", "A1", "A2", f"c{k}", f"c{k}", f"c{k}"]), rng.choice(names), rng.choice(["M1", "M12", ""]), rng.choice(["双", "个", ""])
        rows.append((k, code, name, model, unit, rng.random() < 0.4, rng.choice([None, 1.0, 2.5, 9.0]), " ".join([code, name, model, unit, rng.choice(["cotton", "leather"])]).lower()))
    return rows


def by_loop(rows, terms, unit, most):
    seen, found = set(), []
    for k, code, name, model, own, image, price, text in rows:
        score = 0
        for term in terms:
            t = term.lower()
            score += 120 if name.lower() == t else 70 if t in name.lower() else 0
            score += 40 * (t in model.lower()) + 80 * (t in code.lower()) + 15 * (t in text)
        score += 10 if unit and unit == own else 0
        if score > 0 and code not in seen:
            seen.add(code)
            found.append((-score, not image, -(price if price is not None else -1), k))
    return [(k, -s) for s, _, _, k in sorted(found)[:most]]


def test_search_equals_a_loop_with_repeated_codes(spark):
    asks = [("a", ["手套", "M1"], "双"), ("b", ["glove"], ""), ("c", ["nothing"], "个"), ("d", [], "双"), ("e", ["A1", "cotton", "glove"], "个"), ("f", ["nothing"], "none"), ("g", ["M12"], "双"), ("h", ["glove", "", "glove"], "")]
    asked = spark.createDataFrame(asks, "ask_id string, terms array<string>, unit string")
    for seed, n in ((1, 12), (2, 90), (3, 300)):
        rows = view_rows(seed, n)
        got = {}
        for r in C.search_for_lines(spark.createDataFrame(rows, VIEW), asked, most=7).collect():
            got.setdefault(r.ask_id, {})[r["rank"]] = (r.catalog_idx, r.score)
        for name, terms, unit in asks:
            want = by_loop(rows, set(terms) - {""}, unit, 7)
            assert [got.get(name, {}).get(k + 1) for k in range(len(got.get(name, {})))] == want, (seed, name)


def test_terms_of_a_line(spark):
    rows = [(" 防护  手套 ", "L", "x"), ("", "GB 2626/2019", "r"), ("", " ", " 备注 "), ("", "", ""), (None, None, None), ("棉手套", "棉手套", "")]
    found = spark.createDataFrame(rows, "n string, s string, r string").select(C.search_terms(F.col("n"), F.col("s"), F.col("r")).alias("t")).collect()
    assert [r.t for r in found] == [["防护 手套", "手套", "l", "L"], ["GB 2626/2019", "GB2626-2019"], ["备注"], [], [], ["棉手套", "布手套"]]
    given = spark.createDataFrame([("手套",)], "n string").select(C.search_terms(F.col("n"), F.lit(""), F.lit(""), F.lit("key")).alias("t")).first().t
    assert given == ["key", "手套"]


def test_blocks_end_where_another_mark_stands(spark):
    block = re.compile(r'(?is)<div class="product_item".*?(?=<div class="product_item"|<div class="page_search_tool_area"|<script type="text/javascript">)')
    rng = random.Random(4)
    bits = ['<div class="product_item"', '<DIV class="Product_Item" id=1>', '<div class="page_search_tool_area"', '<script type="text/javascript">', "text", "\n", "<b>x</b>"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 12))) for _ in range(200)] + ["", None]
    frame = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "key int, html string")
    got = {}
    for r in I.blocks(frame).collect():
        got.setdefault(r.key, {})[r.block_no] = r.block
    assert [[got.get(k, {})[n] for n in range(len(got.get(k, {})))] for k in range(len(pages))] == [block.findall(p or "") for p in pages]


def test_a_page_without_blocks_is_read_around_the_first_needle_found(spark):
    page = "a" * 5000 + "MODEL9" + "b" * 9000 + "名称" + '<img src="/ProductImg/1.jpg">productinfo_12' + "c" * 100
    frame = spark.createDataFrame([("k", page)], "key string, html string")
    asked = spark.createDataFrame([(1, "k", "CODE", "名称", "MODEL9"), (2, "k", "CODE", "none", "MODEL9"), (3, "k", "CODE", "", ""), (4, "k", None, " MODEL9 ", None)], "catalog_idx int, key string, code string, name string, model string")
    got = {r.catalog_idx: (r.block_no, r.score, r.image, r.product_id) for r in I.resolve(asked, frame).collect()}
    assert got == {1: (-1, 0, "/ProductImg/1.jpg", "12"), 2: (-1, 0, "", ""), 4: (-1, 0, "", "")}
    around = frame.select(I.window(F.col("html"), F.lit("none"), F.lit("MODEL9")).alias("w")).first().w
    at = page.find("MODEL9")
    assert around == page[max(0, at - 4000) : at + 8000]


def test_scanned_rows_under_a_mapping_take_the_first_filled_column(spark):
    rows = spark.createDataFrame([("p", 1, 0.9, False, ["1", " ", "棉手套", "12.0", None]), ("p", 2, 0.5, True, ["2", "", "", "3", "双"]), ("q", 1, 0.8, False, ["x"])], "image_id string, line_no int, confidence double, low_confidence boolean, cells array<string>")
    mapping = spark.createDataFrame([("p", 0, "seq"), ("p", 1, "name"), ("p", 2, "name"), ("p", 3, "quantity"), ("p", 4, "unit"), ("p", 9, "spec"), ("q", 0, "")], "image_id string, col_idx int, field string")
    got = [r.asDict() for r in O.mapped_items(rows, mapping).collect()]
    assert len(got) == 1
    assert {k: got[0][k] for k in ("image_id", "line_no", "seq", "name", "quantity", "unit", "spec", "normalized_name", "low_confidence")} == {"image_id": "p", "line_no": 1, "seq": "1", "name": "棉手套", "quantity": "12", "unit": "", "spec": "", "normalized_name": "布手套", "low_confidence": False}
