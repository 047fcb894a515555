"""Views that Spark reads in one pass, and the pages and sheets made of them, which lie by quote already."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import scans as S
from millrace.plans import bindings as B
from millrace.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(B.IN_ONE_PASS))
def test_a_view_in_one_pass_has_the_views_rows(spark, name):
    found = B.bind(spark, SF, name)
    want = spark.sql(B.VIEWS[name], **{n: B.bind(spark, SF, n) for n in B._needs(B.VIEWS[name])})
    assert found.dtypes == want.dtypes and found.count() == want.count()
    assert found.exceptAll(want).count() == want.exceptAll(found).count() == 0


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange hashpartitioning"), text.count("Sort [")


@pytest.mark.parametrize("name,most", [("scan_lines", (2, 3)), ("scan_items", (2, 4)), ("scan_column_confidence", (2, 4)), ("scan_results", (2, 4))])
def test_boxes_are_shuffled_once_beside_their_lines(spark, name, most):
    found = exchanges(QUERIES[name](spark, SF))
    assert found[0] <= most[0] and found[1] <= most[1]


def page(n_lines):
    rows = []
    for i in range(1, n_lines + 1):
        for c, (text, x1, x2) in enumerate([(str(i), 10, 50), (f"n{i}", 100, 180), (f"s{i}", 300, 400), ("红", 520, 560), ("个", 590, 620), (str(i * 2), 660, 700)]):
            rows.append((1, i * 10 + c, text, 0.9, [[x1, i * 100], [x2, i * 100], [x2, i * 100 + 20], [x1, i * 100 + 20]]))
        rows.append((1, i * 10 + 7, "备注说明", 0.9, [[900, i * 100], [1000, i * 100], [1000, i * 100 + 20], [900, i * 100 + 20]]))
    return rows


def lines_of(spark, n_lines):
    frame = spark.createDataFrame(page(n_lines), "image_id long, box_no long, text string, confidence double, position array<array<int>>")
    return S.logical_rows(S.boxes(frame), *S.ZONED)


def test_all_lines_of_a_page_are_items(spark):
    items = S.zone_items(lines_of(spark, 63))
    assert [(r.line_no, r.seq, r.name, r.spec, r.color, r.unit, r.quantity) for r in items.orderBy("line_no").collect()] == [(i, i, f"n{i}", f"s{i}", "红", "个", 2.0 * i) for i in range(1, 64)]
    assert [(r.n_items, r.header_signature) for r in S.parse_results(items).collect()] == [(63, "序号|产品名称|规格型号|颜色|单位|数量")]


def test_fields_shown_are_those_of_the_columns_confidence(spark):
    rows = [(1, 1, None, "", "s", None, " ", 2.0, 0.9), (1, 2, 3, "n", "", "", "", None, None), (2, 1, 1, "n", "", None, "个", 1.0, None)]
    items = spark.createDataFrame(rows, "image_id long, line_no long, seq int, name string, spec string, color string, unit string, quantity double, confidence double")
    kept = {r.image_id: r.h for r in S.column_confidence(items).groupBy("image_id").agg(F.collect_set("header").alias("h")).collect()}
    assert {r.image_id: sorted(r.header_signature.split("|")) for r in S.parse_results(items).collect()} == {k: sorted(h) for k, h in kept.items()}


@pytest.mark.parametrize("name,most", [("sheet_regions", 1), ("sheet_headers", 2), ("sheet_items", 3), ("sheet_preview", 3)])
def test_cells_of_quote_sheets_move_with_their_lines_only(spark, name, most):
    found = QUERIES[name](spark, SF)
    text = found._jdf.queryExecution().executedPlan().toString()
    # that of the lines, once a reading of the cells, and that of the columns' types
    assert exchanges(found)[0] <= most and "REPARTITION" not in text and "SortMergeJoin" not in text


def test_a_previews_second_column_of_a_field_has_its_number(spark):
    from millrace.operators import sheets

    cells = spark.createDataFrame([(1, r, c, v) for r, row in enumerate([["h", "h", "h", "h"], ["a", None, "c", "d"]]) for c, v in enumerate(row)], "file_id long, row_idx long, col_idx long, value string")
    where = spark.createDataFrame([(1, 1)], "file_id long, data_start long")
    types = spark.createDataFrame([(1, 0, "name"), (1, 1, "name"), (1, 2, "")], "file_id long, col_idx long, detected_type string")
    assert sorted((r.col_idx, r.field, r.value) for r in sheets.preview(cells, where, types).collect()) == [(0, "name", "a"), (1, "name_col1", ""), (2, "col_2", "c")]
