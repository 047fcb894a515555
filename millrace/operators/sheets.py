"""Quote sheets of unknown layout: reading, orientation, header, column types, items; many files in one job.

A sheet is a grid of cells (file_id, row_idx, col_idx, value), all from 0, with
a row for every cell of the grid; a null or blank value is an empty cell. All
steps group by file, so a file is never in one task's memory but row by row.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.streaming.runs import saved

# Words of header rows; words that tell how a sheet lies.
HEADER_WORDS = ["名称", "单位", "数量", "价格", "单价", "规格", "品牌", "备注", "序号", "物资", "计量", "预算", "总价", "含税", "型号", "item", "name", "qty", "技术要求", "图片", "编码"]
LAYOUT_WORDS = ["名称", "单位", "数量", "价格", "单价", "规格", "品牌", "备注", "序号", "物资", "计量", "预算", "总价", "含税", "质保", "型号", "颜色"]
# Column types in order, each with its weight and the words of its headers.
TYPES = {
    "name": (1.0, ["产品名称", "物资名称", "品名", "商品名", "名称", "货品名", "产品", "item", "product", "物资", "货物名称", "材料名称", "商品名称"]),
    "quantity": (1.0, ["数量", "需求数量", "需求量", "qty", "quantity", "count", "计划数量", "采购数量", "订货数量", "数量（", "数量("]),
    "unit": (1.0, ["单位", "计量单位", "uom", "unit", "单位名称", "计量", "基本单位", "数量单位"]),
    "price": (1.0, ["单价", "预算单价", "价格", "销售单价", "采购单价", "含税单价", "单价（元）", "单价(元)", "预算价格", "单价（", "单价(", "总价", "预算单价（元）", "金额（元）", "金额(元)", "报价单价"]),
    "spec": (0.8, ["规格", "型号", "规格型号", "spec", "型号规格", "规格（", "规格(", "参数", "技术参数", "规格/材质", "材质"]),
    "color": (1.0, ["颜色", "色号", "色彩", "color", "颜色（", "颜色("]),
    "remark": (0.7, ["备注", "说明", "要求", "技术参数", "remark", "备注说明", "技术要求", "特殊要求", "备注（", "备注("]),
    "seq": (1.0, ["序号", "no", "编号", "no.", "序 号", "序  号", "项号", "项目编号", "序号（", "序号("]),
    "brand": (1.0, ["品牌", "brand", "品牌/生产厂家", "生产厂家", "厂商", "品牌型号", "报价品牌", "品牌名称", "推荐品牌"]),
    "category": (0.6, ["类别", "分类", "category", "商品类别", "物资类别", "类型", "品类"]),
    "image": (1.0, ["图片", "照片", "image", "img", "产品图片", "产品图", "商品图片", "实物图", "报价产品图片"]),
    "ignore": (0.3, ["备注说明", "其他", "ignore", "供应商", "供货商", "厂家"]),
}
# Words that mark a row of the fixed layout as a header; what a remark contains; names that are none.
FIXED_HEADERS = ["物资", "计量单位", "预算单价", "名称", "规格", "详细报价项", "十二"]
REMARK_WORDS = ["GB", "符合", "标准"]
NO_NAMES = ["物资", "名称", "NaN", "nan"]
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(text: Column) -> Column:
    """The number that a text is, null if it is none."""
    plain = F.trim(text)
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def _any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(map(re.escape, words)))


def _value() -> Column:
    return F.trim(F.coalesce("value", F.lit("")))


def _grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = list(csv.reader(io.StringIO(content.decode("utf-8-sig"), newline="")))
            wide = max(map(len, rows), default=0)
            cells = [(r, c, row[c] if c < len(row) and row[c] != "" else None) for r, row in enumerate(rows) for c in range(wide)]
            r, c, v = zip(*cells, strict=True) if cells else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(r, pa.int64()), pa.array(c, pa.int64()), pa.array(v, pa.string())], names=["file_id", "row_idx", "col_idx", "value"])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all CSV files of a folder; file_id is a file's path. A sheet is read whole by one task: they are small, a row may have any width and cells may hold line feeds."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(_grid, "file_id string, row_idx long, col_idx long, value string")


def joined_parts(cells: DataFrame, sheet: Column) -> DataFrame:
    """Cells of sheets that lie in several files, parts that Spark wrote in order (``part-00001-*.c002.csv``): file_id is the sheet's, rows are numbered through its parts. Parts are equally wide."""
    parts = cells.groupBy("file_id").agg((F.max("row_idx") + 1).alias("n"))
    # a part's place: the task that wrote it, then its number among that task's files
    place = [F.regexp_extract("file_id", r"part-(\d+)-[^/]*$", 1).cast("long"), F.regexp_extract("file_id", r"\.?c(\d+)\.[^/]*$", 1).cast("long")]
    before = Window.partitionBy("_sheet").orderBy("_task", "_file").rowsBetween(Window.unboundedPreceding, -1)
    start = parts.select("file_id", "n", sheet.alias("_sheet"), place[0].alias("_task"), place[1].alias("_file")).withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return cells.join(saved(start, "starts"), "file_id").select(F.col("_sheet").alias("file_id"), (F.col("row_idx") + F.col("_start")).alias("row_idx"), "col_idx", "value")


def oriented(cells: DataFrame, dealt: bool = False) -> DataFrame:
    """cells, turned where the first column names fields (four words or more) and the first row does not (fewer than three).

    dealt: the cells lie by file already, as a step before left them, and need no shuffle.
    """
    # a bit for each word that a cell of the first row or column contains; a loop over the words, as long generated code is not compiled
    words = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(1 << k).alias("bit")) for k, w in enumerate(LAYOUT_WORDS)))
    said = F.when((F.col("row_idx") == 0) | (F.col("col_idx") == 0), F.aggregate(words, F.lit(0), lambda acc, w: acc + F.when(_value().contains(w["word"]), w["bit"]).otherwise(0)))
    of_file = Window.partitionBy("file_id")
    count = lambda cond: F.bit_count(F.coalesce(F.bit_or(F.when(cond, F.col("_said"))).over(of_file), F.lit(0)))
    # one shuffle by file serves all steps on sheets: grouping and joining by file after it moves no cell again
    cells = cells if dealt else cells.repartition("file_id")
    flags = cells.withColumn("_said", said).withColumns({
        "n_rows": F.max("row_idx").over(of_file) + 1, "n_cols": F.max("col_idx").over(of_file) + 1,
        "in_row": count((F.col("row_idx") == 0) & (F.col("col_idx") < 15)), "in_column": count((F.col("col_idx") == 0) & (F.col("row_idx") < 15)),
    })
    both = flags.withColumn("turn", F.expr("n_rows >= 3 and n_cols >= 3 and in_column >= 4 and in_row < 3"))
    return both.select("file_id", F.when(F.col("turn"), F.col("col_idx")).otherwise(F.col("row_idx")).alias("row_idx"), F.when(F.col("turn"), F.col("row_idx")).otherwise(F.col("col_idx")).alias("col_idx"), "value")


def row_scores(cells: DataFrame) -> DataFrame:
    """(file_id, row_idx, n_filled, score): how much each row looks like a header, from 0.1 to 0.9."""
    return _scored(cells).drop("total")


def _scored(cells: DataFrame) -> DataFrame:
    """row_scores, and total, how many columns the sheet has."""
    v = _value()
    filled, short, num = v != "", (v != "") & (F.length(v) <= 20), number(v)
    rows = cells.groupBy("file_id", "row_idx").agg(
        F.count_if(filled).alias("n_filled"), F.count_if(num.isNotNull()).alias("numbers"), F.count_if(num > 100).alias("large"),
        F.count_if(short & _any(F.lower(v), [w.lower() for w in HEADER_WORDS])).alias("words"), F.count_if(short).alias("short"),
        F.coalesce(F.min_by(v.rlike(r"^\d+(\.\d+)?$"), F.when(filled, F.col("col_idx"))), F.lit(False)).alias("first"), (F.max("col_idx") + 1).alias("wide"),
    ).withColumn("total", F.max("wide").over(Window.partitionBy("file_id")))
    c = F.col
    score = (
        F.when(c("first") & (c("n_filled") >= 4) & (c("words") == 0), 0.1)
        .when((c("numbers") >= 2) & (c("words") == 0) & (c("n_filled") > c("numbers")), 0.1).when(c("large") >= 2, 0.1)
        .when((c("words") >= 2) & (c("short") >= c("total") * 0.5), 0.9).when((c("words") >= 1) & (c("short") >= c("total") * 0.6), 0.7)
        .when((c("short") >= c("total") * 0.8) & (c("n_filled") - c("numbers") >= c("total") * 0.5), 0.6).otherwise(0.2)
    )
    return rows.select("file_id", "row_idx", "n_filled", score.alias("score"), "total")


def regions(cells: DataFrame) -> DataFrame:
    """(file_id, n_rows, n_cols, header_start, header_rows, data_start): where each sheet's header and data are.

    The header starts at the first row with three cells and goes on, up to five rows, as rows look like one; data
    start at the next row with three cells.
    """
    # rows are scored once, what is known of their file comes beside them
    of_file = Window.partitionBy("file_id")
    first = lambda cond: F.min(F.when(cond, F.col("row_idx"))).over(of_file)
    rows = _scored(cells).withColumns({"n_rows": F.max("row_idx").over(of_file) + 1, "header_start": F.coalesce(first(F.col("n_filled") >= 3), F.lit(0))})
    rows = rows.withColumn("end", F.coalesce(first((F.col("row_idx") > F.col("header_start")) & (F.col("score") < 0.6)), F.col("n_rows")))
    run = F.greatest(F.lit(1), F.least(F.col("end") - F.col("header_start"), F.lit(5)))
    last = F.when(F.col("header_start") + run >= F.col("n_rows"), F.greatest(F.col("header_start") + 1, F.col("n_rows") - 1)).otherwise(F.col("header_start") + run)
    rows = rows.withColumn("header_rows", F.greatest(F.lit(1), last - F.col("header_start")).cast("long"))
    found = F.min(F.when((F.col("row_idx") >= F.col("header_start") + F.col("header_rows")) & (F.col("n_filled") >= 3), F.col("row_idx")))
    after = rows.groupBy("file_id", "n_rows", F.col("total").alias("n_cols"), "header_start", "header_rows").agg(found.alias("found"))
    return after.select("file_id", "n_rows", "n_cols", "header_start", "header_rows", F.coalesce("found", F.col("header_start") + F.col("header_rows")).alias("data_start"))


def headers(cells: DataFrame, where: DataFrame) -> DataFrame:
    """(file_id, col_idx, header, raw_header): each column's header texts in one; raw_header names empty ones by their number."""
    return _named(cells.join(where.hint("shuffle_hash"), "file_id").groupBy("file_id", "col_idx").agg(_header()))


def _header() -> Column:
    inside = (F.col("row_idx") >= F.col("header_start")) & (F.col("row_idx") < F.col("header_start") + F.col("header_rows")) & (_value() != "")
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("row_idx", _value().alias("v"))))), lambda x: x["v"]), " ").alias("header")


def _named(out: DataFrame) -> DataFrame:
    return out.withColumn("raw_header", F.when(F.col("header") == "", F.concat(F.lit("列"), (F.col("col_idx") + 1).cast("string"))).otherwise(F.col("header")))


def _data_scores() -> dict[str, Column]:
    """What the first ten values of a column (sample, with the numbers they are and whether they are Chinese words; first: their first number; five: the first five, whole) say of its type."""
    sample, first, five = F.col("sample"), F.col("first"), F.col("five")
    total = F.size(sample)
    numeric = (total > 0) & (F.size(F.filter(sample, lambda x: x["n"].isNotNull())) / total > 0.7)
    plain = F.forall(F.slice(sample, 1, 3), lambda x: x["value"].rlike(r"^\d{1,4}$")) & F.forall(five, lambda x: x.isNotNull())
    steps = F.forall(F.transform(five, lambda x, i: x == F.get(five, 0) + i), lambda b: b)
    seq = F.when(steps & (F.get(five, 0) >= 1) & (F.element_at(five, -1) <= 100), 0.8).when(F.array_max(five) < 100, 0.4).otherwise(0.0)
    chinese = F.size(F.filter(sample, lambda x: x["chinese"])) / total > 0.5
    in_range = numeric & (first > 0) & (first < 1000)
    zero = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), x).otherwise(0.0)
    return {"price": zero(in_range & (first < 10), 0.6), "quantity": zero(in_range, 0.5), "seq": zero(numeric & plain, seq), "name": zero((total > 0) & chinese, 0.5)}


def _sample() -> Column:
    """Up to ten values below a column's header, each read as a number once."""
    inside = (F.col("row_idx") >= F.col("header_start") + F.col("header_rows")) & (F.col("row_idx") < F.col("header_start") + F.col("header_rows") + 10) & F.col("value").isNotNull()
    n = number(F.col("value"))
    return F.array_sort(F.collect_list(F.when(inside, F.struct("row_idx", "value", n.alias("n"), (n.isNull() & F.col("value").rlike("[一-龥]")).alias("chinese"))))).alias("sample")


def _with_scores(sampled: DataFrame, *keep: str) -> DataFrame:
    five = F.transform(F.slice("sample", 1, 5), lambda x: F.floor(x["n"]))
    read = sampled.select("file_id", "col_idx", *keep, "sample", F.get("sample", 0)["n"].alias("first"), five.alias("five"))
    return read.select("file_id", "col_idx", *keep, *(x.alias(t) for t, x in _data_scores().items()))


def data_patterns(cells: DataFrame, where: DataFrame) -> DataFrame:
    """(file_id, col_idx, price, quantity, seq, name): what each column's first values say of its type, whatever its header."""
    return _with_scores(cells.join(where.hint("shuffle_hash"), "file_id").groupBy("file_id", "col_idx").agg(_sample()))


def column_types(cells: DataFrame, where: DataFrame) -> DataFrame:
    """(file_id, col_idx, header, detected_type, confidence, needs_confirm): the best type of each column by its header's words and its first values."""
    low = F.lower("header")
    # headers and samples in one pass; words are looked for once a distinct header
    told = saved(_with_scores(cells.join(where.hint("shuffle_hash"), "file_id").groupBy("file_id", "col_idx").agg(_header(), _sample()), "header"), "columns")
    by_words = []
    for weight, words in TYPES.values():
        weights = F.array(*(F.struct(F.lit(w.lower()).alias("word"), F.lit(weight).alias("weight")) for w in words))
        by_words.append(F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + F.when(low == w["word"], 2.0).when(low.contains(w["word"]), w["weight"]).otherwise(0.0)))
    texts = saved(told.select("header").distinct().select("header", F.array(*by_words).alias("by_words")), "headers")
    scores = []
    for k, kind in enumerate(TYPES):
        by_data = F.col(kind) * 0.5 if kind in ("price", "quantity", "seq", "name") else F.lit(0.0)
        scores.append(F.struct((F.get("by_words", k) + by_data).alias("s"), F.lit(-k).alias("k"), F.lit(kind).alias("t")))
    best = told.join(texts, "header").withColumn("best", F.array_max(F.array(*scores)))
    s = F.col("best.s")
    return best.select("file_id", "col_idx", "header", F.when(s > 0, F.col("best.t")).otherwise("").alias("detected_type"), F.least(s / 2, F.lit(1.0)).alias("confidence"), (s < 1.0).alias("needs_confirm"))


def apply_mapping(types: DataFrame, confirmed: DataFrame) -> DataFrame:
    """types under a confirmed mapping (file_id, col_idx, field): these columns are sure."""
    both = types.join(confirmed.select("file_id", "col_idx", "field"), ["file_id", "col_idx"], "left")
    known = F.col("field").isNotNull()
    return both.select(
        "file_id", "col_idx", "header", F.coalesce("field", "detected_type").alias("detected_type"),
        F.when(known, F.greatest(F.col("confidence"), F.lit(0.99))).otherwise(F.col("confidence")).alias("confidence"), (F.col("needs_confirm") & ~known).alias("needs_confirm"),
    )


def preview(cells: DataFrame, where: DataFrame, types: DataFrame, most: int = 5) -> DataFrame:
    """(file_id, row_idx, col_idx, field, value) of the first data rows; a field's second column has its number in the field's name."""
    kind = F.when(F.col("detected_type") != "", F.col("detected_type")).otherwise(F.concat(F.lit("col_"), F.col("col_idx").cast("string")))
    # a file's columns are a few: they stand beside its cells, which move for none of them
    listed = types.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", kind.alias("kind")))).alias("all"))
    again = lambda m: F.exists("all", lambda x: (x["kind"] == m["kind"]) & (x["col_idx"] < m["col_idx"]))
    named = F.transform("all", lambda m: F.struct(m["col_idx"].alias("col_idx"), F.when(again(m), F.concat(m["kind"], F.lit("_col"), m["col_idx"].cast("string"))).otherwise(m["kind"]).alias("field")))
    told = where.select("file_id", "data_start").join(listed.select("file_id", named.alias("columns")).hint("shuffle_hash"), "file_id")
    shown = cells.join(told.hint("shuffle_hash"), "file_id").where((F.col("row_idx") >= F.col("data_start")) & (F.col("row_idx") < F.col("data_start") + most))
    field = F.get(F.filter("columns", lambda m: m["col_idx"] == F.col("col_idx")), 0)["field"]
    return shown.select("file_id", "row_idx", "col_idx", field.alias("field"), F.coalesce("value", F.lit("")).alias("value")).where(F.col("field").isNotNull())


def items(cells: DataFrame, where: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per data row with two cells and a name: for each field the first cell that is not blank, in the order of columns. mapping: file_id, col_idx, field."""
    # a file's mapping is a few columns: it stands beside the file's cells, which move for none of them
    columns = mapping.groupBy("file_id").agg(F.collect_list(F.struct("col_idx", "field")).alias("columns"))
    told = where.select("file_id", "data_start").join(columns.hint("shuffle_hash"), "file_id", "left")
    rows = cells.join(told.hint("shuffle_hash"), "file_id").where("row_idx >= data_start")
    meant = F.transform(F.filter("columns", lambda m: m["col_idx"] == F.col("col_idx")), lambda m: m["field"])
    rows = rows.select("file_id", "row_idx", "col_idx", "value", meant.alias("fields"))
    filled = _value() != ""
    pick = lambda kind: F.coalesce(F.min_by("value", F.when(filled & F.array_contains("fields", kind), F.col("col_idx"))), F.lit("")).alias(kind)
    fields = [t for t in TYPES if t not in ("image", "ignore")]
    out = rows.groupBy("file_id", "row_idx").agg(F.count_if(filled).alias("n_filled"), *map(pick, fields))
    return out.where((F.col("n_filled") >= 2) & (F.trim("name") != "")).drop("n_filled")


def fixed_items(cells: DataFrame) -> DataFrame:
    """Items of the fixed layout: number, name, unit, quantity and price in the first five columns, a remark after them.

    The remark is the right-most cell from the sixth column on that speaks of a standard or is longer than 15
    characters. Rows with a header's words and rows whose first cell is no number from 1 to 1000 are left out.
    """
    v = F.col("value")
    at = lambda k: F.max(F.when(F.col("col_idx") == k, v)).alias(f"c{k}")
    notes = v.isNotNull() & (F.col("col_idx") >= 5) & (_any(v, REMARK_WORDS) | (F.length(v) > 15))
    rows = cells.groupBy("file_id", "row_idx").agg(
        *map(at, range(5)), F.count_if(_value() != "").alias("n_filled"), F.coalesce(F.max(_any(v, FIXED_HEADERS)), F.lit(False)).alias("is_header"),
        F.coalesce(F.max_by(v, F.when(notes, F.col("col_idx"))), F.lit("")).alias("remark"),
    )
    seq = number(F.col("c0"))
    good = rows.where(~F.col("is_header") & (F.col("n_filled") >= 2) & (seq >= 1) & (seq <= 1000) & (F.coalesce("c1", F.lit("")) != "") & ~F.col("c1").isin(NO_NAMES))
    text = lambda c: F.coalesce(c, F.lit(""))
    return good.select("file_id", "row_idx", F.floor(seq).cast("int").alias("seq"), F.col("c1").alias("name"), text("c2").alias("unit"), text("c3").alias("quantity"), number(F.col("c4")).alias("budget_price"), "remark")


def typed(kind: str, value: Column) -> Column:
    """A cell's value as its field has it: quantities and prices as numbers, whole quantities and seq without decimals; text if it is no number."""
    plain = F.trim(F.coalesce(value, F.lit("")))
    if kind not in ("quantity", "price", "seq"):
        return plain
    n = number(F.regexp_replace(plain, ",", "") if kind != "seq" else plain)
    whole = F.floor(n).cast("long").cast("string") if kind != "seq" else n.cast("long").cast("string")
    as_text = whole if kind == "seq" else F.when((n == F.floor(n)) & F.lit(kind == "quantity"), whole).otherwise(n.cast("string"))
    return F.when(n.isNull(), plain).otherwise(as_text)
