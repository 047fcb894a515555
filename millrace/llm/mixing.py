"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents are put into one shuffled stream of words and cut
into blocks of equally many words. A schedule of slots is made from the
golden-ratio sequence: the point of slot i falls into one source's share of
the cumulative slot weights, slots are ranked per source, and the r-th slot of
a source takes its r-th block, from the start again after the last one and
three times at most. A document is taken as often as its words' blocks are.

Targets: sources in code-point order, null last, weigh 1, 2, 3, 1, ... and
share the words of all documents; a target stops at three times its source's
words and the excess goes to the others by weight until none is above.

Everything is DataFrame functions. Running sums over a source are made in two
levels (buckets of the shuffle key, then rows of one bucket; runs of slots,
then slots of one run), so that a source that holds a third of all rows is
never sorted in one task.

Defined cases: null or blank text has size 0 and is never taken; null doc_id
and repeated rows are rows of their own (a row without an id is placed by its
text); an empty table, or one without words, has all targets and takes 0. Extra
columns, whatever their names, are kept by :func:`apply_mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import save, word_count

#: Words of a block at most; slots of a source as far as its target allows.
BLOCK, SLOTS = 4096, 1024
#: Times a source's words can be taken.
REPEATS = 3
GOLDEN = 0.6180339887498949
#: Hexadecimal digits of the shuffle key that name a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3


def targets(sizes: DataFrame) -> DataFrame:
    """(src_no, source, source_size, target) from (source, source_size): one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("src_no", F.row_number().over(by_name)).withColumn("weight", (F.col("src_no") - 1) % 3 + 1)
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "src_no")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    # sources in the order in which their targets stop: a source is stopped if its share of what is left exceeds its limit
    level = (total - REPEATS * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    shared = numbered.withColumn("level", level).withColumn("stopped", F.col("level") * F.col("weight") >= REPEATS * F.col("source_size"))
    free = F.min(F.when(~F.col("stopped"), F.struct(F.col("source_size") / F.col("weight"), "src_no", "level"))).over(Window.partitionBy())["level"]
    return shared.withColumn("target", F.when(F.col("stopped"), (REPEATS * F.col("source_size")).cast("double")).otherwise(free * F.col("weight"))).select("src_no", "source", "source_size", "target")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) of every row."""
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))).alias("key"))
    sized = save(sized.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)), "sized")
    bucketed = save(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    plan = (
        targets(bucketed.groupBy("source").agg(F.sum("words").alias("source_size")))
        .withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.col("target") / SLOTS))).cast("long"))
        .withColumn("slots", F.ceil(F.col("target") / F.col("block")).cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
        .withColumn("hi", F.coalesce(F.sum("slots").over(Window.orderBy("src_no")), F.lit(0)))
        .withColumn("lo", F.col("hi") - F.col("slots"))
    )
    plan = save(plan, "plan")
    n = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]

    # slots: the source of slot i is that whose share [lo, hi) holds the i-th point
    cell = max(1, n // 4096)
    run = max(4096, int(n**0.5))
    shares = plan.where("slots > 0").select("src_no", "lo", "hi", "blocks", F.explode(F.expr(f"sequence(lo div {cell}, (hi - 1) div {cell})")).alias("cell"))
    point = (F.col("id") + 0.5) * GOLDEN
    slots = spark.range(n).select(F.col("id").alias("slot"), F.least(F.floor((point - F.floor(point)) * n), F.lit(n - 1)).alias("at")).withColumn("cell", F.expr(f"at div {cell}"))
    taken_by = slots.join(shares, "cell").where("at >= lo and at < hi").select("slot", "src_no", "blocks", F.expr(f"slot div {run}").alias("run"))
    taken_by = save(taken_by, "slots")
    runs = taken_by.groupBy("src_no", "run").agg(F.count(F.lit(1)).alias("n"))
    earlier = runs.select(F.col("src_no"), F.col("run"), (F.sum("n").over(Window.partitionBy("src_no").orderBy("run")) - F.col("n")).alias("earlier"))
    ranked = taken_by.join(earlier, ["src_no", "run"]).withColumn("rank", F.col("earlier") + F.row_number().over(Window.partitionBy("src_no", "run").orderBy("slot")) - 1)
    uses = ranked.where(f"rank < {REPEATS} * blocks").groupBy("src_no", F.expr("rank % blocks").alias("block_no")).agg(F.count(F.lit(1)).alias("uses"))

    # the shuffled stream of a source: [start, start + size) is a document's place
    ahead = bucketed.join(plan.select("source", "src_no", "source_size", "target", "block").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "src_no", "source_size", "target", "block", F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), (F.sum("words").over(Window.partitionBy("src_no").orderBy("bucket")) - F.col("words")).alias("ahead")
    )
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        sized.withColumn("upto", F.sum("size").over(within))
        .join(ahead, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
        .select("doc_id", "source", "size", "src_no", "source_size", "target", "block", (F.col("ahead") + F.col("upto") - F.col("size")).alias("start"))
    )
    parts = placed.where("size > 0").withColumn("block_no", F.explode(F.expr("sequence(start div block, (start + size - 1) div block)")))
    words = F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * F.col("block")) - F.greatest("start", F.col("block_no") * F.col("block"))
    cols = ["doc_id", "size", "source", "source_size", "target"]
    some = parts.join(uses, ["src_no", "block_no"], "left").groupBy("src_no", "start", *cols).agg(F.sum(words * F.coalesce("uses", F.lit(0))).alias("taken")).select(*cols, "taken")
    return some.unionByName(placed.where("size = 0").select(*cols, F.lit(0).cast("long").alias("taken")))


def apply_mix(docs: DataFrame) -> DataFrame:
    """docs with every row repeated as often as the mix takes it, to the nearest whole number of times."""
    names = docs.columns
    times = mix(docs).where("size > 0").groupBy("doc_id", "size", "source").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows")).select(
        F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("source").alias("_source"), F.expr("cast(round(taken / (_size * rows)) as int)").alias("_times")
    ).where("_times > 0")
    return (
        docs.select("doc_id", "source", word_count(F.col("text")).alias("_words"), F.struct(*names).alias("_row"))
        .join(times, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size")))
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy"))
        .select("_row.*")
    )


#: DuckDB SQL for mix() over the view documents, without source.
ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, md5(text), '')) AS k FROM documents),
src AS (
  SELECT *, (src_no - 1) % 3 + 1 AS weight FROM (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS src_no FROM sized GROUP BY source)),
lev AS (
  SELECT *, (sum(source_size) OVER () - {REPEATS} * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, src_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size / weight, src_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM src),
tgt AS (
  SELECT src_no, source, source_size, CASE WHEN level * weight >= {REPEATS} * source_size THEN ({REPEATS} * source_size)::DOUBLE
    ELSE (SELECT arg_min(level, (source_size / weight, src_no)) FROM lev WHERE level * weight < {REPEATS} * source_size) * weight END AS target FROM lev),
blk AS (SELECT *, greatest(1, least({BLOCK}, floor(target / {SLOTS})))::BIGINT AS block FROM tgt),
cnt AS (SELECT *, ceil(target / block)::BIGINT AS slots, ceil(source_size / block)::BIGINT AS blocks FROM blk),
plan AS (SELECT *, sum(slots) OVER (ORDER BY src_no)::BIGINT AS hi, sum(slots) OVER (ORDER BY src_no)::BIGINT - slots AS lo, sum(slots) OVER ()::BIGINT AS n FROM cnt),
pts AS (SELECT i, (i + 0.5::DOUBLE) * {GOLDEN}::DOUBLE AS x, n FROM (SELECT DISTINCT n FROM plan), range((SELECT max(n) FROM plan)) AS r(i)),
slot AS (SELECT i, least(floor((x - floor(x)) * n)::BIGINT, n - 1) AS pos FROM pts),
hit AS (SELECT src_no, blocks, row_number() OVER (PARTITION BY src_no ORDER BY i) - 1 AS rnk FROM slot JOIN plan ON pos >= lo AND pos < hi),
uses AS (SELECT src_no, rnk % blocks AS block_no, count(*) AS uses FROM hit WHERE rnk < {REPEATS} * blocks GROUP BY 1, 2),
placed AS (
  SELECT s.doc_id, s.size, p.src_no, p.source_size, p.target, p.block,
    sum(s.size) OVER (PARTITION BY p.src_no ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - s.size AS start
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
parts AS (SELECT *, unnest(range(start // block, (start + size - 1) // block + 1)) AS block_no FROM placed WHERE size > 0),
got AS (
  SELECT p.src_no, p.start, sum((least(p.start + size, (p.block_no + 1) * block) - greatest(p.start, p.block_no * block)) * coalesce(uses, 0))::BIGINT AS taken
  FROM parts p LEFT JOIN uses u ON p.src_no = u.src_no AND p.block_no = u.block_no GROUP BY 1, 2)
SELECT p.doc_id, p.size, p.source_size, p.target, CASE WHEN p.size > 0 THEN g.taken ELSE 0 END AS taken
FROM placed p LEFT JOIN got g ON p.src_no = g.src_no AND p.start = g.start AND p.size > 0
"""
