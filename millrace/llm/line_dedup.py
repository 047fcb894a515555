"""Repeated runs of lines, found as content-defined chunks of lines.

A text is cut into lines at line feeds. A rolling polynomial hash over the
hashes of the last ``window`` lines says where a chunk may end: where it is 0
modulo ``divisor`` and was not so one line before, so chunks but the last of
a text have two lines or more, and the cut depends on the neighbouring lines
alone: text put in or taken out elsewhere does not shift it. Chunks of at
least two lines that occur more than once in the whole table are compared byte
by byte; all but the first occurrence (least doc_id, then text, then place)
are removed. That is :func:`drop_repeated_chunks`, whose coarse cuts leave the
ends of a passage and most short passages where they are.

:func:`drop_repeated_passages` takes finer chunks as seeds and extends them. Each
of three chunkings cuts a text after all lines but those of one of three classes,
by the line's own hash; chunks, of one line or more, that occur more than once are
seeds, and each seed is extended line by line both ways: every pair of neighbouring
lines within it and at its edges that occurred before is removed. Of two
neighbouring lines at most two classes are theirs, so in one of the chunkings the
text is cut after both, and the second is a chunk there wherever both stand: every
repeated run of two lines or more has seeds at all its lines, and is extended to
both ends, wherever it begins. A pair that overlaps its own first occurrence
(three equal lines) is no repetition; the first occurrence of every line stays.

Everything is DataFrame functions. Only digests are shuffled to find repeated
chunks; the bytes of repeated chunks alone are shuffled to be compared. A chunk
that a third of all documents hold is counted by partial aggregation, looked up
by broadcast (:func:`millrace.llm.common.lookup`), and its bytes are compared in
as many tasks as it has 512 occurrences: the first one's bytes are copied to
each.

Defined cases: a null text stays null and has no lines; an empty text has one
empty line; chunks and pairs of blank lines are left alone; rows that repeat
both doc_id and text are treated alike (they are one occurrence, so both stay);
an empty table gives no rows. Extra columns are kept, whatever their names;
n_lines and n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import lookup, save

#: The rolling hash: line hashes below 2**31, this base, and no overflow of 64 bits.
BASE = 31
#: Chunkings of which each leaves one class of lines uncut; with three, two lines are cut after in one of them.
CHUNKINGS = 3


def _chunks(docs: DataFrame, window: int, divisor: int) -> DataFrame:
    """(doc_id, doc_hash, start, n, chunk): the multi-line chunks of every text, places from 0."""
    hashes = F.transform("lines", lambda x: F.xxhash64(x).bitwiseAND(F.lit(0x7FFFFFFF)))
    rolled = F.transform(
        F.sequence(F.lit(0), F.size("hashes") - 1),
        lambda i: F.aggregate(
            F.slice("hashes", F.greatest(i - (window - 1), F.lit(0)) + 1, F.least(i + 1, F.lit(window))),
            F.lit(0).cast("long"),
            lambda acc, h: acc * BASE % 0x7FFFFFFF + h,
        ) % divisor == 0,
    )
    ends = F.filter(
        F.sequence(F.lit(0), F.size("hashes") - 1),
        lambda i: (i == F.size("hashes") - 1) | (F.get("rolled", i) & (i > 0) & ~F.coalesce(F.get("rolled", i - 1), F.lit(False))),
    )
    spans = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.size("ends") - 1),
            lambda k: F.struct((F.coalesce(F.get("ends", k - 1), F.lit(-1)) + 1).alias("start"), (F.get("ends", k) - F.coalesce(F.get("ends", k - 1), F.lit(-1))).alias("n")),
        ),
        lambda x: x["n"] > 1,
    )
    told = F.transform(
        "spans",
        lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), F.xxhash64(F.slice("hashes", x["start"] + 1, x["n"])).alias("chunk")),
    )
    return (
        docs.where("text is not null")
        .select("doc_id", F.xxhash64("text").alias("doc_hash"), F.split("text", "\n", -1).alias("lines"))
        .where("size(lines) > 1")
        .withColumn("hashes", hashes)
        .withColumn("rolled", rolled)
        .withColumn("ends", ends)
        .withColumn("spans", spans)
        .select("doc_id", "doc_hash", F.explode(told).alias("x"))
        .select("doc_id", "doc_hash", "x.*")
    )


def _seeds(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_hash, chunk, pairs): the chunks of every text by three chunkings, each place once, with the pairs (start, chunk) of neighbouring lines, not both blank, that they hold or touch."""
    hashed = lambda x, y: F.when(y.isNotNull() & F.concat(x, y).rlike(r"[^\s]"), F.xxhash64(F.concat(x, F.lit("\n"), y)))
    last = F.size("hashes") - 1
    cuts = lambda k: F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.pmod(F.get("hashes", i), F.lit(CHUNKINGS)) != k))
    spans = lambda ends: F.transform(F.col(ends), lambda e, k: F.struct((F.coalesce(F.get(ends, k - 1), F.lit(-1)) + 1).alias("start"), e.alias("end")))
    every = F.array_distinct(F.concat(*(spans(f"ends{k}") for k in range(CHUNKINGS))))
    around = lambda x: F.filter(F.transform(F.sequence(F.greatest(x["start"] - 1, F.lit(0)), x["end"]), lambda i: F.struct(i.alias("start"), F.get("keys", i).alias("chunk"))), lambda p: p["chunk"].isNotNull())
    told = F.transform("spans", lambda x: F.struct(F.xxhash64(F.slice("hashes", x["start"] + 1, x["end"] - x["start"] + 1)).alias("chunk"), around(x).alias("pairs")))
    cut = (
        docs.where("text is not null")
        .select("doc_id", F.xxhash64("text").alias("doc_hash"), F.split("text", "\n", -1).alias("lines"))
        .where("size(lines) > 1")
        .select("doc_id", "doc_hash", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), F.zip_with("lines", F.slice("lines", F.lit(2), F.size("lines")), hashed).alias("keys"))
        .select("*", *(cuts(k).alias(f"ends{k}") for k in range(CHUNKINGS)))
        .select("doc_id", "doc_hash", "hashes", "keys", every.alias("spans"))
    )
    return cut.select("doc_id", "doc_hash", F.explode(told).alias("x")).select("doc_id", "doc_hash", "x.*").where("size(pairs) > 0")


def _pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_hash, start, n, chunk): every two neighbouring lines, not both blank, that a repeated chunk holds or touches, each once."""
    seeds = save(_seeds(docs), "seeds")
    again = save(seeds.groupBy("chunk").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "again")
    found = lookup(seeds, again, "chunk", "times").select("doc_id", "doc_hash", F.explode("pairs").alias("p")).select("doc_id", "doc_hash", "p.start", F.lit(2).alias("n"), "p.chunk")
    return found.distinct()


def _repeats(rows: DataFrame, chunks: DataFrame, share: int = 512) -> DataFrame:
    """(id, of, runs): per row of rows (doc_id, doc_hash, row) with something to remove, its doc_id, the hash of its text, and (start, n)."""
    chunks = save(chunks, "chunks")
    at = F.struct("doc_id", "doc_hash", "start")
    first = chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("times"), F.min(at).alias("first")).where("times > 1")
    first = save(first.withColumn("tasks", F.ceil(F.col("times") / share).cast("int")), "repeated")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("doc_hash") == F.col("first.doc_hash"))
    is_first = same & (F.col("start") == F.col("first.start"))
    # what overlaps its own first occurrence is no repetition
    overlaps = same & (F.col("start") > F.col("first.start")) & (F.col("start") < F.col("first.start") + F.col("n"))
    alike = (
        lookup(chunks, first, "chunk", "times")
        .where(~overlaps)
        .groupBy(F.col("doc_id").alias("id"), F.col("doc_hash").alias("of"))
        .agg(F.collect_set(F.struct("start", "n", "chunk", "tasks", is_first.alias("is_first"))).alias("alike"))
    )
    body = F.array_join(F.slice("lines", F.col("x.start") + 1, F.col("x.n")), "\n")
    bodies = (
        rows.join(alike, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("doc_hash") == F.col("of")))
        # the whole row is named, so that this and _without share one shuffle of the rows
        .where(F.xxhash64("row").isNotNull())
        .select("id", "of", F.split("row.text", "\n", -1).alias("lines"), F.explode("alike").alias("x"))
        .select("id", "of", "x.*", body.alias("body"))
    )
    # the bytes decide; a chunk that only shares its hash with the first one stays
    firsts = bodies.where("is_first").groupBy("chunk").agg(F.min("body").alias("original"), F.max("tasks").alias("tasks"))
    firsts = firsts.select("chunk", "original", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    again = bodies.where("not is_first").withColumn("task", F.pmod(F.xxhash64("id", "of", "start"), F.col("tasks")).cast("int"))
    return (
        again.join(firsts, ["chunk", "task"])
        .where(r"body = original and body rlike '[^\\s]'")
        .groupBy("id", "of")
        .agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    )


def _without(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """docs with text less the lines of the repeated ones of chunks, and n_lines, n_removed beside."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), F.struct("*").alias("row"))
    found = rows.join(_repeats(rows, chunks), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("doc_hash") == F.col("of")), "left")
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["n"] - 1)))
    told = found.select("row", "runs", F.split("row.text", "\n", -1).alias("lines")).withColumn("kept", F.when(F.col("runs").isNotNull(), F.array_except(places, gone)))
    text = F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n"))
    columns = [text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    return told.select(*columns, n_lines.alias("n_lines"), F.when(F.col("runs").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).alias("n_removed"))


def drop_repeated_chunks(docs: DataFrame, window: int = 2, divisor: int = 2) -> DataFrame:
    """docs with text less its repeated chunks, and n_lines, n_removed beside."""
    return _without(docs, _chunks(docs, window, divisor))


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """docs with text less its repeated runs of two or more lines, and n_lines, n_removed beside."""
    return _without(docs, _pairs(docs))
