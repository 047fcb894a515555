"""SimHash near-duplicate groups found through deletion-variant signatures.

A fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of a
document's word shingles. Two fingerprints that differ in at most two bits
agree, up to one bit, on one of their two 32-bit halves. So every half is
indexed under its 32 one-wildcard variants, variants are matched by equality,
and pairs are verified on all 64 bits.

Work is done on distinct fingerprints only. A variant shared by more than
``hot`` different fingerprints is not joined with itself: its members are
dealt again under wildcard variants of the other half, under which at most
four different fingerprints can meet, so no group of copies, however large,
makes pairs of all its members.

Defined cases: null or blank text has fingerprint zero and is linked like any
other; fewer words than a shingle count as one shingle; repeated rows share a
fingerprint and so a component; an empty table gives no rows; a null doc_id
keeps a null doc_id and joins the component of its fingerprint (component_id
is null only if all its members' ids are null). Extra columns are ignored by
:func:`near_duplicates` and kept by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shingle_groups
from millrace.llm.common import components, keep_first, lookup, release, save

#: Shingles unpacked at once, which bounds memory on very long texts.
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The signed 64-bit fingerprint of one text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    width = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    columns = [tokens[k : len(tokens) - width + 1 + k] for k in range(width)]
    hashes = np.fromiter((digest(b" ".join(s), 42) for s in zip(*columns, strict=True)), np.uint64, len(columns[0]))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        octets = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(x, words) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda it: _fingerprints(it, words), f"doc_id {kind}, fp long")


def _halves(fps: DataFrame) -> DataFrame:
    """Every half h of a fingerprint with the other half o: (fp, s, h, o)."""
    low = F.lit(0xFFFFFFFF)
    hi, lo = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(low)
    return fps.select("fp", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("s"), hi.alias("h"), lo.alias("o")), F.struct(F.lit(1).cast("long").alias("s"), lo.alias("h"), hi.alias("o")))).alias("x")).select("fp", "x.*")


def _mask(bit):
    """All 32 bits but one."""
    return F.lit(0xFFFFFFFF).bitwiseXOR(F.expr(f"shiftleft(1L, cast({bit} as int))"))


def links(fps: DataFrame, hot: int = 256) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within two bits of each other."""
    # a fingerprint becomes 64 rows: dealt out before that, however few tasks its bytes would make
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = _halves(fps.repartition(parts, "fp")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(31)))).withColumn(
        # bit 38: which half; bits 32 to 37: the wildcard's place; below: the half without it
        "key", F.expr("shiftleft(s, 38) + shiftleft(cast(p as long), 32)") + F.col("h").bitwiseAND(_mask("p"))
    )
    shared = save(variants.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "variants")
    twos = shared.where("n = 2").select("a", "b").where("bit_count(a ^ b) <= 2")
    # dealt by key at every size: the shared keys are too many to be sent to every task
    crowded = save(variants.select("key", "fp", "h", "o", "p").hint("merge").join(shared.where("n > 2").select("key", "n"), "key"), "crowded")
    several = crowded.where(f"n <= {hot}")
    cold = (
        several.select("key", F.col("fp").alias("a"))
        .join(several.select("key", F.col("fp").alias("b")), "key")
        .where("a < b and bit_count(a ^ b) <= 2")
        .select("a", "b")
    )
    # every row becomes 528: dealt out before that, however few tasks its bytes would make
    crowd = crowded.where(f"n > {hot}").repartition(parts, "fp", "key")
    # the halves differ at p: the other halves differ in one bit at most
    one = crowd.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(31)))).select("fp", "key", F.lit(-1).cast("long").alias("h"), "q", F.lit(-1).alias("r"), F.col("o").bitwiseAND(_mask("q")).alias("rest"))
    # the halves are equal: the other halves differ in two bits at most; one variant has all such pairs
    two = (
        crowd.where("p = 0")
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(30))))
        .withColumn("r", F.explode(F.sequence(F.col("q") + 1, F.lit(31))))
        .select("fp", "key", "h", "q", "r", F.col("o").bitwiseAND(_mask("q")).bitwiseAND(_mask("r")).alias("rest"))
    )
    met = one.union(two).groupBy("key", "h", "q", "r", "rest").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where("size(all) > 1")
    return twos.union(cold).union(met.select("a", F.explode("all").alias("b")).where("a <> b"))


def near_duplicates(docs: DataFrame, words: int = 3, hot: int = 256) -> DataFrame:
    """(doc_id, fp, component_id) of every row; components link fingerprints within two bits."""
    prints = save(fingerprints(docs, words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    joined = components(links(distinct.select("fp"), hot))
    classes = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = save(classes.join(firsts, "component").select("fp", "rows", "component_id"), "named")
    return lookup(prints, named, "fp", "rows").select("doc_id", "fp", "component_id")


def likely(docs: DataFrame, words: int, hot: int = 256) -> DataFrame:
    """Pairs (a, b) of different texts, by :func:`shingle_groups.node`, that connect all with fingerprints within two bits."""
    texts = shingle_groups.once(docs).select(F.col("node").alias("doc_id"), "text")
    prints = save(fingerprints(texts, words), "fingerprints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    same = lookup(prints, first, "fp", "rows").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    close = links(first.select("fp"), hot)
    close = close.join(first.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    found = save(same.union(close.select("x", "y")).where("a <> b"), "likely")
    release(docs.sparkSession)
    return found


def deduplicate(docs: DataFrame, words: int = 5, least: float = 0.8, hot: int = 256) -> DataFrame:
    """One row of docs of each group: that with the least doc_id (nulls last), then the least text hash.

    Groups are of texts linked by a Jaccard similarity of ``least`` or more on
    their word shingles. Texts whose fingerprints are within two bits are
    verified on their shingles and joined first; fingerprints of texts that
    similar may be more bits apart, so the links that those leave out are added
    by :func:`shingle_groups.links`, which loses none.
    """
    named = shingle_groups.groups(docs, words, least, likely=likely(docs, words, hot)).select(F.col("node").alias("hash"), "component")
    release(docs.sparkSession)
    return keep_first(docs, shingle_groups.node(), named)
