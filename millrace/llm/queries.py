"""The registered queries of this subpackage: thin wrappers around its operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from millrace.llm import alignment, dual_tree, html_extract, langid, lexical_packing, license_scan, line_dedup, mixing, packing, permutation_ann, pq_dedup, simhash, toxicity
from millrace.llm.common import table


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op2_permutation_ann(spark, sf_dir):
    return permutation_ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op3_packing(spark, sf_dir, tokenizer=None):
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return packing.pack(cut)


def op4_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))).select("lang", "text"))
    held = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return langid.identify(held, profiles).select("doc_id", "held_out", "lang_pred", "score")


def op5_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_pq_dedup(spark, sf_dir):
    return pq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_html_extract(spark, sf_dir):
    return html_extract.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_line_dedup(spark, sf_dir):
    return line_dedup.drop_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_lexical_packing(spark, sf_dir):
    return lexical_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op12_dual_tree_lloyd(spark, sf_dir):
    return dual_tree.compress(table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark, sf_dir):
    found = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), with_groups=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_permutation_ann, op3_packing, op4_langid, op5_simhash, op6_pq_dedup, op7_mixing, op8_html_extract, op9_line_dedup, op10_license_scan, op11_lexical_packing, op12_dual_tree_lloyd, op13_token_alignment)}
ORACLES = {"op7_mixing": mixing.ORACLE_SQL, "op10_license_scan": license_scan.oracle_sql(), "op12_dual_tree_lloyd": dual_tree.oracle_sql()}
