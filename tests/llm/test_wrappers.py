"""Every registered query of the subpackage: its contract's columns, one row for each row that it answers for, and its SQL twin."""

import zlib

import duckdb
import pytest

from millrace.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_permutation_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op3_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op4_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_pq_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op7_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8_html_extract": "page_id bigint, url string, text string, n_chars bigint",
}
#: Queries with a row for each row of a table.
ROWS = {"op1_toxicity": ("documents", "doc_id"), "op4_langid": ("documents", "doc_id"), "op5_simhash": ("documents", "doc_id"), "op6_pq_dedup": ("embeddings", "vec_id"), "op7_mixing": ("documents", "doc_id"), "op8_html_extract": ("pages", "page_id")}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    found = QUERIES[name](spark, SF)
    assert COLUMNS[name].split(", ") == [f"{f.name} {f.dataType.simpleString()}" for f in found.schema][: COLUMNS[name].count(",") + 1]
    rows = found.collect()
    if name in ROWS:
        table, key = ROWS[name]
        assert sorted(r[key] for r in rows) == sorted(r[key] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    if name == "op1_toxicity":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    if name == "op4_langid":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    if name == "op5_simhash":
        assert all(len(r.fingerprint) == 16 and int(r.fingerprint, 16) >= 0 and r.fingerprint == r.fingerprint.lower() and r.component_id <= r.doc_id for r in rows)
    if name == "op8_html_extract":
        assert all(r.n_chars == len(r.text) and r.text == " ".join(r.text.split()) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_its_twins_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS FROM '{SF}/{table}.parquet'")
    found, twin = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    names = [d[0] for d in twin.description]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    assert sorted(found.columns) == sorted(names)
    ours = sorted(str([plain(r[c]) for c in names]) for r in found.collect())
    assert ours == sorted(str([plain(v) for v in r]) for r in twin.fetchall())
