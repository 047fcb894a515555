"""SimHash dedup keeps exactly one row of each group, whatever the ids are."""

from millrace.llm import simhash

DOCS = "doc_id long, text string, source string"


def test_rows_without_ids_or_with_shared_ids_stay_one_per_group(spark):
    a, b, c, d = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue black white", "north east south west up down")
    rows = [(None, a, "s"), (None, b, "s"), (None, a, "t"), (3, c, "s"), (3, d, "s"), (1, d, "s"), (None, c, "s")]
    docs = spark.createDataFrame(rows, DOCS)
    kept = sorted((str(r.doc_id), r.text) for r in simhash.deduplicate(docs).collect())
    assert kept == sorted([("None", a), ("None", b), ("3", c), ("1", d)])
