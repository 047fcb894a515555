"""Matching again only what has changed gives what matching everything gives; few projections lose few vectors."""

import random

import numpy as np
import pytest

from millrace.operators import matching as X
from millrace.operators import near_vectors as N
from millrace.operators import rematching as Z
from millrace.streaming.runs import saved

WORDS = ["手套", "防护", "glove", "safety", "帽", "boots", "red", "blue", "3M", "N95"]


def test_a_rerun_matches_changed_requests_alone(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.sample(WORDS, n))
    products = spark.createDataFrame([(k, text(3), f"M{k % 5}", rng.choice(["3M", ""])) for k in range(80)], "catalog_idx long, name string, model string, brand string")
    lines = [(q, i, text(2), f"M{i % 7}", "") for q in range(6) for i in range(5)] + [(9, 1, "zz", "", ""), (9, 2, "", "", "")]
    schema = "quote_id long, item_index int, name string, spec string, brand string"
    one = spark.createDataFrame(lines, schema)
    two = spark.createDataFrame([(q, i, n, s + "x" if q == 2 else s, b) for q, i, n, s, b in lines if q != 4] + [(7, 1, "safety glove", None, None)], schema)
    prepared = Z.Prepared(products)
    none = one.selectExpr("'' as digest").limit(0)
    first, asked, new = Z.rematch(None, none, one, prepared, most=5)
    assert new.count() == one.where("name <> ''").select("name", "spec", "brand").distinct().count()
    kept = saved(first, "kept")
    now, _, changed = Z.rematch(kept, asked, two, prepared, most=5)
    was = {(r.name, r.spec) for r in one.collect()}
    assert {(r.name, r.spec) for r in changed.collect()} == {(r.name, r.spec or "") for r in two.where("name <> ''").collect()} - was
    columns = ["name", "spec", "brand", "rank", "catalog_idx", "score"]
    assert sorted(map(tuple, now.select(*columns).collect())) == sorted(map(tuple, X.match(two, products, most=5).select(*columns).collect()))
    rows = Z.for_lines(two, now, prepared.version).where("rank = 1 or rank is null").collect()
    assert len(rows) == two.count() and {r.catalog_idx for r in rows if r.quote_id == 9} == {None}
    # another catalogue matches everything anew
    other = Z.Prepared(products.where("catalog_idx <> 3"))
    assert other.version != prepared.version
    _, _, again = Z.rematch(kept, asked, two, other, most=5)
    assert again.count() == two.where("name <> ''").selectExpr("name", "coalesce(spec, '')", "coalesce(brand, '')").distinct().count()
    assert Z.catalog_version(products.repartition(3, "name")) == prepared.version


@pytest.mark.parametrize("n", [300, 2000, 6000])
def test_recall_of_projections_at_three_sizes(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 32)) + 1.5 * rng.normal(size=(25, 32))[rng.integers(0, 25, n)]
    rows = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(n, None), (n + 1, [0.0] * 32), (n + 2, [float("nan")] * 32)], "vec_id long, embedding array<double>")
    queries = rows.where("vec_id % 50 = 0")
    got = {}
    for r in N.search(queries, rows, part_rows=500).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = total = 0
    for q in range(0, n, 50):
        score = u @ u[q]
        score[q] = -2
        best = [k for k in np.argsort(-score, kind="stable")[:20] if score[k] >= 0.3]
        total += len(best)
        hits += len(set(best) & set(got.get(q, {})))
        assert all(abs(score[k] - s) < 1e-9 and s >= 0.3 for k, s in got.get(q, {}).items()) and len(got.get(q, {})) <= 20
    assert hits / total >= 0.9
    assert N.search(queries.limit(0), rows).count() == 0 and N.search(queries, rows.limit(0)).count() == 0


def test_a_bucket_of_copies_is_split(spark):
    rows = spark.createDataFrame([(k, [1.0, 2.0, 3.0] if k % 3 else [3.0, -1.0, 0.5]) for k in range(900)], "vec_id long, embedding array<float>")
    found = N.search(rows.where("vec_id = 100"), rows, most=30, part_rows=50).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == [k for k in range(900) if k % 3 and k != 100][:30]
