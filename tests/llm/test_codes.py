"""Vector codes of the dual-tree rounds against plain loops in integers of any size."""

import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np

from millrace.llm import dual_tree, queries

SCHEMA = "vec_id long, embedding array<double>, label int, n long, row string"


def plain(rows, parts, entries, rounds):
    whole = [r for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[math.floor(256 * Fraction(v)) for v in r[1]] for r in whole]
    cut = [c + [0] * (-len(c) % parts) for c in cut]
    width = len(cut[0]) // parts
    part = [[c[p * width : (p + 1) * width] for p in range(parts)] for c in cut]
    books = [[list(part[k][p]) for k in range(min(entries, len(cut)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda a, book: min(range(len(book)), key=lambda e: (far(a, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            got = [near(x[p], books[p]) for x in part]
            for e in range(len(books[p])):
                own = [part[k][p] for k, g in enumerate(got) if g == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for r, x in zip(whole, part, strict=True):
        code = [near(x[p], books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{c:02x}" for c in code), sum(far(x[p], books[p][c]) for p, c in enumerate(code)), r[2]))
    sums = {}
    for _, _, error, label in out:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    most = 2**63 - 1
    return sorted((str(i), c, min(e, most), min(sums[label], most), digest) for i, c, e, label in out)


def got(spark, rows, parts=4, entries=6, rounds=2):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in dual_tree.compress(frame, parts, entries, rounds).collect())


def test_codes_equal_loops_with_ties_repeats_and_rows_that_drop_out(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(v) for v in np.round(rng.normal(size=8), 1)], None if k % 5 == 0 else k % 3) for k in range(300)]
    rows += [(k, rows[0][1], 1) for k in range(300, 340)] + [(7, rows[9][1], 2), (None, rows[3][1], 0), (1000, [0.0] * 8, None)]
    bad = [(2, None, 0), (3, [], 0), (4, [float("nan")] * 8, 0), (5, [float("inf")] + [0.0] * 7, 0), (6, [None] + [0.0] * 7, 0)]
    assert got(spark, rows + bad) == plain(rows, 4, 6, 2)
    # other lengths than most rows have are dropped
    assert got(spark, rows + [(8, [1.0] * 9, 0)]) == plain(rows, 4, 6, 2)


def test_components_of_any_size_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(v) for v in rng.normal(size=6) * 10.0 ** rng.integers(-3, 200)], k % 2) for k in range(60)]
    assert got(spark, rows, parts=4, entries=5) == plain(rows, 4, 5, 2)
    some = [(k, [float(v) * 1e12 for v in rng.normal(size=6)], 0) for k in range(40)]
    assert got(spark, some, parts=3, entries=50) == plain(some, 3, 50, 2)


def test_nothing_gives_nothing(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, 1)]) == []


def test_trees_prune_and_give_whole_nodes(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-9, 9, (2000, 4)) + c for c in ((0, 0, 0, 0), (900, 0, 0, 0), (0, 900, 900, 0))])
    entries, seen = x[[0, 2500, 4500, 1, 2501]], {}
    sums, counts = np.zeros(entries.shape, int), np.zeros(5, int)
    code, error = dual_tree.assign(dual_tree.Tree(x, 8), entries, sums, counts, seen)
    far = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (code == far.argmin(1)).all() and (error == far.min(1)).all()
    assert (counts == np.bincount(code, minlength=5)).all() and all((sums[e] == x[code == e].sum(0)).all() for e in range(5))
    assert seen["whole"] > 2000 and seen["single"] < far.size / 3


def test_query_has_the_contracts_columns_and_its_twins_rows(spark):
    sf = "/root/testdata/sf0.001"
    found = queries.op12_dual_tree_lloyd(spark, sf)
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(queries.ORACLES["op12_dual_tree_lloyd"]).fetchall())
