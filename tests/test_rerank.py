"""The image pass after learning against a plain loop."""

import random

from millrace.operators import feedback as L


def by_loop(rows):
    """Codes in order: sorted, then one pass over neighbours."""
    rows = sorted(rows, key=lambda r: (-r[1], -r[2], r[3]))
    for k in range(1, len(rows)):
        before, now = rows[k - 1], rows[k]
        if now[4] and not before[4] and abs(before[1] - now[1]) <= 0.03:
            rows[k - 1], rows[k] = now, before
    return [r[3] for r in rows]


def test_rerank_equals_a_loop(spark):
    rng = random.Random(8)
    # scores in steps of 1/64: differences are exact, none at the limit
    rows = [(ask, rng.randrange(20, 40) / 64, rng.randrange(4) / 4, k, rng.random() < 0.5) for ask in range(12) for k in range(ask)]
    found = {}
    for r in L.rerank(spark.createDataFrame(rows, "ask_id long, score double, base_score double, catalog_idx long, has_image boolean")).orderBy("ask_id", "place").collect():
        found.setdefault(r.ask_id, []).append((r.place, r.catalog_idx))
    for ask, got in found.items():
        assert [p for p, _ in got] == list(range(1, len(got) + 1))
        assert [c for _, c in got] == by_loop([r for r in rows if r[0] == ask])
    assert sorted(found) == list(range(1, 12))
