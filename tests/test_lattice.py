"""Cutting by a dictionary against all ways to cut, and the matcher with it."""

import math
import random

import pytest

from millrace.functions import lattice
from millrace.operators import matching as X

WORDS = {"手套": 30, "防护": 20, "防护手套": 6, "布手套": 4, "棉": 9, "棉布": 3, "安全帽": 12, "安全": 15, "帽": 2, "护手": 5, "套": 1}


def ways(run):
    if not run:
        yield []
    for k in range(1, len(run) + 1):
        if k == 1 or run[:k] in WORDS:
            for rest in ways(run[k:]):
                yield [run[:k], *rest]


def test_the_path_is_the_best_of_all():
    rng, total = random.Random(1), math.log(sum(WORDS.values()))
    cut = lattice.Lattice(WORDS)
    value = lambda words: sum(math.log(WORDS.get(w, 1)) - total for w in words)
    for _ in range(300):
        run = "".join(rng.choice("手套防护布棉安全帽鞋") for _ in range(rng.randrange(1, 10)))
        got = cut.cut(run)
        assert "".join(got) == run and abs(value(got) - max(map(value, ways(run)))) < 1e-9
    assert cut.keywords("棉布手套3M加厚, N95 安全帽 a") == ["棉布", "手套", "3M", "N95", "安全帽"]
    assert cut.keywords(None) == cut.keywords("") == cut.keywords("。") == []


def test_the_matcher_runs_with_it(spark):
    rng = random.Random(2)
    name = lambda: rng.choice(["棉", "布", "防护", ""]) + rng.choice(["手套", "安全帽", "口罩", "glove"]) + rng.choice([" 3M", "", " L"])
    requests = spark.createDataFrame([(name(), "", "") for _ in range(25)], "name string, spec string, brand string")
    products = spark.createDataFrame([(k, name(), "M1", "") for k in range(70)], "catalog_idx long, name string, model string, brand string")
    tokenise = lattice.tokeniser(WORDS)
    columns = ["name", "rank", "catalog_idx", "score"]
    some, every = (sorted(map(tuple, X.match(requests, products, most=6, all_pairs=p, tokenise=tokenise).select(*columns).collect())) for p in (False, True))
    assert some == every and some
    plain = sorted(map(tuple, X.match(requests, products, most=6).select(*columns).collect()))
    assert plain != some


def test_a_dictionary_is_counted_from_names_and_its_size_is_bounded(spark):
    names = spark.createDataFrame([("棉手套",), ("布手套 L",), ("手套",), (None,), ("安全帽",)], "name string")
    assert lattice.dictionary(names, "name") == {"手套": 3}
    assert lattice.dictionary(names, "name", least=1, most=2) == {"手套": 3, "全帽": 1}
    with pytest.raises(ValueError):
        lattice.tokeniser({str(k): 1 for k in range(lattice.MOST_WORDS + 1)})
