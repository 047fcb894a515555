"""The pipeline's near-dedup stage against brute force on five-word shingles."""

import random

import pytest

import corpus_pipeline
from millrace.llm import shingle_groups, simhash
from millrace.llm.common import keep_first

DOCS = "doc_id long, text string, source string"


def brute_kept(rows):
    def cut(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    sets, root = [cut(t) for _, t, _ in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            if not either or len(sets[i] & sets[j]) * 10 >= either * 8:
                root[find(i)] = find(j)
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    members = {}
    for k in range(len(rows)):
        members.setdefault(find(k), []).append(k)
    return [(min(own, key=order), own) for own in members.values()]


def corpus():
    rng = random.Random(11)
    words = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(n)]
    texts = [None, "", " ", "One two", "one  TWO", "one three"]
    for n in (5, 9, 40, 60, 120, 200):
        base = words(n)
        texts.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 4, 6, 9):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = words(1)[0]
            texts.append(" ".join(own))
    common = words(40)
    texts += [" ".join(common + words(rng.choice([2, 8, 20]))) for _ in range(30)]
    return [(k, t, "s") for k, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [64, 3])
@pytest.mark.parametrize("block", [256, 4])
def test_groups_equal_brute_force_however_crowded(spark, monkeypatch, hot, block):
    monkeypatch.setattr(shingle_groups, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    named = shingle_groups.groups(docs, hot=hot)
    kept = sorted(r.doc_id for r in keep_first(docs, shingle_groups.node(), named.withColumnRenamed("node", "hash")).collect())
    assert kept == sorted(rows[first][0] for first, _ in brute_kept(rows))


def test_fingerprints_and_the_rest_equal_brute_force(spark):
    rows = corpus()
    kept = sorted(r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, DOCS)).collect())
    assert kept == sorted(rows[first][0] for first, _ in brute_kept(rows))


def test_stage_keeps_one_row_of_each_group_whatever_its_ids(spark):
    rows = [(None if k % 3 else k, t, "s") for k, t, _ in corpus()] + [(7, "two rows share this id but", "s"), (7, "not a word of their text at all", "s")]
    docs = spark.createDataFrame(rows + rows[:40], DOCS)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    found = brute_kept(rows)
    assert len(kept) == len(found)
    texts = [{rows[k][1] for k in own} for _, own in found]
    assert all(sum(text in own for _, text in kept) == 1 for own in texts)
    assert sorted(str(i) for i, _ in kept) == sorted(str(rows[first][0]) for first, _ in found)
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), "").count() == 0


def test_sketches_rule_out_pairs_and_lose_none(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(4000)]
    texts = [" ".join(rng.choices(words, k=n)) for n in (6, 30, 100, 250, 260)]
    texts += [" ".join(t.split()[k:]) for t in texts for k in (1, 3, 20)] + [t + " x y z" for t in texts]
    own = [shingle_groups.shingles(t, 5) for t in texts]
    sketches, ruled_out = [shingle_groups.sketch(x) for x in own], 0
    for i, x in enumerate(own):
        for j, y in enumerate(own):
            most = shingle_groups.most_shared(sketches[i], len(x), sketches[j], len(y))
            assert len(set(x) & set(y)) <= most <= min(len(x), len(y))
            ruled_out += len(x) > 90 and len(y) > 90 and not set(x) & set(y) and most < 0.8 / 1.8 * (len(x) + len(y))
    assert ruled_out > 20
    # texts that share a passage and nothing else are not sent to be compared
    passage = " ".join(f"p{k}" for k in range(30))
    apart = [(k, passage + " " + " ".join(f"t{k}x{i}" for i in range(170)), "s") for k in range(6)]
    sent = []
    verified = shingle_groups.verified
    monkeypatch.setattr(shingle_groups, "verified", lambda texts, sides, *a: sent.append(sides.count()) or verified(texts, sides, *a))
    assert shingle_groups.groups(spark.createDataFrame(apart, DOCS)).count() == 0
    assert sent == [0, 0, 0]
