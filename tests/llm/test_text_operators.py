"""Toxicity, language ID, SimHash, line dedup and licence scans against brute force and on edge rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from millrace.llm import common, langid, license_scan, line_dedup, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, hash string"


def docs_of(spark, texts, langs=None):
    """Documents with columns whose names clash with those used inside."""
    langs = langs or [None] * len(texts)
    return spark.createDataFrame([(k, t, lang, "s", len(t or ""), "x", "y") for k, (t, lang) in enumerate(zip(texts, langs, strict=True))], DOCS)


EDGE = [None, "", " \n\t ", "one", "One TWO", "x " * 5000, "ß ǅ İ 漢字 \U0001f600", "a\x0bb\x0cc", "same text here now", "same text here now"]


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, linked):
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(60)) for _ in range(12)]
    texts = EDGE + base + [b.replace(b.split()[k], "zz", 1) for b in base for k in (0, 30)] + base[:3]
    found = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    assert [found[k].fp % 2**64 for k in range(len(texts))] == prints
    assert [found[k].component_id for k in range(len(texts))] == brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)


@pytest.mark.parametrize("hot", [256, 2])
def test_links_find_every_pair_however_crowded(spark, hot):
    rng = random.Random(hot)
    centre = rng.getrandbits(64)
    fps = sorted({centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 1, 2, 3]))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(40)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), hot)
    pairs = [(r.a, r.b) for r in edges.collect()]
    assert all(((a % 2**64) ^ (b % 2**64)).bit_count() <= 2 for a, b in pairs)
    joined = {r.node: r.component for r in common.components(edges).collect()}
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    groups = defaultdict(set)
    for f, r in zip(signed, roots, strict=True):
        groups[r].add(f)
    assert all({joined.get(f, f) for f in g} == {min(g)} for g in groups.values())


def test_components_of_long_paths_and_nothing(spark):
    chain = [(k, k + 1) for k in range(100)] + [(200, 200), (300, 301), (301, 300)]
    found = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(101)} | {300: 300, 301: 300}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicate_keeps_one_row_of_each_group(spark):
    text = "five words are enough here for some shingles"
    rows = docs_of(spark, [text, text, "another text altogether with its own words", None, ""])
    assert sorted(r.doc_id for r in simhash.deduplicate(rows.union(rows)).collect()) == [0, 2, 3]
    assert simhash.deduplicate(rows.where("false")).count() == 0
    assert simhash.deduplicate(rows).columns == rows.columns


def brute_line_dedup(rows, window=2, divisor=2):
    """Texts by (doc_id, place) after removal, by a plain loop over the same rule."""
    seed = 42

    def h(line):
        return xxhash.xxh64(line.encode(), seed=seed).intdigest() & 0x7FFFFFFF

    def chunks(text):
        lines = text.split("\n")
        hashes = [h(x) for x in lines]
        hit = []
        for i in range(len(lines)):
            acc = 0
            for x in hashes[max(i - window + 1, 0) : i + 1]:
                acc = acc * 31 % 0x7FFFFFFF + x
            hit.append(acc % divisor == 0)
        start, out = 0, []
        for i in range(len(lines)):
            if i == len(lines) - 1 or (hit[i] and i > 0 and not hit[i - 1]):
                if i - start >= 1:
                    out.append((start, i + 1))
                start = i + 1
        return lines, out

    seen, result = set(), {}
    for doc_id, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        lines, spans = chunks(text)
        gone = set()
        for a, b in spans:
            body = "\n".join(lines[a:b])
            if body in seen and body.strip():
                gone |= set(range(a, b))
            seen.add(body)
        result[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return result


def test_line_dedup_equals_a_loop_and_survives_shifts(spark):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice("abcdefgh") * 3 for _ in range(6))
    passage = [line() for _ in range(40)]
    texts = ["\n".join([line() for _ in range(rng.randrange(5))] + passage + [line()]) for _ in range(6)]
    texts += ["single", "a\nb", "a\nb", "", "\n\n\n", "\n\n\n", None]
    docs = docs_of(spark, texts)
    found = {r.doc_id: r for r in line_dedup.drop_repeated_chunks(docs).collect()}
    assert {k: r.text for k, r in found.items() if r.text is not None} == brute_line_dedup(list(enumerate(texts)))
    assert found[len(texts) - 1].text is None and found[len(texts) - 1].n_lines == 0
    assert all(found[k].n_removed >= 30 for k in range(1, 6)) and found[0].n_removed == 0
    assert line_dedup.drop_repeated_chunks(docs.where("false")).count() == 0


def test_line_dedup_treats_repeated_rows_alike(spark):
    docs = docs_of(spark, ["p\nq\nr\ns"])
    assert {(r.text, r.n_removed) for r in line_dedup.drop_repeated_chunks(docs.union(docs)).collect()} == {("p\nq\nr\ns", 0)}


def test_license_scan_finds_texts_in_other_spellings(spark):
    mit = license_scan.KNOWN["MIT"][2]
    texts = ["Copyright (c) 2020 Someone\n" + mit.upper().replace("LICENSE", "LICENCE"), mit + " extra", "words\nreleased under the mit licence!\nwords", None, "", "©©©"]
    found = {r.doc_id: r for r in license_scan.scan(docs_of(spark, texts)).collect()}
    assert found[0].license_id == "MIT" and found[1].license_id is None
    assert found[2].notices == "MIT" and found[2].n_notice_lines == 1
    assert all(found[k].digest is None and found[k].notices == "" for k in (3, 4, 5))
    twice = docs_of(spark, texts)
    assert [r.n_notice_lines for r in license_scan.scan(twice.union(twice)).where("doc_id = 2").collect()] == [1, 1]


def test_language_profiles_tell_languages_apart(spark):
    rng = random.Random(5)
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "eit"]}
    make = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(40))
    langs = [rng.choice(["aa", "bb"]) for _ in range(120)]
    docs = docs_of(spark, [make(x) for x in langs] + EDGE + ["123 $$"], langs + ["aa"] * len(EDGE) + [None])
    profiles = langid.learn(docs.where(~langid.held_out(docs.doc_id)).select("lang", "text"))
    found = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text"), profiles).collect()}
    assert [found[k].lang_pred for k in range(120)] == langs
    assert all(0 <= r.score <= 1 for r in found.values())
    none = [120, 121, 122, 120 + len(EDGE)]
    assert all(found[k].lang_pred == "und" and found[k].score == 0 for k in none)
    kept = langid.accept(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(found) - set(none)
    assert langid.accept(docs.where("false")).count() == 0


def test_language_distance_is_the_sum_of_rank_differences():
    text = "banana bandana"
    own = [int(x) for x in langid.ranked(langid.counts(text), 300)]
    profiles = {"x": own[::-1], "y": own[:2]}
    ranks = langid.Ranks(profiles)
    far = {lang: sum(abs(p.index(g) - k) if g in p else abs(300 - k) for k, g in enumerate(own)) for lang, p in profiles.items()}
    assert ranks.predict(text)[0] == min(far, key=far.get)


def test_nnpu_separates_from_positive_and_unlabelled_only(spark):
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in "abcdefghijklmnopqrstuvwxyz"]
    texts, toxic = [], []
    for _ in range(600):
        bad = rng.random() < 0.2
        own = list(rng.choice(words, 30)) + (["loathsome", "vermin"] if bad else [])
        texts.append(" ".join(rng.permutation(own)))
        toxic.append(int(bad))
    docs = docs_of(spark, texts + EDGE)
    labels = spark.createDataFrame([(k, t if k % 3 else None) for k, t in enumerate(toxic)] + [(1, toxic[1])], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    right = np.mean([found[k].predicted == t for k, t in enumerate(toxic)])
    assert right > 0.97 and len(found) == len(texts) + len(EDGE)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    blank = toxicity.learn(docs, labels.where("toxic = 0"))
    assert all(r.score < 1e-9 for r in toxicity.score(docs, blank).collect())
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_nnpu_risk_is_not_driven_below_zero():
    rng = np.random.default_rng(1)
    p, u = rng.random((40, 200)) < 0.5, rng.random((80, 200)) < 0.5
    weights, bias = toxicity.fit_nnpu(p, u, 0.4)
    z = lambda m: m @ weights + bias
    assert np.logaddexp(0, z(u)).mean() - 0.4 * np.logaddexp(0, z(p)).mean() > -0.05


def test_ngram_counts_equal_a_counter():
    x = "Ab ab!"
    c = langid.counts(x)
    stream = [0, ord("a"), ord("b"), 0, ord("a"), ord("b"), 0]
    three = sum(1 for k in range(len(stream) - 2) if stream[k + 1])
    assert c.sum() == sum(1 for s in stream if s) + len(stream) - 1 + three
    assert Counter(c[c > 0]).most_common()
