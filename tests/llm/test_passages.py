"""Repeated passages of lines against a loop over all pairs of neighbouring lines."""

import random

from millrace.llm import line_dedup

DOCS = "doc_id long, text string, fp string"


def brute_passages(texts):
    seen, out = {}, []
    for k, text in enumerate(texts):
        if text is None:
            out.append(None)
            continue
        lines, gone = text.split("\n"), set()
        for i, pair in enumerate(zip(lines, lines[1:])):
            first = seen.setdefault(pair, (k, i))
            if "".join(pair).strip() and first not in ((k, i), (k, i - 1)):
                gone |= {i, i + 1}
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_whole_passages_go_whatever_their_length_and_place(spark):
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice("abcdefgh") * 3 for _ in range(12))
    texts, planted = [], []
    for n in (2, 2, 2, 3, 3, 4, 5, 8, 20):
        passage = [line() for _ in range(n)]
        texts.append("\n".join([line(), *passage, line()]))
        for _ in range(2):
            head, tail = [line() for _ in range(rng.randrange(4))], [line() for _ in range(rng.randrange(4))]
            planted.append((len(texts), head + tail))
            texts.append("\n".join(head + passage + tail))
    texts += ["single", "single", "a\na\na", "a\na\na\na\nb", "p\nq\np\nq\np", "", "\n\n\n", "\n\n\n", None]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], DOCS)
    found = {r.doc_id: r for r in line_dedup.drop_repeated_passages(docs).collect()}
    assert [found[k].text for k in range(len(texts))] == brute_passages(texts)
    assert all(found[k].text == "\n".join(rest) for k, rest in planted)
    assert all(r.n_lines - r.n_removed == (len(r.text.split("\n")) if r.text else r.n_lines - r.n_removed) for r in found.values() if r.text is not None)
    assert found[len(texts) - 1].n_lines == 0 and found[len(texts) - 9].n_removed == 0
    assert line_dedup.drop_repeated_passages(docs.where("false")).count() == 0


def test_repeated_rows_are_one_occurrence(spark):
    docs = spark.createDataFrame([(1, "p\nq\nr", "x")] * 2 + [(None, "s\nt", "x")], DOCS)
    assert {(r.doc_id, r.text, r.n_removed) for r in line_dedup.drop_repeated_passages(docs).collect()} == {(1, "p\nq\nr", 0), (None, "s\nt", 0)}


def test_pairs_are_those_that_repeated_chunks_hold_or_touch(spark):
    rng = random.Random(5)
    texts = ["\n".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randint(2, 9))) if k % 2 else "\n".join(f"{k} {n}" for n in range(8)) for k in range(40)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], DOCS)
    # a chunk is one or more lines, cut by its lines alone
    assert {len(r.pairs) for r in line_dedup._seeds(docs).collect()} > {1, 2, 3, 4}
    found = {(r.doc_id, r.start) for r in line_dedup._pairs(docs).collect()}
    places = {}
    for k, t in enumerate(texts):
        lines = t.split("\n")
        for i, pair in enumerate(zip(lines, lines[1:])):
            places.setdefault(pair, set()).add((k, i))
    assert set().union(*(p for p in places.values() if len(p) > 1)) <= found
    # texts without a repeated line have no seed, so no pair of theirs is looked at
    assert {k for k, _ in found} <= {k for k in range(40) if k % 2}
