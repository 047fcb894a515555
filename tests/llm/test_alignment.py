"""Stretch-wise token ids against the vocabularies' own libraries; alignments against sets and loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from millrace.llm import alignment, chunks, queries

A, B, W = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
BITS = ["th", "er", "ing", "é", "Zu", "12", ".", "'s", "don't", " ", "  ", "\n", "\t", " \n", "\xa0", "　", "漢字", "\U0001f600", "<|endoftext|>", "<s>", "é", "İ", "ΣΑΣ", "\x1c", "\x00", "ﬁ", "½", "<0x0A>", "A" * 300, "́", "\xad", "\r\n", "ß", "ÀÉ", "×", "ſ", "\x85"]


def made(n, seed, bits=BITS):
    rng = random.Random(seed)
    return ["".join(rng.choice(bits) + (" " if rng.random() < 0.4 else "") for _ in range(rng.randrange(0, 60))) for _ in range(n)] + ["", " ", "  ", "\n", "a", " a", "a ", "a  b"]


@pytest.mark.parametrize("kind", ["plain specials", "specials", "word ends", "word ends, plain specials", "pieces"])
def test_ids_by_stretches_are_the_librarys(kind):
    from tokenizers import Tokenizer

    texts = made(600, 1)
    if kind == "pieces":
        encode, cut = chunks.Pieces(B), chunks.stretches
        real = lambda t: encode.model.encode(t)
    else:
        word, plain = "word" in kind, "plain" in kind
        encode, cut = (chunks.WordEnds if word else chunks.ByteLevel)(W if word else A, plain), chunks.words if word else chunks.stretches
        model = Tokenizer.from_file(W if word else A)
        model.encode_special_tokens = plain
        real = lambda t: model.encode(t if word else " " + t, add_special_tokens=False).ids
        assert encode.fast is not None
    found = cut(pa.array(texts))
    ids, bounds = encode(found.different).texts(found)
    assert [ids[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:], strict=True)] == [real(t) for t in texts]


def test_merges_that_ranks_do_not_give_are_told():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5}
    assert chunks.merges_agree(ranks, [(b"a", b"b"), (b"b", b"c"), (b"ab", b"c")])
    assert not chunks.merges_agree(ranks, [(b"a", b"b"), (b"b", b"c"), (b"a", b"bc")])


def test_common_ends_equal_sets():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 5000):
        for dense in (0.2, 0.6, 0.97):
            every = np.arange(1, n + 1)
            a, b = (every[rng.random(n) < dense] for _ in range(2))
            a, b = (np.union1d(x, every[-1:]) for x in (a, b))
            shared = np.intersect1d(a, b)
            got = alignment.common_ends(a, b, np.zeros(min(1, n), int), section=40)
            assert (a[got[0]] == shared).all() and (b[got[1]] == shared).all()


def plain(texts):
    """Per text: A and B ids with byte ranges, groups and links by comparing all ranges."""
    first, second = chunks.ByteLevel(A, True), chunks.Pieces(B)
    out = []
    for t in texts:
        ids_a = first.model.encode(" " + (t or ""), add_special_tokens=False).ids
        ids_b = second.model.encode(t or "")
        whole = (" " + (t or "")).encode()
        if not t or b"".join(first.bytes[i] for i in ids_a) != whole or b"".join(second.bytes[i] for i in ids_b) != whole:
            out.append(([], [], [], []))
            continue
        ends = [np.cumsum([len(s.bytes[i]) for i in ids]).tolist() for s, ids in ((first, ids_a), (second, ids_b))]
        ranges = [list(zip([0, *e[:-1]], e, strict=True)) for e in ends]
        groups, at = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append([[i for i, (s, e) in zip(ids, r, strict=True) if at <= s and e <= cut] for ids, r in zip((ids_a, ids_b), ranges, strict=True)])
            at = cut
        links = [(i, j) for i, (s, e) in zip(ids_a, ranges[0], strict=True) for j, (u, v) in zip(ids_b, ranges[1], strict=True) if s < v and u < e]
        out.append((ids_a, ids_b, groups, links))
    return out


def test_alignment_equals_loops_over_blocks_and_slices(spark):
    texts = [None, *made(120, 2, [*BITS, "ndenon", "reingwhen", "▁"])] + ["same text here"] * 5
    truth = plain(texts)
    count = Counter(p for *_, links in truth for p in links)
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    docs = spark.createDataFrame([(k if k != 3 else None, t, 1, "b") for k, t in enumerate(texts)], "doc_id long, text string, block int, links string").repartition(3)
    for with_groups in (True, False):
        rows = {r.doc_id: r for r in alignment.align(docs, A, B, with_groups=with_groups, slice_bytes=700, block_links=900).collect()}
        assert len(rows) == len(texts)
        for k, (ids_a, ids_b, groups, links) in enumerate(truth):
            r = rows[k if k != 3 else None]
            said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            assert r.groups == (said if with_groups or not said else hashlib.sha256(said.encode()).hexdigest())
            assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(ids_a), len(ids_b), len(groups), len(links))
            assert (r.n_best, r.count_sum) == (sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links))
    assert alignment.align(docs.where("false"), A, B).count() == 0
    nothing = alignment.align(docs.where("text is null or text = ''"), A, B).collect()
    assert {(r.n_links, r.n_best, r.groups) for r in nothing} == {(0, 0, "")}


def test_query_has_the_contracts_columns(spark):
    found = queries.op13_token_alignment(spark, "/root/testdata/sf0.001")
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", "string")]
    assert found.count() == 200
