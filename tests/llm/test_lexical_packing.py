"""Packing by lexical neighbours: round trips, padding, and the index against loops."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from millrace.llm import lexical_packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, n long, first string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "x", 7, "y") for k, t in enumerate(texts)], SCHEMA)


def hold(rows, texts, tokenizer, capacity, ids="ids"):
    """Every id lies in one piece; sequences are gapless, no longer than capacity, and full or a power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for k, text in enumerate(texts):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(by_doc[k], key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert {r.doc_tokens for r in own} == {len(want)} == {sum(r.length for r in own)}
        for r in own:
            part = want[r.start : r.start + r.length]
            if ids == "ids":
                assert r.ids == part
            else:
                assert r.ids_crc32 == zlib.crc32(np.asarray(part, "<u4").tobytes())
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in own])
        assert [r.offset for r in own] == [0, *ends[:-1]] and ends[-1] <= capacity
        assert ends[-1] & (ends[-1] - 1) == 0
    return by_sequence


def test_packing_round_trips_over_shards_and_edge_rows(spark, tokenizer):
    rng = random.Random(1)
    bits = ["Then", "don't", "é", "漢字", "12", "<|endoftext|>", "\n", "ſ", "word"]
    texts = [None, "", "  ", *(" ".join(rng.choice(bits) for _ in range(rng.randrange(1, 120))) for _ in range(80)), *["the same words here"] * 30, "long " * 3000]
    docs = docs_of(spark, texts)
    hold(lexical_packing.pack(docs, PATH, capacity=128, shard_tokens=700, slice_bytes=900).collect(), texts, tokenizer, 128)
    assert lexical_packing.pack(docs.where("false"), PATH).count() == 0
    assert [tuple(r)[1:5] for r in lexical_packing.pack(docs.where("doc_id = 0"), PATH).collect()] == [(0, 1, [1], 1)]
    with pytest.raises(ValueError):
        lexical_packing.pack(docs, PATH, capacity=100)


def test_windows_hold_documents_of_a_subject(spark, tokenizer):
    rng = random.Random(2)
    subjects = [[f"{a}{b}" for b in ("alpha", "brown", "candle", "dust", "evening")] for a in ("gold", "iron", "wind", "rock", "lake", "bird")]
    common = ["the", "of", "and", "is"]
    kind = [k % 6 for k in range(240)]
    texts = [" ".join(rng.choice(common if rng.random() < 0.5 else subjects[k]) for _ in range(30)) for k in kind]
    rows = lexical_packing.pack(docs_of(spark, texts), PATH, capacity=256).collect()
    pure = [Counter(kind[r.doc_id] for r in own) for own in hold(rows, texts, tokenizer, 256).values()]
    assert sum(max(c.values()) for c in pure) / sum(sum(c.values()) for c in pure) > 0.8


def test_the_index_ranks_by_bm25_and_gives_what_is_unused():
    rng = np.random.default_rng(3)
    shard = [np.r_[rng.integers(5, 40, rng.integers(0, 60)), 1].astype("<u2") for _ in range(50)]
    counted = Counter(int(t) for ids in shard for t in set(ids[:-1].tolist()))
    told = lexical_packing.Statistics({**counted, -1: 50, -2: sum(len(x) - 1 for x in shard)})
    mean = sum(len(x) - 1 for x in shard) / 50

    def score(query, ids):
        tf = Counter(ids[:-1].tolist())
        return sum(
            math.log(1 + (50 - counted[t] + 0.5) / (counted[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * (len(ids) - 1) / mean)) for t in set(query[:-1].tolist())
        )

    index = lexical_packing.Index(shard, told)
    gone = set()
    for seed in (3, 9, 30):
        want = sorted((k for k in range(50) if k not in gone), key=lambda k: (-round(score(shard[seed], shard[k]), 9), k))
        got = list(index.neighbours(index.terms[seed]))
        assert sorted(got) == sorted(want)
        assert np.allclose([score(shard[seed], shard[k]) for k in got], [score(shard[seed], shard[k]) for k in want])
        for k in got[:20]:
            if len(gone) < 45:
                index.use(k)
                gone.add(k)


def test_query_keeps_the_contract(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    found = queries.op11_lexical_packing(spark, sf)
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [(c, "bigint") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    hold(found.collect(), [docs[k] for k in range(len(docs))], tokenizer, 2048, "crc")
