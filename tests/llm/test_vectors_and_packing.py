"""Vector operators, packing, mixing and extraction against brute force and on edge rows."""

import html
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from millrace.llm import html_extract, mixing, packing, permutation_ann, pq_dedup

VECTORS = "vec_id long, embedding array<float>, label int, home string"


def vectors(spark, x, extra=()):
    return spark.createDataFrame([(k, [float(v) for v in row], k % 3, "h") for k, row in enumerate(x)] + list(extra), VECTORS)


BAD = [(9001, None, 0, ""), (9002, [0.0] * 8, 0, ""), (9003, [None] + [1.0] * 7, 0, ""), (9004, [float("nan")] * 8, 0, ""), (9005, [float("inf")] + [1.0] * 7, 0, ""), (9006, [1.0, 2.0], 0, ""), (None, [1.0] * 8, 0, "")]


def test_search_equals_brute_force_on_small_tables(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32) * rng.uniform(0.2, 5, size=(300, 1)).astype(np.float32)
    x[50:60] = x[40]  # ties
    rows = vectors(spark, x, BAD)
    found = defaultdict(list)
    # all of a shard is ranked again
    for r in permutation_ann.search(rows, lambda v: v % 20 == 0, share=1.0, shard_rows=64).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    y = x.astype(float)
    for q in range(0, 300, 20):
        score = y @ y[q]
        order = sorted((k for k in range(300) if k != q), key=lambda k: (-score[k], k))[:20]
        assert [v for v, _ in found[q]] == order
        assert np.allclose([s for _, s in found[q]], score[order], atol=1e-12)
    assert permutation_ann.search(rows.where("false"), lambda v: v % 20 == 0).count() == 0


def test_rows_that_repeat_an_id_are_rows_of_their_own(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    rows = vectors(spark, x, [(7, [float(v) for v in x[20] * 2], 0, "h"), (20, [float(v) for v in x[20]], 0, "h")])
    found = permutation_ann.search(rows, lambda v: v % 20 == 0, k=70, share=1.0).where("query_id = 20").collect()
    # each of the two rows with id 20 finds the other and all the rest
    assert len(found) == 2 * 61 and sum(r.vec_id == 20 for r in found) == 2 and sum(r.vec_id == 7 for r in found) == 4


def test_search_recall_with_real_pruning(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = permutation_ann.search(vectors(spark, x), lambda v: v % 100 == 0, shard_rows=1000).toPandas()
    y = x.astype(np.float32).astype(float)
    hits = sum(len(set(g.vec_id) & set(np.argsort(-np.where(np.arange(3000) == q, -9, y @ y[q]))[:20])) for q, g in got.groupby("query_id"))
    assert hits / (30 * 20) >= 0.9


def test_footrule_equals_its_definition():
    rng = np.random.default_rng(2)
    ranked = np.array([rng.permutation(12)[:5] for _ in range(40)])
    index = permutation_ann.InvertedFiles(ranked, 12)
    for q in ranked[:5]:
        place = lambda p, row: list(row).index(p) if p in row else 5
        exact = [sum(abs(place(p, q) - place(p, row)) for p in range(12)) for row in ranked]
        assert index.footrule(q).tolist() == exact


def test_pq_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(80, 8))
    near = base[:20].repeat(4, 0) + rng.normal(size=(80, 8)) * 0.15
    x = np.concatenate([base, near, base[:5]]).astype(np.float32)
    got = {r.vec_id: r for r in pq_dedup.near_duplicates(vectors(spark, x, BAD), probes=40, block_rows=16).collect()}
    u = pq_dedup.unit(x.astype(float))
    link = u @ u.T >= 0.9
    root = list(range(len(x)))
    for _ in range(len(x)):
        root = [min(root[j] for j in range(len(x)) if link[i, j]) for i in range(len(x))]
    assert [got[k].n_links for k in range(len(x))] == (link.sum(1) - 1).tolist()
    assert [got[k].component_id for k in range(len(x))] == root
    assert all(got[k].kept == (root[k] == k) for k in range(len(x)))
    assert all(got[b[0]].n_links == 0 and got[b[0]].component_id == b[0] for b in BAD)
    assert pq_dedup.near_duplicates(vectors(spark, x).where("false")).count() == 0


def test_forest_joins_what_edges_join():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (10, 6), (200, 150), (300, 900)):
        p, q = rng.integers(0, n, (2, m))
        keep = p != q
        label = np.arange(n)
        a, b = pq_dedup._joined(label, p[keep], q[keep])
        root = np.arange(n)
        for _ in range(n):
            np.minimum.at(root, p, root[q])
            np.minimum.at(root, q, root[p])
        assert (label == root).all() and len(a) == n - len(set(root.tolist()))
        again = np.arange(n)
        assert len(pq_dedup._joined(again, a, b)[0]) == len(a) and (again == root).all()


def test_a_crowd_of_near_copies_in_one_list_takes_seconds(spark):
    import time

    rng = np.random.default_rng(5)
    x = (np.ones((4000, 64)) + rng.normal(size=(4000, 64)) * 0.05).astype(np.float32)
    rows = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)] + [(9999, x[0].tolist())] * 3, "vec_id long, embedding array<float>")
    began = time.time()
    found = pq_dedup.near_duplicates(rows).collect()
    assert time.time() - began < 60
    assert {r.component_id for r in found} == {0} and {r.n_links for r in found} == {4002} and len(found) == 4003


DOCS = "doc_id long, text string, lang string, source string, n_chars long, length long, no string"


def docs_of(spark, texts, sources=None):
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(k, t, "en", s, 0, 7, "z") for k, (t, s) in enumerate(zip(texts, sources, strict=True))], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_and_packing_round_trip(spark, tokenizer):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["th", "er", "ing", "é", "Zu", "12", "."]) for _ in range(rng.randrange(1, 4)))
    texts = [None, "", " ", "a  b", "x\n y", "\ttab ", "<|endoftext|> it's", "漢字 \U0001f600"] + [" ".join(word() for _ in range(rng.randrange(1, 900))) for _ in range(150)] + [" ".join(word() for _ in range(6000))]
    docs = docs_of(spark, texts)
    rows = packing.pack(packing.pieces(docs.union(docs.where("doc_id = 9")), public_tokenizers.path("byte_bpe_50k.json")), shard_rows=64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    total = 0
    for k, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[k], key=lambda r: r.piece)
        own = own[::2] if k == 9 else own
        total += len(ids) * (2 if k == 9 else 1)
        assert [i for r in own for i in r.ids] == ids and all(r.length == 1024 for r in own[1:])
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
    for rs in by_sequence.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == list(np.cumsum([0] + [r.length for r in rs])[:-1]) and sum(r.length for r in rs) <= 1024
    assert len(by_sequence) <= -(-total // 1024) * 1.03 + 2
    digests = packing.pieces(docs.where("doc_id = 10"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).collect()
    ids = np.asarray(tokenizer.encode(texts[10], add_special_tokens=False).ids + [2], "<u4")
    assert digests[0].ids_crc32 == zlib.crc32(ids[: digests[0].length].tobytes())
    assert packing.pack(packing.pieces(docs.where("false"), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_genetic_packing_is_valid_and_not_worse_than_best_fit():
    rng = np.random.default_rng(5)
    size = rng.integers(1, 1024, 400).tolist()
    falling = sorted(range(400), key=lambda i: -size[i])
    plain = packing.Packing(1024).best_fit(falling, size)
    got = packing.evolve(size, 1024, 1, generations=20)
    assert sorted(i for b in got.bins for i in b) == list(range(400))
    assert all(sum(size[i] for i in b) == 1024 - f <= 1024 for b, f in zip(got.bins, got.free, strict=True))
    assert len(got.bins) <= len(plain.bins)
    child = plain.cross(got, size, rng)
    assert sorted(i for b in child.bins for i in b) == list(range(400))


def test_mix_reaches_its_targets(spark):
    rng = random.Random(6)
    sources = [rng.choice(["a"] * 6 + ["b", "c", None]) for _ in range(400)]
    texts = [" ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 200))) for _ in range(396)] + [None, "", " ", "\n"]
    got = mixing.mix(docs_of(spark, texts, sources)).collect()
    assert len(got) == 400
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(texts)}
    by_source = defaultdict(int)
    for k, s in enumerate(sources):
        by_source[s] += size[k]
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, total, open_ = {}, sum(by_source.values()), set(order)
    while open_:
        left = total - sum(target.values())
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * by_source[s]}
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        target |= {s: 3.0 * by_source[s] for s in over}
        open_ -= over
    taken = defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == by_source[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 8 for s in order)
    again = mixing.mix(docs_of(spark, texts, sources)).collect()
    assert sorted(got) == sorted(again)
    assert mixing.mix(docs_of(spark, texts).where("false")).count() == 0
    copies = mixing.apply_mix(docs_of(spark, texts, sources))
    assert copies.columns == docs_of(spark, texts).columns and copies.groupBy("doc_id").count().where("count > 3").count() == 0


PAGE = '<html><head><title>T</title><script>var x="</p>";</script></head><body><nav><a href=/>Home</a></nav><div class="ad box">Buy</div>{}<footer>&copy; f</footer></body></html>'


def test_extraction_cases():
    parts = {
        "<article><h1>A &amp; B</h1><p>One  <b>two</b>,\n three<br>four<p>five</p></article>": "A & B One two, three four five",
        "<div class='post 12'><p>Long text of a page without an article element, which holds the most of it.</p><div class=comments><p>Nice!</p></div></div>": "Long text of a page without an article element, which holds the most of it.",
        "<main><p>x &lt;y&gt; &eacute; &#8364;</p><form><input>q</form><!-- c --><aside>s</aside></main>": "x <y> é €",
    }
    for body, text in parts.items():
        page = PAGE.format(body)
        assert html_extract.extract(page, [html_extract.vote(page)]) == text
    assert html_extract.extract(None, None) == html_extract.extract("", ["x"]) == html_extract.extract("<html></html>", None) == ""
    assert html_extract.extract("<a <a <a '", None) in ("", "<a <a <a '")
    assert html_extract.extract("plain words", None) in ("", "plain words")


def test_a_host_outvotes_an_odd_page(spark):
    article = lambda k: f"<div class='story s{k}'><p>{'Words of the story itself, and more of them. ' * 4}</p></div><div class=box><p>Note {k}</p></div>"
    odd = "<div class='story s9'><p>Short.</p></div><div class=box><p>" + "A long note that is no story at all. " * 9 + "</p></div>"
    rows = [(k, "http://H.example/a", PAGE.format(article(k)), 1) for k in range(5)] + [(9, "http://h.example/b?x", PAGE.format(odd), 1), (10, None, None, 1), (11, "nonsense", "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    assert got[9] == "Short." and got[10] == got[11] == "" and got[0].startswith("Words of the story") and "Note" not in got[0]
    assert html_extract.main_text(pages.where("false")).count() == 0


def test_plain_articles_equal_a_regular_expression(spark):
    rng = random.Random(7)
    for _ in range(50):
        paragraphs = ["".join(rng.choice("ab &<é\n ") for _ in range(30)) for _ in range(4)]
        page = PAGE.format("<article>" + "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs) + "</article>")
        assert html_extract.extract(page, None) == " ".join(" ".join(p.split()) for p in paragraphs if p.split())
