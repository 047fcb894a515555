"""Alignment of two tokenizers' tokens over the same bytes by skipping diagonal runs.

A document's tokens under either vocabulary end at growing byte offsets. While
the ends at the current index shift are the same the two run side by side:
windows of doubling width are compared until one differs. There the token that
ends first is stepped over, on either side in turn, until both end together;
that closes an irregular group and sets the shift anew. All documents of a batch
step at once, each from its own place, and long ones are taken up at ends that
both sides share every hundred tokens or so, so that steps are few.

Links are pairs of a token of either side that share a byte. Their counts over
the corpus pass through blocks: a block of documents asks for each of its
different id pairs once, with its own number of links; the answers come back to
the block, which adds them up for its documents. What is shuffled grows with
the different pairs of blocks, not with links, and no pair has more rows than
there are blocks.

Defined cases: null and empty texts, and texts that either side does not give
back byte for byte with a space before (such as those with U+2581), have no
tokens: zeros and no groups; a text of any length is a document; repeated rows
and null ids are documents of their own; an empty table gives no rows; columns
other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.chunks import ByteLevel, Pieces, flat, slices, spread, stretches
from millrace.llm.common import save

#: An id pair is the first side's id in the high bits and the second's in this many low ones.
SECOND_BITS = 15
COUNTED = ("n_a", "n_b", "n_groups", "n_links")
_MADE: dict[tuple[str, str], tuple] = {}


class Side:
    """A vocabulary with its ids' bytes."""

    def __init__(self, encode: ByteLevel | Pieces) -> None:
        self.encode, self.length = encode, encode.length
        self.table = pa.array([encode.bytes.get(i, b"") for i in range(len(encode.length))], pa.large_binary())

    def gives_back(self, ids: np.ndarray, sizes: np.ndarray, names: pa.Array) -> np.ndarray:
        """Which strings, of so many ids each, are their ids' bytes joined."""
        bounds = np.r_[0, np.cumsum(sizes)]
        good = _sums(self.length[ids], bounds) == pc.binary_length(names).to_numpy()
        ours = _bytes(self.table.take(pa.array(ids[np.repeat(good, sizes)])))
        theirs = _bytes(names.filter(pa.array(good)).cast(pa.large_binary()))
        apart = np.flatnonzero(ours != theirs)
        if len(apart):
            kept = np.flatnonzero(good)
            ends = np.cumsum(pc.binary_length(names).to_numpy()[kept])
            good[kept[np.searchsorted(ends, apart, "right")]] = False
        return good


def _bytes(strings: pa.Array) -> np.ndarray:
    """All bytes of a large binary or string array, one after another."""
    if not len(strings):
        return np.zeros(0, np.uint8)
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)


def _sides(a_path: str, b_path: str) -> tuple[Side, Side, pa.Array]:
    """Both vocabularies and the texts of ids in groups, once a worker process: A's before a comma and before a bar, then B's before a comma and before a semicolon."""
    if (a_path, b_path) not in _MADE:
        a, b = Side(ByteLevel(a_path, plain_specials=True)), Side(Pieces(b_path))
        if len(b.length) > 1 << SECOND_BITS:
            raise ValueError(f"{b_path} has more than {1 << SECOND_BITS} ids")
        shown = [f"{i}{end}" for n, ends in ((len(a.length), ",|"), (len(b.length), ",;")) for end in ends for i in range(n)]
        _MADE[a_path, b_path] = (a, b, pa.array(shown, pa.large_string()))
    return _MADE[a_path, b_path]


def common_ends(ea: np.ndarray, eb: np.ndarray, starts: np.ndarray, section: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Which of the growing ends ea are among eb, and which of eb among ea.

    starts: places of ea that begin documents; ends before them, and the last ones, are shared.
    """
    shared_a, shared_b = np.zeros(len(ea), bool), np.zeros(len(eb), bool)
    if not len(ea):
        return shared_a, shared_b
    sampled = np.arange(section - 1, len(ea) - 1, section)
    sampled = sampled[eb[np.minimum(np.searchsorted(eb, ea[sampled]), len(eb) - 1)] == ea[sampled]]
    i = np.union1d(starts, sampled + 1)
    j = np.where(i > 0, np.searchsorted(eb, ea[i - 1]) + 1, 0)
    i_end, j_end = np.r_[i[1:], len(ea)], np.r_[j[1:], len(eb)]
    width = np.ones(len(i), np.int64)
    while len(i):
        size = np.minimum(width, np.minimum(i_end - i, j_end - j))
        at = spread(i, size)
        same = ea[at] == eb[at + np.repeat(j - i, size)]
        first = np.cumsum(size) - size
        run = np.minimum.reduceat(np.where(same, len(at), np.arange(len(at)) - np.repeat(first, size)), first)
        run = np.minimum(run, size)
        shared_a[spread(i, run)] = True
        shared_b[spread(j, run)] = True
        i, j = i + run, j + run
        width = np.where(run < size, 1, 2 * width)
        odd = np.flatnonzero(run < size)
        a, b, going = i[odd], j[odd], np.arange(len(odd))
        while len(going):
            x, y = ea[a[going]], eb[b[going]]
            a[going] += x < y
            b[going] += y < x
            going = going[x != y]
        shared_a[a], shared_b[b] = True, True
        i[odd], j[odd] = a + 1, b + 1
        left = i < i_end
        i, j, i_end, j_end, width = i[left], j[left], i_end[left], j_end[left], width[left]
    return shared_a, shared_b


@dataclass
class Aligned:
    """Documents of a batch: counts, groups (text or digest), and each one's id pairs, rising, one for each link."""

    numbers: dict[str, np.ndarray]
    groups: list[str]
    pairs: np.ndarray
    links: np.ndarray


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds."""
    return np.diff(np.r_[0, np.cumsum(values, dtype=np.int64)][bounds])


def align_texts(texts: pa.Array, a_path: str, b_path: str, with_groups: bool) -> Aligned:
    """Of texts without nulls."""
    first, second, shown = _sides(a_path, b_path)
    found = stretches(texts)
    under_a, under_b = first.encode(found.different), second.encode(found.different)
    # a stretch that comes back byte for byte does so in every text
    names = pc.binary_join_element_wise("", found.different, " ")
    whole = first.gives_back(under_a.ids, under_a.sizes, names) & second.gives_back(under_b.ids, under_b.sizes, names)
    good = (_sums(~whole[found.codes], found.starts) == 0) & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
    live = np.repeat(good, np.diff(found.starts))
    codes = found.codes[live]
    starts = np.r_[0, np.cumsum(np.where(good, np.diff(found.starts), 0))]
    (a, size_a), (b, size_b) = under_a.take(codes), under_b.take(codes)
    bounds_a, bounds_b = np.r_[0, np.cumsum(size_a)][starts], np.r_[0, np.cumsum(size_b)][starts]
    ea, eb = np.cumsum(first.length[a]), np.cumsum(second.length[b])
    shared_a, shared_b = common_ends(ea, eb, np.unique(bounds_a[:-1][good]))
    n_a, n_b, n_groups = np.diff(bounds_a), np.diff(bounds_b), _sums(shared_a, bounds_a)

    # where a group's tokens of the other side begin or end gives each token's place in the groups' text
    last_a, last_b = np.flatnonzero(shared_a), np.flatnonzero(shared_b)
    group_a, group_b = np.cumsum(shared_a) - shared_a, np.cumsum(shared_b) - shared_b
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + np.r_[0, last_b[:-1] + 1][group_a] if len(a) else slice(0)] = a + shared_a * len(first.length)
    order[np.arange(len(b)) + last_a[group_b] + 1 if len(b) else slice(0)] = b + 2 * len(first.length) + shared_b * len(second.length)
    said = shown.take(pa.array(order))
    text = memoryview(_bytes(said))
    bounds = np.r_[0, np.cumsum(pc.binary_length(said).to_numpy(zero_copy_only=False))][bounds_a + bounds_b].tolist()
    parts = [text[s : max(s, e - 1)] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
    groups = [str(x, "ascii") if with_groups else hashlib.sha256(x).hexdigest() if len(x) else "" for x in parts]

    # each end of either side ends the bytes that one pair of tokens shares
    only_a = np.flatnonzero(~shared_a)
    pair = lambda i, j: (a[i] << SECOND_BITS) | b[j]
    document = np.arange(len(texts))
    linked = np.r_[
        (np.repeat(document, n_b) << 32) | pair(np.searchsorted(ea, eb), np.arange(len(b))),
        (np.repeat(document, n_a)[only_a] << 32) | pair(only_a, np.searchsorted(eb, ea[only_a])),
    ]
    linked.sort()
    return Aligned({"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups}, groups, (linked & 0xFFFFFFFF).astype(np.uint32), n_a + n_b - n_groups)


def _packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their bytes by place, so that high ones compress."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, with_groups: bool, slice_bytes: int, block_links: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    held: list[tuple[pa.Array, Aligned]] = []

    def emit() -> Iterator[pa.RecordBatch]:
        different = np.unique(np.concatenate([x.pairs for _, x in held]))
        counts = np.zeros(len(different), np.int64)
        rows = []
        for ids, x in held:
            slot = np.searchsorted(different, x.pairs)
            counts += np.bincount(slot, minlength=len(different))
            bounds = np.r_[0, np.cumsum(x.links)].tolist()
            step = np.diff(slot, prepend=0)
            first = np.asarray(bounds[:-1])[x.links > 0]
            step[first] = slot[first]
            rows.append((ids, x, [_packed(step[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]))
        for k, (ids, x, links) in enumerate(rows):
            n = len(ids)
            head = [0] if k == 0 else []
            one = lambda v, kind, head=head, n=n: pa.array([v if q in head else None for q in range(n)], kind)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([block] * n, pa.int64()), *(pa.array(x.numbers[c], pa.int64()) for c in COUNTED), pa.array(x.groups, pa.string()), pa.array(links, pa.binary()),
                 one(len(different), pa.int64()), one(_packed(different), pa.binary()), one(_packed(counts), pa.binary())],
                names=["doc_id", "block", *COUNTED, "groups", "links", "n_pairs", "pairs", "counts"],
            )

    for batch in batches:
        texts = flat(batch.column(1)).fill_null("")
        for at, n in slices(texts, slice_bytes):
            held.append((batch.column(0).slice(at, n), align_texts(texts.slice(at, n), a_path, b_path, with_groups)))
            if sum(len(x.pairs) for _, x in held) >= block_links:
                yield from emit()
                held, block = [], block + 1
    if held:
        yield from emit()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different pair of a block: its place there and the block's links of it."""
    for batch in batches:
        for block, n, pairs, counts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            pair, count = _unpacked(pairs, n).astype(np.int64), _unpacked(counts, n).astype(np.int64)
            for at in range(0, n, 1 << 16):
                part = slice(at, min(n, at + (1 << 16)))
                size = part.stop - at
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block)), pa.array(np.arange(at, part.stop, dtype=np.int32)), pa.array(pair[part]), pa.array(count[part])], names=["block", "slot", "pair", "n"])


def _answered(documents: pa.Table, answers: pa.Table) -> pa.Table:
    """A block's documents with the sums of their links' answers."""
    slot = answers.column("slot").to_numpy()
    total, best = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
    total[slot], best[slot] = answers.column("total").to_numpy(), answers.column("best").to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for links, n in zip(documents.column("links"), documents.column("n_links").to_pylist(), strict=True):
        own = np.cumsum(_unpacked(links.as_py(), n).astype(np.int64))
        n_best.append(int(best[own].sum()))
        count_sum.append(int(total[own].sum()))
    kept = documents.select(["doc_id", *COUNTED, "groups"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def align(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = True, slice_bytes: int = 1 << 22, block_links: int = 1 << 24) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of every row of docs.

    groups: ids of either side by group, `a1,a2|b1;a3|b2,b3`; without groups: its SHA-256 in hex ('' without tokens).
    n_best: links whose pair is linked as often as any of its second id. count_sum: how often links' pairs are linked, added up.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in COUNTED)
    schema = f"doc_id {kind}, block long, {numbers}, groups string, links binary, n_pairs long, pairs binary, counts binary"
    held = save(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda it: _blocks(it, a_path, b_path, with_groups, slice_bytes, block_links), schema), "aligned")
    asked = held.where("n_pairs is not null").select("block", "n_pairs", "pairs", "counts").mapInArrow(_asked, "block long, slot int, pair long, n long")
    totals = save(asked.select("block", "slot", "pair", F.sum("n").over(Window.partitionBy("pair")).alias("total")), "totals")
    second = F.col("pair").bitwiseAND((1 << SECOND_BITS) - 1)
    # a row for each id of the second vocabulary at most
    most = totals.groupBy(second.alias("second")).agg(F.max("total").alias("most"))
    answers = totals.join(F.broadcast(most), second == F.col("second")).select("block", "slot", "total", (F.col("total") == F.col("most")).alias("best"))
    documents = held.select("doc_id", "block", *COUNTED, "groups", "links")
    return documents.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_answered, f"doc_id {kind}, {numbers}, groups string, n_best long, count_sum long")
