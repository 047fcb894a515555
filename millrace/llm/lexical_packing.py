"""Packing documents with their lexical neighbours: a sharded BM25 inverted index fills each seed's window.

Documents become token ids, which are also the index's terms, so the table of
document frequencies, counted over all documents, has at most as many rows as
the vocabulary. Rows are ordered by their two most telling terms (of tf x idf,
among terms that another document has too) and dealt to tasks by range, so that
documents of a subject lie together; the row's number ends the order, so that no
group of copies is too large for a task. A task cuts its rows into shards of
bounded tokens. For each shard it builds an inverted index of BM25 weights and
goes on greedily: a seed document opens a window, the index returns the shard's
unused documents by their score for the seed's terms (those without a common
term last, in the order of rows), and these fill the window. A document that
does not fit is cut, and what is left of it is the next window's seed. An open
window goes over to the task's next shard. So every window is full but the last
of a task, which is cut to lengths that are powers of two.

A task's memory is that of a shard and of the longest document, whatever the
table's size.

Defined cases: null and empty texts are packed as their end token; a document of
any length is cut over as many windows as it takes; repeated rows and null ids
are documents of their own; an empty table gives no rows; columns other than
doc_id and text are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import WordEnds, flat, slices, spread, words
from millrace.llm.common import save

#: BM25's saturation of repeats and share of the length.
K1, B = 1.2, 0.75
#: Documents whose terms are counted at once.
STEP = 512
_MADE: dict[str, WordEnds] = {}


def _tokens(batches: Iterator[pa.RecordBatch], path: str, end_id: int, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids as two bytes each, n)."""
    if path not in _MADE:
        _MADE[path] = WordEnds(path, plain_specials=False)
    encode = _MADE[path]
    for batch in batches:
        texts = flat(batch.column(1)).fill_null("")
        for at, n in slices(texts, slice_bytes):
            found = words(texts.slice(at, n))
            ids, bounds = encode(found.different).texts(found)
            size = np.diff(bounds)
            whole = np.full(len(ids) + n, end_id, "<u2")
            whole[np.arange(len(ids)) + np.repeat(np.arange(n), size)] = ids
            offsets = 2 * (bounds + np.arange(n + 1))
            told = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(whole)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), told.cast(pa.binary()), pa.array(size + 1, pa.int64())], names=["doc_id", "ids", "n"])


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2") for x in flat(column)]


def _terms(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of ids, whose last is the end's: each row's different terms rising, how often each is there, the row of each, and where each row's begin (and the last's end)."""
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    kind = np.uint32 if len(rows) <= 1 << 16 else np.uint64
    key = np.repeat(np.arange(len(rows), dtype=kind) << kind(16), size) | (np.concatenate(rows) if rows else np.zeros(0, np.uint16))
    body = np.ones(len(key), bool)
    body[np.cumsum(size) - 1] = False
    key = np.sort(key[body])
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    row = (key[first] >> kind(16)).astype(np.int64)
    return (key[first] & kind(0xFFFF)).astype(np.int64), np.diff(np.r_[first, len(key)]), row, np.searchsorted(row, np.arange(len(rows) + 1))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): in how many of a task's documents a term is; -1 counts documents and -2 tokens."""
    counts, documents, tokens = np.zeros(1 << 16, np.int64), 0, 0
    for batch in batches:
        for at in range(0, len(batch), STEP):
            rows = _ids(batch.column(0).slice(at, STEP))
            counts += np.bincount(_terms(rows)[0], minlength=1 << 16)
            documents, tokens = documents + len(rows), tokens + sum(map(len, rows)) - len(rows)
    terms = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, terms]), pa.array(np.r_[tokens, documents, counts[terms]])], names=["term", "n"])


class Statistics:
    """Of the whole table: documents, their mean length, each term's inverse document frequency, and whether two documents have it."""

    def __init__(self, counted: dict[int, int]) -> None:
        self.documents = counted.pop(-1, 0)
        self.length = max(1.0, counted.pop(-2, 0) / max(1, self.documents))
        df = np.zeros(1 << 16)
        df[list(counted.keys())] = list(counted.values())
        self.idf = np.log(1 + (self.documents - df + 0.5) / (df + 0.5))
        self.shared = df >= 2

    def weights(self, terms: np.ndarray, tf: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.length))


def statistics(tokens: DataFrame) -> Statistics:
    """Sums over all documents; as many rows as the vocabulary has ids come to the driver."""
    rows = tokens.select("ids").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return Statistics({r.term: r.n for r in rows})


def _telling(batches: Iterator[pa.RecordBatch], told: Statistics) -> Iterator[pa.RecordBatch]:
    """Rows with their two most telling terms; -1 where there is none."""
    for whole in batches:
        for at in range(0, len(whole), STEP):
            batch = whole.slice(at, STEP)
            terms, tf, row, bounds = _terms(_ids(batch.column(2)))
            value = np.where(told.shared[terms], tf * told.idf[terms], 0.0)
            some = np.flatnonzero(np.diff(bounds))
            two = np.full((2, len(batch)), -1)
            for k in range(2 if len(some) else 0):
                best = np.maximum.reduceat(value, bounds[some])
                # of equally telling terms the one with the smallest id
                where = np.minimum.reduceat(np.where(value == np.repeat(best, np.diff(bounds)[some]), np.arange(len(value)), len(value)), bounds[some])
                two[k][some] = np.where(best > 0, terms[where], -1)
                value[where] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(t.astype(np.int32)) for t in two)], names=[*batch.schema.names, "first", "second"])


class Index:
    """BM25 weights of a shard's documents by term."""

    def __init__(self, shard: list[np.ndarray], told: Statistics) -> None:
        term, tf, document, bounds = _terms(shard)
        self.told, self.terms = told, [term[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        length = np.fromiter((len(ids) - 1 for ids in shard), np.int64, len(shard))
        weight = told.weights(term, tf, length[document])
        order = np.argsort(term.astype(np.uint16), kind="stable")
        self._keep(term[order], document[order], weight[order])
        self.unused = np.ones(len(shard), bool)
        self.left = self.at_build = len(shard)

    def _keep(self, term: np.ndarray, document: np.ndarray, weight: np.ndarray) -> None:
        self.term, self.document, self.weight = term, document, weight
        self.start = np.r_[0, np.cumsum(np.bincount(term, minlength=1 << 16))]

    def use(self, k: int) -> None:
        self.unused[k] = False
        self.left -= 1
        if self.left < self.at_build // 2:
            # documents that are used up leave the lists
            keep = self.unused[self.document]
            self._keep(self.term[keep], self.document[keep], self.weight[keep])
            self.at_build = self.left

    def neighbours(self, terms: np.ndarray) -> Iterator[int]:
        """Unused documents, best first; those without a common term come last, in order."""
        at = spread(self.start[terms], self.start[terms + 1] - self.start[terms])
        score = np.bincount(self.document[at], self.weight[at], minlength=len(self.unused))
        score[~self.unused] = -1.0
        # the best few fill most windows; the others are put in order only when they are asked for
        few = min(16, len(score))
        some = np.argpartition(-score, few - 1)[:few]
        for rest in (few < len(score), False):
            for k in some[np.lexsort((some, -score[some]))].tolist():
                if score[k] >= 0 and self.unused[k]:
                    yield k
            if not rest:
                return
            some = np.setdiff1d(np.arange(len(score)), some)


class Windows:
    """Pieces of windows in the making; full ones are handed out with their numbers."""

    def __init__(self, capacity: int, task: int) -> None:
        self.capacity, self.number = capacity, task << 32
        self.room, self.open, self.full = capacity, [], []

    def put(self, row: tuple, at: int) -> int:
        """Put a row's tokens from a place on; returns the place reached."""
        n = min(self.room, len(row[1]) - at)
        self.open.append((row, at, n))
        self.room -= n
        if not self.room:
            self._close(self.open)
            self.room, self.open = self.capacity, []
        return at + n

    def _close(self, pieces: list) -> None:
        offset = 0
        for row, at, n in pieces:
            self.full.append((row, at, n, self.number, offset))
            offset += n
        self.number += 1

    def finish(self) -> None:
        """Cut the open window to lengths that are powers of two."""
        pieces, self.open, self.room = self.open[::-1], [], self.capacity
        left = sum(n for _, _, n in pieces)
        while left:
            length = 1 << (left.bit_length() - 1)
            left -= length
            own = []
            while length:
                row, at, n = pieces.pop()
                own.append((row, at, min(n, length)))
                if n > length:
                    pieces.append((row, at + length, n - length))
                length -= own[-1][2]
            self._close(own)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Runs of rows (doc_id, ids) with at least so many tokens in all, but for the last."""
    held, size = [], 0
    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), _ids(batch.column(1)), strict=True):
            held.append((doc_id, ids))
            size += len(ids)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _packed(batches: Iterator[pa.RecordBatch], told: Statistics, capacity: int, shard_tokens: int, kind: pa.DataType, with_ids: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    windows, seed = Windows(capacity, TaskContext.get().partitionId()), np.zeros(0, np.int64)

    def done() -> pa.RecordBatch:
        full, windows.full = windows.full, []
        column = lambda values, t=pa.int64(): pa.array(list(values), t)
        bodies = (row[1][at : at + n].astype("<u4") for row, at, n, _, _ in full)
        last = column(bodies, pa.list_(pa.int64())) if with_ids else column(zlib.crc32(b.tobytes()) for b in bodies)
        return pa.RecordBatch.from_arrays(
            [column((f[0][0] for f in full), kind), column(f[1] for f in full), column(f[2] for f in full), last, column(len(f[0][1]) for f in full), column(f[3] for f in full), column(f[4] for f in full)],
            names=["doc_id", "start", "length", "ids" if with_ids else "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )

    for shard in _shards(batches, shard_tokens):
        index, following = Index([ids for _, ids in shard], told), 0
        # a cut document's place in the shard and how far it is packed; the open window's neighbours as they come
        left, near = None, None
        while True:
            if windows.open:
                near = near or index.neighbours(seed)
                k, at = next(near, None), 0
                if k is None:
                    break  # the next shard's documents fill this window
                index.use(k)
            elif left:
                (k, at), left = left, None
                seed = index.terms[k]
            else:
                while following < len(shard) and not index.unused[following]:
                    following += 1
                if following == len(shard):
                    break
                k, at = following, 0
                index.use(k)
                seed = index.terms[k]
            at = windows.put(shard[k], at)
            if at < len(shard[k][1]):
                left = (k, at)
            if not windows.open:
                near = None
        if windows.full:
            yield done()
    windows.finish()
    yield done()


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, shard_tokens: int = 1 << 19, slice_bytes: int = 1 << 23, with_ids: bool = True) -> DataFrame:
    """A row for each piece of every row of docs: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Without ids: their CRC-32 (of unsigned little-endian 32-bit ids) as ids_crc32. capacity is a power of two.
    """
    if capacity < 1 or not math.log2(capacity).is_integer():
        raise ValueError("capacity must be a power of two")
    field = docs.select("doc_id").schema[0]
    kind, arrow = field.dataType.simpleString(), docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    tokens = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda it: _tokens(it, tokenizer, end_id, slice_bytes), f"doc_id {kind}, ids binary, n long")
    tokens = save(tokens.select(F.monotonically_increasing_id().alias("no"), "doc_id", "ids"), "tokens")
    told = statistics(tokens)
    order = ["first", "second", "no"]
    routed = tokens.mapInArrow(lambda it: _telling(it, told), f"no long, doc_id {kind}, ids binary, first int, second int").repartitionByRange(*order).sortWithinPartitions(*order)
    last = "ids array<long>" if with_ids else "ids_crc32 long"
    return routed.select("doc_id", "ids").mapInArrow(
        lambda it: _packed(it, told, capacity, shard_tokens, arrow, with_ids), f"doc_id {kind}, start long, length long, {last}, doc_tokens long, sequence_id long, offset long"
    )
