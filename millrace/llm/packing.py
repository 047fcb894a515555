"""Packing token sequences by a grouping genetic algorithm on islands.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.
Pieces are dealt by hash to shards of some thousand pieces. On each shard
several islands evolve packings of the shard's pieces: crossover injects whole
well-filled sequences of one packing into another, removes the sequences that
held the same pieces, and best-fits the displaced pieces; the initial ones are
best-fit packings of the pieces by falling length and of orders near it. After
an epoch each island's elite migrates to the next island of its shard, and
the best island's packing stands. Pieces of poorly filled sequences of all
shards are then dealt anew and evolved once more, so that no shard's rest is
left alone in a sequence.

An island's work and memory are those of one shard, whatever the table's size.

Defined cases: null text is packed as empty text (its end token alone); a
document whose length is a multiple of the capacity has full pieces only;
repeated rows and null ids are pieces of their own; an empty table gives no
rows; extra columns of :func:`pack`'s input are kept, whatever their names
(sequence_id and offset are replaced).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.chunks import byte_of, merges_agree
from millrace.llm.common import save

#: The usual way of byte-level vocabularies to cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose kind may depend on the version of Unicode a library knows.
BEYOND = re.compile("[\u0590-\U0010ffff]")
#: Texts with this many characters in a row that hold no space, or white space alone, are for the encoder whose time and
#: stack do not grow with such runs.
LONG = 1000


def _ranks(told: dict) -> dict[bytes, int] | None:
    """The vocabulary of a tokenizer's description as byte strings with their ranks; None if it is not a byte-level one that cuts and merges the usual way."""
    before, model = told["pre_tokenizer"] or {}, told["model"]
    usual = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and told["normalizer"] is None
    if not usual or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    byte = byte_of()
    code = lambda t: bytes(byte[c] for c in t)
    pairs = [tuple(map(code, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    ranks = {code(t): i for t, i in model["vocab"].items() if i < 256 + len(pairs) and all(c in byte for c in t)}
    ordered = all(ranks.get(a + b) == 256 + k for k, (a, b) in enumerate(pairs)) and sorted(ranks.get(bytes([b]), -1) for b in range(256)) == list(range(256))
    return ranks if ordered and merges_agree(ranks, pairs) else None


class Tokens:
    """Token ids of texts, as unsigned 32-bit bytes of this machine, as the tokenizers library gives them; special tokens' strings are special tokens.

    Where the vocabulary's merges are numbered in their order and merging by
    rank ends each of them with its own pair, which is checked for all when it
    is loaded, tiktoken makes the same ids from it in a quarter of the time; it
    encodes the texts that hold no special token's string, whose characters both
    libraries know alike and that have no very long run of one kind.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        told = json.loads(self.model.to_str())
        self.special = [t["content"] for t in told["added_tokens"]]
        self.fast = None
        if ranks := _ranks(told):
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        plain = self.fast and (text.isascii() or not BEYOND.search(text)) and not any(s in text for s in self.special)
        if plain and all(text.find(" ", k, k + LONG) >= 0 and not text[k : k + LONG].isspace() for k in range(0, len(text) - LONG + 1, LONG)):
            return self.fast.encode_to_numpy(text, disallowed_special=()).tobytes()
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()


_TOKENS: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One per worker process."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first may be shorter."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = tokens(path)
    end = np.asarray([end_id], "<u4").tobytes()
    for whole in batches:
        for at in range(0, len(whole), 64):  # long texts: bounded memory
            batch = whole.slice(at, 64)
            origin, no, start, length, last = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                for n, (s, size) in enumerate(cuts(len(ids) // 4, capacity)):
                    body = ids[4 * s : 4 * (s + size)]
                    origin.append(k)
                    no.append(n)
                    start.append(s)
                    length.append(size)
                    last.append(np.frombuffer(body, "<i4") if with_ids else zlib.crc32(body))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(origin, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(last, pa.list_(pa.int32()) if with_ids else pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids" if with_ids else "ids_crc32"],
            )


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every piece of docs; without ids: their CRC-32 as ids_crc32."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = "ids array<int>" if with_ids else "ids_crc32 long"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda it: _pieces(it, tokenizer, end_id, capacity, with_ids), f"doc_id {kind}, piece int, start long, length long, {last}")


class Packing:
    """Sequences as lists of piece numbers; free room of each."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []

    def best_fit(self, items: list[int], size: list[int]) -> Packing:
        """Put items, in this order, where the least room is left; open a sequence where none has room."""
        rooms = sorted((f, k) for k, f in enumerate(self.free) if f)
        for i in items:
            need = size[i]
            at = bisect_left(rooms, (need, -1))
            if at < len(rooms):
                room, k = rooms.pop(at)
                self.bins[k].append(i)
            else:
                room, k = self.capacity, len(self.bins)
                self.bins.append([i])
                self.free.append(0)
            self.free[k] = room - need
            if room > need:
                insort(rooms, (room - need, k))
        return self

    def fitness(self) -> tuple[int, int]:
        """Fewer sequences are better, then fuller ones (sum of squared fills)."""
        return -len(self.bins), sum((self.capacity - f) ** 2 for f in self.free)

    def cross(self, other: Packing, size: list[int], rng: np.random.Generator) -> Packing:
        """A child: whole well-filled sequences of other, those of this that share no piece with them, the rest best-fitted."""
        full = [k for k, f in enumerate(other.free) if f <= self.capacity // 64]
        if not full:
            full = list(np.argsort(other.free, kind="stable")[: max(1, len(other.free) // 4)])
        lo, hi = sorted(int(x) for x in rng.integers(0, len(full) + 1, 2))
        chosen = [other.bins[k] for k in full[lo:hi]]
        given = {i for b in chosen for i in b}
        child, displaced = Packing(self.capacity), []
        for b, f in zip(self.bins, self.free, strict=True):
            if given.isdisjoint(b):
                # the emptiest sequences are dissolved too, so that their pieces find better places
                if f > self.capacity // 4 and rng.random() < 0.5:
                    displaced += b
                else:
                    child.bins.append(list(b))
                    child.free.append(f)
            else:
                displaced += [i for i in b if i not in given]
        for b in chosen:
            child.bins.append(list(b))
            child.free.append(self.capacity - sum(size[i] for i in b))
        return child.best_fit(sorted(displaced, key=lambda i: -size[i]), size)


def evolve(size: list[int], capacity: int, seed: int, start: list[Packing] | None = None, population: int = 6, generations: int = 12) -> Packing:
    """The best packing of pieces of these sizes found on one island."""
    rng = np.random.default_rng(seed)
    falling = sorted(range(len(size)), key=lambda i: (-size[i], i))
    bound = -(-sum(size) // capacity)
    pool = list(start or [Packing(capacity).best_fit(falling, size)])
    noise = np.asarray(size, float)
    while len(pool) < population and len(pool[0].bins) > bound:
        order = np.argsort(-noise * rng.uniform(1 - 0.02 * len(pool), 1, len(size)), kind="stable")
        pool.append(Packing(capacity).best_fit(order.tolist(), size))
    for _ in range(generations):
        pool.sort(key=Packing.fitness, reverse=True)
        if len(pool[0].bins) <= bound or len(pool) < 2:
            break
        a, b = (int(x) for x in rng.choice(len(pool) // 2 + 1, 2, replace=False))
        child = pool[a].cross(pool[b], size, rng)
        if child.fitness() > pool[-1].fitness():
            pool[-1] = child
    return max(pool, key=Packing.fitness)


def _rebuild(size: list[int], place: list[int], capacity: int) -> Packing:
    out = Packing(capacity)
    at: dict[int, int] = {}
    for i, p in enumerate(place):
        if p not in at:
            at[p] = len(out.bins)
            out.bins.append([])
            out.free.append(capacity)
        out.bins[at[p]].append(i)
        out.free[at[p]] -= size[i]
    return out


def _places(packing: Packing, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(packing.bins):
        for i in b:
            out[i] = k
    return out


def _epoch(table: pa.Table, capacity: int, generations: int) -> pa.Table:
    """One epoch of one island: rows are its shard's pieces, with the places that earlier elites gave them."""
    table = table.sort_by([("no", "ascending")])
    size = table["length"].to_pylist()
    start = [_rebuild(size, table[c].to_pylist(), capacity) for c in ("own", "elite") if len(table) and table[c][0].is_valid]
    seed = table["shard"][0].as_py() * 1009 + table["island"][0].as_py() * 2 + bool(start)
    got = evolve(size, capacity, seed, start, generations=generations)
    columns = {"shard": table["shard"], "island": table["island"], "no": table["no"], "length": table["length"], "place": pa.array(_places(got, len(size)), pa.int64()), "sequences": pa.array([len(got.bins)] * len(size), pa.int64())}
    return pa.table(columns)


def pack(items: DataFrame, capacity: int = 1024, islands: int = 2, shard_rows: int = 4096, generations: int = 12) -> DataFrame:
    """items (with a long column length, from 1 to capacity) with sequence_id and offset: gapless in each sequence."""
    names = [c for c in items.columns if c not in ("sequence_id", "offset")]
    # a fixed number for every row, by which it is found again; written, so that it stays; the row itself is one column
    numbered = save(items.select(F.struct(*names).alias("row"), "length", F.monotonically_increasing_id().alias("no")), "items")

    def evolved(rows: DataFrame, salt: int) -> DataFrame:
        """(no, length, shard, place) of rows (no, length) packed anew."""
        n = rows.count()
        shards = max(1, -(-n // shard_rows))
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("no", F.lit(salt)), F.lit(shards)))
        schema = "shard long, island int, no long, length long, place long, sequences long"
        first = dealt.withColumn("island", F.explode(F.array(*(F.lit(k) for k in range(islands))))).select("shard", "island", "no", "length", F.lit(None).cast("long").alias("own"), F.lit(None).cast("long").alias("elite"))
        one = save(first.groupBy("shard", "island").applyInArrow(lambda t: _epoch(t, capacity, generations), schema), "epoch")
        # elite migration: each island also gets the packing of the one before it
        moved = one.select("shard", ((F.col("island") + 1) % islands).alias("island"), "no", F.col("place").alias("elite"))
        second = one.withColumnRenamed("place", "own").join(moved, ["shard", "island", "no"]).select("shard", "island", "no", "length", "own", "elite")
        two = save(second.groupBy("shard", "island").applyInArrow(lambda t: _epoch(t, capacity, generations), schema), "epoch")
        best = two.groupBy("shard").agg(F.min(F.struct("sequences", "island")).alias("b")).select("shard", F.col("b.island").alias("island"))
        return two.join(best, ["shard", "island"]).select("no", "length", "shard", "place")

    partial = numbered.where(F.col("length") < capacity).select("no", "length")
    packed = save(evolved(partial, 1), "packed")
    poor = packed.groupBy("shard", "place").agg(F.sum("length").alias("fill")).where(F.col("fill") < capacity - capacity // 16)
    again = save(packed.join(poor.select("shard", "place"), ["shard", "place"]).select("no", "length"), "poor")
    kept = packed.join(poor, ["shard", "place"], "left_anti")
    # sequence numbers: the round in the two lowest bits
    placed = (
        numbered.where(F.col("length") == capacity).select("no", "length", (F.col("no") * 4).alias("sequence_id"))
        .union(kept.select("no", "length", ((F.col("shard") * (1 << 24) + F.col("place")) * 4 + 1).alias("sequence_id")))
        .union(evolved(again, 2).select("no", "length", ((F.col("shard") * (1 << 24) + F.col("place")) * 4 + 2).alias("sequence_id")))
    )
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    return numbered.join(placed.select("no", "sequence_id", offset.alias("offset")), "no").select("row.*", "sequence_id", "offset")
