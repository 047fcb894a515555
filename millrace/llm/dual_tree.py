"""Compression of vectors to codes: integer Lloyd rounds on two trees for each part position.

Components become integers floor(256 * x); vectors are cut into equal parts and
each part position has a codebook. A task takes blocks of vectors. For each part
position it builds a tree over the block's parts, halved along the widest side of
each node, and a tree over the codebook's entries, and walks both together.
Integer bounds of the distance between two nodes' boxes prune pairs whose entries
cannot be nearest; a node of parts with a single entry left goes to it whole,
with the sums cached in the node; parts of leaves with several entries left are
compared one by one in integers, so that codes, ties and means are exact.

Only sums and counts of entries leave a task, and only codebooks (of a size the
parameters fix) pass the driver.

Defined cases: vectors that are null, empty, hold null or non-finite components,
or have another number of components than most do (the smaller number if two are
as common) are dropped; a number of components that the parts do not divide is
filled up with zeros; fewer vectors than entries give as many entries as there
are vectors; repeated rows and ids are vectors of their own, null ids come last;
an empty table gives no rows. Integers of any size are exact; an error beyond the
range of a long is given as the largest long. Columns of other names are not
looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import lookup, save

LARGEST = 2**63 - 1
#: Sums leave tasks as digits of this many bits, so that they are exact at any size.
LIMB = 48


def kept(rows: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, embedding as doubles, label as text or null) of the vectors that take part."""
    value = F.col(column).cast("array<double>")
    whole = rows.where(F.col(column).isNotNull() & (F.size(column) > 0)).select(
        F.col(id_column).alias("vec_id"), value.alias("embedding"), F.col(label).cast("string").alias("label")
    ).where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    lengths = whole.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return whole.where(F.size("embedding") == (lengths.d if lengths else 0))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x): as 64-bit integers if all squared distances of vectors stay within them, else as integers of any size."""
    if not x.size or np.abs(x).max() * 256 < 2**30 / math.sqrt(max(1, x.shape[-1])):
        return np.floor(x * 256).astype(np.int64)
    # a double of 2**52 or more is an integer itself
    exact = [int(v) * 256 if abs(v) >= 2**52 else math.floor(v * 256) for v in x.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(x.shape)


def parts_of(column: pa.Array, parts: int) -> np.ndarray:
    """(vectors, parts, width) integers of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = integers(flat.reshape(len(column), -1))
    missing = -x.shape[1] % parts
    if missing:
        x = np.concatenate([x, np.zeros((len(x), missing), x.dtype)], axis=1)
    return x.reshape(len(x), parts, -1)


class Tree:
    """Points halved again and again along the widest side of each node, all nodes of a level at once.

    Level h has 2**h nodes; ``order`` lists the points so that every node's are
    a slice. The last point is repeated with weight zero until leaves are equal.
    """

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        n = len(points)
        self.depth = max(0, math.ceil(math.log2(max(1, n) / leaf)))
        padded = math.ceil(n / 2**self.depth) * 2**self.depth
        order = np.minimum(np.arange(padded), n - 1)
        weight = np.arange(padded) < n
        for h in range(self.depth):
            x = points[order].reshape(2**h, padded >> h, -1)
            side = (x.max(1) - x.min(1)).argmax(1)
            along = np.take_along_axis(x, side[:, None, None], 2)[:, :, 0]
            by = along.argsort(1, kind="stable") + np.arange(2**h)[:, None] * (padded >> h)
            order, weight = order[by.ravel()], weight[by.ravel()]
        self.order, self.weight = order, weight
        self.points = points[order]
        self.low, self.high, self.sums, self.counts = [], [], [], []
        weighted = np.where(weight[:, None], self.points, 0)
        for h in range(self.depth + 1):
            x = self.points.reshape(2**h, padded >> h, -1)
            self.low.append(x.min(1))
            self.high.append(x.max(1))
            self.sums.append(weighted.reshape(2**h, padded >> h, -1).sum(1))
            self.counts.append(weight.reshape(2**h, padded >> h).sum(1))


def _bounds(low: np.ndarray, high: np.ndarray, elow: np.ndarray, ehigh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance between points of two boxes."""
    gap = np.maximum(np.maximum(elow - high, low - ehigh), 0)
    span = np.maximum(high - elow, ehigh - low)
    return (gap * gap).sum(1), (span * span).sum(1)


def _never_nearer(low: np.ndarray, high: np.ndarray, entry: np.ndarray, rival: np.ndarray) -> np.ndarray:
    """Least value, over a box, of the squared distance to entry less that to rival."""
    slope = 2 * (entry - rival)
    corner = np.where(slope > 0, high, low)
    return (entry * entry - rival * rival - slope * corner).sum(1)


def assign(tree: Tree, entries: np.ndarray, sums: np.ndarray, counts: np.ndarray, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each of the tree's points and its squared distance; adds the points to their entries' sums and counts.

    seen, if given, counts the node pairs looked at, points assigned by whole
    nodes, and distances of single points.
    """
    n = int(tree.weight.sum())
    # of equal entries the first gets all
    _, first = np.unique(entries.astype(str) if entries.dtype == object else entries, axis=0, return_index=True)
    live = np.sort(first)
    other = Tree(entries[live], 1)
    name = live[other.order]
    leaves = tree.order.size >> tree.depth
    code = np.zeros(tree.order.size, np.int64)
    # pairs of a node of parts and a node of entries, by the former
    node, entry, h, e = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while len(node):
        at_entries = e == other.depth
        low, high = tree.low[h][node], tree.high[h][node]
        least, most = _bounds(low, high, other.low[e][entry], other.high[e][entry])
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        size = np.diff(np.r_[start, len(node)])
        keep = least <= np.repeat(np.minimum.reduceat(most, start), size)
        if at_entries:
            # the entry nearest to the middle of the box rules out those that no point of the box is nearer to
            own = name[entry]
            twice = 2 * entries[own] - (low + high)
            middle = (twice * twice).sum(1)
            nearest = np.repeat(np.minimum.reduceat(middle, start), size)
            rival = np.repeat(np.minimum.reduceat(np.where(middle == nearest, own, len(entries)), start), size)
            margin = _never_nearer(low, high, entries[own], entries[rival])
            keep &= (own == rival) | (margin < 0) | ((margin == 0) & (own < rival))
        if seen is not None:
            seen["pairs"] = seen.get("pairs", 0) + len(node)
        node, entry = node[keep], entry[keep]
        if at_entries:
            start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            size = np.diff(np.r_[start, len(node)])
            single = start[size == 1]
            if len(single):
                whole, to = node[single], name[entry[single]]
                np.add.at(sums, to, tree.sums[h][whole])
                np.add.at(counts, to, tree.counts[h][whole])
                code.reshape(2**h, -1)[whole] = to[:, None]
                if seen is not None:
                    seen["whole"] = seen.get("whole", 0) + int(tree.counts[h][whole].sum())
            left = np.repeat(size > 1, size)
            node, entry = node[left], entry[left]
            if h == tree.depth:
                _leaves(tree, entries, name, node, entry, leaves, code, sums, counts, seen)
                break
        if h < tree.depth:
            h, node, entry = h + 1, (2 * node[:, None] + [0, 1]).ravel(), entry.repeat(2)
        if not at_entries:
            e, node, entry = e + 1, node.repeat(2), (2 * entry[:, None] + [0, 1]).ravel()
        by = np.lexsort((entry, node))
        node, entry = node[by], entry[by]
        # entries stand once each: drop the repeats that fill up their tree
        if e == other.depth:
            real = other.weight[entry]
            node, entry = node[real], entry[real]
    out = np.zeros(n, np.int64)
    out[tree.order[tree.weight]] = code[tree.weight]
    apart = tree.points - entries[code]
    error = np.zeros(n, tree.points.dtype)
    error[tree.order[tree.weight]] = (apart * apart).sum(1)[tree.weight]
    return out, error


def _leaves(tree, entries, name, node, entry, leaves, code, sums, counts, seen) -> None:
    """Points of leaves with several entries left, one by one in integers."""
    if not len(node):
        return
    points = tree.points.reshape(-1, leaves, tree.points.shape[1])
    apart = points[node] - entries[name[entry]][:, None, :]
    far = (apart * apart).sum(2)
    start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    size = np.diff(np.r_[start, len(node)])
    best = np.repeat(np.minimum.reduceat(far, start, axis=0), size, axis=0)
    to = np.minimum.reduceat(np.where(far == best, name[entry][:, None], len(entries)), start, axis=0)
    which = node[start]
    code.reshape(-1, leaves)[which] = to
    real = tree.weight.reshape(-1, leaves)[which]
    np.add.at(sums, to[real], points[which][real])
    np.add.at(counts, to[real], 1)
    if seen is not None:
        seen["single"] = seen.get("single", 0) + far.size


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches joined to blocks of at least ``rows`` rows, but for the last: larger trees prune more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    got = table.column(name).combine_chunks()
    return got.chunk(0) if isinstance(got, pa.ChunkedArray) else got


def _together(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in one kind of integers, that of any size if either needs it."""
    if object in (x.dtype, book.dtype):
        return x.astype(object), book.astype(object)
    return x, book


def _limbs(value: int) -> list[int]:
    sign, value, out = (-1 if value < 0 else 1), abs(int(value)), []
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], leaf: int, block_rows: int) -> Iterator[pa.RecordBatch]:
    """(part, entry, place, limb, value) of a task's sums; place -1 has the counts."""
    parts, entries = len(books), len(books[0])
    total = [[np.zeros((entries, books[0].shape[1]), object), np.zeros(entries, np.int64)] for _ in range(parts)]
    for table in _blocks(batches, block_rows):
        x = parts_of(_column(table, "embedding"), parts)
        for p in range(parts):
            own, book = _together(x[:, p], books[p])
            sums = np.zeros(book.shape, own.dtype)
            assign(Tree(own, leaf), book, sums, total[p][1])
            total[p][0] += sums.astype(object)
    out = [
        (p, e, place, limb, v)
        for p, (sums, counts) in enumerate(total)
        for e in np.flatnonzero(counts).tolist()
        for place, whole in [(-1, counts[e]), *enumerate(sums[e])]
        for limb, v in enumerate(_limbs(whole))
    ]
    columns = list(zip(*out, strict=True)) if out else [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "place", "limb", "value"])


def _codes(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], leaf: int, block_rows: int) -> Iterator[pa.RecordBatch]:
    for table in _blocks(batches, block_rows):
        x = parts_of(_column(table, "embedding"), len(books))
        digits, error = np.zeros((len(x), len(books)), np.int64), 0
        for p, whole in enumerate(books):
            own, book = _together(x[:, p], whole)
            sums, counts = np.zeros(book.shape, own.dtype), np.zeros(len(book), np.int64)
            digits[:, p], far = assign(Tree(own, leaf), book, sums, counts)
            error = error + far.astype(object) if far.dtype == object or isinstance(error, np.ndarray) and error.dtype == object else error + far
        wide = 2 * max(1, math.ceil(max(1, (len(books[0]) - 1).bit_length()) / 8))
        hexes = [f"{k:0{wide}x}" for k in range(len(books[0]))]
        code = ["".join([hexes[k] for k in row]) for row in digits.tolist()]
        yield pa.RecordBatch.from_arrays(
            [_column(table, "vec_id"), _column(table, "label"), pa.array(code, pa.string()), pa.array([min(v, LARGEST) for v in error.tolist()], pa.int64())], names=["vec_id", "label", "code", "error"]
        )


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, leaf: int = 8, block_rows: int = 16384) -> list[np.ndarray]:
    """Codebooks, one (entries, width) array a part position, after ``rounds`` Lloyd rounds from the vectors with the least ids.

    vectors: what :func:`kept` gives. Rows that repeat an id start in the order of their components.
    """
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    if not len(first):
        return []
    start = parts_of(_column(first, "embedding"), parts)
    books = [start[:, p] for p in range(parts)]
    for _ in range(rounds):
        now = books
        told = vectors.select("embedding").mapInArrow(lambda it: _sums(it, now, leaf, block_rows), "part long, entry long, place long, limb long, value long")
        summed: dict[tuple[int, int, int], int] = {}
        # at most parts * entries * (width + 1) numbers of a few limbs
        for r in told.groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v")).collect():
            at = (r.part, r.entry, r.place)
            summed[at] = summed.get(at, 0) + (int(r.v) << (LIMB * r.limb))
        books = [_means(book, p, summed) for p, book in enumerate(now)]
    return books


def _means(book: np.ndarray, part: int, summed: dict[tuple[int, int, int], int]) -> np.ndarray:
    out = book.copy()
    for e in range(len(book)):
        if n := summed.get((part, e, -1)):
            out[e] = [summed.get((part, e, d), 0) // n for d in range(book.shape[1])]
    return out


def encode(vectors: DataFrame, books: list[np.ndarray], leaf: int = 8, block_rows: int = 16384) -> DataFrame:
    """(vec_id, label, code, error) of every vector under the codebooks."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, label string, code string, error long"
    if not books:
        return vectors.sparkSession.createDataFrame([], schema)
    return vectors.mapInArrow(lambda it: _codes(it, books, leaf, block_rows), schema)


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components as decimal integers, by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def _long(total: Column) -> Column:
    return F.least(total, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")


def compress(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): each vector's code and what the codes lose."""
    vectors = kept(rows)
    books = fit(vectors, parts, entries, rounds)
    coded = save(encode(vectors, books).withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("-"))), "codes")
    total = coded.groupBy("key").agg(_long(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"), F.count(F.lit(1)).alias("n"))
    return lookup(coded, total, "key", "n").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The same in DuckDB by comparing every part with every entry."""
    nearest = "(SELECT k.pos, k.vec_id, k.part, arg_min(b.entry, struct_pack(d := {d}, e := b.entry)) AS entry, min({d}) AS far FROM cut k JOIN {book} b ON b.pos = k.pos GROUP BY ALL)"
    d = "list_sum(list_transform(list_zip(k.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(rounds):
        steps.append(
            f"near{r} AS {nearest.format(d=d, book=f'book{r}')}, flat{r} AS (SELECT pos, entry, unnest(part) AS x, generate_subscripts(part, 1) AS i FROM near{r}), "
            f"mean{r} AS (SELECT pos, entry, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM flat{r} GROUP BY ALL), "
            f"new{r} AS (SELECT pos, entry, list(x ORDER BY i) AS part FROM mean{r} GROUP BY ALL), "
            f"book{r + 1} AS (SELECT b.pos, b.entry, coalesce(n.part, b.part) AS part FROM book{r} b LEFT JOIN new{r} n ON n.pos = b.pos AND n.entry = b.entry)"
        )
    return f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pos AS (SELECT unnest(range({parts})) AS pos),
    cut AS (SELECT vec_id, label, pos, v[pos * (len(v) // {parts}) + 1 : (pos + 1) * (len(v) // {parts})] AS part FROM kept, pos),
    first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}),
    book0 AS (SELECT c.pos, f.entry, c.part FROM cut c JOIN first f USING (vec_id)),
    {', '.join(steps)},
    final AS {nearest.format(d=d, book=f'book{rounds}')},
    codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, CAST(sum(far) AS BIGINT) AS error FROM final GROUP BY vec_id),
    books AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM book{rounds})
    SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, b.codebooks_sha256
    FROM codes c JOIN kept k USING (vec_id), books b"""
