"""Near-duplicate vectors by product quantisation.

Unit vectors are put into the inverted list of their nearest coarse centroid;
what is left after taking the centroid away is quantised in ``parts`` subspaces
of ``codes`` centroids each. Every vector probes the lists of its ``probes``
nearest centroids and of all centroids near enough for most of their vectors to
link with it; centroids too near to each other are one, so that a crowd of near
copies is not spread over lists: asymmetric distances to the listed codes are read from a
table of the vector's distances to all subspace centroids, and listed vectors
whose distance, less the quantisation error stored with their code, is within
the threshold are compared exactly by cosine in double precision. Since the
triangle inequality bounds the true distance so, the codes lose no pair within
the lists probed.

Equal vectors are one class and searched once, weighted by their number. A
list's task counts each vector's links and sends on a spanning forest of the
links it finds, not the pairs, so a crowd of near copies gives as many rows as
it has members. A pair met from both sides is counted for one side in each of
the two lists, one met from one side only is counted for both there: counts
agree whatever was probed. Large lists are dealt out in blocks, every block of
probing vectors to every block of listed ones.

Centroids are fitted by k-means on a sample of ``fit_rows`` vectors, or of two a
list if that is more; the number of lists is the square root of that of the
vectors, so lists do not grow faster than their number, and probes grow with it
(:func:`probes_of`). Every row is indexed.

Defined cases: null vectors, zero ones, those of another length than most and
those with null or non-finite components link with nothing; a null vec_id is
reported, but stands for no component; rows that repeat a vec_id are vectors of
their own (each links to the other if their cosine says so); an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, lookup, save
from millrace.llm.vectors import matrix, sample, usable


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Centroids of x; fewer than k if x has fewer rows."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        # by parts: the product of all rows with all centroids may be large
        near = np.concatenate([np.argmin((centre**2).sum(1) - 2 * x[at : at + 4096] @ centre.T, axis=1) for at in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return centre


def apart(centre: np.ndarray, least: float = 0.3) -> np.ndarray:
    """Centroids, in order, less those that are nearer than ``least`` to one before: a crowd of near copies is one list."""
    kept: list[int] = []
    for k in range(len(centre)):
        if not kept or ((centre[kept] - centre[k]) ** 2).sum(1).min() >= least**2:
            kept.append(k)
    return centre[kept]


class Quantiser:
    """Coarse centroids and the subspace centroids of residuals."""

    def __init__(self, fit: np.ndarray, lists: int, parts: int, codes: int) -> None:
        x = unit(fit)
        self.coarse = apart(kmeans(x, lists))
        left = x - self.coarse[self.nearest(x)]
        self.edges = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
        self.books = [kmeans(left[:, a:b], codes, seed=k) for k, (a, b) in enumerate(zip(self.edges, self.edges[1:], strict=False))]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The list of every row."""
        return np.argmin((self.coarse**2).sum(1) - 2 * x @ self.coarse.T, axis=1)

    def probes(self, x: np.ndarray, n: int, within: float) -> list[np.ndarray]:
        """For every row the n nearest lists, and all whose centroid is no farther than ``within``."""
        far = (self.coarse**2).sum(1) - 2 * x @ self.coarse.T + (x**2).sum(1)[:, None]
        n = min(n, far.shape[1])
        take = far <= np.maximum(np.partition(far, n - 1, axis=1)[:, n - 1 : n], within**2)
        return np.split(np.nonzero(take)[1].astype(np.int32), np.cumsum(take.sum(1))[:-1])

    def encode(self, x: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of rows in list at, and how far each is from what its code stands for."""
        left = x - self.coarse[at]
        codes, error = np.empty((len(x), len(self.books)), np.int16), np.zeros(len(x))
        for k, book in enumerate(self.books):
            part = left[:, self.edges[k] : self.edges[k + 1]]
            far = (book**2).sum(1) - 2 * part @ book.T + (part**2).sum(1)[:, None]
            codes[:, k] = np.argmin(far, 1)
            error += np.maximum(far[np.arange(len(x)), codes[:, k]], 0)
        return codes, np.sqrt(error)

    def distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of rows of x to the coded vectors of list at, by table look-up."""
        left = x - self.coarse[at]
        total = np.zeros((len(x), len(codes)), np.float32)
        for k, book in enumerate(self.books):
            part = left[:, self.edges[k] : self.edges[k + 1]]
            table = ((book**2).sum(1) - 2 * part @ book.T + (part**2).sum(1)[:, None]).astype(np.float32)
            total += table[:, codes[:, k]]
        return np.sqrt(np.maximum(total, 0))


def _joined(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the edges (p, q) that join components of label, a forest; label is brought up to date in place.

    Every component hooks to the least one that it has an edge to, if that is less than itself; so there are no rings,
    and each round joins all components that touch.
    """
    took_p, took_q = [], []
    while True:
        a, b = label[p], label[q]
        between = a != b
        if not between.any():
            break
        p, q, a, b = p[between], q[between], a[between], b[between]
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((low, high))
        first = order[np.r_[True, high[order][1:] != high[order][:-1]]]
        took_p.append(p[first])
        took_q.append(q[first])
        hook = np.arange(len(label))
        hook[high[first]] = low[first]
        while True:
            further = hook[hook]
            if (further == hook).all():
                break
            hook = further
        label[:] = hook[label]
    none = np.zeros(0, int)
    return np.concatenate(took_p or [none]), np.concatenate(took_q or [none])


def _links(table: pa.Table, quantiser: Quantiser, least: float) -> pa.Table:
    """(a, links, b): what each vector's count grows by (b null), and edges of a spanning forest (links 0)."""
    probing = table["role"].to_numpy() == 1
    rep, weight, home = (table[c].to_numpy() for c in ("rep", "weight", "home"))
    x = unit(matrix(table["embedding"]))
    at = table["list"][0].as_py()
    ragged = table["probes"].combine_chunks()
    sizes = np.diff(ragged.offsets.to_numpy())
    probes = np.full((len(rep), sizes.max(initial=1)), -1, np.int32)
    probes[np.arange(probes.shape[1]) < sizes[:, None]] = ragged.flatten().to_numpy()
    asks, listed = np.flatnonzero(probing), np.flatnonzero(~probing)
    grow = np.zeros(len(rep), np.int64)
    label = np.arange(len(rep))
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    if len(asks) and len(listed):
        codes, error = quantiser.encode(x[listed], at)
        reach = np.sqrt(max(2 - 2 * least, 0)) + error + 1e-4
        for lo in range(0, len(asks), 512):
            part = asks[lo : lo + 512]
            near = (quantiser.distances(x[part], at, codes) <= reach) & (rep[part][:, None] != rep[listed])
            if near.mean() > 1 / 32:
                # many pairs: by one product, which leaves out those that are clearly apart
                near &= x[part] @ x[listed].T >= least - 1e-9
            near_q, near_l = np.nonzero(near)
            for step in range(0, len(near_q), 1 << 17):
                i, j = part[near_q[step : step + (1 << 17)]], listed[near_l[step : step + (1 << 17)]]
                link = np.einsum("ij,ij->i", x[i], x[j]) >= least
                i, j = i[link], j[link]
                np.add.at(grow, i, weight[j])
                back = ~(probes[j] == home[i][:, None]).any(1)  # j does not meet i from its side
                np.add.at(grow, j[back], weight[i[back]])
                edges.append(_joined(label, i, j))
    some = np.flatnonzero(grow)
    a = np.concatenate([rep[some], *(rep[p] for p, _ in edges)])
    b = np.concatenate([np.zeros(len(some), np.int64), *(rep[q] for _, q in edges)])
    is_edge = np.arange(len(a)) >= len(some)
    links = np.concatenate([grow[some], np.zeros(len(a) - len(some), np.int64)])
    return pa.table({"a": pa.array(a, pa.int64()), "links": pa.array(links, pa.int64()), "b": pa.array(b, pa.int64(), mask=~is_edge)})


def _assign(batches, quantiser: Quantiser, probes: int, least: float):
    # beyond the nearest lists, those whose centroid is within one and a half times the distance that links
    within = 1.5 * np.sqrt(max(2 - 2 * least, 0))
    for batch in batches:
        for at in range(0, len(batch), 1024):
            part = batch.slice(at, 1024)
            x = unit(matrix(part.column(2)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(quantiser.nearest(x), pa.int32()), pa.array(quantiser.probes(x, probes, within), pa.list_(pa.int32()))], names=["rep", "weight", "embedding", "home", "probes"])


def probes_of(lists: int) -> int:
    """Lists that a vector probes: of isotropic vectors of 64 dimensions, pairs with a cosine of just 0.9 (the ones that
    are lost first) met in 0.999 and more of the cases at 101, 226, 1000 and 4096 lists."""
    return min(lists, max(12, int(np.ceil(1.2 * lists**0.5))))


def near_duplicates(rows: DataFrame, least: float = 0.9, probes: int | None = None, parts: int = 8, codes: int = 64, fit_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row. probes: by :func:`probes_of` if None."""
    ids = rows.select("vec_id", "embedding")
    # 128 bits of hash stand for a vector where rows find their class
    key = F.struct(F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(11), "embedding").alias("g"))
    # equal vectors are one class; vec_id may repeat, so classes have a number of their own
    classes = usable(ids).groupBy("embedding").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first"))
    classes = save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    none = ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return none
    lists = max(1, round(n**0.5))
    probes = probes or probes_of(lists)
    quantiser = Quantiser(sample(classes, max(fit_rows, 2 * lists)), lists, parts, codes)
    kind = rows.schema["embedding"].dataType.simpleString()
    placed = save(
        classes.select("rep", "weight", "embedding").mapInArrow(lambda it: _assign(it, quantiser, probes, least), f"rep long, weight long, embedding {kind}, home int, probes array<int>"),
        "placed",
    )
    # blocks a list is dealt out in: one row a list
    asked = placed.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("asks"))
    listed = placed.groupBy(F.col("home").alias("list")).agg(F.count(F.lit(1)).alias("holds"))
    blocks = listed.join(asked, "list").select("list", F.ceil(F.col("holds") / block_rows).cast("int").alias("down"), F.ceil(F.col("asks") / (4 * block_rows)).cast("int").alias("across"))
    split = F.xxhash64("rep")
    homes = placed.withColumn("list", F.col("home")).join(blocks, "list").select("*", F.lit(0).alias("role"), F.pmod(split, F.col("down")).cast("int").alias("row"), F.explode(F.expr("sequence(0, across - 1)")).alias("column"))
    asks = placed.withColumn("list", F.explode("probes")).join(blocks, "list").select("*", F.lit(1).alias("role"), F.explode(F.expr("sequence(0, down - 1)")).alias("row"), F.pmod(split, F.col("across")).cast("int").alias("column"))
    met = save(homes.unionByName(asks).groupBy("list", "row", "column").applyInArrow(lambda t: _links(t, quantiser, least), "a long, links long, b long"), "links")
    counted = met.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(met.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    named = classes.join(joined, "rep", "left").join(counted, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    told = named.join(firsts, "component").select(key.alias("key"), "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    found = lookup(ids.select("vec_id", key.alias("key")), save(told, "classes"), "key", "weight", "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
