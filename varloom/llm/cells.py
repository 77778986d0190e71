"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Vectors of equal label and equal components are one node. Centroids, fitted to a bounded
sample, divide the sphere into cells; two vectors of one label whose cosine reaches the
threshold are met in the lower-numbered of their cells, to which the one from the other
cell comes as a visitor. Whether a vector must visit a cell follows from its angle to the
plane between that cell's centroid and its own: all of the cell lies beyond that plane, so
a vector further from it than the threshold's angle has no partner there, and every one
nearer pays a visit. So cells prune and never lose a pair, whatever the centroids.

Nodes of a cell are dealt into blocks. A task holds one block and passes the rest of the
cell, later blocks and visitors, by it in matrix products, so memory is bounded by a block
and a batch, and a cell that holds a third of all rows is as many groups as it has blocks.
What leaves a task are numbers of links by node and enough links to connect what is
connected, never all pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import cut, stored, with_line_of
from varloom.llm.graph import components

NEAR = 0.98
#: Nodes that a cell is meant for; cells at most; rows of the sample for each cell; rounds of the fit.
FULL, CELLS, FOR_EACH, ROUNDS = 1024, 1024, 16, 8
#: Nodes of a block, and rows that pass by it at once.
BLOCK, STEP = 4096, 512
#: Room for rounding where an angle is held against the threshold's.
SLACK = 1e-9


def usable(embedding: Column) -> Column:
    """Whether a vector has a direction: not null, of some length, all components finite, not all of them zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(embedding) > 0) & F.forall(embedding, fine) & F.exists(embedding, lambda x: x != 0), F.lit(False))


def units(values: np.ndarray, n: int) -> np.ndarray:
    """(n, components) in double precision and of length one; scaled by the largest component first, so that no square overflows."""
    x = np.asarray(values, np.float64).reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical(u: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """(cells, components) centroids of unit vectors: means of those nearest by cosine, brought to length one."""
    rng = np.random.default_rng(seed)
    c = u[rng.permutation(len(u))[: max(1, min(k, len(u)))]].copy()
    for _ in range(rounds):
        at = np.concatenate([(u[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(u), 4096)])
        mean = np.zeros_like(c)
        np.add.at(mean, at, u)
        size = np.sqrt((mean * mean).sum(axis=1))
        c[size > SLACK] = mean[size > SLACK] / size[size > SLACK, None]
    return np.unique(c, axis=0)


def centroids(nodes: DataFrame, cells: int) -> dict[int, np.ndarray]:
    """Centroids by number of components, of (dim, h1, embedding): fitted in one task to at most cells * FOR_EACH nodes, the first by digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            rows = pd.concat(held).sort_values("h1", kind="stable")
            found = {int(d): spherical(units(np.concatenate(g["embedding"].to_numpy()), len(g)), max(1, cells * len(g) // len(rows))) for d, g in rows.groupby("dim")}
            yield pd.DataFrame({"model": [pickle.dumps(found)]})

    some = nodes.select("dim", "h1", "embedding").orderBy("h1").limit(cells * FOR_EACH)
    made = some.repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else {}


def cells_of(u: np.ndarray, c: np.ndarray | None, near: float = NEAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home cell of each unit vector, rows, cells): the visits each pays to lower-numbered cells."""
    if c is None or len(c) < 2:
        return np.zeros(len(u), int), np.zeros(0, int), np.zeros(0, int)
    sims = u @ c.T
    home = sims.argmax(axis=1)
    between = np.sqrt(np.maximum(2 - 2 * (c @ c.T), SLACK))
    # sine of the angle to the plane between the own centroid and each other
    beyond = (sims[np.arange(len(u)), home][:, None] - sims) / between[home]
    row, cell = np.nonzero((beyond <= np.sqrt(1 - near * near) + SLACK) & (np.arange(len(c)) < home[:, None]))
    return home, row, cell


def placed(nodes: DataFrame, model: dict[int, np.ndarray], near: float, visits: bool) -> DataFrame:
    """(label, dim, cell, visitor, id, times, embedding) of nodes: at home and, with ``visits``, where they visit."""
    names = ["label", "dim", "id", "times", "embedding"]
    fields = [f"{c} {t}" for c, t in nodes.select(*names).dtypes]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            dims = b.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                for at in range(0, len(mine), 2048):
                    some = b.take(pa.array(mine[at : at + 2048]))
                    home, row, cell = cells_of(units(some.column(4).flatten().to_numpy(zero_copy_only=False), some.num_rows), model.get(int(d)), near)
                    n = 0 if not visits else len(row)
                    out = some.take(pa.array(np.concatenate([np.arange(len(home)), row[:n]])))
                    where = pa.array(np.concatenate([home, cell[:n]]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [*out.columns, where, pa.array(np.arange(len(where)) >= len(home))], names=[*names, "cell", "visitor"]
                    )

    return nodes.select(*names).mapInArrow(run, ", ".join([*fields, "cell int", "visitor boolean"]))


class _Block:
    """One block, and what has passed by it: numbers of links and which of its nodes are connected."""

    def __init__(self, near: float):
        self.near, self.parts, self.out = near, [], []
        self.u = None

    def hold(self, ids, times, u):
        self.parts.append((ids, times, u))

    def seal(self):
        if self.u is None:
            self.ids, self.times, self.u = (np.concatenate(p) for p in zip(*self.parts, strict=True))
            self.root, self.n = np.arange(len(self.ids)), np.zeros(len(self.ids), np.int64)
            for at in range(0, len(self.ids), STEP):
                self._met(self.ids[at : at + STEP], self.times[at : at + STEP], self.u[at : at + STEP], at)

    def passing(self, ids, times, u):
        if not self.parts:
            return  # no node fell to this block
        self.seal()
        for at in range(0, len(ids), STEP):
            self._met(ids[at : at + STEP], times[at : at + STEP], u[at : at + STEP], None)

    def _met(self, ids, times, u, own):
        hit = u @ self.u.T >= self.near
        if own is not None:
            hit[np.arange(len(ids)), own + np.arange(len(ids))] = False
        row, col = np.nonzero(hit)
        if not len(row):
            return
        if own is None:
            self.n += np.bincount(col, times[row], len(self.n)).astype(np.int64)
            counts = np.bincount(row, self.times[col], len(ids)).astype(np.int64)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            self.out.append((ids[counts > 0], np.full((counts > 0).sum(), -1), counts[counts > 0]))
            self.out.append((ids[row[first]], self.ids[col[first]], np.zeros(len(first), np.int64)))
        else:
            self.n[own : own + len(ids)] += np.bincount(row, self.times[col], len(ids)).astype(np.int64)
        # nodes of the block that meet one row are connected, and so is the row itself if it is of the block
        start = np.flatnonzero(np.diff(row, prepend=-1))
        nth = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(row))))
        while True:
            least = np.minimum.reduceat(self.root[col], start)
            if own is not None:
                least = np.minimum(least, self.root[own + row[start]])
            before = self.root.copy()
            np.minimum.at(self.root, col, least[nth])
            if own is not None:
                np.minimum.at(self.root, own + row[start], least)
            self.root = np.minimum(self.root, self.root[self.root])
            if (self.root == before).all():
                return

    def rows(self) -> Iterator[pd.DataFrame]:
        if not self.parts:
            return
        self.seal()
        some = self.n > 0
        self.out.append((self.ids[some], np.full(some.sum(), -1), self.n[some]))
        moved = self.root != np.arange(len(self.root))
        self.out.append((self.ids[moved], self.ids[self.root[moved]], np.zeros(moved.sum(), np.int64)))
        a, b, n = (np.concatenate(p) for p in zip(*self.out, strict=True))
        for at in range(0, len(a), 50_000):
            yield pd.DataFrame({"a": a[at : at + 50_000], "b": b[at : at + 50_000], "n": n[at : at + 50_000]})
        self.out = []


def met(nodes: DataFrame, model: dict[int, np.ndarray], near: float = NEAR, block: int = BLOCK) -> DataFrame:
    """(a, b, n): with b = -1 a number n of links of node a, else nodes a and b that links connect (ids are 0 or more)."""
    key = ["label", "dim", "cell"]
    load = placed(nodes, model, near, visits=False).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    load = cut(load.select(*[F.col(c).alias(f"l_{c}") for c in key], F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    rows = with_line_of(placed(nodes, model, near, visits=True), load, [(c, f"l_{c}") for c in key]).where("blocks is not null")
    own = F.when(F.col("visitor"), F.col("blocks")).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a node goes to the blocks before its own, to pass by, and to its own, to be held; a visitor passes by all
    rows = rows.withColumn("own", own)
    upto = F.when(F.col("visitor"), F.col("blocks") - 1).otherwise(F.col("own"))
    rows = rows.select(*key, "id", "times", "embedding", "own", F.explode(F.sequence(F.lit(0), upto)).alias("block"))
    rows = rows.withColumn("passes", (F.col("block") != F.col("own")).cast("int"))
    dealt = rows.repartition(*key, "block").sortWithinPartitions(*key, "block", "passes", "id")

    def run(batches: Iterator) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        key_now, now = None, None
        for b in batches:
            keys = list(zip(*[b.column(i).to_pylist() for i in (0, 1, 2, 7)], strict=True))
            passes = b.column(8).to_numpy(zero_copy_only=False)
            ids, times = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            marks = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1] or passes[i] != passes[i - 1]]
            for lo, hi in zip(marks, [*marks[1:], len(keys)], strict=True):
                if keys[lo] != key_now:
                    if now:
                        yield from _batches(now, pa)
                    key_now, now = keys[lo], _Block(near)
                u = units(b.column(5).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False), hi - lo)
                (now.passing if passes[lo] else now.hold)(ids[lo:hi], times[lo:hi], u)
                if now.u is not None and now.out:
                    yield from _passed(now, pa)
        if now:
            yield from _batches(now, pa)

    return dealt.mapInArrow(run, "a long, b long, n long")


def _batches(block: _Block, pa) -> Iterator:
    for rows in block.rows():
        yield pa.RecordBatch.from_pandas(rows, preserve_index=False)


def _passed(block: _Block, pa) -> Iterator:
    """What has been found of rows that passed by, so that a task doesn't keep it."""
    a, b, n = (np.concatenate(p) for p in zip(*block.out, strict=True))
    block.out = []
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, n)], names=["a", "b", "n"])


def near_duplicates(vectors: DataFrame, near: float = NEAR, block: int = BLOCK, cells: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Rows link if their labels are equal and not null, their vectors have as many components
    and their cosine in double precision is ``near`` or more; null and zero vectors and
    those with null, NaN or infinite components link with nothing. Repeated rows are rows
    of their own and link with each other; the row with a component's smallest vec_id is
    its representative (all rows of that id). Rows with a null vec_id take part, name no
    component unless it has no other, and are not kept; an empty table gives an empty
    result; other columns are ignored.
    """
    digest = lambda salt: F.xxhash64(F.lit(salt), "label", "embedding")
    rows = vectors.select("vec_id", "label", "embedding", (usable(F.col("embedding")) & F.col("label").isNotNull()).alias("usable"))
    rows = rows.withColumns({"h1": digest(1), "h2": digest(2)})
    nodes = rows.where("usable").groupBy("h1", "h2").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times")
    )
    nodes = stored(nodes.select("*", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("id")), "nodes")
    many = min(CELLS, max(1, nodes.count() // FULL)) if cells is None else cells
    found = stored(met(nodes, centroids(nodes, many), near, block), "links")
    counts = found.where("b < 0").groupBy(F.col("a").alias("c_id")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b >= 0").select("a", "b"))
    named = nodes.select("h1", "h2", "id", "least", "times").join(roots, F.col("id") == F.col("node"), "left")
    named = named.join(counts, F.col("id") == F.col("c_id"), "left").select("h1", "h2", "least", "times", "root", F.coalesce("n", F.lit(0)).alias("n"))
    named = cut(named)
    heads = named.where("root is not null").groupBy("root").agg(F.min("least").alias("head"))
    heads = named.join(heads, "root", "left").select(
        F.col("h1").alias("g1"), F.col("h2").alias("g2"), (F.col("n") + F.col("times") - 1).alias("n_links"), F.coalesce("head", "least").alias("head")
    )
    out = rows.drop("embedding", "label").join(heads, F.col("usable") & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    component = F.coalesce("head", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
