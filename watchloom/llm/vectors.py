"""Embedding near-duplicates: an exact metric range join over pivot cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import Workspace, connected_components

#: Vectors of a cell that one task holds, and pivots (which bound what is broadcast).
HOME_ROWS, MIN_PIVOTS, MAX_PIVOTS = 8_192, 8, 1_024
#: Vectors of a cell's surroundings compared at once.
STREAM_ROWS = 1_024
#: Cosines this near to the threshold in single precision are computed again in double.
NEAR = 1e-4
SLACK = 1e-6


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if len(column) else np.zeros((0, dim))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision, without overflow for extreme components."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Cells:
    """Pivots with what the triangle inequality needs to bound distances to their cells."""

    def __init__(self, pivots: np.ndarray, reach: float):
        self.pivots, self.reach = pivots, reach
        self.apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
        self.radius = np.full(len(pivots), np.inf)
        self.chunks = np.ones(len(pivots), np.int64)

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest pivot of every unit vector, the distance, and the distances to all."""
        d = np.sqrt(np.maximum(2 - 2 * x @ self.pivots.T, 0))
        home = d.argmin(axis=1)
        return home, d[np.arange(len(x)), home], d

    def within_reach(self, home: np.ndarray, own: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Whether a cell may hold a vector within ``reach`` of each vector: one of radius r about p
        may not if d(x, p) > r + reach, nor if x is further than ``reach`` on its own pivot's side
        of the two pivots' bisector."""
        apart = np.maximum(self.apart[home], 1e-12)
        side = (d**2 - own[:, None] ** 2) / (2 * apart)
        near = (side <= self.reach) & (d <= self.radius + self.reach)
        near[np.arange(len(home)), home] = True
        return near


def _homes(cells, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, radius = np.zeros(len(cells.value.pivots), np.int64), np.zeros(len(cells.value.pivots))
        for batch in batches:
            home, own, _ = cells.value.homes(unit(matrix(batch.column(0), dim)))
            n += np.bincount(home, minlength=len(n))
            np.maximum.at(radius, home, own)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n), pa.array(radius)], ["cell", "n", "radius"])

    return run


def _deal(cells, dim: int):
    """A row for each (cell chunk, vector) that must meet: kind 0 at home, then kind 1 for all in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = cells.value
        for batch in batches:
            x = unit(matrix(batch.column(2), dim))
            ids = batch.column(0).to_numpy()
            for a in range(0, len(x), STREAM_ROWS):
                home, own, d = c.homes(x[a : a + STREAM_ROWS])
                at, cell = np.nonzero(c.within_reach(home, own, d))
                many = c.chunks[cell]
                at, cell = np.repeat(at, many), np.repeat(cell, many)
                chunk = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                start = np.cumsum(c.chunks) - c.chunks
                group = np.r_[start[home] + ids[a : a + STREAM_ROWS] % c.chunks[home], start[cell] + chunk]
                rows = pa.array(np.r_[np.arange(len(home)), at] + a)
                kind = np.r_[np.zeros(len(home), np.int64), np.ones(len(at), np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(kind), *(batch.column(i).take(rows) for i in range(3))], ["g", "kind", "cid", "m", "emb"])

    return run


class _Group:
    """One cell chunk: its home vectors are held, the surrounding ones pass by in blocks."""

    def __init__(self, threshold: float):
        self.threshold, self.held, self.home = threshold, [], None

    def add_home(self, ids: np.ndarray, m: np.ndarray, x: np.ndarray) -> None:
        self.held.append((ids, m, x))

    def meet(self, ids: np.ndarray, m: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(kind 1, a, b) links from passing vectors to home vectors: a spanning star for each."""
        if self.home is None:
            self.ids, self.mult, self.home = (np.concatenate(v) for v in zip(*self.held, strict=True)) if self.held else (ids[:0], m[:0], x[:0])
            self.small = self.home.astype(np.float32)
            self.links, self.root = np.zeros(len(self.ids), np.int64), np.arange(len(self.ids))
        for a in range(0, len(ids), STREAM_ROWS):
            s_ids, s_m, s = ids[a : a + STREAM_ROWS], m[a : a + STREAM_ROWS], x[a : a + STREAM_ROWS]
            cos = s.astype(np.float32) @ self.small.T
            i, j = np.nonzero(cos >= self.threshold - NEAR)
            close = np.flatnonzero(cos[i, j] < self.threshold + NEAR)
            drop = np.zeros(len(i), bool)
            for at in range(0, len(close), 100_000):
                part = close[at : at + 100_000]
                drop[part] = np.einsum("ij,ij->i", s[i[part]], self.home[j[part]]) < self.threshold
            i, j = i[~drop], j[~drop]
            other = s_ids[i] != self.ids[j]
            self.links += np.bincount(j, s_m[i] - (~other), minlength=len(self.links)).astype(np.int64)
            i, j = i[other], j[other]
            if not len(i):
                continue
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])  # i ascends: one link out of each
            hub = np.repeat(j[first], np.diff(np.r_[first, len(i)]))
            self._union(hub, j)
            yield np.ones(len(first), np.int64), s_ids[i[first]], self.ids[j[first]]

    def _union(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root != (up := root[root])).any():
                root = up
        self.root = root

    def close(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(kind 0, vector class, links) of the home vectors and the links between them."""
        if self.home is None:
            return
        yield np.zeros(len(self.ids), np.int64), self.ids, self.links
        linked = np.flatnonzero(self.root != np.arange(len(self.root)))
        yield np.ones(len(linked), np.int64), self.ids[linked], self.ids[self.root[linked]]


def _join(dim: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(parts) -> Iterator[pa.RecordBatch]:
            for kind, a, b in parts:
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b)], ["kind", "a", "b"])

        current, group = None, None
        for batch in batches:
            if not len(batch):
                continue
            g, kind, ids, m = (batch.column(i).to_numpy() for i in range(4))
            x = unit(matrix(batch.column(4), dim))
            cuts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (kind[1:] != kind[:-1])])
            for a, b in zip(cuts, np.r_[cuts[1:], len(g)], strict=True):
                if g[a] != current:
                    if group:
                        yield from rows(group.close())
                    current, group = g[a], _Group(threshold)
                if kind[a]:
                    yield from rows(group.meet(ids[a:b], m[a:b], x[a:b]))
                else:
                    group.add_home(ids[a:b], m[a:b], x[a:b])
        if group:
            yield from rows(group.close())

    return run


def range_join(ws: Workspace, classes: DataFrame, dim: int, threshold: float, home_rows: int = HOME_ROWS, pivots: int | None = None) -> DataFrame:
    """kind, a, b for the distinct vectors (cid, m, emb) of one dimension: kind 0 gives the vectors b
    linked to one vector of class a, copies included; kind 1 links, whose components are all links'.

    A vector is compared in its home cell with every vector that can be in reach, so each count is
    whole in one place. Cells over ``home_rows`` are split in chunks, each of which meets the cell's
    whole surroundings; these pass through in blocks, so a task's memory stays the same.
    """
    spark = classes.sparkSession
    n = classes.count()
    k = min(max(MIN_PIVOTS, -(-n // home_rows)), MAX_PIVOTS, n) if pivots is None else min(pivots, n)
    picked = classes.orderBy(F.xxhash64("emb"), "cid").limit(k).collect()
    cells = Cells(unit(np.array([r.emb for r in picked], np.float64)), float(np.sqrt(2 - 2 * threshold)) + SLACK)
    shared = spark.sparkContext.broadcast(cells)  # MAX_PIVOTS vectors
    stats = classes.select("emb").mapInArrow(_homes(shared, dim), "cell long, n long, radius double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()
    final = Cells(cells.pivots, cells.reach)
    for r in stats:
        final.radius[r.cell], final.chunks[r.cell] = r.radius + SLACK, max(1, -(-r.n // home_rows))
    shared = spark.sparkContext.broadcast(final)
    element = classes.schema["emb"].dataType.simpleString()
    dealt = classes.select("cid", "m", "emb").mapInArrow(_deal(shared, dim), f"g long, kind long, cid long, m long, emb {element}")
    return dealt.repartition("g").sortWithinPartitions("g", "kind").mapInArrow(_join(dim, threshold), "kind long, a long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, home_rows: int = HOME_ROWS, pivots: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings.

    Links are pairs of rows with cosine >= ``threshold`` in double precision; equal vectors are
    joined once and counted as often as they occur. Vectors that are null, empty, all zero or hold a
    null or non-finite component link with nothing, nor do vectors of different dimensions; such a
    row is its own component. A cosine of exactly the threshold links; very long vectors are compared
    whole. Rows without an id take part and show the smallest id in reach, if any; repeated rows each
    come back. Labels and other columns are ignored; an empty table gives no rows.
    """
    ws = Workspace(vectors.sparkSession)
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, F.col("embedding")).alias("emb")).withColumn("h", F.xxhash64("emb"))
    own = rows.where("emb is not null")
    classes = own.groupBy("h", "emb").agg(F.count("*").alias("m"), F.min("vec_id").alias("low"))
    classes = ws.store(classes.select("h", "emb", "m", "low", F.size("emb").alias("dim"), F.monotonically_increasing_id().alias("cid")))
    dims = [r[0] for r in classes.select("dim").distinct().orderBy("dim").collect()]
    found = None
    for dim in dims:
        part = ws.store(range_join(ws, classes.where(F.col("dim") == dim).select("cid", "m", "emb"), dim, threshold, home_rows, pivots))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    roots = connected_components(ws, found.where("kind = 1").select("a", "b"))
    links = found.where("kind = 0").select(F.col("a").alias("cid"), F.col("b").alias("n_links"))
    known = classes.select("cid", "low").join(roots, F.col("cid") == F.col("node"), "left").select("cid", "low", F.coalesce("root", "cid").alias("root"))
    known = ws.store(known)
    lows = known.groupBy("root").agg(F.min("low").alias("component_id"))
    result = ws.store(known.join(lows, "root").join(links, "cid").select("cid", "component_id", "n_links"))
    keyed = classes.select("h", "emb", "cid").join(result, "cid").drop("cid").withColumnsRenamed({"h": "c_h", "emb": "c_emb"})
    joined = rows.join(keyed, (F.col("h") == F.col("c_h")) & (F.col("emb") == F.col("c_emb")), "left")
    component = F.when(F.col("emb").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
