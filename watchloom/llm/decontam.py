"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from watchloom.llm.common import Workspace, mark_maybe, maybe_among, text_identity, worker_state

#: Words of a seed and of the shortest tile; share of a test item's words that tiles must cover.
TILE, COVERAGE = 5, 0.8
#: Words of benchmark text that one broadcast index holds; a larger benchmark is run in blocks.
BLOCK_WORDS = 500_000
WORD = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15

HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("item_words", T.IntegerType()), T.StructField("covered", T.IntegerType()), T.StructField("tiles", T.IntegerType())])


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of every run of n ids (arithmetic modulo 2**64)."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    h, x = np.zeros(len(ids) - n + 1, np.uint64), ids.astype(np.uint64) + np.uint64(1)
    for i in range(n):
        h = h * np.uint64(_BASE) + x[i : i + len(h)]
    return h ^ (h >> np.uint64(29))


@dataclass
class Index:
    """Seeds of a block of test items by their Karp-Rabin hash: runs of ``tile`` words, or the whole
    item where it is shorter."""

    vocabulary: dict[str, int]
    items: dict[int, np.ndarray]  # ordinal -> word ids
    names: dict[int, int]  # ordinal -> item_id
    seeds: dict[int, tuple[np.ndarray, np.ndarray]]  # words of a seed -> sorted hashes, (ordinal, position) of each
    tile: int

    @classmethod
    def of(cls, rows: list[tuple[int, list[str]]], tile: int = TILE) -> Index:
        vocabulary: dict[str, int] = {}
        items, names = {}, {}
        by_size: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for n, (item, words) in enumerate(rows):
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int64)
            items[n], names[n] = ids, item
            if size := min(tile, len(ids)):
                h = rolling(ids, size)
                by_size[size].append((h, np.stack([np.full(len(h), n), np.arange(len(h))], axis=1)))
        seeds = {}
        for size, parts in by_size.items():
            h, at = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            order = np.argsort(h, kind="stable")
            seeds[size] = h[order], at[order]
        return cls(vocabulary, items, names, seeds, tile)

    def hits(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, item words, words covered, tiles) of every item that shares a seed."""
        if not self.seeds:
            return []
        known = self.vocabulary.get
        doc = np.array([known(w, 0) for w in words_of(text)], np.int64)
        out = []
        for size, (hashes, where) in self.seeds.items():
            h = rolling(doc, size)
            lo = np.searchsorted(hashes, h)
            found = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == h)
            if not len(found):
                continue
            lo = lo[found]
            n = np.searchsorted(hashes, h[found], side="right") - lo
            pos = np.repeat(found, n)
            entry = np.repeat(lo, n) + np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)
            order = np.argsort(where[entry, 0], kind="stable")
            entry, pos = entry[order], pos[order]
            cuts = np.flatnonzero(np.r_[True, np.diff(where[entry, 0]) != 0, True])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                item = int(where[entry[a], 0])
                tiles = tile_pairs(self.items[item], doc, np.stack([where[entry[a:b], 1], pos[a:b]], axis=1), size)
                if tiles:
                    out.append((item, self.names[item], len(self.items[item]), sum(t[2] for t in tiles), len(tiles)))
        return [x[1:] for x in sorted(out)]


def tile_pairs(item: np.ndarray, doc: np.ndarray, seeds: np.ndarray, tile: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy tiling: (item start, doc start, words) of the longest common runs, longest first (ties:
    earliest in the item, then in the document), no word of either text in two tiles, none shorter
    than ``tile``. ``seeds`` holds the starts of all common runs of ``tile`` words."""
    same = (item[seeds[:, 0][:, None] + np.arange(tile)] == doc[seeds[:, 1][:, None] + np.arange(tile)]).all(axis=1)
    seeds = seeds[same]  # the seeds' hashes are verified word by word
    if not len(seeds):
        return []
    diagonal = seeds[:, 1] - seeds[:, 0]
    order = np.lexsort((seeds[:, 0], diagonal))
    seeds, diagonal = seeds[order], diagonal[order]
    first = np.flatnonzero(np.r_[True, (np.diff(diagonal) != 0) | (np.diff(seeds[:, 0]) != 1)])
    length = np.diff(np.r_[first, len(seeds)]) + tile - 1
    heap = [(-int(n), int(i), int(j)) for n, (i, j) in zip(length, seeds[first], strict=True)]
    heapq.heapify(heap)
    used_item, used_doc, out = np.zeros(len(item), bool), {}, []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = ~used_item[i : i + n] & ~np.fromiter((j + k in used_doc for k in range(n)), bool, n)
        if free.all():
            used_item[i : i + n] = True
            used_doc.update((j + k, True) for k in range(n))
            out.append((i, j, n))
            continue
        edges = np.flatnonzero(np.diff(np.r_[0, free.astype(np.int8), 0]))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= tile:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, tile: int) -> Iterator[tuple[Index, bool]]:
    """Indexes over the benchmark, read as a stream of rows, BLOCK_WORDS words at a time, and whether
    each is the last."""
    rows, size = [], 0
    held: Index | None = None
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).orderBy(id_col, text_col).toLocalIterator():
        if held is not None:
            yield held, False
            held = None
        rows.append((row[0], words_of(row[1])))
        size += len(rows[-1][1])
        if size >= BLOCK_WORDS:
            held, rows, size = Index.of(rows, tile), [], 0
    if rows:
        held = Index.of(rows, tile)
    if held is not None:
        yield held, True


def _hits(shared):
    @pandas_udf(T.ArrayType(HIT))
    def hits(texts: pd.Series) -> pd.Series:
        worker_state("decontam")
        return pd.Series([shared.value.hits(t) for t in texts])

    return hits


def _leaks(shared, coverage: float):
    @pandas_udf(T.BooleanType())
    def leaks(texts: pd.Series) -> pd.Series:
        worker_state("decontam")
        return pd.Series([any(c / n >= coverage for _, n, c, _ in shared.value.hits(t)) for t in texts], dtype=bool)

    return leaks


def overlaps(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, tile: int = TILE) -> DataFrame:
    """doc_id, item_id, item_words, covered, tiles, coverage for every document and test item whose
    tiles cover at least ``coverage`` of the item's words.

    Words are lower-cased runs of letters, digits and underscores, so case and punctuation do not
    hide a copy; tiles may come in any order and need not be adjacent, so neither does reordering.
    Equally long tiles are taken in the item's order, then the document's. Items of fewer than
    ``tile`` words are sought whole. Each block of the benchmark is broadcast and met with all whole
    documents, however long, in a scan of its own without a shuffle; if there are several blocks, one
    is held at a time. Null, empty and wordless texts match nothing. Repeated documents or items each
    give rows. Other columns of either table are ignored; an empty one gives no rows.
    """
    spark, out, ws = docs.sparkSession, None, None
    for index, last in _blocks(benchmark, "item_id", "text", tile):
        shared = spark.sparkContext.broadcast(index)  # BLOCK_WORDS bounds it
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(_hits(shared)(F.col("text").cast("string"))).alias("hit")).select("doc_id", "hit.*")
        found = found.withColumn("coverage", F.col("covered") / F.col("item_words")).where(F.col("coverage") >= coverage)
        if not last:
            ws = ws or Workspace(spark)
            found = ws.store(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    empty = T.StructType([T.StructField("doc_id", T.LongType()), *HIT.fields, T.StructField("coverage", T.DoubleType())])
    return spark.createDataFrame([], empty) if out is None else out


def clean_documents(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, tile: int = TILE) -> DataFrame:
    """The rows of ``docs`` that contain no test item (see ``overlaps``), columns unchanged; null and
    empty texts stay. All blocks but the last write the id and text hash of what they hit, so that
    only one is held at a time; rows are then filtered by these keys."""
    spark, ws, hit = docs.sparkSession, None, None
    ident = (F.col("doc_id").cast("long").alias("k_id"), text_identity(F.col("text").cast("string")).alias("k_text"))
    for index, last in _blocks(benchmark, "item_id", "text", tile):
        shared = spark.sparkContext.broadcast(index)  # BLOCK_WORDS bounds it
        leaks = _leaks(shared, coverage)(F.col("text").cast("string"))
        if last:
            docs = docs.where(~leaks)
            continue
        ws = ws or Workspace(spark)
        found = ws.store(docs.where(leaks).select(*ident).distinct())
        shared.destroy()
        hit = found if hit is None else hit.unionByName(found)
    if hit is None:
        return docs
    hit = ws.store(hit.distinct().select(F.col("k_id").alias("h_id"), F.col("k_text").alias("h_text")))
    key = lambda i, t: F.xxhash64(F.coalesce(i, F.lit(-1)), t)
    packed = docs.select(F.struct("*").alias("row"), *ident)
    marked = mark_maybe(packed, key("k_id", "k_text"), maybe_among(hit, key("h_id", "h_text")), "maybe")
    asked = marked.where("maybe").join(hit, F.col("k_id").eqNullSafe(F.col("h_id")) & (F.col("k_text") == F.col("h_text")), "left_anti")
    return marked.where(~F.col("maybe")).select("row").unionByName(asked.select("row")).select("row.*")
