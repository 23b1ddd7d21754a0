"""SimHash near-duplicates: a binary trie self-join of the distinct fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from watchloom.llm.common import Workspace, connected_components, mark_maybe, maybe_among, sized, text_identity, worker_state

BITS, SHINGLE, SEED, BUDGET = 64, 4, 42, 4
#: Shingles hashed at once, so that a very long text needs bounded memory.
CHUNK = 1 << 16
#: Distinct fingerprints under one path that one task joins; larger groups are split in block pairs.
GROUP_ROWS = 200_000
#: Node pairs that a traversal expands at once.
FRONTIER = 1 << 20


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text's 4-word shingles (fewer words: all of them; none: 0)."""
    words = text.encode("utf-8", "replace").lower().split() if text else []  # A-Z and ASCII blanks only
    n = len(words)
    if not n:
        return 0
    buf = b" ".join(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(buf, SEED)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    starts, ends = (ends - lens)[: n - SHINGLE + 1], ends[SHINGLE - 1 :]
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        h = np.array([digest(buf[a:b], SEED) for a, b in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


@pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    worker_state("simhash")
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def path_keys(budget: int = BUDGET) -> list[list[tuple[int, int]]]:
    """The bit orders of the tries that are joined: for budget + 2 blocks of the 64 bits, every choice
    of 2, as (shift, width) lists. In a choice's trie its two blocks come first, then the other bits.
    ``budget`` differing bits spoil at most ``budget`` blocks, so a pair in reach agrees on some
    choice: in that trie it is below one node of the upper levels, with no difference used up yet.
    Pairs of different upper nodes of a trie can therefore be left to the other tries."""
    blocks, cuts = budget + 2, [round(i * BITS / (budget + 2)) for i in range(budget + 3)]
    return [[(cuts[i], cuts[i + 1] - cuts[i]) for i in pair] for pair in combinations(range(blocks), 2)]


def free_bits(parts: list[tuple[int, int]]) -> list[int]:
    """The bits below a choice's upper levels, in the order in which its trie takes them."""
    fixed = {b for shift, width in parts for b in range(shift, shift + width)}
    return [b for b in range(BITS - 1, -1, -1) if b not in fixed]


#: The number of a choice is in the low bits of its paths.
CHOICE_BITS = 8


def _path_column(n: int, parts: list[tuple[int, int]]) -> Column:
    key: Column = F.lit(0).cast("long")
    for shift, width in parts:
        key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)))
    return F.shiftleft(key, CHOICE_BITS).bitwiseOR(F.lit(n))


def leaf_pairs(fps: np.ndarray, a: np.ndarray, b: np.ndarray, used: np.ndarray, rest: int, budget: int) -> np.ndarray:
    """Which pairs of leaves are in reach: the differences used up on the way down, and those of the
    ``rest``, the bits on the leaves' own edges."""
    return used + np.bitwise_count((fps[a] ^ fps[b]) & np.uint64(rest)) <= budget


def trie_links(fps: np.ndarray, frontier: tuple[np.ndarray, ...], bits: list[int], budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``fps`` that connect all that is within ``budget`` differing bits, by walking
    pairs of trie nodes down together.

    A node is a range of ``fps``, sorted in the order of ``bits`` within it; ``frontier`` holds the
    start pairs (lo, hi, lo, hi), which agree on all other bits; a pair of equal ranges joins a node
    with itself. A step goes down one bit on both sides and adds to the differences used up; a pair
    over the budget is dropped with all below it. Two leaves compare their edges. If the bits left
    cannot exceed the budget, all leaves of both nodes are linked through the first.
    """
    stack = [(0, *frontier, np.zeros(len(frontier[0]), np.int8))]
    ones: dict[int, np.ndarray] = {}  # by bit: ones before each position
    while stack:
        depth, alo, ahi, blo, bhi, used = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(depth, *(x[:half] for x in (alo, ahi, blo, bhi, used))), (depth, *(x[half:] for x in (alo, ahi, blo, bhi, used)))]
            continue
        same = alo == blo
        leaf = ~same & (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            a, b = alo[leaf], blo[leaf]
            near = leaf_pairs(fps, a, b, used[leaf], sum(1 << x for x in bits[depth:]), budget)
            if near.any():
                yield a[near], b[near]
        whole = ~leaf & (used + (len(bits) - depth) <= budget)
        for lo, hi in ((alo, ahi), (blo, bhi)):
            n = (hi - lo)[whole]
            if n.sum():
                yield np.repeat(alo[whole], n), np.repeat(lo[whole] - np.cumsum(n) + n, n) + np.arange(n.sum())
        keep = ~leaf & ~whole & ~(same & (ahi - alo == 1))
        if not keep.any():
            continue
        alo, ahi, blo, bhi, used, same = (x[keep] for x in (alo, ahi, blo, bhi, used, same))
        bit = bits[depth]
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int32)])
        c = ones[bit]
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        steps = [(alo, amid, blo, bmid, used), (amid, ahi, bmid, bhi, used), (alo, amid, bmid, bhi, used + 1), (amid, ahi, blo, bmid, np.where(same, budget + 1, used + 1))]
        new = [np.concatenate(x) for x in zip(*steps, strict=True)]
        alive = (new[0] < new[1]) & (new[2] < new[3]) & (new[4] <= budget)
        stack.append((depth + 1, *(x[alive] for x in new)))


def join_group(fps: np.ndarray, group: np.ndarray, side: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Links found in every group (rows of one group and side are adjacent and sorted by value), as
    a star (fingerprint, root of its component there): all links' components, without all pairs.
    A group has a node joined with itself, or two chunks of one (sides 0 and 1) joined."""
    cuts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])])
    lo, hi = cuts, np.r_[cuts[1:], len(fps)]
    two = np.r_[group[lo][1:] == group[lo][:-1], False]
    second = np.r_[False, two[:-1]]
    own = ~two & ~second & (side[lo] == 0) & (hi - lo > 1)
    at = np.flatnonzero(own | two)
    to = np.where(two[at], at + 1, at)
    choice = group[lo[at]] & ((1 << CHOICE_BITS) - 1)
    root = np.arange(len(fps))
    for n, parts in enumerate(path_keys(budget)):
        own = choice == n
        if not own.any():
            continue
        for a, b in trie_links(fps, (lo[at[own]], hi[at[own]], lo[to[own]], hi[to[own]]), free_bits(parts), budget):
            while True:
                ra, rb = root[a], root[b]
                apart = ra != rb
                if not apart.any():
                    break
                a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
                np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
                while (root != (up := root[root])).any():
                    root = up
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def _join_partition(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("simhash join")
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            fps = rows[2].view(np.uint64)
            order = np.lexsort((fps, rows[1], rows[0]))
            a, b = join_group(fps[order], rows[0][order], rows[1][order], budget)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        size = 0
        for batch in batches:
            rows = np.vstack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            if not rows.shape[1]:
                continue
            held.append(rows)
            size += rows.shape[1]
            last = rows[0, -1]
            if size >= GROUP_ROWS and held[0][0, 0] != last:
                every = np.hstack(held)
                cut = np.searchsorted(every[0], last)
                yield from flush(every[:, :cut])
                held = [every[:, cut:]]
                size = held[0].shape[1]
        if held:
            yield from flush(np.hstack(held))

    return run


def fingerprint_links(ws: Workspace, fps: DataFrame, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): edges with the same components as all links between the distinct fingerprints ``fp``.

    The upper levels of the tries are dealt out by shuffle: each fingerprint goes to its node of every
    choice, and a task walks the node pairs below. A node with more than ``group_rows`` fingerprints
    is split into m chunks and m (m + 1) / 2 chunk pairs, so no task holds more than two chunks; no
    row is dropped."""
    keys = path_keys(budget)
    paths = fps.select("fp", F.explode(F.array(*[_path_column(n, p) for n, p in enumerate(keys)])).alias("path"))
    big = ws.store(paths.groupBy("path").count().where(F.col("count") > group_rows).select("path", F.ceil(F.col("count") / group_rows).cast("int").alias("m")))
    if big.isEmpty():
        rows = paths.select(F.col("path").alias("g"), F.lit(0).cast("long").alias("side"), "fp")
    else:
        dealt = paths.join(sized(big), "path", "left").withColumn("m", F.coalesce("m", F.lit(1)))
        dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        low = (1 << CHOICE_BITS) - 1
        pair = F.xxhash64("path", F.least("chunk", "other"), F.greatest("chunk", "other")).bitwiseAND(F.lit(~low)).bitwiseOR(F.lit(-(1 << 63))).bitwiseOR(F.col("path").bitwiseAND(F.lit(low)))  # below 0, as no path is
        rows = dealt.select(F.when(F.col("m") == 1, F.col("path")).otherwise(pair).alias("g"), (F.col("chunk") > F.col("other")).cast("long").alias("side"), "fp")
    dealt = rows.repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(_join_partition(budget), "a long, b long")


def fingerprint_components(ws: Workspace, fps: DataFrame, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(node, root) of the fingerprints that have a link; the others are alone."""
    return connected_components(ws, fingerprint_links(ws, fps, budget, group_rows))


def near_duplicates(docs: DataFrame, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of documents.

    Null, empty and blank texts have fingerprint zero and link like any other; very long texts are
    hashed whole, in steps. component_id is the smallest doc_id reachable over links of at most
    ``budget`` bits; rows without an id take part and show the smallest id of the others, null if
    there is none. A bit set in exactly half the shingles is 0. Repeated rows each come back.
    Other columns are ignored; an empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession)
    rows = ws.store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _fingerprints(F.col("text").cast("string")).alias("fp")))
    ids = component_ids(ws, rows, budget, group_rows)
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def component_ids(ws: Workspace, rows: DataFrame, budget: int, group_rows: int) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of rows (doc_id, fp)."""
    distinct = ws.store(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = fingerprint_components(ws, distinct, budget, group_rows)
    rooted = ws.store(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return ws.store(rooted.join(lows, "root").select("fp", "component_id"))


def keep_one(docs: DataFrame, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged: one document of each component, the one
    with the smallest id (null last), then the smallest text hash. Rows equal in id and text count as
    copies; which of them stays is settled by a hash of their other plain columns. Null, empty and
    very long texts have fingerprints like any other; an empty table gives no rows.

    What goes is decided on keys alone. A bitmap of the keys that go or repeat lets most rows stay
    where they are; only the others move to be joined with the decision.
    """
    ws = Workspace(docs.sparkSession)
    ident = (F.col("doc_id").cast("long").alias("k_id"), text_identity(F.col("text").cast("string")).alias("k_text"))
    rows = ws.store(docs.select(*ident, _fingerprints(F.col("text").cast("string")).alias("fp")).groupBy("k_id", "k_text", "fp").agg(F.count("*").alias("n")))
    distinct = ws.store(rows.select("fp").distinct())
    roots = fingerprint_components(ws, distinct, budget, group_rows)
    best = F.min(F.struct(F.col("k_id").isNull().alias("none"), "k_id", "k_text"))
    by_fp = ws.store(rows.groupBy("fp").agg(best.alias("best")).join(roots, F.col("fp") == F.col("node"), "left").select("fp", "best", F.coalesce("root", "fp").alias("root")))
    chosen = by_fp.groupBy("root").agg(F.min("best").alias("chosen"))
    stays = by_fp.join(chosen, "root").select("fp", "chosen")
    settled = rows.join(stays, "fp").select("k_id", "k_text", "n", (F.col("k_id").eqNullSafe(F.col("chosen.k_id")) & (F.col("k_text") == F.col("chosen.k_text"))).alias("stays"))
    open_ = ws.store(settled.where(~F.col("stays") | (F.col("n") > 1)).select(F.col("k_id").alias("o_id"), F.col("k_text").alias("o_text"), "stays"))
    key = F.xxhash64(F.coalesce("k_id", F.lit(-1)), "k_text")
    packed = docs.select(F.struct("*").alias("row"), *ident)
    marked = mark_maybe(packed, key, maybe_among(open_, F.xxhash64(F.coalesce("o_id", F.lit(-1)), "o_text")), "maybe")
    asked = marked.where("maybe").join(open_, F.col("k_id").eqNullSafe(F.col("o_id")) & (F.col("k_text") == F.col("o_text")), "left")
    plain = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    repeat = F.row_number().over(Window.partitionBy("k_id", "k_text").orderBy(F.xxhash64(*plain)))
    first = asked.where("stays").withColumn("nth", repeat).where("nth = 1").select("row")
    # a row that is in no decision only looked like one in the bitmap
    kept = marked.where(~F.col("maybe")).select("row").unionByName(asked.where("o_text is null").select("row")).unionByName(first)
    return kept.select("row.*")
