"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.common import Workspace

#: Numbering ranges per shard and the most shards: the offsets table has shards x RANGES rows.
RANGES, MOST_SHARDS = 1024, 1024


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Index of the shard that wins ``key``: the smallest -ln(u) / weight, u uniform per (key, shard).

    A shard's score for a key never depends on the other shards, so adding one moves only the keys
    it wins, in proportion to its weight. Ties (equal scores) go to the lower index.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    if len(weights) > MOST_SHARDS:
        raise ValueError(f"more than {MOST_SHARDS} shards: a score of each is a column expression")

    def score(i: int, w: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.ln(u) / F.lit(float(w))).alias("s"), F.lit(i).alias("i"))

    return F.array_min(F.array(*[score(i, w) for i, w in enumerate(weights)]))["i"]


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, grown: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    size is the text's UTF-8 bytes plus 1 (null: 1), of the whole text however long; text_crc32 of a
    null text is that of the empty one. The key is the id; a row without an id is keyed by its text,
    and rows that tie in their key are in one shard. ``grown`` defaults to one more shard of weight 1.
    Slots number a shard's rows 0, 1, ...: rows are dealt over RANGES ranges of a shard by a hash that
    also takes their place in the input, so rows of one key or text spread over all of them; each
    range is numbered on its own, and the ranges' offsets come from their counts. Slots of equal rows
    are arbitrary, and other splits of the input give other slots. Repeated rows get separate slots;
    an empty table gives no rows; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession)
    grown = [*weights, 1.0] if grown is None else grown
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.when(F.col(id_col).isNull(), F.concat(F.lit("t:"), F.xxhash64(text).cast("string"))).otherwise(F.concat(F.lit("d:"), F.col(id_col).cast("string"))).alias("key"))
    place = F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(RANGES)).cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", rendezvous(F.col("key"), weights).alias("shard"), rendezvous(F.col("key"), grown).alias("grown_shard"), place.alias("range"))
    order = Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32")
    numbered = ws.store(rows.withColumn("row", F.row_number().over(order) - 1))
    counts = numbered.groupBy("shard", "range").agg((F.max("row") + 1).alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # shards x RANGES rows at most, whatever the input
    return numbered.join(F.broadcast(offsets), ["shard", "range"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("row")).cast("long").alias("slot"), "grown_shard")
