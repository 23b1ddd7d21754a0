"""Mixing sources to target weights with nested hash thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.common import Workspace, sized

WORD = r"[^\x20\x09-\x0D]+"
#: A hash has LEVELS x LEVEL_BITS bits; a histogram level has 2 ** LEVEL_BITS buckets a source.
LEVEL_BITS, LEVELS = 12, 5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of id and text: rows equal in both tie (see ``row_place``)."""
    salted = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(salted.cast("binary")), 1, 15), 16, 10).cast("long")


def row_place() -> Column:
    """60 bits of a hash of a row's place in the input, which tells rows apart that tie in their hash."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << (LEVEL_BITS * LEVELS)))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, target for (source, source_size): sources by code point (null last) have
    ``weights`` in turn and share ``share`` times all sizes; a target stops at ``most`` times its
    source's size and the excess is reshared by weight until none is above (water filling). One row
    a source: the windows over the whole table hold a narrow row for each source only."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    cap, w = F.col("source_size") * F.lit(float(most)), F.col("w")
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn + 1)).withColumn("cap", cap).withColumn("fills_at", F.col("cap") / w)
    up = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    full, rest = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(full), F.lit(0.0))) / F.sum("w").over(rest)
    ranked = ranked.withColumn("level", level)
    # the level at the first source that it does not fill holds for all
    level = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(every)["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * w))
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(ws: Workspace, rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets (source, budget, ...) plus ``below``: the rows of a source whose hash is under it have
    at most ``budget`` words, and the next hash would exceed it.

    Level by level: words by (source, bucket of the hash's next bits) give the boundary bucket, and
    only rows in it are looked at again. Larger budgets give higher thresholds, so selections nest.
    """
    bits = LEVEL_BITS * LEVELS
    state = ws.store(budgets.withColumn("left", F.col("budget")).withColumn("lo", F.lit(0).cast("long")).withColumn("below", F.lit(None).cast("long")))
    sources = state.count()
    for level in range(LEVELS):
        shift = bits - LEVEL_BITS * (level + 1)
        open_ = sized(state.where("below is null").select(F.col("source").alias("s"), "left", "lo"))
        inside = rows.join(open_, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + LEVEL_BITS) == F.shiftright("lo", shift + LEVEL_BITS)))
        histogram = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("first"), F.max("h").alias("last"), F.first("left").alias("left"))
        upto = Window.partitionBy("source").orderBy("bucket")
        over = histogram.withColumn("sum", F.sum("n").over(upto)).where(F.col("sum") > F.col("left"))
        edge = over.groupBy("source").agg(F.min(F.struct("bucket", "sum", "n", "first", "last")).alias("e")).select(F.col("source").alias("s"), (F.col("e.sum") - F.col("e.n")).alias("used"), F.shiftleft("e.bucket", shift).alias("at"), F.when(F.col("e.first") == F.col("e.last"), F.col("e.first")).alias("exact"))
        # a source without an edge fits whole; an edge of one hash value is the threshold
        after = state.where("below is null").join(sized(ws.store(edge, rows=sources)), F.col("source").eqNullSafe(F.col("s")), "left")
        after = after.withColumn("below", F.when(F.col("at").isNull(), F.lit(1 << bits)).otherwise(F.col("exact"))).withColumn("left", F.col("left") - F.coalesce("used", F.lit(0))).withColumn("lo", F.coalesce("at", "lo"))
        state = ws.store(state.where("below is not null").unionByName(after.select(*state.columns)), rows=sources)
        if state.where("below is null").isEmpty():
            break
    return state.drop("left", "lo")


def plan_mix(ws: Workspace, rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, whole, below, below_tie for stored rows (source, size, h, place):
    every document of a source is taken ``whole`` times, and once more if its hash is under ``below``,
    or equal to it with its place under ``below_tie``."""
    sizes = ws.store(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = source_targets(sizes, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    targets = targets.withColumn("whole", whole)
    plan = ws.store(thresholds(ws, rows, targets.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))))
    key = plan.select(F.col("source").alias("s"), "below", "budget")
    same = F.col("source").eqNullSafe(F.col("s"))
    edge = rows.join(sized(key), same & (F.col("h") <= F.col("below"))).groupBy("source").agg(F.count_if(F.col("h") == F.col("below")).alias("ties"), F.sum(F.when(F.col("h") < F.col("below"), F.col("size")).otherwise(0)).alias("used"), F.first("budget").alias("budget"), F.first("below").alias("below"))
    edge = ws.store(edge.where("ties > 1"))
    if edge.isEmpty():
        return plan.drop("budget").withColumn("below_tie", F.lit(0).cast("long"))
    tied = rows.join(sized(edge.select(F.col("source").alias("s"), "below")), same & (F.col("h") == F.col("below"))).select("source", "size", F.col("place").alias("h"))
    inner = thresholds(ws, tied, edge.select("source", (F.col("budget") - F.col("used")).alias("budget"))).select(F.col("source").alias("s"), F.col("below").alias("below_tie"))
    return plan.drop("budget").join(sized(ws.store(inner)), same, "left").drop("s").withColumn("below_tie", F.coalesce("below_tie", F.lit(0).cast("long")))


def taken_times() -> Column:
    more = (F.col("h") < F.col("below")) | ((F.col("h") == F.col("below")) & (F.col("place") < F.col("below_tie")))
    return F.col("whole") + more.cast("int")


def mix_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of documents.

    Null text has size 0; very long texts are counted whole; a null source is a source of its own,
    ranked last. Rows equal in id and text are interchangeable: as many of them are taken as fit, by
    their place in the input. If all sizes are 0, so is everything else. Other columns are ignored; an
    empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession)
    rows = ws.store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h"), row_place().alias("place")))
    plan = sized(ws.store(plan_mix(ws, rows, weights, share, most).withColumnRenamed("source", "s")))
    return rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", (F.col("size") * taken_times()).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, columns unchanged; see
    ``mix_documents`` for nulls, ties and empty tables."""
    ws = Workspace(docs.sparkSession)
    packed = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), row_hash(F.col("doc_id"), F.col("text")).alias("h"), word_count(F.col("text")).alias("size"), row_place().alias("place"))
    rows = ws.store(packed.select("source", "size", "h", "place"))
    plan = sized(ws.store(plan_mix(ws, rows, weights, share, most).select(F.col("source").alias("s"), "whole", "below", "below_tie")))
    return packed.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(F.explode(F.array_repeat("row", taken_times())).alias("row")).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
q AS (SELECT *, cap / w AS fills_at FROM r),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM q),
g AS (SELECT arg_min(lev, fills_at) AS lev FROM l WHERE lev <= fills_at),
t AS (SELECT source, source_size, CASE WHEN g.lev IS NULL THEN cap ELSE least(cap, g.lev * w) END AS target FROM l LEFT JOIN g ON true),
k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, k.source_size, k.target, k.whole, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum
    FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN cum <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
