"""Stored tables, pages over them, and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latency buckets in seconds, and page sizes.
BUCKETS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0)
DEFAULT_PAGE, MAX_PAGE = 50, 100


def event_rows(events: DataFrame) -> DataFrame:
    """The stored projection of events, partitioned by day when written."""
    return events.select(F.col("event.id").alias("event_id"), F.col("timestamp").alias("occurred_at"), F.col("event.category").alias("category"), F.col("event.action").alias("action"), F.col("event.outcome").alias("outcome"), F.col("event.severity").alias("severity"), F.col("host.name").alias("host"), F.col("source.ip").alias("source_ip"), "message")


def alert_rows(alerts: DataFrame) -> DataFrame:
    return alerts.select("dedup_key", "rule_id", "severity", F.array_join("attack", ",").alias("attack"), F.array_join("nist_csf", ",").alias("nist_csf"), "event_id", "host", F.col("timestamp").alias("occurred_at"), "summary")


def with_ids(rows: DataFrame, first: int = 1) -> DataFrame:
    """``rows`` with a unique ascending id (not gapless: partitions number apart) and created_at."""
    return rows.withColumn("id", F.monotonically_increasing_id() + first).withColumn("created_at", F.current_timestamp())


def append(rows: DataFrame, path: str) -> None:
    rows.withColumn("day", F.to_date("occurred_at")).write.mode("append").partitionBy("day").parquet(path)


def page(rows: DataFrame, limit: int, before: int | None = None, key: str = "id") -> DataFrame:
    """The ``limit`` rows with the largest keys below ``before``: a top-k, never a full sort."""
    if before is not None:
        rows = rows.where(F.col(key) < before)
    return rows.orderBy(F.col(key).desc()).limit(limit)


def read_page(rows: DataFrame, limit: int = DEFAULT_PAGE, cursor: int | None = None, key: str = "id", max_limit: int = MAX_PAGE) -> dict:
    """items, has_more, next_cursor and total of one page; one row more is asked to see if it is the last."""
    if not 1 <= limit <= max_limit:
        raise ValueError(f"limit must be from 1 to {max_limit}")
    found = page(rows, limit + 1, cursor, key).collect()
    items = [r.asDict(recursive=True) for r in found[:limit]]
    more = len(found) > limit
    return {"items": items, "has_more": more, "next_cursor": items[-1][key] if more else None, "total": rows.count()}


def counters(rows: DataFrame, *labels: str) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count("*").alias("n"))


def histogram(seconds: Column, *labels: str):
    """Function of a frame: cumulative latency buckets (le, n), one aggregation and no join."""

    def of(rows: DataFrame) -> DataFrame:
        sums = [F.count_if(seconds <= b).alias(str(b)) for b in BUCKETS] + [F.count(seconds).alias("+Inf")]
        names = [*map(str, BUCKETS), "+Inf"]
        wide = rows.groupBy(*labels).agg(*sums) if labels else rows.agg(*sums)
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("le"), F.col(f"`{n}`").alias("n")) for n in names]))
        return wide.select(*labels, pairs.alias("b")).select(*labels, "b.le", "b.n")

    return of


def rate(rows: DataFrame, time: str, width: str = "1 minute", *labels: str) -> DataFrame:
    """Events in each tumbling window, and a second's share of them."""
    counted = rows.groupBy(F.window(time, width).alias("w"), *labels).agg(F.count("*").alias("n"))
    length = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    return counted.select(F.col("w.start").alias("start"), *labels, "n", (F.col("n") / length).alias("per_second"))


def prometheus(rows: DataFrame, metric: str, labels: list[str], value: str = "n") -> DataFrame:
    """Metric lines in the text exposition format."""
    swap = lambda c, old, new: F.replace(c, F.lit(old), F.lit(new))
    quote = lambda c: swap(swap(swap(F.col(c).cast("string"), "\\", "\\\\"), "\n", "\\n"), '"', '\\"')
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), quote(c), F.lit('"')) for c in labels])
    return rows.select(F.concat(F.lit(metric), F.lit("{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))
