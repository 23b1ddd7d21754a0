"""Order-dependent folds: clear-on-fire thresholds, fixed-expiry dedup and throttling.

One scan and one shuffle: rows go to their key's task, are sorted there by Spark (spilling) and pass
as a stream of Arrow batches, so what is held is one key's window, never its rows. A busy key is one
task's work, in bounded memory. ``split_pauses`` divides it: a key's history is first cut where its
state must have been forgotten (whole empty windows between events make the stretches before and
after independent), at the price of a second, narrow scan and of a second shuffle.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Step = Callable[[int], bool]


class ThresholdStep:
    """True when ``count`` events are at most ``window`` apart; the window then starts empty."""

    def __init__(self, window: int, count: int, times: tuple[int, ...] = ()):
        self.window, self.count, self.times = window, count, deque(times)

    def __call__(self, t: int) -> bool:
        while self.times and self.times[0] < t - self.window:
            self.times.popleft()
        self.times.append(t)
        if len(self.times) < self.count:
            return False
        self.times.clear()
        return True


class DedupStep:
    """True for an event that is fresh: none was admitted within ``ttl`` before. Repeats do not
    prolong it, and exactly ``ttl`` later is fresh again."""

    def __init__(self, ttl: int, expiry: int | None = None):
        self.ttl, self.expiry = ttl, expiry

    def __call__(self, t: int) -> bool:
        if self.expiry is not None and self.expiry > t:
            return False
        self.expiry = t + self.ttl
        return True


class ThrottleStep:
    """True for an event that passes: fewer than ``most`` passed in the ``window`` before it."""

    def __init__(self, window: int, most: int, times: tuple[int, ...] = ()):
        self.window, self.most, self.times = window, most, deque(times)

    def __call__(self, t: int) -> bool:
        while self.times and self.times[0] < t - self.window:
            self.times.popleft()
        if len(self.times) >= self.most:
            return False
        self.times.append(t)
        return True


def _run(start: Callable[..., Step], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, step = None, None
    for batch in batches:
        flags = []
        params = [c.to_pylist() for c in batch.columns[3:]]
        for i, (k, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if step is None or k != key:
                key, step = k, start(*(p[i] for p in params))
            flags.append(step(t))
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(flags, pa.bool_())], ["row", "flag"])


def ordered_fold(df: DataFrame, keys: list[str], time: str, order: list[str], start: Callable[..., Step], window: int, flag: str, params: tuple[Column, ...] = (), split_pauses: bool = False) -> DataFrame:
    """``df`` with the boolean column ``flag``: each row's result of the key's step in (time, order).

    ``time`` is a timestamp column and ``window`` the microseconds a state can last. Equal times are
    taken in ``order``. ``start`` makes a key's step, from the values of ``params`` in its first row.
    Rows travel whole, so no join follows.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    key = F.col(keys[0]).cast("string") if len(keys) == 1 else F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    extra = [f"p{i}" for i in range(len(params))]
    seq = [F.col("row")[c] for c in order]  # sorted where they are, not beside the row again
    row = df.select(F.struct("*").alias("row"), key.alias("k"), micros.alias("t"), *[p.alias(n) for p, n in zip(params, extra, strict=True)])
    group = "k"
    if split_pauses:
        row = row.withColumn("slot", F.floor(F.col("t") / max(window, 1)).cast("long"))
        by_slot = Window.partitionBy("k").orderBy("slot")
        fresh = (F.col("slot") - F.coalesce(F.lag("slot").over(by_slot), F.col("slot") - 9) > 1).cast("int")
        islands = row.select("k", "slot").distinct().withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(by_slot)).select(F.col("k").alias("i_k"), F.col("slot").alias("i_slot"), "island")
        row = row.join(islands, F.col("k").eqNullSafe(F.col("i_k")) & (F.col("slot") == F.col("i_slot"))).withColumn("g", F.concat_ws("#", F.coalesce(F.concat(F.lit("="), "k"), F.lit("")), F.col("island").cast("string")))
        group = "g"
    ordered = row.repartition(group).sortWithinPartitions(group, "t", *seq).select(group, "t", "row", *extra)
    schema = T.StructType([T.StructField("row", df.schema), T.StructField("flag", T.BooleanType())])
    return ordered.mapInArrow(partial(_run, start), schema).select("row.*", F.col("flag").alias(flag))


def threshold(df: DataFrame, keys: list[str], time: str, order: list[str], window_seconds: float, count: int, flag: str = "fired", split_pauses: bool = False) -> DataFrame:
    """Flags the rows at which a threshold fires; rows with a null key are dropped."""
    window = round(window_seconds * 1e6)
    df = df.dropna(subset=keys)
    return ordered_fold(df, keys, time, order, partial(ThresholdStep, window, count), window, flag, split_pauses=split_pauses)


def dedup(df: DataFrame, keys: list[str], time: str, order: list[str], ttl_seconds: float, flag: str = "fresh", split_pauses: bool = False) -> DataFrame:
    ttl = round(ttl_seconds * 1e6)
    return ordered_fold(df, keys, time, order, partial(DedupStep, ttl), ttl, flag, split_pauses=split_pauses)


def throttle(df: DataFrame, keys: list[str], time: str, order: list[str], window_seconds: float, most: int, flag: str = "passed", split_pauses: bool = False) -> DataFrame:
    window = round(window_seconds * 1e6)
    return ordered_fold(df, keys, time, order, partial(ThrottleStep, window, most), window, flag, split_pauses=split_pauses)
