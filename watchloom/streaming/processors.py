"""Stateful folds over streams, and the queries that chain sources, rules and gates."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from watchloom import schemas
from watchloom.operators import alerts, detect
from watchloom.operators.compile import Compiler
from watchloom.operators.folds import DedupStep, ThresholdStep, ThrottleStep
from watchloom.sources.rules import Rule, Threshold

STATE = "state string"
#: Event time after which the state of a key that went silent is dropped, in windows.
KEEP_WINDOWS = 2


def stateful(df: DataFrame, key: str, time: str, window_seconds: float, restore: Callable[[dict | None], object], dump: Callable[[object], dict], flag: str, lateness: str = "1 minute", order: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``flag``: the step's result for each row, in event time within a micro-batch (equal
    times by ``order``, else as they come).

    ``df`` needs ``key`` (a string column) and a watermark is set on ``time``; rows behind it are
    dropped, and a key's state goes KEEP_WINDOWS windows after its last event.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(flag, T.BooleanType())])
    keep = max(1, round(window_seconds * 1000 * KEEP_WINDOWS))

    def fold(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True)
        rows = rows.sort_values([time, *order], kind="stable")
        step = restore(json.loads(state.get[0]) if state.exists else None)
        micros = rows[time].astype("datetime64[us]").astype("int64")
        rows[flag] = [step(int(t)) for t in micros]
        state.update((json.dumps(dump(step)),))
        state.setTimeoutTimestamp(max(int(micros.iloc[-1] // 1000), state.getCurrentWatermarkMs()) + keep)
        yield rows

    return df.withWatermark(time, lateness).groupBy(key).applyInPandasWithState(fold, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def dedup_stream(df: DataFrame, key: str, time: str, ttl_seconds: float, lateness: str = "1 minute", flag: str = "fresh", order: tuple[str, ...] = ()) -> DataFrame:
    ttl = round(ttl_seconds * 1e6)
    return stateful(df, key, time, ttl_seconds, lambda s: DedupStep(ttl, s and s["e"]), lambda d: {"e": d.expiry}, flag, lateness, order)


def threshold_stream(df: DataFrame, key: str, time: str, window_seconds: float, count: int, lateness: str = "1 minute", flag: str = "fired") -> DataFrame:
    window = round(window_seconds * 1e6)
    return stateful(df, key, time, window_seconds, lambda s: ThresholdStep(window, count, tuple(s["w"]) if s else ()), lambda d: {"w": list(d.times)}, flag, lateness)


def throttle_stream(df: DataFrame, key: str, time: str, window_seconds: float, most: int, lateness: str = "1 minute", flag: str = "passed", order: tuple[str, ...] = ()) -> DataFrame:
    window = round(window_seconds * 1e6)
    return stateful(df, key, time, window_seconds, lambda s: ThrottleStep(window, most, tuple(s["w"]) if s else ()), lambda d: {"w": list(d.times)}, flag, lateness, order)


def dedup_events(events: DataFrame, ttl_seconds: float = 60.0, lateness: str = "1 minute") -> DataFrame:
    """Events whose id was not admitted within the time to live."""
    keyed = events.withColumn("dedup_id", F.col("event.id"))
    return dedup_stream(keyed, "dedup_id", "timestamp", ttl_seconds, lateness).where("fresh").drop("fresh", "dedup_id")


def detections(events: DataFrame, rules: list[Rule], lateness: str = "1 minute") -> DataFrame:
    """Detections of a stream of events: a stateless branch and one for each threshold rule."""
    rules = [r for r in rules if r.enabled]
    plain = [r for r in rules if not isinstance(r.condition, Threshold)]
    parts = [detect.stateless(events, plain)] if plain else []
    compiler = Compiler(events.schema, events.sparkSession)
    for rule in (r for r in rules if isinstance(r.condition, Threshold)):
        t = rule.condition
        matched = events.where(compiler(t.match)).select(F.col(t.group_by).cast("string").alias("group"), "timestamp", "event", "host").where("group is not null")
        fired = threshold_stream(matched, "group", "timestamp", t.window_seconds, t.count, lateness).where("fired")
        parts.append(fired.withColumn("rule", detect.meta(rule)).select(*detect.detection(F.col("rule"))))
    return reduce(DataFrame.unionByName, parts)


SCREENED = T.StructType([*schemas.ALERT.fields, T.StructField("status", T.StringType())])


def screen_stream(found: DataFrame, gates: alerts.Gates, lateness: str = "1 minute") -> DataFrame:
    """Alerts of a stream of detections behind the floor and the dedup gate: status is
    suppressed_severity, deduped or null. State is one expiry for each dedup key."""
    built = alerts.build(found)
    high = F.col("severity") >= gates.min_severity
    keyed = built.withColumn("_key", F.concat(F.when(high, "+|").otherwise("-|"), "dedup_key"))
    seen = dedup_stream(keyed, "_key", "timestamp", gates.dedup_seconds, lateness, order=("event_id",))
    status = F.when(F.col("severity") < gates.min_severity, "suppressed_severity").when(~F.col("fresh"), "deduped")
    return seen.select(*built.columns, status.alias("status"))


def throttle_alerts(screened: DataFrame, gates: alerts.Gates, lateness: str = "1 minute") -> DataFrame:
    """Screened alerts with their last status. State is the times of a rule's latest alerts; alerts
    that are settled already pass by under keys of their own."""
    open_ = F.col("status").isNull()
    keyed = screened.withColumn("_key", F.when(open_, F.concat(F.lit("+|"), "rule_id")).otherwise(F.concat(F.lit("-|"), "dedup_key")))
    passed = throttle_stream(keyed, "_key", "timestamp", gates.throttle_seconds, gates.throttle_max, lateness, order=("event_id",))
    return passed.select(*[c for c in screened.columns if c != "status"], F.coalesce("status", F.when(F.col("passed"), "emitted").otherwise("throttled")).alias("status"))


def progress(query: StreamingQuery) -> dict[str, int]:
    """Rows read, rows dropped as too late and rows of state, over the query's recent progress."""
    recent = [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]
    operators = [o for p in recent for o in p.get("stateOperators", [])]
    return {"rows": sum(p.get("numInputRows", 0) for p in recent), "late": sum(o.get("numRowsDroppedByWatermark", 0) for o in operators), "state": sum(o.get("numRowsTotal", 0) for o in (recent[-1].get("stateOperators", []) if recent else []))}


class Pipeline:
    """The composition root: four queries with a table between each two, so that every stage has its
    own checkpoint and restarts without losing or repeating rows.

    events -> dedup -> ``silver``; ``silver`` -> rules -> ``gold``; ``gold`` -> floor and dedup ->
    ``screened``; ``screened`` -> throttle -> sinks.
    """

    def __init__(self, spark, folder: str, rules: list[Rule], gates: alerts.Gates = alerts.Gates(), sinks: list[alerts.Sink] | None = None, dedup_seconds: float = 60.0, lateness: str = "1 minute", max_files: int | None = None):  # noqa: B008
        self.spark, self.folder, self.rules, self.gates = spark, folder, rules, gates
        self.sinks, self.dedup_seconds, self.lateness, self.max_files = sinks or [], dedup_seconds, lateness, max_files
        self.failures: dict[str, int] = {}
        self.progress: dict[str, dict[str, int]] = {}

    def _write(self, df: DataFrame, name: str, trigger: dict) -> StreamingQuery:
        return df.writeStream.format("parquet").option("path", f"{self.folder}/{name}").option("checkpointLocation", f"{self.folder}/checkpoints/{name}").queryName(name).trigger(**trigger).start()

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        reader = self.spark.readStream.schema(schema)
        if self.max_files:  # backpressure: files a micro-batch takes
            reader = reader.option("maxFilesPerTrigger", self.max_files)
        return reader.parquet(f"{self.folder}/{name}")

    def dedup(self, events: DataFrame, trigger: dict) -> StreamingQuery:
        return self._write(dedup_events(schemas.conform(events, schemas.EVENT), self.dedup_seconds, self.lateness), "silver", trigger)

    def detect(self, trigger: dict) -> StreamingQuery:
        return self._write(detections(self._read("silver", schemas.EVENT), self.rules, self.lateness), "gold", trigger)

    def screen(self, trigger: dict) -> StreamingQuery:
        return self._write(screen_stream(self._read("gold", schemas.DETECTION), self.gates, self.lateness), "screened", trigger)

    def alert(self, trigger: dict) -> StreamingQuery:
        gated = throttle_alerts(self._read("screened", SCREENED), self.gates, self.lateness)

        def batch(df: DataFrame, epoch: int) -> None:
            if self._marked(epoch):  # an epoch that is repeated after its alerts went out
                return
            df.write.mode("overwrite").parquet(f"{self.folder}/alerts/epoch={epoch}")  # a repeated epoch replaces itself
            stored = self.spark.read.parquet(f"{self.folder}/alerts/epoch={epoch}")
            for name, n in alerts.route(stored.where("status = 'emitted'"), self.sinks).items():
                self.failures[name] = self.failures.get(name, 0) + n
            self._mark(epoch)

        return gated.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.folder}/checkpoints/alerts").queryName("alerts").trigger(**trigger).start()

    def _marker(self, epoch: int):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/checkpoints/sent/{epoch}")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _marked(self, epoch: int) -> bool:
        path, fs = self._marker(epoch)
        return fs.exists(path)

    def _mark(self, epoch: int) -> None:
        path, fs = self._marker(epoch)
        fs.create(path, True).close()

    def run_available(self, events: DataFrame) -> None:
        """Takes all that is there through every stage, then stops."""
        for start in (lambda t: self.dedup(events, t), self.detect, self.screen, self.alert):
            query = start({"availableNow": True})
            query.awaitTermination()
            if query.exception():
                raise query.exception()
            self.progress[query.name] = progress(query)
