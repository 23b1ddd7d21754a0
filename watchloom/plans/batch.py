"""The whole chain over a batch: raw records to gated alerts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from watchloom import schemas
from watchloom.operators import alerts, detect, folds, normalize
from watchloom.sources.rules import Rule


@dataclass
class Batch:
    """Frames of every step; ``stats`` fills when a job over the alerts has run."""

    events: DataFrame
    dead_letters: dict[str, DataFrame]
    detections: DataFrame
    alerts: DataFrame
    observed: dict[str, Observation]
    rules: int

    def stats(self) -> dict[str, int]:
        """Counts of the steps that have run. received = accepted + dead_letters, and accepted =
        processed + deduped; a processed event is evaluated against every rule; each fired detection
        is emitted, deduped, throttled or suppressed at the gates."""
        got: dict[str, int] = {"rules": self.rules}
        for o in self.observed.values():
            for k, v in o.get.items():
                got[k] = got.get(k, 0) + v
        got["accepted"] = got["received"] - got["dead_letters"]
        got["deduped"] = got["accepted"] - got["processed"]
        got["evaluations"] = got["processed"] * self.rules
        return got


def run(records: dict[str, DataFrame], rules: list[Rule], gates: alerts.Gates | None = None, dedup_seconds: float = 60.0, host_in_id: bool = False) -> Batch:
    """``records`` holds raw records by source, each read once on the way to the alerts. Nothing runs
    until a frame of the result is used; the counts are observed on the way and need no job of their
    own."""
    watch = {f"received {s}": Observation(f"received {s}") for s in records} | {name: Observation(name) for name in ("processed", "fired", "gated")}
    checked = {}
    for s, df in records.items():
        df = df if "errors" in df.columns else df.withColumn("errors", schemas.raw_errors(s))
        checked[s] = df.observe(watch[f"received {s}"], F.count(F.lit(1)).alias("received"), F.count_if(F.size("errors") > 0).alias("dead_letters"))
    valid = {s: df.where(F.size("errors") == 0).drop("errors") for s, df in checked.items()}
    dead = {s: normalize.split_valid(df, s)[1] for s, df in records.items()}
    events = reduce(DataFrame.unionByName, [normalize.normalize(df, s, host_in_id) for s, df in valid.items()])
    keyed = events.withColumn("dedup_id", F.col("event.id"))
    fresh = folds.dedup(keyed, ["dedup_id"], "timestamp", ["dedup_id"], dedup_seconds).where("fresh").drop("fresh", "dedup_id")
    fresh = fresh.observe(watch["processed"], F.count(F.lit(1)).alias("processed"))
    found = detect.evaluate(fresh, rules).observe(watch["fired"], F.count(F.lit(1)).alias("fired"))
    gated = alerts.gate(alerts.build(found), gates or alerts.Gates())
    gated = gated.observe(watch["gated"], *[F.count_if(F.col("status") == x).alias(name) for x, name in (("emitted", "alerts_emitted"), ("deduped", "alerts_deduped"), ("throttled", "alerts_throttled"), ("suppressed_severity", "alerts_suppressed"))])
    return Batch(fresh, dead, found, gated, watch, sum(r.enabled for r in rules))
