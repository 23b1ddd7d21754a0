"""The chain from raw records to alerts."""

from datetime import datetime, timedelta

from watchloom import schemas
from watchloom.operators import alerts
from watchloom.plans import batch
from watchloom.sources.rules import load_rules

T0 = datetime(2026, 1, 1)


def record(i, t, outcome="failure"):
    return ("auth", T0 + timedelta(seconds=t), "h", f"Jan 1 00:00:{i:02d}", "1", "ssh_login_failed", outcome, 4, "u", "1.2.3.4", 22, "Failed password")


def test_chain(spark):
    rows = [record(i, i) for i in range(6)] + [record(3, 4), record(9, 9, "bogus")]
    got = batch.run({"auth": spark.createDataFrame(rows, schemas.RAW["auth"])}, load_rules(), alerts.Gates(min_severity=6))
    assert [(r.rule_id, r.status) for r in got.alerts.collect()] == [("ssh-brute-force", "emitted")]
    assert got.dead_letters["auth"].first().errors == ["outcome"]
    n = got.stats()
    assert (n["received"], n["dead_letters"], n["accepted"], n["processed"], n["deduped"]) == (8, 1, 7, 6, 1)
    assert n["processed"] + n["deduped"] + n["dead_letters"] == n["received"] and n["evaluations"] == 6 * 17
    assert n["fired"] == n["alerts_emitted"] + n["alerts_deduped"] + n["alerts_throttled"] + n["alerts_suppressed"] == 1
    assert got.events.count() == 6
    bad = got.events.withColumn("errors", schemas.event_errors()).where("size(errors) > 0")
    assert bad.count() == 0


def test_event_rules_and_tables(spark, tmp_path):
    good = {"timestamp": T0, "event": {"id": "a", "kind": "event", "category": "file", "action": "x", "outcome": "success", "severity": 9}, "host": {"name": "h"}, "source": {"port": 70000}, "destination": {}, "process": {"pid": -1}, "file": {"size": -1, "mode": "9", "hash": {"sha256": "A" * 64}}, "message": "m"}
    df = spark.createDataFrame([good], schemas.EVENT)
    assert df.select(schemas.event_errors().alias("e")).first().e == ["event.severity", "source.port", "process.pid", "file.size", "file.mode", "file.hash.sha256"]
    schemas.create_tables(spark, str(tmp_path))
    assert spark.table("alerts").count() == 0
    spark.sql("DROP TABLE alerts")
    spark.sql("DROP TABLE events")


def test_the_chain_reads_its_input_once(spark, tmp_path):
    spark.createDataFrame([record(0, 0)], schemas.RAW["auth"]).write.parquet(str(tmp_path / "r"))
    got = batch.run({"auth": spark.read.schema(schemas.RAW["auth"]).parquet(str(tmp_path / "r"))}, load_rules())
    plan = got.alerts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("MapInArrow") == 4
