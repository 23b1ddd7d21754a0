"""Streams agree with batches, and a restart neither loses nor repeats rows."""

from datetime import datetime, timedelta

import pytest

from watchloom import schemas
from watchloom.operators import alerts, detect
from watchloom.sources import live
from watchloom.sources.rules import load_rules
from watchloom.streaming import processors
from watchloom.streaming.processors import Pipeline

T0 = datetime(2026, 1, 1)


def login(i, t, ip="1.2.3.4", ident=None):
    return {"timestamp": T0 + timedelta(seconds=t), "event": {"id": ident or f"e{i:03d}", "kind": "event", "category": "authentication", "action": "ssh_login_failed", "outcome": "failure", "severity": 4}, "host": {"name": "h"}, "source": {"ip": ip, "port": 1, "user": "u"}, "destination": {}, "process": {}, "file": None, "message": "m"}


@pytest.fixture()
def landing(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, schemas.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return tmp_path, write


def test_pipeline_matches_batch_and_restarts(spark, landing):
    folder, write = landing
    sent = []
    sink = alerts.Sink("list", lambda d: sent.extend(r.event_id for r in d.collect()))
    rules = [r for r in load_rules() if r.id == "ssh-brute-force"]
    first = [login(i, i) for i in range(7)] + [login(90, 8, ident="e003"), login(50, 3, ip="9.9.9.9")]
    second = [login(i, i) for i in range(10, 14)]
    pipe = lambda: Pipeline(spark, str(folder / "out"), rules, sinks=[sink, alerts.Sink("bad", lambda d: 1 / 0)])
    stream = lambda: spark.readStream.schema(schemas.EVENT).parquet(str(folder / "in"))
    write(first)
    p = pipe()
    p.run_available(stream())
    assert sent == ["e004"] and p.failures["bad"] >= 1
    assert p.progress["silver"]["rows"] == 9 and p.progress["silver"]["late"] == 0 and p.progress["gold"]["rows"] == 8
    write(second)
    pipe().run_available(stream())
    silver = spark.read.parquet(str(folder / "out" / "silver"))
    assert silver.count() == 12 and silver.select("event.id").distinct().count() == 12
    batch = sorted(r.event_id for r in detect.evaluate(silver, rules).collect())
    gold = sorted(r.event_id for r in spark.read.parquet(str(folder / "out" / "gold")).collect())
    assert gold == batch == ["e004", "e012"] and sent == gold
    pipe().run_available(stream())
    assert sent == gold and spark.read.parquet(str(folder / "out" / "silver")).count() == 12


def test_collector_lands_rows_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n")
    make = lambda: live.Collector("lines", lambda s: s.readStream.text(str(tmp_path / "in")), str(tmp_path / "out"))
    for more, want in ((None, 2), ("three\n", 3)):
        if more:
            (tmp_path / "in" / "b.txt").write_text(more)
        collector = make()
        collector.run(spark)
        assert not collector.wait_stop(0.1)
        collector.stop()
        assert collector.wait_stop(5) and spark.read.parquet(str(tmp_path / "out" / "lines")).count() == want
    with pytest.raises(ValueError):
        live.Collector("", lambda s: None, "x")


def test_a_failing_row_does_not_stop_the_others(spark):
    def send(row):
        if row["i"] % 3 == 0:
            raise KeyError(row["i"])

    got = alerts.deliver(spark.range(10).withColumnRenamed("id", "i"), send).collect()
    assert {r.i: r.error for r in got} == {i: "KeyError" if i % 3 == 0 else None for i in range(10)}


def test_stream_gates_agree_with_the_batch_gate(spark, tmp_path):
    rows = [("r", "a", 5, 0), ("r", "a", 5, 1), ("r", "b", 5, 2), ("r", "c", 5, 3), ("r", "c", 5, 4), ("r", "d", 2, 5), ("r", "e", 5, 30), ("q", "a", 5, 0), ("q", "f", 5, 0)]
    found = spark.createDataFrame([(r, "t", s, ["T1"], ["DE.CM"], [], e, "h", T0 + timedelta(seconds=t), "m") for r, e, s, t in rows], schemas.DETECTION)
    gates = alerts.Gates(min_severity=3, dedup_seconds=300, throttle_max=2, throttle_seconds=60)
    want = sorted(tuple(r) for r in alerts.gate(alerts.build(found), gates).select("rule_id", "event_id", "timestamp", "status").collect())
    found.coalesce(1).write.parquet(str(tmp_path / "gold"))
    stream = spark.readStream.schema(schemas.DETECTION).parquet(str(tmp_path / "gold"))
    for name, make in (("screened", lambda: processors.screen_stream(stream, gates)), ("final", lambda: processors.throttle_alerts(spark.readStream.schema(processors.SCREENED).parquet(str(tmp_path / "screened")), gates))):
        make().writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "final")).select("rule_id", "event_id", "timestamp", "status").collect()) == want
