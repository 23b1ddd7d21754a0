"""Folds against plain loops, gates, sinks, storage and metrics."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from watchloom import schemas
from watchloom.operators import alerts, folds, store
from watchloom.plans import catalog

T0 = datetime(2026, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(k, T0 + timedelta(seconds=t), i) for i, (k, t) in enumerate(rows)], "k string, at timestamp, i long")


def flags(df, name):
    return {r.i for r in df.where(name).select("i").collect()}


def test_threshold_cases(spark):
    run = lambda rows, n=3: flags(folds.threshold(frame(spark, rows), ["k"], "at", ["i"], 60, n), "fired")
    assert run([("a", t) for t in range(6)]) == {2, 5}
    assert run([("a", 0), ("a", 1), ("b", 0), ("b", 1)]) == set()
    assert run([("a", 0), ("a", 1), ("a", 120)]) == set()
    assert run([("a", 0), ("a", 30), ("a", 60)]) == {2}
    assert run([(None, t) for t in range(5)]) == set()


def test_dedup_cases(spark):
    run = lambda times: flags(folds.dedup(frame(spark, [("a", t) for t in times]), ["k"], "at", ["i"], 10), "fresh")
    assert run([0, 5]) == {0}
    assert run([0, 11]) == {0, 1}
    assert run([0, 5, 11]) == {0, 2}
    assert run([0, 10]) == {0, 1}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 400)), max_size=60))
def test_folds_match_loops(spark, rows):
    df = frame(spark, rows)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1], i))
    steps = {"fired": lambda: folds.ThresholdStep(30, 3), "fresh": lambda: folds.DedupStep(30), "passed": lambda: folds.ThrottleStep(30, 2)}
    for split in (False, True):
        frames = {"fired": folds.threshold(df, ["k"], "at", ["i"], 30, 3, split_pauses=split), "fresh": folds.dedup(df, ["k"], "at", ["i"], 30, split_pauses=split), "passed": folds.throttle(df, ["k"], "at", ["i"], 30, 2, split_pauses=split)}
        for name, start in steps.items():
            state = {}
            want = {i for i in order if state.setdefault(rows[i][0], start())(rows[i][1])}
            assert flags(frames[name], name) == want


def test_one_scan_and_one_exchange_a_fold(spark, tmp_path):
    frame(spark, [("a", 1), ("b", 2)]).write.parquet(str(tmp_path / "t"))
    made(spark, [("r", "a", 5, 0)]).write.parquet(str(tmp_path / "a"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    one = plan(folds.dedup(spark.read.parquet(str(tmp_path / "t")), ["k"], "at", ["i"], 10))
    assert one.count("FileScan") == 1 and one.count("Exchange hashpartitioning") == 1 and "Join" not in one
    two = plan(alerts.gate(spark.read.parquet(str(tmp_path / "a"))))
    assert two.count("FileScan") == 1 and two.count("Exchange hashpartitioning") == 2 and "Union" not in two


def test_api_rate_limit_rejects(spark, tmp_path):
    """A third of all requests is one client's, over 100 a minute for a while."""
    rows = [(i, 7 if i % 3 == 0 else i % 40 + 100, T0 + timedelta(milliseconds=150 * i if i < 1500 else 225_000 + 900 * (i - 1500))) for i in range(2000)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    want, hits = {}, {}
    for _, user, at in sorted(rows, key=lambda r: (r[2], r[0])):
        hits[user] = [t for t in hits.get(user, []) if t >= at - timedelta(seconds=60)]
        if len(hits[user]) < 100:
            hits[user].append(at)
            want[user] = want.get(user, 0) + 1
    assert want[7] < sum(r[1] == 7 for r in rows)
    got = catalog.queries()["api_rate_limit"](spark, str(tmp_path)).collect()
    assert {r.user_id: r.n for r in got} == want


def made(spark, rows):
    return spark.createDataFrame([(f"{r}|{e}", r, "t", s, ["T1"], ["DE.CM"], e, "h", T0 + timedelta(seconds=t), "sum") for r, e, s, t in rows], schemas.ALERT)


def test_gates(spark):
    gates = alerts.Gates(min_severity=3, dedup_seconds=300, throttle_max=2, throttle_seconds=60)
    rows = [("r", "a", 5, 0), ("r", "a", 5, 1), ("r", "b", 5, 2), ("r", "c", 5, 3), ("r", "c", 5, 4), ("r", "d", 2, 5), ("r", "e", 5, 70), ("q", "a", 5, 0)]
    got = alerts.stats(alerts.gate(made(spark, rows), gates)).collect()
    assert {r.status: r.n for r in got} == {"emitted": 4, "deduped": 2, "throttled": 1, "suppressed_severity": 1}
    own = alerts.per_rule(made(spark, rows), {"r": (300, 1)}, gates).where("status = 'emitted'")
    assert sorted((r.rule_id, r.event_id) for r in own.collect()) == [("q", "a"), ("r", "a")]


def test_sinks(spark):
    import hashlib
    import hmac

    df = made(spark, [("r", "a", 6, 0)])
    assert df.select(alerts.console_line()).first()[0] == "2026-01-01T00:00:00Z [HIGH] r (T1) host=h :: sum"
    mail = df.select(alerts.email("a@x", ["b@x", "c@x"]).alias("m")).first().m
    assert mail.subject == "[HIGH] r on h" and "Severity:  6 (HIGH)" in mail.body and mail.to == "b@x, c@x"
    body = df.select(alerts.webhook_body(["rule_id", "severity"]).alias("b"))
    for key in ("k", "long" * 40):
        row = body.select("b", alerts.signature(key, F.col("b")).alias("s")).first()
        assert row.s == "sha256=" + hmac.new(key.encode(), row.b.encode(), hashlib.sha256).hexdigest()
    wrote = []
    sinks = [alerts.Sink("bad", lambda d: 1 / 0), alerts.Sink("good", lambda d: wrote.append(d.count())), alerts.Sink("high", lambda d: wrote.append(d.count()), 7)]
    assert alerts.route(df, sinks) == {"bad": 1} and wrote == [1, 0]
    for url, ok in {"https://8.8.8.8/": True, "http://8.8.8.8/": False, "https://127.0.0.1/": False, "https://10.0.0.1/": False, "https://[::1]/": False, "https://169.254.1.1/": False}.items():
        if ok:
            alerts.check_destination(url)
        else:
            with pytest.raises(alerts.BlockedDestination):
                alerts.check_destination(url)
    with pytest.raises(alerts.BlockedDestination):
        alerts.check_destination("https://name.example/", resolve=lambda h: ["8.8.8.8", "10.0.0.1"])
    waits, codes = [], iter([503, 429, 200])
    assert alerts.post_with_retry(lambda b: next(codes), "x", waits.append) == 200 and waits == [0.5, 1.0]
    with pytest.raises(RuntimeError):
        alerts.post_with_retry(lambda b: 500, "x", waits.append)
    with pytest.raises(RuntimeError):
        alerts.post_with_retry(lambda b: 400, "x", waits.append)


def test_pages_and_metrics(spark, tmp_path):
    rows = spark.range(1, 6)
    first = store.read_page(rows, 2)
    second = store.read_page(rows, 2, first["next_cursor"])
    last = store.read_page(rows, 2, second["next_cursor"])
    assert [[i["id"] for i in p["items"]] for p in (first, second, last)] == [[5, 4], [3, 2], [1]]
    assert first["total"] == 5 and last["has_more"] is False and last["next_cursor"] is None
    with pytest.raises(ValueError):
        store.read_page(rows, 101)
    values = spark.createDataFrame([(0.0005,), (0.02,), (9.0,), (None,)], "v double")
    assert [r.n for r in store.histogram(F.col("v"))(values).collect()] == [1, 1, 1, 2, 2, 2, 2, 2, 3]
    lines = store.prometheus(spark.createDataFrame([('a"b\\c', 2)], "l string, n long"), "m_total", ["l"]).first().line
    assert lines == 'm_total{l="a\\"b\\\\c"} 2'
    stored = store.with_ids(store.alert_rows(made(spark, [("r", "a", 6, 0)])))
    store.append(stored, str(tmp_path / "alerts"))
    assert spark.read.parquet(str(tmp_path / "alerts")).first().attack == "T1"
