"""Random conditions over random events, against a plain interpreter of the grammar."""

import random

from pyspark.sql import functions as F

from watchloom.operators.compile import Compiler
from watchloom.sources.rules import parse_condition

SCHEMA = "a struct<s:string,n:int,f:double,b:boolean,l:array<string>>, t string"
VALUES = ["x", "xy", "", "X", "5", 0, 1, 2, 2.0, 2.5, -1, True, False]


def value_of(event, path):
    for name in path.split("."):
        if not isinstance(event, dict) or name not in event:
            return None
        event = event[name]
    return event


def interpret(node, event):
    if "all" in node:
        return all(interpret(c, event) for c in node["all"])
    if "any" in node:
        return any(interpret(c, event) for c in node["any"])
    if "not" in node:
        return not interpret(node["not"], event)
    actual, op, value = value_of(event, node["field"]), node["op"], node["value"]
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if op.startswith("not_"):
        return not interpret(node | {"op": op[4:]}, event)
    if op == "equals":
        return actual == value and not isinstance(actual, dict)
    if op == "in":
        return actual is not None and actual in value
    if op == "contains":
        return (isinstance(actual, str) and isinstance(value, str) and value in actual) or (isinstance(actual, list) and value in actual)
    if op in ("startswith", "endswith"):
        return isinstance(actual, str) and isinstance(value, str) and getattr(actual, op)(value)
    if not number(actual) or not number(value):
        return False
    return {"gt": actual > value, "gte": actual >= value, "lt": actual < value, "lte": actual <= value}[op]


def condition(rng, depth):
    if depth and rng.random() < 0.5:
        kind = rng.choice(["all", "any", "not"])
        return {kind: condition(rng, depth - 1)} if kind == "not" else {kind: [condition(rng, depth - 1) for _ in range(rng.randint(1, 3))]}
    op = rng.choice(["equals", "not_equals", "contains", "not_contains", "startswith", "endswith", "gt", "gte", "lt", "lte", "in", "not_in"])
    path = rng.choice(["a.s", "a.n", "a.f", "a.b", "a.l", "t", "a", "a.zz", "t.x", "zz"])
    return {"field": path, "op": op, "value": [rng.choice(VALUES) for _ in range(rng.randint(1, 4))] if op in ("in", "not_in") else rng.choice(VALUES)}


def test_random_conditions(spark):
    rng = random.Random(11)
    maybe = lambda x: None if rng.random() < 0.25 else x
    events = [{"a": maybe({"s": maybe(rng.choice(["x", "xy", "", "yx"])), "n": maybe(rng.randint(-1, 3)), "f": maybe(rng.choice([2.0, 2.5, -1.0])), "b": maybe(rng.random() < 0.5), "l": maybe([rng.choice(["x", "y"]) for _ in range(rng.randint(0, 2))])}), "t": maybe(rng.choice(["x", "5"]))} for _ in range(40)]
    df = spark.createDataFrame(events, SCHEMA).coalesce(1)
    nodes = [condition(rng, 2) for _ in range(120)]
    compiler = Compiler(df.schema, spark)
    got = df.select(F.array(*[compiler(parse_condition(n)) for n in nodes]).alias("r")).collect()
    for event, row in zip(events, got, strict=True):
        for node, result in zip(nodes, row.r, strict=True):
            assert result is bool(interpret(node, event)), (node, event)
