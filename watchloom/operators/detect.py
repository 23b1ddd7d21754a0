"""Rules applied to events: one scan for all rules, one fold for all thresholds."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom import schemas
from watchloom.operators import folds
from watchloom.operators.compile import Compiler, field_type
from watchloom.sources.rules import Group, Leaf, Rule, Threshold, leaves

META = T.StructType([f for f in schemas.DETECTION.fields if f.name in ("rule_id", "title", "severity", "attack", "nist_csf", "d3fend")])


def meta(rule: Rule) -> Column:
    """The part of a detection that only depends on the rule, as a constant."""
    texts = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    return F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.title).alias("title"), F.lit(rule.severity).alias("severity"), texts(rule.attack).alias("attack"), texts(rule.nist_csf).alias("nist_csf"), texts(rule.d3fend).alias("d3fend"))


def detection(rule: Column) -> list[Column]:
    """Detection columns of an event row for a rule's meta column."""
    message = F.concat(rule["title"], F.lit(" ["), F.array_join(rule["attack"], ","), F.lit("] — "), F.col("event.action"), F.lit(" on "), F.col("host.name"))
    return [*(rule[f].alias(f) for f in META.names), F.col("event.id").alias("event_id"), F.col("host.name").alias("host"), F.col("timestamp").alias("timestamp"), message.alias("message")]


def actions(node: Leaf | Group | Threshold) -> set[str] | None:
    """Values of event.action that a condition needs, or None if it may hold for any."""
    if isinstance(node, Leaf):
        if node.path == "event.action" and node.op == "equals" and isinstance(node.value, str):
            return {node.value}
        return {v for v in node.value if isinstance(v, str)} if node.path == "event.action" and node.op == "in" else None
    if isinstance(node, Threshold):
        return actions(node.match)
    parts = [actions(c) for c in node.children]
    if node.kind == "all":
        known = [p for p in parts if p is not None]
        return reduce(set.intersection, known) if known else None
    return None if node.kind == "not" or any(p is None for p in parts) else set().union(*parts)


def needed(rules: list[Rule]) -> Column | None:
    """A filter on event.action that no match of the rules fails; it reaches the scan."""
    sets = [actions(r.condition) for r in rules]
    return None if any(s is None for s in sets) else F.col("event.action").isin(sorted(set().union(*sets)))


def stateless(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Detections of rules without a window, in rule order for each event: all predicates are
    evaluated in one pass and a row comes out for each that holds."""
    compiler = Compiler(events.schema, events.sparkSession)
    fired = F.array_compact(F.array(*[F.when(compiler(r.condition), meta(r)) for r in rules]))
    if (keep := needed(rules)) is not None:
        events = events.where(keep)
    found = events.withColumn("fired", fired).where(F.size("fired") > 0)
    return found.select("*", F.explode("fired").alias("rule")).select(*detection(F.col("rule")))


class _Gate:
    """The step of a rule's threshold, or one that lets every row through where it has no window."""

    def __init__(self, windows: list[tuple[int, int] | None], rule: int):
        self.step = folds.ThresholdStep(*windows[rule]) if windows[rule] else None

    def __call__(self, t: int) -> bool:
        return self.step is None or self.step(t)


def evaluate(events: DataFrame, rules: list[Rule], order: list[Column] | None = None) -> DataFrame:
    """All detections of the enabled rules over a batch of events, in one scan.

    Without threshold rules no row moves. With some, the rows that match any rule are folded together,
    keyed by rule and group; events without the group's value are skipped.
    """
    rules = [r for r in rules if r.enabled]
    plain = [r for r in rules if not isinstance(r.condition, Threshold)]
    timed = [r for r in rules if isinstance(r.condition, Threshold) and field_type(events.schema, r.condition.group_by) is not None]
    if not plain and not timed:
        return events.sparkSession.createDataFrame([], schemas.DETECTION)
    if not timed:
        return stateless(events, plain)
    compiler = Compiler(events.schema, events.sparkSession)
    every = [*plain, *timed]
    hits, windows = [], []
    for i, r in enumerate(every):
        t = r.condition if isinstance(r.condition, Threshold) else None
        group = F.col(t.group_by).cast("string") if t else F.lit(None).cast("string")
        holds = compiler(t.match) & group.isNotNull() if t else compiler(r.condition)
        hits.append(F.when(holds, F.struct(F.lit(i).alias("i"), group.alias("group"))))
        windows.append((round(t.window_seconds * 1e6), t.count) if t else None)
    if (keep := needed(every)) is not None:
        events = events.where(keep)
    seq = {f"seq{n}": c for n, c in enumerate(order or [])}
    found = events.select("timestamp", F.col("event.id").alias("event_id"), F.col("event.action").alias("action"), F.col("host.name").alias("name"), *[c.alias(n) for n, c in seq.items()], F.array_compact(F.array(*hits)).alias("hits")).where(F.size("hits") > 0)
    # a busy group is one task's to sort: rows carry the rule's number, and its texts come after
    found = found.select("*", F.explode("hits").alias("hit")).drop("hits").select("*", "hit.*").drop("hit")
    # a stateless hit is alone under its key, so it moves to any task
    key = F.concat_ws("|", F.col("i").cast("string"), F.coalesce(F.concat(F.lit("g:"), "group"), F.concat(F.lit("e:"), "event_id")))
    longest = max(w[0] for w in windows if w)
    fired = folds.ordered_fold(found.withColumn("key", key).drop("group"), ["key"], "timestamp", list(seq) or ["event_id"], partial(_Gate, windows), longest, "fired", (F.col("i"),))
    fired = fired.where("fired").select("timestamp", F.struct(F.col("event_id").alias("id"), "action").alias("event"), F.struct("name").alias("host"), F.element_at(F.array(*map(meta, every)), F.col("i") + 1).alias("rule"))
    return fired.select(*detection(F.col("rule"))).select(*schemas.DETECTION.names)


def fields_used(rules: list[Rule]) -> list[str]:
    """Paths that the rules read, for pruning by hand where a source cannot."""
    return sorted({leaf.path for r in rules for leaf in leaves(r.condition)})


def listing(spark, rules: list[Rule]) -> DataFrame:
    """id, title, severity and framework ids of the rules."""
    return spark.createDataFrame([(r.id, r.title, r.severity, list(r.attack), list(r.nist_csf), list(r.d3fend)) for r in rules], "id string, title string, severity int, attack array<string>, nist_csf array<string>, d3fend array<string>")


def coverage(spark, rules: list[Rule]) -> DataFrame:
    """Rules by id with their framework ids as text; a dash where there is none."""
    text = lambda c: F.when(F.size(c) == 0, "—").otherwise(F.array_join(c, ", "))
    return listing(spark, rules).select("id", "severity", text(F.col("attack")).alias("attack"), text(F.col("nist_csf")).alias("nist_csf"), text(F.col("d3fend")).alias("d3fend")).orderBy("id")
