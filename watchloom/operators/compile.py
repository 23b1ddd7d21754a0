"""Rule conditions compiled to boolean columns that are never null."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from watchloom.functions.core import iso_utc
from watchloom.sources.rules import Group, Leaf, Threshold

#: Characters of a value that a pattern sees, and seconds that one match may take off the JVM.
REGEX_CHARS, REGEX_SECONDS = 8192, 0.1
#: Java is asked for dot-all-free, Unicode-aware matching with \n as the only line end.
FLAGS = "(?diuU)"
_NESTED = re.compile(r"\((?:[^()\\]|\\.)*[+*](?:[^()\\]|\\.)*\)[+*{]|\((?:[^()\\]|\\.)*\|(?:[^()\\]|\\.)*\)[+*]")


def field_type(schema: T.StructType, path: str) -> T.DataType | None:
    """Type of a dotted path; None if it is absent or leads through something that is no struct."""
    at: T.DataType = schema
    for name in path.split("."):
        if not isinstance(at, T.StructType) or name not in at.names:
            return None
        at = at[name].dataType
    return at


def _number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


class Compiler:
    """Compiles conditions against one schema; types are settled here, so ANSI casts never raise."""

    def __init__(self, schema: T.StructType, spark: SparkSession | None = None):
        self.schema = schema
        self.spark = spark or SparkSession.active()

    def __call__(self, node: Leaf | Group | Threshold) -> Column:
        if isinstance(node, Threshold):
            return self(node.match)
        if isinstance(node, Group):
            parts = [self(c) for c in sorted(node.children, key=_cost)]
            if node.kind == "not":
                return ~parts[0]
            return reduce(lambda a, b: a & b, parts) if node.kind == "all" else reduce(lambda a, b: a | b, parts)
        return self.leaf(node)

    def leaf(self, leaf: Leaf) -> Column:
        op, value = leaf.op, leaf.value
        if op in ("not_equals", "not_contains", "not_in"):
            return ~self.leaf(Leaf(leaf.path, op.removeprefix("not_"), value))
        dtype = field_type(self.schema, leaf.path)
        if dtype is None or isinstance(dtype, T.StructType):
            return F.lit(False)
        c = F.col(".".join(f"`{p}`" for p in leaf.path.split(".")))
        if isinstance(dtype, T.TimestampType):
            c, dtype = iso_utc(c), T.StringType()
        text, number = isinstance(dtype, T.StringType), isinstance(dtype, T.NumericType)
        if op == "equals":
            return self._equal(c, dtype, value)
        if op == "in":
            return reduce(lambda a, b: a | b, [self._equal(c, dtype, v) for v in value if not (text and isinstance(v, str)) and not (number and _number(v))], self._member(c, text, number, value))
        if op == "contains":
            if isinstance(dtype, T.ArrayType):
                return F.coalesce(F.exists(c, lambda x: self._equal(x, dtype.elementType, value)), F.lit(False))
            return F.coalesce(c.contains(value), F.lit(False)) if text and isinstance(value, str) else F.lit(False)
        if op in ("startswith", "endswith"):
            return F.coalesce(getattr(c, op)(value), F.lit(False)) if text and isinstance(value, str) else F.lit(False)
        if op == "regex":
            return self._regex(c, value) if text and isinstance(value, str) else F.lit(False)
        if not number or not _number(value):
            return F.lit(False)
        return F.coalesce({"gt": c > value, "gte": c >= value, "lt": c < value, "lte": c <= value}[op], F.lit(False))

    @staticmethod
    def _member(c: Column, text: bool, number: bool, values: tuple) -> Column:
        """One IN list for the values of the column's own kind, which Catalyst turns into a set."""
        own = [v for v in values if (text and isinstance(v, str)) or (number and _number(v))]
        return F.coalesce(c.isin(own), F.lit(False)) if own else F.lit(False)

    @staticmethod
    def _equal(c: Column, dtype: T.DataType, value: Any) -> Column:
        if isinstance(dtype, T.StringType):
            return c.eqNullSafe(value) if isinstance(value, str) else F.lit(False)
        if isinstance(value, str):
            return F.lit(False)
        if isinstance(dtype, T.BooleanType):
            return c.cast("int").eqNullSafe(F.lit(value).cast("int") if isinstance(value, bool) else F.lit(value))
        if isinstance(dtype, T.NumericType):
            return c.eqNullSafe(int(value) if isinstance(value, bool) else value)
        return F.lit(False)

    def _regex(self, c: Column, pattern: str) -> Column:
        seen = F.substring(c, 1, REGEX_CHARS)
        java = to_java(self.spark, pattern)
        return F.coalesce(seen.rlike(java) if java else slow_regex(pattern)(seen), F.lit(False))


def _cost(node: Leaf | Group | Threshold) -> int:
    """Cheap predicates first: generated code stops at the first that decides."""
    return (2 if node.op == "regex" else 0) if isinstance(node, Leaf) else 1


def to_java(spark: SparkSession, pattern: str) -> str | None:
    """The pattern for the JVM, or None where it must not run there: it does not compile, means
    something else (sets inside classes), or may take exponential time, as Spark has no time limit."""
    if _NESTED.search(pattern) or re.search(r"\[[^\]]*(\[|&&|--)", pattern):
        return None
    java = FLAGS + pattern.replace("(?P<", "(?<")
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except Exception as err:
        if "PatternSyntaxException" not in str(err):
            raise
        return None
    return java


def slow_regex(pattern: str):
    """Matching in Arrow batches with a time limit for each value; a timeout is no match."""

    @pandas_udf(T.BooleanType())
    def match(values: pd.Series) -> pd.Series:
        import regex

        compiled = regex.compile(pattern, regex.IGNORECASE)

        def one(value: str | None) -> bool:
            try:
                return value is not None and compiled.search(value, timeout=REGEX_SECONDS) is not None
            except TimeoutError:
                return False

        return values.map(one).astype(bool)

    return match
