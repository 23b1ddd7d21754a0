"""Regex spans with code-point offsets from SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string,extra:string>"
#: Matches folded at once: appending to an array copies it, so folds are nested to stay linear.
FOLD = 256


def find(text: Column, pattern: str, extra: int = 0) -> Column:
    """array<SPAN> of the leftmost non-overlapping matches (none may be empty), with group ``extra``.

    ``split`` keeps what lies between the matches, and their lengths add up to the offsets; Spark
    counts in code points. ``pattern`` is tried from each match's end, as ``\\G`` needs.
    """
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(extra)) if extra else values
    found = F.arrays_zip(gaps.alias("gap"), values.alias("value"), groups.alias("extra"))
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["extra"].alias("extra"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def block(acc: Column, first: Column) -> Column:
        inner = F.aggregate(F.slice(found, first, FOLD), F.struct(acc["at"].alias("at"), none.alias("spans")), lambda a, x: F.when(x["value"].isNull(), a).otherwise(step(a, x)))
        return F.transform(F.array(inner), lambda i: F.struct(i["at"].alias("at"), F.concat(acc["spans"], i["spans"]).alias("spans")))[0]

    spans = F.aggregate(F.sequence(F.lit(1), F.size(gaps), F.lit(FOLD)), F.struct(F.lit(0).alias("at"), none.alias("spans")), block)["spans"]
    return F.when(F.size(values) == 0, none).otherwise(spans)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def labelled(kinds: dict[str, Column]) -> Column:
    """array<struct<start, rank, end, kind, value>> of all spans, by start and then kind as listed;
    value is the match's extra group, the whole match without one."""

    def ranked(i: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["extra"].alias("value")))

    parts = [ranked(i, kind, found) for i, (kind, found) in enumerate(kinds.items())]
    return F.array_sort(F.concat(*parts))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: Column) -> Column:
    return F.sha2(joined(spans).cast("binary"), 256)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def outside(spans: Column, base: Column) -> Column:
    """The spans that overlap none of ``base``."""
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
