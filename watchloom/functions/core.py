"""Scalar functions over columns."""

from __future__ import annotations

import socket

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "\x1f"
# Key fragments whose values are hidden, and what replaces them.
SENSITIVE = ("password", "passwd", "secret", "token", "api_key", "apikey", "authorization", "auth_header", "cookie", "session", "credential", "private_key", "hmac", "smtp_pass")
REDACTED = "***REDACTED***"
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f]"


def compute_id(*parts: Column) -> Column:
    """SHA-256 of the parts' text joined by the unit separator; null counts as 'None'."""
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256)


def clamp_severity(severity: Column) -> Column:
    return F.when(severity.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(7), severity))).cast("int")


def severity_label(severity: Column) -> Column:
    return F.when(severity.between(2, 3), "LOW").when(severity.between(4, 5), "MEDIUM").when(severity == 6, "HIGH").when(severity == 7, "CRITICAL").otherwise("INFO")


def resolve_host(host: Column, local: str | None = None) -> Column:
    """``host``, or the name of the machine that plans the query where it is null or empty."""
    return F.coalesce(F.nullif(host, F.lit("")), F.lit(local or socket.gethostname() or "localhost"))


def strip_control(c: Column, dtype: T.DataType) -> Column:
    """Control characters but tab and newline become '?', in strings at any depth."""
    if isinstance(dtype, T.StringType):
        return F.regexp_replace(c, CONTROL, "?")
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: strip_control(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, v: strip_control(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[strip_control(c[f.name], f.dataType).alias(f.name) for f in dtype.fields]))
    return c


def sensitive(key: Column) -> Column:
    return F.lower(key).rlike("|".join(SENSITIVE))


def redact(c: Column, dtype: T.DataType, key: str = "") -> Column:
    """Values under sensitive keys are hidden at any depth: struct fields by the schema, map entries by
    row. A struct field becomes text; see ``hidden`` for maps."""
    if any(s in key.lower() for s in SENSITIVE):
        return F.lit(REDACTED)
    if isinstance(dtype, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[redact(c[f.name], f.dataType, f.name).alias(f.name) for f in dtype.fields]))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda k, v: F.when(sensitive(k), hidden(v, dtype.valueType)).otherwise(redact(v, dtype.valueType)))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: redact(x, dtype.elementType))
    return c


def hidden(c: Column, dtype: T.DataType) -> Column:
    """A value under a sensitive key of a map. All values of a map have one type, so text in it is
    replaced and everything else becomes null."""
    if isinstance(dtype, T.StringType):
        return F.lit(REDACTED)
    if isinstance(dtype, T.StructType):
        return F.struct(*[hidden(c[f.name], f.dataType).alias(f.name) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StringType):
        return F.array(F.lit(REDACTED))
    return F.lit(None).cast(dtype)


def iso_utc(ts: Column) -> Column:
    """A timestamp as JSON text: seconds, microseconds only where there are some, and Z."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("Z"))


def split_csv(c: Column) -> Column:
    return F.filter(F.split(c, ","), lambda x: x != "")
