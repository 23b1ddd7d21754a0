"""Canonical schemas of events, detections and alerts, and what makes an event valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the event model.
KINDS = ("event", "alert", "metric", "state", "signal")
CATEGORIES = ("authentication", "process", "file", "network", "intrusion_detection", "host", "configuration")
OUTCOMES = ("success", "failure", "unknown")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()
_STRINGS = T.ArrayType(_S)
ENDPOINT = _struct(ip=_S, port=_I, user=_S)
PROCESS = _struct(pid=_I, ppid=_I, name=_S, executable=_S, command_line=_S)
FILE = _struct(path=_S, size=_L, mode=_S, hash=_struct(sha256=_S))
EVENT = _struct(timestamp=_TS, event=_struct(id=_S, kind=_S, category=_S, action=_S, outcome=_S, severity=_I), host=_struct(name=_S), source=ENDPOINT, destination=ENDPOINT, process=PROCESS, file=FILE, message=_S)
DETECTION = _struct(rule_id=_S, title=_S, severity=_I, attack=_STRINGS, nist_csf=_STRINGS, d3fend=_STRINGS, event_id=_S, host=_S, timestamp=_TS, message=_S)
ALERT = _struct(dedup_key=_S, rule_id=_S, title=_S, severity=_I, attack=_STRINGS, nist_csf=_STRINGS, event_id=_S, host=_S, timestamp=_TS, summary=_S)

_COMMON = {"source": _S, "occurred_at": _TS, "host": _S}
RAW = {
    "auth": _struct(**_COMMON, syslog_ts=_S, pid=_S, action=_S, outcome=_S, severity=_I, user=_S, ip=_S, port=_I, message=_S),
    "process": _struct(**_COMMON, action=_S, severity=_I, pid=_I, ppid=_I, starttime=_L, comm=_S, cmdline=_S, executable=_S),
    "file": _struct(**_COMMON, action=_S, severity=_I, path=_S, size=_L, mode=_S, sha256=_S, id_seed=_S),
    "network": _struct(**_COMMON, action=_S, severity=_I, proto=_S, local_ip=_S, local_port=_I, remote_ip=_S, remote_port=_I, state=_S, uid=_L, inode=_L),
}

#: Rules of a valid raw record, by source: (name, SQL predicate that must be true).
_WITHIN = "coalesce(length({0}) between {1} and {2}, false)"
_RANGE = "coalesce({0} between {1} and {2}, false)"
_OPTIONAL = "({0} is null or length({0}) <= {1})"
_PID = (1 << 31) - 1
_COMMON_RULES = [("occurred_at", "occurred_at is not null"), ("host", _WITHIN.format("host", 1, 253)), ("action", _WITHIN.format("action", 1, 200)), ("severity", _RANGE.format("severity", 0, 7))]
RAW_RULES: dict[str, list[tuple[str, str]]] = {
    "auth": [("syslog_ts", _WITHIN.format("syslog_ts", 1, 64)), ("pid", _WITHIN.format("pid", 0, 20)), ("outcome", "coalesce(outcome in ('success', 'failure', 'unknown'), false)"), ("user", _WITHIN.format("user", 1, 256)), ("ip", _WITHIN.format("ip", 1, 64)), ("port", _RANGE.format("port", 0, 65535)), ("message", _WITHIN.format("message", 1, 10000))],
    "process": [("pid", _RANGE.format("pid", 0, _PID)), ("ppid", _RANGE.format("ppid", 0, _PID)), ("starttime", "coalesce(starttime >= 0, false)"), ("comm", _WITHIN.format("comm", 0, 256)), ("cmdline", _OPTIONAL.format("cmdline", 10000)), ("executable", _OPTIONAL.format("executable", 4096))],
    "file": [("path", _WITHIN.format("path", 1, 4096)), ("size", "coalesce(size >= 0, false)"), ("mode", _WITHIN.format("mode", 1, 8)), ("sha256", r"(sha256 is null or sha256 rlike '^[0-9a-f]{64}\\z')"), ("id_seed", _WITHIN.format("id_seed", 1, 256))],
    "network": [("proto", _WITHIN.format("proto", 1, 8)), ("local_ip", _WITHIN.format("local_ip", 1, 64)), ("remote_ip", _WITHIN.format("remote_ip", 1, 64)), ("local_port", _RANGE.format("local_port", 0, 65535)), ("remote_port", _RANGE.format("remote_port", 0, 65535)), ("state", _WITHIN.format("state", 1, 20)), ("uid", "coalesce(uid >= 0, false)"), ("inode", "coalesce(inode >= 0, false)")],
}


def failed(rules: list[tuple[str, str]]) -> Column:
    """array<string> of the names of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(~F.expr(rule), F.lit(name)) for name, rule in rules]))


def raw_errors(source: str) -> Column:
    return failed(_COMMON_RULES + RAW_RULES[source])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``, absent ones null."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


#: Rules of a valid event, as for raw records.
EVENT_RULES: list[tuple[str, str]] = [
    ("timestamp", "timestamp is not null"),
    ("event.id", _WITHIN.format("event.id", 1, 128)),
    ("event.kind", f"coalesce(event.kind in {KINDS}, false)"),
    ("event.category", f"coalesce(event.category in {CATEGORIES}, false)"),
    ("event.action", _WITHIN.format("event.action", 1, 200)),
    ("event.outcome", f"coalesce(event.outcome in {OUTCOMES}, false)"),
    ("event.severity", _RANGE.format("event.severity", 0, 7)),
    ("host.name", _WITHIN.format("host.name", 1, 253)),
    *[(f"{end}.port", f"({end}.port is null or {end}.port between 0 and 65535)") for end in ("source", "destination")],
    *[(f"process.{p}", f"(process.{p} is null or process.{p} between 0 and {_PID})") for p in ("pid", "ppid")],
    ("file.size", "(file.size is null or file.size >= 0)"),
    ("file.mode", r"(file.mode is null or file.mode rlike '^[0-7]{1,8}\\z')"),
    ("file.hash.sha256", r"(file.hash.sha256 is null or file.hash.sha256 rlike '^[0-9a-f]{64}\\z')"),
]


def event_errors() -> Column:
    """array<string> of the fields of an event that are out of their range."""
    return failed(EVENT_RULES)


#: Stored tables; ``day`` is the partition column that storing adds.
STORED = {
    "events": "id long, event_id string, occurred_at timestamp, category string, action string, outcome string, severity int, host string, source_ip string, message string, created_at timestamp, day date",
    "alerts": "id long, dedup_key string, rule_id string, severity int, attack string, nist_csf string, event_id string, host string, occurred_at timestamp, summary string, created_at timestamp, day date",
}


def create_tables(spark, folder: str) -> None:
    """External Parquet tables of the stored rows, partitioned by day; existing ones stay."""
    for name, columns in STORED.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (day) LOCATION '{folder}/{name}'")
