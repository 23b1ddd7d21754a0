"""Raw records to events, with dead letters set aside."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom import schemas
from watchloom.functions.core import clamp_severity, compute_id, resolve_host



def _meta(event_id: Column, category: str, outcome: Column) -> Column:
    return F.struct(event_id.alias("id"), F.lit("event").alias("kind"), F.lit(category).alias("category"), F.col("action").alias("action"), outcome.alias("outcome"), clamp_severity(F.col("severity")).alias("severity"))


def _endpoint(ip: Column | None = None, port: Column | None = None, user: Column | None = None) -> Column:
    parts = {"ip": ip, "port": port, "user": user}
    return F.struct(*[(F.lit(None) if c is None else c).cast(schemas.ENDPOINT[k].dataType).alias(k) for k, c in parts.items()])


def _event(meta: Column, message: Column, source: Column | None = None, destination: Column | None = None, process: Column | None = None, file: Column | None = None) -> list[Column]:
    empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.PROCESS.fields])
    return [F.col("occurred_at").alias("timestamp"), meta.alias("event"), F.struct(resolve_host(F.col("host")).alias("name")).alias("host"), (_endpoint() if source is None else source).alias("source"), (_endpoint() if destination is None else destination).alias("destination"), (empty if process is None else process).alias("process"), (F.lit(None).cast(schemas.FILE) if file is None else file).alias("file"), message.alias("message")]


def _key(host_in_id: bool, *parts: str) -> Column:
    return compute_id(*[F.col(p) for p in ((*parts, "host") if host_in_id else parts)])


def auth_columns(host_in_id: bool = False) -> list[Column]:
    meta = _meta(_key(False, "syslog_ts", "host", "pid", "action", "user", "ip", "port"), "authentication", F.col("outcome"))
    return _event(meta, F.col("message"), source=_endpoint(F.col("ip"), F.col("port"), F.col("user")))


def process_columns(host_in_id: bool = False) -> list[Column]:
    meta = _meta(_key(host_in_id, "pid", "starttime", "action"), "process", F.lit("success"))
    process = F.struct(F.col("pid").cast("int").alias("pid"), F.col("ppid").cast("int").alias("ppid"), F.nullif("comm", F.lit("")).alias("name"), F.col("executable").alias("executable"), F.col("cmdline").alias("command_line"))
    message = F.regexp_replace(F.concat(F.col("action"), F.lit(": pid="), F.col("pid").cast("string"), F.lit(" "), F.col("comm")), r"\s+\z", "")
    return _event(meta, message, process=process)


def file_columns(host_in_id: bool = False) -> list[Column]:
    meta = _meta(_key(host_in_id, "path", "action", "id_seed"), "file", F.lit("success"))
    file = F.struct(F.col("path").alias("path"), F.col("size").cast("long").alias("size"), F.col("mode").alias("mode"), F.struct(F.col("sha256").alias("sha256")).alias("hash"))
    return _event(meta, F.concat(F.col("action"), F.lit(": "), F.col("path")), file=file)


def network_columns(host_in_id: bool = False) -> list[Column]:
    meta = _meta(_key(host_in_id, "proto", "local_ip", "local_port", "remote_ip", "remote_port", "inode", "action"), "network", F.lit("success"))
    listens = F.col("state") == "LISTEN"
    destination = _endpoint(F.when(~listens, F.col("remote_ip")), F.when(~listens, F.col("remote_port")))
    remote = F.when(listens, F.lit("")).otherwise(F.concat(F.lit(" -> "), F.col("remote_ip"), F.lit(":"), F.col("remote_port").cast("string")))
    message = F.concat(F.col("action"), F.lit(": "), F.col("proto"), F.lit(" "), F.col("local_ip"), F.lit(":"), F.col("local_port").cast("string"), remote, F.lit(" (uid="), F.col("uid").cast("string"), F.lit(")"))
    return _event(meta, message, source=_endpoint(F.col("local_ip"), F.col("local_port")), destination=destination)


MAPPERS = {"auth": auth_columns, "process": process_columns, "file": file_columns, "network": network_columns}


def parse_json(lines: DataFrame, source: str, column: str = "value") -> DataFrame:
    """Records of one source from JSON text; ``errors`` names what is wrong with each.

    Unknown keys, a time without a UTC offset and unreadable JSON are faults, as is any field out of
    its range: such records stay in the frame as dead letters, with the text they came from.
    """
    schema = schemas.RAW[source]
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    extra = F.array_except(keys, F.array(*[F.lit(n) for n in schema.names]))
    when = F.get_json_object(column, "$.occurred_at")
    rows = lines.where(F.get_json_object(column, "$.source") == source).select(F.col(column).alias("raw"), F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("r"), F.when(F.size(extra) > 0, F.transform(extra, lambda k: F.concat(F.lit("extra:"), k))).alias("extra"), when.alias("at"))
    rows = rows.select("raw", "extra", "at", "r.*")
    zone = F.when(F.coalesce(~F.col("at").rlike(r"(Z|[+-]00:?00)\z"), F.lit(True)), F.array(F.lit("occurred_at_zone")))
    errors = F.concat(F.coalesce("extra", F.array().cast("array<string>")), F.coalesce(zone, F.array().cast("array<string>")), schemas.raw_errors(source))
    return rows.withColumn("errors", errors).drop("extra", "at")


def split_valid(records: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(valid, dead letters) of raw records; no job runs, both filter the same lazily added column."""
    checked = records if "errors" in records.columns else records.withColumn("errors", schemas.raw_errors(source))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def normalize(records: DataFrame, source: str, host_in_id: bool = False) -> DataFrame:
    """Events of valid raw records. ``host_in_id`` tells hosts of a fleet apart where the compatible
    id would not (process, file and network records)."""
    return records.select(*MAPPERS[source](host_in_id))


def normalize_all(by_source: dict[str, DataFrame], host_in_id: bool = False) -> DataFrame:
    """Events of several sources in one frame."""
    return reduce(DataFrame.unionByName, [normalize(split_valid(df, s)[0], s, host_in_id) for s, df in by_source.items()])
