"""The synthetic tables seen as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom import schemas
from watchloom.functions.core import clamp_severity, compute_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows: the action is the type, the address comes from the user, severity from the value."""
    raw = table(spark, sf_dir, "events")
    none = {k: F.lit(None).cast(t) for k, t in (("s", "string"), ("i", "int"))}
    ip = F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"))
    end = lambda ip, port, user: F.struct(ip.alias("ip"), port.alias("port"), user.alias("user"))
    empty = end(none["s"], none["i"], none["s"])
    process = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.PROCESS.fields])
    meta = F.struct(compute_id(F.col("event_id"), F.col("event_type")).alias("id"), F.lit("event").alias("kind"), F.lit("host").alias("category"), F.col("event_type").alias("action"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"), clamp_severity(F.floor(F.col("value") / 50)).alias("severity"))
    return raw.select(
        F.col("ts").cast("timestamp").alias("timestamp"), meta.alias("event"), F.struct(F.concat(F.lit("host-"), (F.col("user_id") % 7).cast("string")).alias("name")).alias("host"), end(ip, F.get_json_object("props", "$.k").cast("int"), F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("source"), empty.alias("destination"), process.alias("process"), F.lit(None).cast(schemas.FILE).alias("file"),
        F.concat(F.col("event_type"), F.lit(" by u"), F.col("user_id").cast("string")).alias("message"), "event_id", "value", "props", "event_type", "user_id",
    )
