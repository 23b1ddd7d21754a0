"""Differences between two snapshots of files, processes or sockets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE_KEY, PROCESS_KEY = ("path",), ("pid", "starttime")
SOCKET_KEY = ("proto", "local_ip", "local_port", "remote_ip", "remote_port", "inode")


def paired(old: DataFrame, new: DataFrame, key: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Full outer join on the key (and ``by``, such as the host): key columns, structs old and new."""
    on = [*by, *key]
    left = old.select(*on, F.struct(*[c for c in old.columns if c not in on] or [F.lit(1).alias("one")]).alias("old"))
    right = new.select(*on, F.struct(*[c for c in new.columns if c not in on] or [F.lit(1).alias("one")]).alias("new"))
    return left.join(right, on, "full_outer")


def octal_mode(mode: Column) -> Column:
    """A mode as octal text of at least four digits."""
    text = F.conv(mode.cast("string"), 10, 8)
    return F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)


def content_changed(old: Column, new: Column) -> Column:
    both = old["sha256"].isNotNull() & new["sha256"].isNotNull()
    return F.when(both, old["sha256"] != new["sha256"]).otherwise((old["size"] != new["size"]) | (old["mtime_ns"] != new["mtime_ns"]))


def diff_files(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Changes of (path, size, mtime_ns, mode, sha256): action, severity, size, mode, sha256, id_seed.
    A content change beats a change of mode; a deletion reports the old state."""
    o, n = F.col("old"), F.col("new")
    action = F.when(o.isNull(), "file_created").when(n.isNull(), "file_deleted").when(content_changed(o, n), "file_modified").when(o["mode"] != n["mode"], "file_attributes_modified")
    rows = paired(old, new, FILE_KEY, by).withColumn("action", action).where("action is not null").withColumn("s", F.coalesce("new", "old"))
    severity = F.when(F.col("action") == "file_created", 3).when(F.col("action") == "file_modified", 4).otherwise(5)
    content = F.coalesce(F.col("s.sha256"), F.concat_ws(":", F.col("s.size").cast("string"), F.col("s.mtime_ns").cast("string")))
    mode = octal_mode(F.col("s.mode"))
    seed = F.when(F.col("action") == "file_attributes_modified", mode).otherwise(content)
    return rows.select(*by, "path", "action", severity.alias("severity"), F.col("s.size").alias("size"), mode.alias("mode"), F.col("s.sha256").alias("sha256"), seed.alias("id_seed"))


def diff_processes(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Processes that started or stopped; a reused pid is a stop and a start, as its start time differs."""
    rows = paired(old, new, PROCESS_KEY, by).where("old is null or new is null").withColumn("s", F.coalesce("new", "old"))
    started = F.col("old").isNull()
    return rows.select(*by, *PROCESS_KEY, F.when(started, "process_started").otherwise("process_stopped").alias("action"), F.when(started, 3).otherwise(2).alias("severity"), "s.*")


def diff_sockets(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sockets that appeared or went, by their state; a change of state alone is none."""
    rows = paired(old, new, SOCKET_KEY, by).where("old is null or new is null").withColumn("s", F.coalesce("new", "old"))
    opened, listens = F.col("old").isNull(), F.col("s.state") == "LISTEN"
    action = F.when(opened & listens, "network_listen_started").when(listens, "network_listen_stopped").when(opened, "network_connection_opened").otherwise("network_connection_closed")
    severity = F.when(opened & listens, 4).when(listens, 3).when(opened, 2).otherwise(1)
    return rows.select(*by, *SOCKET_KEY, action.alias("action"), severity.alias("severity"), "s.*")


def with_previous(snapshots: DataFrame, at: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, at, previous): the times of each host's snapshots with the one before. The first has
    none and is dropped: it only sets the baseline."""
    times = snapshots.select(*by, at).distinct()
    return times.withColumn("previous", F.lag(at).over(Window.partitionBy(*by).orderBy(at))).where("previous is not null")
