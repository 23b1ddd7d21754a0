"""Storage, size-checked broadcasts and connected components shared by the operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow dimension table (a key and a few numbers) is broadcast.
BROADCAST_ROWS = 100_000
#: Narrow rows of a file where a table's size is known.
FILE_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or an own one where it is unset and
    the master is local (on a cluster every machine would have its own, so that is an error)."""
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    if known := spark.sparkContext.getCheckpointDir():
        return known.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="watchloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return f"file://{own}"


class Workspace:
    """Tables that one operator run writes to the shared folder to cut lineage.

    A lost executor rereads them instead of recomputing; writes go through Spark's committer, so
    retried and speculative tasks leave no partial rows. ``drop`` removes a table once later tables
    that were derived from it are written; what lazy results may still read goes at exit.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/watchloom-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        atexit.register(self._remove, self.root)

    def path(self, name: str = "t") -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:12]}"

    def store(self, df: DataFrame, codec: str | None = None, rows: int | None = None) -> DataFrame:
        """``df`` written and read back. ``rows``, if it is known about how many narrow rows there are,
        keeps a small table from being written as one file for each shuffle partition."""
        if rows is not None:
            df = df.repartition(max(2, -(-rows // FILE_ROWS)))
        path, writer = self.path(), df.write
        if codec:
            writer = writer.option("compression", codec)
        writer.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = (back, path)
        return back

    def drop(self, df: DataFrame) -> None:
        self._remove(self._paths.pop(id(df))[1])

    def _remove(self, path: str) -> None:
        if self.spark.sparkContext._jsc is None:
            return
        try:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        except Exception:  # the gateway may be gone at exit
            pass


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; beyond that a plain join
    (shuffle join with AQE skew splitting). ``df`` is a stored narrow table, so counting is cheap."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected long edges (a, b); root is the smallest node.

    Alternates the large-star and small-star steps until the edge set is stable; every step is a
    shuffle on the node, and a hub's rows are split by the skew join rather than gathered. Nulls
    are not allowed as nodes; self-loops are ignored.
    """
    current = ws.store(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = ws.store(large, rows=mark[0])
        # small star: a > b on every edge
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = ws.store(linked.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), rows=mark[0])
        ws.drop(current)
        ws.drop(large)
        current = new
    roots = current.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


#: Bits of ``maybe_among``'s map, which is broadcast (an eighth of that in bytes).
MAP_BITS = 1 << 26


def maybe_among(keys: DataFrame, key: Column) -> DataFrame:
    """One row for each 4,096 bytes of a bitmap of the hashes of ``key`` over ``keys``: bucket, bits."""
    at = F.pmod(F.xxhash64(key), F.lit(MAP_BITS)) + 1
    return keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def mark_maybe(df: DataFrame, key: Column, bitmap: DataFrame, flag: str) -> DataFrame:
    """``df`` with the boolean ``flag``: false where ``key`` is surely in none of the rows that
    ``bitmap`` was made of. No row moves; MAP_BITS bounds the broadcast. A crowded map only lets more
    rows through to the join that decides."""
    at = F.pmod(F.xxhash64(key), F.lit(MAP_BITS)) + 1
    pos = F.bitmap_bit_position(at).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = (F.floor(byte / F.pow(F.lit(2), pos % 8)) % 2) == 1
    joined = df.join(F.broadcast(bitmap), F.bitmap_bucket_number(at) == F.col("bucket"), "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce(hit, F.lit(False)).alias(flag))


def text_identity(text: Column) -> Column:
    """64-bit hash of a text in which null differs from empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def crc_bucket(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


_held: dict[object, object] = {}


def worker_state(owner: object, make: Callable[[], object] = lambda: None) -> object:
    """What ``owner`` keeps in this Python worker between batches, made at first use. A worker serves
    many stages, so whatever another owner kept is let go: only one holds memory at a time."""
    other = owner not in _held
    if other:
        _held.clear()
    hand_back()
    if other:
        _held[owner] = make()
    return _held[owner]


def hand_back() -> None:
    """Returns to the system what the allocators of Arrow and C keep of freed memory; else a worker holds
    the most that any batch of any stage took, beside its executor's JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)
