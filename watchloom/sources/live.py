"""Sources on a live host: files, processes and log tails, as Python data sources."""

from __future__ import annotations

import hashlib
import logging
import os
import stat
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from watchloom.operators import snapshot
from watchloom.sources import procfs

MAX_FILES, MAX_HASHED, CHUNK, MAX_PROCS, MAX_SOCKETS = 50_000, 50 << 20, 1 << 16, 100_000, 100_000
#: Bytes of a log that one micro-batch takes at most, unless a single line is longer.
TAIL_BYTES = 64 << 20
log = logging.getLogger(__name__)


class Registry:
    """Named sources; a name is used once."""

    def __init__(self):
        self._known: dict[str, object] = {}

    def add(self, name: str, source: object) -> None:
        if not name:
            raise ValueError("a source needs a name")
        if name in self._known:
            raise ValueError(f"duplicate source {name!r}")
        self._known[name] = source

    def __getitem__(self, name: str) -> object:
        return self._known[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._known)


class Collector:
    """A named source that lands its rows as files, with a checkpoint of its own: what it has landed is
    not landed again after a restart."""

    def __init__(self, name: str, read: Callable[[SparkSession], DataFrame], folder: str, every: str = "1 second"):
        if not name:
            raise ValueError("a source needs a name")
        self.name, self.read, self.folder, self.every = name, read, folder, every
        self.query: StreamingQuery | None = None

    def run(self, spark: SparkSession) -> StreamingQuery:
        writer = self.read(spark).writeStream.format("parquet").option("path", f"{self.folder}/{self.name}")
        writer = writer.option("checkpointLocation", f"{self.folder}/checkpoints/{self.name}").queryName(self.name)
        self.query = writer.trigger(processingTime=self.every).start()
        return self.query

    def stop(self) -> None:
        """Lands what is there, then stops."""
        if self.query is not None:
            self.query.processAllAvailable()
            self.query.stop()

    def wait_stop(self, timeout: float) -> bool:
        """Whether the source has stopped within ``timeout`` seconds; what made it fail is raised."""
        return self.query is None or bool(self.query.awaitTermination(timeout))


def hash_file(path: str, most: int = MAX_HASHED) -> str | None:
    """SHA-256 of a file, read in chunks; None if it is larger than ``most`` or unreadable."""
    try:
        if os.stat(path).st_size > most:
            return None
        digest = hashlib.sha256()
        with open(path, "rb") as f:
            while part := f.read(CHUNK):
                digest.update(part)
        return digest.hexdigest()
    except OSError:
        return None


def walk(roots: list[str], recursive: bool) -> Iterator[str]:
    for root in roots:
        if os.path.isfile(root) and not os.path.islink(root):
            yield root
        elif os.path.isdir(root):
            for folder, inner, names in os.walk(root):
                inner.sort()
                yield from (os.path.join(folder, n) for n in sorted(names))
                if not recursive:
                    break


class FileScan(DataSource):
    """path, size, mtime_ns, mode, sha256 of the regular files under ``roots`` (comma-separated);
    links are not followed, and unreadable or very large files have no hash."""

    @classmethod
    def name(cls) -> str:
        return "host_files"

    def schema(self) -> str:
        return "path string, size long, mtime_ns long, mode int, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self.options)


class _FileReader(DataSourceReader):
    def __init__(self, options):
        self.roots = options["roots"].split(",")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.most = int(options.get("max_files", MAX_FILES))

    def partitions(self) -> list[InputPartition]:
        found = [p for _, p in zip(range(self.most), walk(self.roots, self.recursive), strict=False)]
        return [InputPartition(found[i : i + 500]) for i in range(0, len(found), 500)] or [InputPartition([])]

    def read(self, partition):
        for path in partition.value:
            try:
                s = os.lstat(path)
            except OSError:
                continue
            if stat.S_ISREG(s.st_mode):
                yield path, s.st_size, s.st_mtime_ns, stat.S_IMODE(s.st_mode), hash_file(path)


class ProcScan(DataSource):
    """pid, stat, comm, cmdline, executable of the processes under ``root`` (/proc)."""

    @classmethod
    def name(cls) -> str:
        return "host_processes"

    def schema(self) -> str:
        return "pid int, stat string, comm string, cmdline binary, executable string"

    def reader(self, schema) -> DataSourceReader:
        return _ProcReader(self.options)


class _ProcReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.most = Path(options.get("root", "/proc")), int(options.get("max_procs", MAX_PROCS))

    def read(self, partition):
        pids = sorted(int(p.name) for p in self.root.iterdir() if p.name.isdigit())[: self.most]
        for pid in pids:
            at = self.root / str(pid)
            text = lambda name, at=at: _read(at / name).decode("utf-8", "replace")
            if not (line := text("stat")):
                continue
            try:
                executable = os.readlink(at / "exe")
            except OSError:
                executable = None
            yield pid, line, text("comm").strip(), _read(at / "cmdline"), executable


def _read(path: Path) -> bytes:
    try:
        return path.read_bytes()
    except OSError:
        return b""


class SocketScan(DataSource):
    """proto, line, value of the rows of ``root``/net/tcp and tcp6, in that order (line numbers both);
    a table that cannot be read has no rows."""

    @classmethod
    def name(cls) -> str:
        return "host_sockets"

    def schema(self) -> str:
        return "proto string, line long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _SocketReader(self.options)


class _SocketReader(DataSourceReader):
    def __init__(self, options):
        self.root = Path(options.get("root", "/proc"))

    def read(self, partition):
        for i, proto in enumerate(("tcp", "tcp6")):
            for n, line in enumerate(_read(self.root / "net" / proto).decode("ascii", "replace").splitlines()[1:]):
                yield proto, i << 40 | n, line


class LogTail(DataSource):
    """Lines added to the file ``path`` as a stream; offsets are byte positions. A file that shrank
    was rotated and is read from its start; a line is held until its newline is there. A batch takes
    ``max_bytes`` of the file, to the end of a line; a file that is missing or unreadable has no
    lines until it can be read."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _TailReader(self.options)


class _TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.last = options["path"], 0
        self.most = int(options.get("max_bytes", TAIL_BYTES))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"from": 0, "to": 0}

    def _whole(self, begin: int, size: int) -> int:
        """Bytes of whole lines from ``begin``: the last newline within ``most`` bytes is looked for
        from their end, and if one line is longer, the first after them."""
        with open(self.path, "rb") as f:
            end = min(size, begin + self.most)
            at = end
            while at > begin:
                start = max(begin, at - CHUNK)
                f.seek(start)
                if (found := f.read(at - start).rfind(b"\n")) >= 0:
                    return start + found + 1 - begin
                at = start
            f.seek(end)
            while end < size and (part := f.read(CHUNK)):
                if (found := part.find(b"\n")) >= 0:
                    return end + found + 1 - begin
                end += len(part)
        return 0

    def latestOffset(self) -> dict:  # noqa: N802
        try:
            size = os.path.getsize(self.path)
            begin = 0 if size < self.last else self.last
            whole = self._whole(begin, size)
        except OSError as err:
            if not isinstance(err, FileNotFoundError):
                log.warning("cannot read %s: %s", self.path, type(err).__name__)
            return {"from": self.last, "to": self.last}
        self.last = begin + whole
        return {"from": begin, "to": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = max(self.last, end["to"]) if end["to"] >= start["to"] else end["to"]
        begin = end["from"] if end["to"] < start["to"] else start["to"]
        return [InputPartition((begin, end["to"]))]

    def read(self, partition):
        """The lines of a range; a line may end in \\n, \\r\\n or \\r, as text files are read."""
        begin, end = partition.value
        if end <= begin:
            return
        with open(self.path, "rb") as f:
            f.seek(begin)
            for line in f.read(end - begin).splitlines():
                yield (line.decode("utf-8", "replace"),)

    def rest(self) -> list[str]:
        """The last catch-up of a tail that stops: what is there after the last batch, with a line
        that has no newline yet."""
        try:
            size = os.path.getsize(self.path)
        except OSError:
            return []
        begin = 0 if size < self.last else self.last
        self.last = size
        return [r[0] for r in self.read(InputPartition((begin, size)))]


def register(spark: SparkSession) -> None:
    for source in (FileScan, ProcScan, SocketScan, LogTail):
        spark.dataSource.register(source)


def scan_files(spark: SparkSession, roots: list[str], recursive: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("host_files").options(roots=",".join(roots), recursive=str(recursive)).load()


def scan_sockets(spark: SparkSession, root: str = "/proc", listen_only: bool = False, most: int = MAX_SOCKETS) -> DataFrame:
    """The tracked sockets of the host; of rows with one key the last one listed stays."""
    register(spark)
    lines = spark.read.format("host_sockets").option("root", root).load()
    rows = [procfs.parse_net(lines.where(F.col("proto") == p).select("line", "value"), p) for p in ("tcp", "tcp6")]
    return procfs.last_written(procfs.tracked(rows[0].unionByName(rows[1]), listen_only), snapshot.SOCKET_KEY, "line").orderBy("line").limit(most).drop("line")
