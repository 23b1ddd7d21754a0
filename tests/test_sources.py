"""Parsers, normalised records and snapshot differences."""

import ipaddress
import json
import random
import re
import socket
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from watchloom import schemas
from watchloom.functions import core
from watchloom.operators import normalize, snapshot
from watchloom.sources import authlog, live, procfs

HEAD = "Jun 17 12:00:00 web-01 sshd[2048]: "
ACCEPT = {
    HEAD + "Failed password for root from 203.0.113.7 port 51234 ssh2": (4, "root"), HEAD + "Failed password for invalid user root from 203.0.113.7 port 51234 ssh2": (5, "root"), HEAD + "Accepted password for bob from 10.0.0.1 port 22 ssh2": (2, "bob"), HEAD + "Accepted publickey for bob from 10.0.0.1 port 22 ssh2": (2, "bob"), HEAD + "Invalid user x from 10.0.0.1 port 22": (5, "x"), "Jun  7 12:00:00 h sshd: Invalid user y from ::1 port 0": (5, "y"),
}
REJECT = ["", "   ", "hello", HEAD.replace("sshd", "sudo") + "Failed password for a from b port 1", HEAD + "Connection closed", HEAD + "Failed password for a from b port 99999", HEAD.replace("Jun", "Zzz") + "Invalid user x from b port 1", HEAD.replace("12:00:00", "99:00:00") + "Invalid user x from b port 1", HEAD + "Invalid user x from b port 1" + "x" * 9000, HEAD.replace("Jun 17", "Jun 31") + "Invalid user x from b port 1"]


def test_auth_lines(spark):
    df = spark.createDataFrame([(x,) for x in [*ACCEPT, *REJECT]], "value string")
    got = authlog.parse_auth(df, 2026, "-04:00").collect()
    assert sorted((r.severity, r.user) for r in got) == sorted(ACCEPT.values())
    assert next(r.occurred_at for r in got if r.user == "bob") == datetime(2026, 6, 17, 16)
    assert authlog.parse_auth(df, 2026, host="other").first().host == "other"


def test_stat_and_cmdline(spark):
    rest = "S 7 " + "0 " * 17 + "99"
    lines = {"1 (a b) " + rest: (7, 99, "a b"), "1 (a) b)) " + rest: (7, 99, "a) b)"), "1 (a) S 7": None, "1 a " + rest: None, "1 (a) S x " + "0 " * 17 + "9": None}
    got = [r.s for r in spark.createDataFrame([(x,) for x in lines], "v string").select(procfs.parse_stat(F.col("v")).alias("s")).collect()]
    assert [tuple(s) if s else None for s in got] == list(lines.values())
    raw = spark.createDataFrame([(bytearray(b"a\0-b\0"),), (bytearray(b""),)], "v binary")
    assert [r[0] for r in raw.select(procfs.parse_cmdline(F.col("v"))).collect()] == ["a -b", None]


def test_sockets(spark):
    row = "0: {a}:1F90 00000000:0000 {s} 0:0 0:0 0 1000 0 {i} 1".format
    good = [row(a="0100007F", s="0A", i=7), row(a="0100007F", s="01", i=8), row(a="0100007F", s="0a", i=9)]
    bad = ["sl local_address rem_address st", "0: 0100007F:1F90", row(a="0100007F", s="FF", i=1), row(a="ZZ00007F", s="0A", i=1), row(a="0100", s="0A", i=1), row(a="0100007F", s="0A", i="x"), row(a="0100007F", s="0A", i=1).replace(":1F90", ":FFFFF"), row(a="0100007F", s="0A", i=1).replace(":1F90", "")]
    got = procfs.parse_net(spark.createDataFrame([(x,) for x in good + bad], "value string"), "tcp").collect()
    assert [(r.local_ip, r.local_port, r.state, r.uid, r.inode) for r in got] == [("127.0.0.1", 8080, "LISTEN", 1000, 7), ("127.0.0.1", 8080, "ESTABLISHED", 1000, 8), ("127.0.0.1", 8080, "LISTEN", 1000, 9)]
    six = "0: 00000000000000000000000001000000:0016 00000000000000000000000000000000:0000 0A 0:0 0:0 0 0 0 5 1"
    assert procfs.parse_net(spark.createDataFrame([(six,)], "value string"), "tcp6").first().local_ip == "::1"


def test_ipv6_text(spark):
    rng = random.Random(3)
    cases = ["0" * 32, "0" * 24 + "01000000", "0" * 16 + "FFFF0000" + "0100000A", "B80D0120" + "0" * 8 + "00000100" + "01000000", "f" * 32, "0" * 31, "x" * 32, None]
    cases += ["".join(rng.choice(["0000", "0000", "0100", "00ff", "abcd", "000A"]) for _ in range(8)) for _ in range(400)]

    def plain(h):
        if h is None or len(h) != 32 or set(h) - set("0123456789abcdefABCDEF"):
            return None
        words = [int.from_bytes(bytes.fromhex(h[i : i + 8]), "little") for i in range(0, 32, 8)]
        return str(ipaddress.IPv6Address(sum(w << 96 - 32 * i for i, w in enumerate(words))))

    got = spark.createDataFrame([(c,) for c in cases], "h string").select("h", procfs.ipv6(F.col("h")).alias("t")).collect()
    assert [r.t for r in got] == [plain(c) for c in cases]


def test_live_sockets(spark, tmp_path):
    row = "{n}: {a} 00000000:0000 {s} 0:0 0:0 0 {u} 0 {i} 1".format
    (tmp_path / "net").mkdir()
    (tmp_path / "net" / "tcp").write_text("head\n" + "\n".join([row(n=0, a="0100007F:1F90", s="0A", u=1, i=7), row(n=1, a="0100007F:1F90", s="01", u=2, i=7), row(n=2, a="0100007F:0016", s="06", u=0, i=8), row(n=3, a="0100007F:0017", s="01", u=0, i=9)]) + "\n")
    (tmp_path / "net" / "tcp6").write_text("head\n" + row(n=0, a="0" * 24 + "01000000:0050", s="0A", u=0, i=10).replace("00000000:0000", "0" * 32 + ":0000") + "\n")
    got = sorted((r.inode, r.state, r.uid, r.local_ip) for r in live.scan_sockets(spark, str(tmp_path)).collect())
    assert got == [(7, "ESTABLISHED", 2, "127.0.0.1"), (9, "ESTABLISHED", 0, "127.0.0.1"), (10, "LISTEN", 0, "::1")]  # of one key the last written stays
    assert [r.inode for r in live.scan_sockets(spark, str(tmp_path), listen_only=True).orderBy("inode").collect()] == [7, 10]
    assert live.scan_sockets(spark, str(tmp_path), most=1).count() == 1
    assert live.scan_sockets(spark, str(tmp_path / "none")).count() == 0


def test_live_processes(spark, tmp_path):
    for pid, comm in ((12, "a b"), (3, "init")):
        (tmp_path / str(pid)).mkdir()
        (tmp_path / str(pid) / "stat").write_text(f"{pid} ({comm}) S 1 " + "0 " * 17 + "99 0")
        (tmp_path / str(pid) / "comm").write_text(comm + "\n")
        (tmp_path / str(pid) / "cmdline").write_bytes(comm.encode() + b"\0-x\0")
    (tmp_path / "7").mkdir()
    (tmp_path / "self").mkdir()
    live.register(spark)
    got = spark.read.format("host_processes").option("root", str(tmp_path)).load().select("pid", "comm", procfs.parse_cmdline(F.col("cmdline")).alias("c"), procfs.parse_stat(F.col("stat"))["starttime"].alias("s"), "executable")
    assert [tuple(r) for r in got.orderBy("pid").collect()] == [(3, "init", "init -x", 99, None), (12, "a b", "a b -x", 99, None)]


def test_tail_is_bounded_and_catches_up(tmp_path):
    path = tmp_path / "log"
    lines = [f"line {i} " + "x" * (i * 37 % 300) for i in range(200)]
    path.write_text("\n".join(lines) + "\nopen")
    reader = live._TailReader({"path": str(path), "max_bytes": "1000"})
    seen, at = [], reader.initialOffset()
    while (end := reader.latestOffset())["to"] > at["to"]:
        part = reader.partitions(at, end)
        assert part[0].value[1] - part[0].value[0] <= 1000
        seen += [r[0] for p in part for r in reader.read(p)]
        at = end
    assert seen == lines and reader.rest() == ["open"] and reader.rest() == []
    path.write_text("y" * 5000 + "\nz\n")
    long = live._TailReader({"path": str(path), "max_bytes": "1000"})
    end = long.latestOffset()
    assert [r[0] for r in long.read(long.partitions(long.initialOffset(), end)[0])] == ["y" * 5000]
    assert live._TailReader({"path": str(tmp_path / "none")}).latestOffset() == {"from": 0, "to": 0}


# Ids that must come out of these fields, which are hashed.
GOLDEN = [
    ("auth", {"syslog_ts": "Jun 17 12:00:00", "pid": "2048", "action": "ssh_login_failed", "outcome": "failure", "severity": 5, "user": "root", "ip": "203.0.113.7", "port": 51234, "message": "Failed password for invalid user root from 203.0.113.7 port 51234 ssh2"}, "186e33648222119314e35e51904d7af89ed8d8c69d7183a9f489743944ca8d56", None),
    ("process", {"action": "process_started", "severity": 3, "pid": 4242, "ppid": 1, "starttime": 998877, "comm": "nc"}, "d94065931d697ba3c00d2748541bcec4915ef49554229106593fb7849025740d", "process_started: pid=4242 nc"),
    ("file", {"action": "file_modified", "severity": 4, "path": "/etc/passwd", "size": 0, "mode": "0644", "sha256": "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "id_seed": "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}, "ab546aa856b071ffdfdacf252f359bdd8d0583967e16b6cfa18980f684385475", "file_modified: /etc/passwd"),
    ("network", {"action": "network_listen_started", "severity": 4, "proto": "tcp", "local_ip": "0.0.0.0", "local_port": 4444, "remote_ip": "0.0.0.0", "remote_port": 0, "state": "LISTEN", "uid": 0, "inode": 90210}, "f03983bfe9cc337005631816151a3a4a5f245b8836f4e3965266204a3bcf3eb0", "network_listen_started: tcp 0.0.0.0:4444 (uid=0)"),
]


@pytest.mark.parametrize(("source", "fields", "ident", "message"), GOLDEN)
def test_golden_events(spark, source, fields, ident, message):
    record = {"source": source, "occurred_at": "2026-06-17T12:00:00Z", "host": "web-01"} | fields
    odd = [json.dumps(record | {"extra": 1}), json.dumps(record | {"severity": 9}), json.dumps(record | {"occurred_at": "2026-06-17T12:00:00"}), json.dumps(record | {"host": ""})]
    lines = spark.createDataFrame([(json.dumps(record),), *((o,) for o in odd)], "value string")
    valid, dead = normalize.split_valid(normalize.parse_json(lines, source), source)
    events = normalize.normalize(valid, source).collect()
    assert len(events) == 1 and dead.count() == 4
    e = events[0]
    assert (e.event.id, e.message, e.host.name) == (ident, message or fields["message"], "web-01")
    assert [f.name for f in normalize.normalize(valid, source).schema] == schemas.EVENT.names
    assert (e.file is None) == (source != "file")
    assert e.destination.ip is None


def test_host_in_id_tells_hosts_apart(spark):
    rows = [(h, "process_started", 3, 1, 1, 5, "a", None, None) for h in ("h1", "h2")]
    df = spark.createDataFrame(rows, "host string, action string, severity int, pid int, ppid int, starttime long, comm string, cmdline string, executable string").withColumn("occurred_at", F.current_timestamp())
    assert normalize.normalize(df, "process").select("event.id").distinct().count() == 1
    assert normalize.normalize(df, "process", host_in_id=True).select("event.id").distinct().count() == 2


def test_file_diff(spark):
    cols = "path string, size long, mtime_ns long, mode int, sha256 string"
    old = [("same", 1, 1, 420, "a"), ("content", 1, 1, 420, "a"), ("mode", 1, 1, 420, "a"), ("both", 1, 1, 420, "a"), ("gone", 1, 1, 420, None), ("nohash", 1, 1, 420, None), ("touched", 1, 1, 420, "a")]
    new = [("same", 1, 1, 420, "a"), ("content", 1, 1, 420, "b"), ("mode", 1, 1, 3565, "a"), ("both", 1, 1, 511, "b"), ("fresh", 2, 3, 420, None), ("nohash", 1, 2, 420, None), ("touched", 1, 9, 420, "a")]
    got = {r.path: (r.action, r.severity, r.id_seed) for r in snapshot.diff_files(spark.createDataFrame(old, cols), spark.createDataFrame(new, cols)).collect()}
    assert got == {"content": ("file_modified", 4, "b"), "mode": ("file_attributes_modified", 5, "6755"), "both": ("file_modified", 4, "b"), "fresh": ("file_created", 3, "2:3"), "gone": ("file_deleted", 5, "1:1"), "nohash": ("file_modified", 4, "1:2")}


def test_process_and_socket_diff(spark):
    cols = "host string, pid int, starttime long, comm string"
    diff = snapshot.diff_processes(spark.createDataFrame([("h", 1, 1, "a"), ("h", 2, 1, "b")], cols), spark.createDataFrame([("h", 1, 5, "a"), ("h", 3, 1, "c")], cols), ("host",))
    assert sorted((r.pid, r.starttime, r.action) for r in diff.collect()) == [(1, 1, "process_stopped"), (1, 5, "process_started"), (2, 1, "process_stopped"), (3, 1, "process_started")]
    cols = "proto string, local_ip string, local_port int, remote_ip string, remote_port int, inode long, state string, uid long"
    s = lambda i, state: ("tcp", "a", 1, "b", 2, i, state, 0)
    diff = snapshot.diff_sockets(spark.createDataFrame([s(1, "LISTEN"), s(2, "ESTABLISHED"), s(5, "LISTEN")], cols), spark.createDataFrame([s(3, "LISTEN"), s(4, "ESTABLISHED"), s(5, "ESTABLISHED")], cols))
    assert {(r.inode, r.action, r.severity) for r in diff.collect()} == {(1, "network_listen_stopped", 3), (2, "network_connection_closed", 1), (3, "network_listen_started", 4), (4, "network_connection_opened", 2)}
    times = snapshot.with_previous(spark.createDataFrame([("h", 1), ("h", 2), ("h", 4), ("g", 2)], "host string, at int"), "at", ("host",))
    assert sorted((r.host, r.previous, r.at) for r in times.collect()) == [("h", 1, 2), ("h", 2, 4)]


def test_live_files_and_tail(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b").write_text("y")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    got = {r.path.removeprefix(str(tmp_path)): r.size for r in live.scan_files(spark, [str(tmp_path)]).collect()}
    assert got == {"/a": 1, "/d/b": 1}
    log = tmp_path / "log"
    log.write_text("one\ntwo\nhalf")
    reader = live._TailReader({"path": str(log)})
    start, end = reader.initialOffset(), reader.latestOffset()
    assert [r[0] for p in reader.partitions(start, end) for r in reader.read(p)] == ["one", "two"]
    log.write_text("one\ntwo\nhalf done\n")
    later = reader.latestOffset()
    assert [r[0] for p in reader.partitions(end, later) for r in reader.read(p)] == ["half done"]
    log.write_text("new\n")
    rotated = reader.latestOffset()
    assert [r[0] for p in reader.partitions(later, rotated) for r in reader.read(p)] == ["new"]
    registry = live.Registry()
    registry.add("auth", reader)
    with pytest.raises(ValueError):
        registry.add("auth", reader)


def test_text_hygiene(spark):
    df = spark.createDataFrame([(("a\x07\r\n\tb", {"Api-Token": "t", "my_token": "x", "n": "y"}, ["\x00"]),)], "r struct<password_hint:string,m:map<string,string>,l:array<string>>")
    clean = df.select(core.strip_control(F.col("r"), df.schema["r"].dataType).alias("r")).first().r
    assert (clean.password_hint, clean.l) == ("a??\n\tb", ["?"])
    hidden = df.select(core.redact(F.col("r"), df.schema["r"].dataType).alias("r")).first().r
    deep = spark.createDataFrame([({"secret_box": {"a": "1"}, "box": {"token": "2", "b": "3"}}, {"cookies": [("x", 1)], "ok": [("y", 2)]}, {"session": 5, "n": 6})], "m map<string,map<string,string>>, s map<string,array<struct<auth_header:string,n:int>>>, i map<string,int>")
    got = deep.select(*[core.redact(F.col(c), deep.schema[c].dataType).alias(c) for c in deep.columns]).first()
    assert got.m == {"secret_box": None, "box": {"token": core.REDACTED, "b": "3"}} and got.i == {"session": None, "n": 6}
    assert got.s["cookies"] is None and got.s["ok"][0].auth_header == core.REDACTED and got.s["ok"][0].n == 2
    hosts = spark.createDataFrame([("h",), ("",), (None,)], "h string").select(core.resolve_host(F.col("h")).alias("h")).collect()
    assert [r.h for r in hosts] == ["h", socket.gethostname(), socket.gethostname()]
    assert hidden.password_hint == core.REDACTED and hidden.m == {"Api-Token": core.REDACTED, "my_token": core.REDACTED, "n": "y"}


def test_socket_queries_equal_their_sql_for_any_user(spark, tmp_path):
    """users whose number is over 16 bits; their ports were cut to four digits."""
    import duckdb

    import __spark_entry__ as entry

    kinds = ["view", "error", "click"]
    rows = [(i, datetime(2024, 1, 1), u, kinds[i % 3], 1.0, "{}") for i, u in enumerate([0, 1, 2, 64_510, 64_511, 64_512, 64_513, 89_999, 539_999, 2**31 - 2000, 5, 70_001])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("netparse_v4", "netparse_v6"):
        got = entry.queries()[name](spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == sorted(con.sql(entry.oracle_sql()[name]).fetchall()) and len(got) == 8


def _net_row(line, proto):
    """A row of /proc/net/tcp or tcp6 field by field, None if it is malformed."""
    f = re.sub(r"\s+", " ", line, flags=re.ASCII).strip(" ").split(" ")
    size = 32 if proto == "tcp6" else 8
    out = [proto]
    for end in f[1:3] if len(f) >= 10 else [""]:
        at = re.fullmatch(rf"([0-9A-Fa-f]{{{size}}}):([0-9A-Fa-f]{{1,8}})", end)
        if not at or int(at[2], 16) > 65535:
            return None
        words = [bytes.fromhex(at[1][i : i + 8])[::-1] for i in range(0, size, 8)]
        out += [str(ipaddress.ip_address(b"".join(words))), int(at[2], 16)]
    whole = [int(f[i]) if re.fullmatch(r"[+-]?[0-9]+", f[i]) and -(2**63) <= int(f[i]) < 2**63 else None for i in (7, 9)]
    state = procfs.STATES.get(f[3].upper())
    return None if state is None or None in whole else (*out, state, *whole)


@pytest.mark.parametrize("proto", ["tcp", "tcp6"])
def test_socket_rows_against_a_loop(spark, proto):
    rng = random.Random(5)
    a = ["0100007F", "0a0B0c0D"] if proto == "tcp" else ["0" * 24 + "01000000", "B80D0120" + "0" * 8 + "00000100" + "01000000", "0" * 16 + "FFFF0000" + "0100000A"]
    odd = ["", "0", "zz", ":", "0100007F", "0" * 33]
    number = ["0", "7", "+5", "-3", "007", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "-9223372036854775809", "0" * 30 + "12", "9" * 18, "1" * 19, "9" * 19, "1" * 25, "x", "1.0", "+", "-", "5x"]
    pick = lambda good, bad: rng.choice(good) if rng.random() < 0.9 else rng.choice(bad)
    lines = ["", " ", "sl local_address rem_address st"]
    for _ in range(3000):
        ends = [pick(a, odd) + rng.choice([":"] * 12 + ["", "::"]) + pick(["0016", "FFFF", "0", "1f90", "0000FFFF"], ["", "10000", "00010000", "000000016", "g", "FFFFFFFF"]) for _ in range(2)]
        f = ["0:", *ends, pick(["01", "0A", "0a", "0b"], ["FF", "00", "0C", "1"]), "0:0", "0:0", "0", pick(["0", "1000"], number), "0", pick(["7", "12345"], number), "1", "0"]
        gap = rng.choice([" ", "  ", "\t", " \n "])
        lines.append(rng.choice(["", " ", "\t "]) + gap.join(f[: rng.choice([12, 12, 12, 11, 10, 9])]) + rng.choice(["", " ", "\n", " x\ny"]))
    got = procfs.parse_net(spark.createDataFrame(list(enumerate(lines)), "i int, value string"), proto).collect()
    expected = {(i, *row) for i, line in enumerate(lines) if (row := _net_row(line, proto))}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected) > 300


def test_a_socket_row_is_split_once(spark, capsys):
    """a filter on parsed columns computed each of them a second time."""
    procfs.parse_net(spark.createDataFrame([("x",)], "value string").repartition(2), "tcp6").explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("split(") == 1 and "lambda" not in plan
