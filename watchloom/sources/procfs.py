"""Text of /proc parsed with SQL functions: process status, command lines and sockets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the kernel's tables.
STATES = {"01": "ESTABLISHED", "02": "SYN_SENT", "03": "SYN_RECV", "04": "FIN_WAIT1", "05": "FIN_WAIT2", "06": "TIME_WAIT", "07": "CLOSE", "08": "CLOSE_WAIT", "09": "LAST_ACK", "0A": "LISTEN", "0B": "CLOSING"}
STAT_FIELDS, PPID, STARTTIME = 20, 1, 19
NET_FIELDS, LOCAL, REMOTE, STATE, UID, INODE = 10, 1, 2, 3, 7, 9
#: The longest run of two or more zero groups, the first of equals, between what is before and after.
ZEROS = "^(?:" + "|".join(f"(.*?):(?:0:){{{n}}}" for n in range(8, 1, -1)) + ")(.*)$"


def fields(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")


def parse_stat(content: Column) -> Column:
    """struct<ppid, starttime, comm> of a stat line, null if it is malformed."""
    rest = F.regexp_extract(content, r"(?s)^.*\)(.*)$", 1)
    part = fields(rest)
    ppid, start = F.get(part, F.lit(PPID)), F.get(part, F.lit(STARTTIME))
    whole = lambda c: F.when(c.rlike(r"^[+-]?[0-9]+\z"), c.try_cast("long"))
    ok = content.contains(")") & (F.size(part) >= STAT_FIELDS) & whole(ppid).isNotNull() & whole(start).isNotNull()
    return F.when(ok, F.struct(whole(ppid).alias("ppid"), whole(start).alias("starttime"), F.regexp_extract(content, r"(?s)^[^(]*\((.*)\)", 1).alias("comm")))


def parse_cmdline(raw: Column) -> Column:
    """A NUL-separated command line as text, null if it is empty."""
    return F.nullif(F.trim(F.translate(raw.cast("string"), "\0", " ")), F.lit(""))


def ipv4(hexed: Column) -> Column:
    byte = [F.conv(F.substring(hexed, i, 2), 16, 10) for i in (7, 5, 3, 1)]
    return F.when(hexed.rlike(r"^[0-9A-Fa-f]{8}\z"), F.concat_ws(".", *byte))


def ipv6(hexed: Column) -> Column:
    """Canonical text of 32 hex digits that hold four words, the low byte of each first.

    The longest run of two or more zero groups (the first of equals) becomes ``::``; an IPv4 address
    mapped into IPv6 ends in dotted digits.
    """
    h = F.lower(hexed)
    groups = F.concat(F.lit(":"), F.regexp_replace(h, "(..)(..)(..)(..)", "$4$3:$2$1:"))
    line = F.regexp_replace(groups, ":0{1,3}(?!:|$)", ":")
    text = F.regexp_replace(F.regexp_replace(line, ZEROS, "$1$2$3$4$5$6$7::$8"), "^:(?!:)|(?<!:):$", "")
    mapped = F.concat(F.lit("::ffff:"), ipv4(F.substring(h, 25, 8)))
    return F.when(hexed.rlike(r"^[0-9A-Fa-f]{32}\z"), F.when(h.startswith("0" * 16 + "ffff0000"), mapped).otherwise(text))


def up_to(most: int) -> str:
    """Pattern of the decimal digits of 0 to ``most``, with any number of zeros before."""
    d = str(most)
    same = [f"{d[:i]}[0-{int(c) - 1}][0-9]{{{len(d) - i - 1}}}" for i, c in enumerate(d) if c != "0"]
    return f"0*(?:[0-9]{{1,{len(d) - 1}}}|{'|'.join([*same, d])})(?![0-9])"


def net_line(digits: int) -> str:
    """Pattern of a well-formed row whose addresses have so many hex digits; its groups are local
    address and port, remote address and port, state, uid and inode."""
    end = rf"([0-9A-Fa-f]{{{digits}}}):(0{{0,4}}[0-9A-Fa-f]{{1,4}})"
    whole = rf"([+]?{up_to(2**63 - 1)}|-{up_to(2**63)})"
    part = {LOCAL: end, REMOTE: end, STATE: f"((?i:{'|'.join(STATES)}))", UID: whole, INODE: whole}
    return r"(?s)^\s*+" + r"\s++".join(part.get(i, r"\S++") for i in range(NET_FIELDS)) + r"(?:\s.*)?\z"


def parse_net(lines: DataFrame, proto: str, column: str = "value") -> DataFrame:
    """proto, local_ip, local_port, remote_ip, remote_port, state, uid, inode of well-formed rows of
    /proc/net/tcp or tcp6; other columns of ``lines`` are kept."""
    kept = [c for c in lines.columns if c != column]
    six = proto.endswith("6")
    ip, pattern = (ipv6, net_line(32)) if six else (ipv4, net_line(8))
    # the text alone decides, so that no filter on a parsed column computes it a second time
    found = F.regexp_replace(column, pattern, " ".join(f"${i}" for i in range(1, 8)))
    part = lines.where(F.col(column).rlike(pattern)).select(*kept, F.split(found, " ").alias("f"))
    state = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    get = lambda i: F.get("f", F.lit(i))
    port = lambda i: F.conv(get(i), 16, 10).try_cast("int")
    return part.select(*kept, F.lit(proto).alias("proto"), ip(get(0)).alias("local_ip"), port(1).alias("local_port"), ip(get(2)).alias("remote_ip"), port(3).alias("remote_port"), F.try_element_at(state, F.upper(get(4))).alias("state"), get(5).try_cast("long").alias("uid"), get(6).try_cast("long").alias("inode"))


def tracked(sockets: DataFrame, listen_only: bool = False, limit: int | None = None) -> DataFrame:
    """Sockets in a tracked state."""
    states = ["LISTEN"] if listen_only else ["LISTEN", "ESTABLISHED"]
    out = sockets.where(F.col("state").isin(states))
    return out if limit is None else out.limit(limit)


def last_written(sockets: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """The last row, by ``order``, of every key."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))
    return sockets.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
