"""Authentication log lines parsed with SQL functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LINE = 8192
#: Between the groups of a match; a line's own are blanks.
MARK = "\x1f"
# Line formats, months, severities and outcomes by message body.
SYSLOG = r"^([A-Z][a-z]{2}\s+\d{1,2}\s\d{2}:\d{2}:\d{2})\s(\S+)\s([\w/.-]+?)(?:\[(\d+)\])?:\s(.*)$"
BODY = r"^(?:(Failed) (?:password|publickey) for (invalid user )?|(Accepted) (?:password|publickey) for |(Invalid) user )(\S+) from (\S+) port (\d+).*$"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def syslog_time(ts: Column, year: Column, tz: str) -> Column:
    """UTC timestamp of a syslog time; null if it is not one."""
    part = F.split(F.trim(F.regexp_replace(ts, r"\s+", " ")), " ")
    clock = F.split(F.get(part, F.lit(2)), ":")
    number = lambda c: c.try_cast("int")
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.get(part, F.lit(0))), F.lit(0)).cast("int")
    return F.try_make_timestamp(year, month, number(F.get(part, F.lit(1))), number(F.get(clock, F.lit(0))), number(F.get(clock, F.lit(1))), number(F.get(clock, F.lit(2))), F.lit(tz))


def parse_auth(lines: DataFrame, year: int | Column, tz: str = "UTC", host: str | None = None, column: str = "value") -> DataFrame:
    """Raw auth records of the lines that are recognised sshd messages with values in range; other
    columns of ``lines`` are kept."""
    line = F.translate(F.regexp_replace(F.col(column), r"\n+\z", ""), MARK, " ")
    year = F.lit(year) if isinstance(year, int) else year
    kept = [c for c in lines.columns if c != column]

    def record(head: Column, body: Column) -> Column:
        h, b = (lambda i: F.get(head, F.lit(i))), (lambda i: F.get(body, F.lit(i)))
        accepted = b(2) != ""
        row = F.struct(
            F.lit("auth").alias("source"), syslog_time(h(0), year, tz).alias("occurred_at"), (F.lit(host) if host else h(1)).alias("host"), h(0).alias("syslog_ts"), h(3).alias("pid"),
            F.when(accepted, "ssh_login_succeeded").otherwise("ssh_login_failed").alias("action"), F.when(accepted, "success").otherwise("failure").alias("outcome"),
            F.when(accepted, 2).when((b(0) != "") & (b(1) == ""), 4).otherwise(5).alias("severity"), b(4).alias("user"), b(5).alias("ip"), b(6).try_cast("int").alias("port"), h(4).alias("message"),
        )
        return let(row, lambda r: F.when(r["occurred_at"].isNotNull() & r["port"].between(0, 65535) & (F.length(r["user"]) <= 256) & (F.length(r["ip"]) <= 64) & (F.length(r["host"]) <= 253) & (F.length(r["pid"]) <= 20) & F.length(r["message"]).between(1, 10000), r))

    # named values, so that each pattern runs once a line however many fields are taken from it
    parsed = let(groups(line, SYSLOG, 5), lambda head: F.when((F.get(head, F.lit(2)) == "sshd") & F.get(head, F.lit(4)).rlike(BODY), let(groups(F.get(head, F.lit(4)), BODY, 7), lambda body: record(head, body))))
    rows = lines.where((F.length(column) <= MAX_LINE) & F.col(column).contains("sshd")).select(*kept, parsed.alias("parsed"))
    return rows.where("parsed is not null").select(*kept, "parsed.*")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def groups(text: Column, pattern: str, n: int) -> Column:
    """The n groups of a text that matches ``pattern`` whole."""
    return F.split(F.regexp_replace(text, pattern, MARK.join(f"${i}" for i in range(1, n + 1))), MARK, -1)
