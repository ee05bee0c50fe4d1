"""Log lines as typed columns: expressions over a column of lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logs import COMBINED, COMMON, SYSLOG_3164, SYSLOG_5424


def _columns(line: Column, pattern: str) -> tuple[Column, dict[str, Column]]:
    """(whether a line matches, its named groups)."""
    names = re.findall(r"\(\?P<(\w+)>", pattern)
    java = re.sub(r"\(\?P<\w+>", "(", pattern)
    return line.rlike(java), {n: F.regexp_extract(line, java, i) for i, n in enumerate(names, 1)}


def syslog(df: DataFrame, line: str = "line", fmt: str = "rfc5424") -> DataFrame:
    """Fields of syslog lines; a line that does not match has them null."""
    ok, cols = _columns(F.col(line), "^" + (SYSLOG_3164 if fmt == "rfc3164" else SYSLOG_5424) + "$")
    pri = F.when(ok, cols.pop("priority").cast("int"))
    return df.select("*", pri.alias("priority"), (pri / 8).cast("int").alias("facility"), (pri % 8).alias("severity"), *(F.when(ok, c).alias(n) for n, c in cols.items()))


def access_log(df: DataFrame, line: str = "line", combined: bool = True) -> DataFrame:
    """Requests of Apache or nginx logs; other lines go."""
    ok, cols = _columns(F.col(line), "^" + (COMBINED if combined else COMMON))
    out = df.where(ok).select("*", *(c.alias(n) for n, c in cols.items()))
    return out.withColumn("status", F.col("status").cast("int")).withColumn("body_bytes", F.expr("try_cast(body_bytes as bigint)")).withColumn("ts", F.try_to_timestamp("timestamp", F.lit("dd/MMM/yyyy:HH:mm:ss Z")))


def cef(df: DataFrame, line: str = "line") -> DataFrame:
    """The seven fields of CEF lines and a map of extensions."""
    parts = F.split(F.regexp_extract(line, r"CEF:(.*)", 1), r"\|", 8)
    names = ("cef_version", "vendor", "product", "device_version", "signature_id", "name", "severity")
    return df.where(F.size(parts) == 8).select("*", *(parts[i].alias(n) for i, n in enumerate(names)), F.str_to_map(parts[7], F.lit(" "), F.lit("=")).alias("extensions"))


def cloudtrail(df: DataFrame, content: str = "content", record: str = "eventName string, eventTime string, eventSource string, sourceIPAddress string, awsRegion string") -> DataFrame:
    """One row for each record of CloudTrail documents."""
    rec = F.from_json(F.col(content).cast("string"), f"Records array<struct<{record.replace(' ', ':')}>>".replace(",:", ","))
    return df.select(F.explode(rec["Records"]).alias("r")).select("r.*")


def level_rank(line: Column) -> Column:
    word = F.lower(F.coalesce(F.get_json_object(line, "$.level"), F.regexp_extract(line, r"(?i)\b(trace|debug|info|warn|warning|error|fatal|critical)\b", 1)))
    return F.when(word.isin("trace", "debug"), 0).when(word == "info", 1).when(word.isin("warn", "warning"), 2).when(word == "error", 3).when(word.isin("fatal", "critical"), 4)


def level_filter(df: DataFrame, min_level: str, line: str = "line") -> DataFrame:
    """Lines of at least a level; lines without a level stay."""
    rank = level_rank(F.col(line))
    return df.where(rank.isNull() | (rank >= level_rank(F.lit(min_level))))
