"""Layouts shared by all operators: blobs, lines, chunks and tables, and moves between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t\n\f\r]"  # ASCII white space
NUMBER = r"^(?i)[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)$"


def text(c: Column) -> Column:
    return c.cast("string")


def raw(c: Column) -> Column:
    return c.cast("binary")


def lines(c: Column) -> Column:
    """Lines of a text: one trailing line feed and trailing carriage returns go; an empty text has none."""
    t = F.regexp_replace(text(c), "\n\\z", "")
    parts = F.transform(F.split(t, "\n", -1), lambda x: F.regexp_replace(x, "\r\\z", ""))
    return F.when(text(c) == "", F.array().cast("array<string>")).otherwise(parts)


def unlines(c: Column) -> Column:
    return F.array_join(c, "\n")


def numbers(c: Column) -> Column:
    """Non-blank lines as doubles; anything else is an error."""
    trimmed = F.transform(lines(c), lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", ""))
    return F.transform(F.filter(trimmed, lambda x: x != ""), lambda x: F.when(x.rlike(NUMBER), x.cast("double")).otherwise(F.raise_error(F.concat(F.lit("not a number: "), x)).cast("double")))


def lenient_numbers(c: Column) -> Column:
    """The lines that are numbers, as doubles; others are skipped."""
    trimmed = F.transform(lines(c), lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", ""))
    return F.transform(F.filter(trimmed, lambda x: x.rlike(NUMBER)), lambda x: x.try_cast("double"))


def to_hex(c: Column) -> Column:
    return F.lower(F.hex(raw(c)))


def big_endian(c: Column, size: int) -> Column:
    """A non-negative integer as ``size`` bytes."""
    return F.unhex(F.lpad(F.hex(c.cast("bigint")), 2 * size, "0"))


def byte_at(c: Column, i: Column) -> Column:
    """Byte ``i`` (from 0) of a binary as int."""
    return F.conv(F.hex(F.substring(raw(c), i + 1, F.lit(1))), 16, 10).cast("int")


def explode_lines(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, pos, line): one row per line."""
    return df.select(key, F.posexplode(lines(F.col(content))).alias("pos", "line"))


def explode_chunks(df: DataFrame, key: str, content: str, size: int = 65536) -> DataFrame:
    """(key, chunk_idx, offset, content): a blob cut into chunks of ``size`` bytes."""
    body = raw(F.col(content))
    n = F.ceil(F.octet_length(body) / size).cast("int")
    idx = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    cut = df.select(key, body.alias("_b"), idx.alias("i"))
    return cut.select(key, F.col("i").cast("bigint").alias("chunk_idx"), (F.col("i").cast("bigint") * size).alias("offset"), F.substring("_b", F.col("i") * size + 1, F.lit(size)).alias("content"))


def join_chunks(df: DataFrame, key: str) -> DataFrame:
    """The blobs of chunk rows, joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_idx", F.hex("content").alias("h"))))
    return df.groupBy(key).agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["h"]), "")).alias("content"))
