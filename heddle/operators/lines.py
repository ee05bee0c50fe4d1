"""Operators over line rows (key, pos, line): the distributed form of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by_pos(key: str):
    return Window.partitionBy(key).orderBy("pos")


def grep(df: DataFrame, pattern: str, invert: bool = False) -> DataFrame:
    hit = F.col("line").rlike(pattern)
    return df.where(~hit if invert else hit)


def unique(df: DataFrame, key: str) -> DataFrame:
    """Without lines equal to the one before."""
    return df.withColumn("_p", F.lag("line").over(_by_pos(key))).where("not (_p <=> line)").drop("_p")


def number_lines(df: DataFrame) -> DataFrame:
    n = (F.col("pos") + 1).cast("string")
    return df.withColumn("line", F.concat(F.when(F.length(n) < 6, F.lpad(n, 6, " ")).otherwise(n), F.lit("\t"), "line"))


def prefix_lines(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumn("line", F.concat(F.lit(prefix), "line"))


def head(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("pos") < n)


def tail(df: DataFrame, key: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col("pos").desc())
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def nth(df: DataFrame, index: int) -> DataFrame:
    return df.where(F.col("pos") == index)


def zip_lines(a: DataFrame, b: DataFrame, key: str, separator: str = "\t") -> DataFrame:
    """Lines at the same place joined; the longer side is cut."""
    right = b.withColumnRenamed("line", "_r")
    return a.join(right, [key, "pos"]).select(key, "pos", F.concat("line", F.lit(separator), "_r").alias("line"))


def alternate(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Lines of both sides in turn; the rest of the longer one follows."""
    rows = a.withColumn("_i", F.lit(0)).unionByName(b.withColumn("_i", F.lit(1)))
    w = Window.partitionBy(key).orderBy("pos", "_i")
    return rows.withColumn("_n", F.row_number().over(w) - 1).select(key, F.col("_n").alias("pos"), "line")


def frequency(df: DataFrame, key: str | None = None) -> DataFrame:
    """Counts of non-empty lines."""
    return df.where("line <> ''").groupBy(*([key] if key else []), "line").agg(F.count("*").alias("n"))


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` lines of each key, chosen by a hash of seed and place, so that partitions do not matter."""
    w = Window.partitionBy(key).orderBy(F.xxhash64("pos", F.lit(seed)), "pos")
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, line, change, n): lines that one side has more often, by multisets."""
    count = lambda df, sign: df.groupBy(key, "line").agg((F.count("*") * sign).alias("n"))
    both = count(a, -1).unionByName(count(b, 1)).groupBy(key, "line").agg(F.sum("n").alias("n")).where("n <> 0")
    return both.select(key, "line", F.when(F.col("n") > 0, "added").otherwise("removed").alias("change"), F.abs("n").alias("n"))


def text(df: DataFrame, key: str) -> DataFrame:
    """The blobs of line rows."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return df.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("content"))
