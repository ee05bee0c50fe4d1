"""Helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def digest(c):
    """What stands for a long value in a result."""
    return F.md5(c.cast("binary"))


#: Lines of t in DuckDB, as ``layout.lines`` has them.
LINES = r"(CASE WHEN t = '' THEN []::VARCHAR[] ELSE list_transform(string_split(regexp_replace(t, '\n$', ''), chr(10)), lambda x: regexp_replace(x, '\r$', '')) END)"
