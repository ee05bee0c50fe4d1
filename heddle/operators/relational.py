"""Relational operators over DataFrames.

Values compare as strings unless ``typed`` is set, as text tables have no types; the typed form is what pushes down to
Parquet.  Everything is declarative: Catalyst chooses join strategies and prunes columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..layout import NUMBER
from ..params import InvalidParam

OPS = ("eq", "ne", "lt", "le", "gt", "ge", "contains", "starts_with", "ends_with", "regex")


def as_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def predicate(c: Column, op: str, value, typed: bool = False) -> Column:
    """A comparison; strings order by bytes, so '9' is greater than '10'."""
    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    if op not in OPS:
        raise InvalidParam(f"unknown op {op}")
    if op in ("contains", "starts_with", "ends_with", "regex"):
        s = c.cast("string")
        return {"contains": s.contains, "starts_with": s.startswith, "ends_with": s.endswith, "regex": s.rlike}[op](str(value))
    left, right = (c, F.lit(value)) if typed else (c.cast("string"), F.lit(str(value)))
    return {"eq": left == right, "ne": left != right, "lt": left < right, "le": left <= right, "gt": left > right, "ge": left >= right}[op]


def filter_rows(df: DataFrame, column: str, op: str, value=None, typed: bool = False) -> DataFrame:
    if column not in df.columns:
        raise InvalidParam(f"no column {column}; there are {', '.join(df.columns)}")
    return df.where(predicate(F.col(column), op, value, typed))


def select_columns(df: DataFrame, columns: list[str], strict: bool = False) -> DataFrame:
    """The named columns in that order.  Unknown ones are dropped, or an error if ``strict`` or if none is left."""
    known = [c for c in columns if c in df.columns]
    lost = [c for c in columns if c not in df.columns]
    if not known or strict and lost:
        raise InvalidParam(f"no column {', '.join(lost)}; there are {', '.join(df.columns)}")
    return df.select(known)


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def number(c: Column) -> Column:
    """A column as double where its text is a number, else null."""
    s = c.cast("string")
    return F.when(F.trim(s).rlike(NUMBER), F.trim(s).try_cast("double"))


def sort_rows(df: DataFrame, column: str, order: str = "asc", ties: list[str] | None = None) -> DataFrame:
    """Numbers first by value, then other strings; ``desc`` is the whole order reversed.  ``ties`` makes it total."""
    n, s = number(F.col(column)), F.col(column).cast("string")
    keys = [n.isNull(), n, s, *(F.col(t) for t in ties or [])]
    return df.orderBy(*(k.desc() if order == "desc" else k.asc() for k in keys))


def aggregate(df: DataFrame, column: str, function: str, by: list[str] | None = None, name: str = "value") -> DataFrame:
    """count, sum, avg, min or max of the values that are numbers; optionally by keys.

    Without any number: count 0, sum 0, avg 0, min and max positive and negative infinity.
    """
    v = number(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column).cast("double")
    out = {
        "count": F.count(v).cast("double"), "sum": F.coalesce(F.sum(v), F.lit(0.0)), "avg": F.coalesce(F.avg(v), F.lit(0.0)),
        "min": F.coalesce(F.min(v), F.lit(float("inf"))), "max": F.coalesce(F.max(v), F.lit(float("-inf")))}
    if function not in out:
        raise InvalidParam(f"unknown aggregate {function}")
    return df.groupBy(*(by or [])).agg(out[function].alias(name))


def join_tables(left: DataFrame, right: DataFrame, on: str, how: str = "inner", fill: str | None = None) -> DataFrame:
    """Equi-join on one column, whose values are joined as strings if its types differ; the key appears once.

    ``fill`` replaces missing string values, as text tables have no null.
    """
    for df in (left, right):
        if on not in df.columns:
            raise InvalidParam(f"no column {on}; there are {', '.join(df.columns)}")
    if how not in ("inner", "left", "right", "full", "left_semi", "left_anti"):
        raise InvalidParam(f"unknown join type {how}")
    if dict(left.dtypes)[on] != dict(right.dtypes)[on]:
        left, right = (df.withColumn(on, F.col(on).cast("string")) for df in (left, right))
    out = left.join(right, on, how)
    return out.na.fill(fill) if fill is not None else out


def deduplicate(df: DataFrame, columns: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The first row of each combination of ``columns`` in ``order``; without an order the rows must be equal."""
    if columns is None and order is None:
        return df.distinct()
    columns = columns or df.columns
    w = Window.partitionBy(*columns).orderBy(*(order or columns))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def union(*tables: DataFrame, distinct: bool = False) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct() if distinct else out


def merge_sorted(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows in one order; where keys are equal, those of the earlier table come first."""
    tagged = [t.withColumn("_input", F.lit(i)) for i, t in enumerate(tables)]
    return union(*tagged).orderBy(*keys, "_input").drop("_input")


def head(df: DataFrame, n: int, order: list) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*(F.col(c).desc() for c in order)).limit(n)


def nth_per_key(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The row at place ``n`` (from 0) of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == n + 1).drop("_n")


def json_field(c: Column, path: str) -> Column:
    """A dot path of a JSON text as string; 'null' where it is missing."""
    return F.coalesce(F.get_json_object(c, "$." + path), F.lit("null"))


def ndjson_filter(df: DataFrame, column: str, path: str, op: str, value) -> DataFrame:
    return df.where(predicate(json_field(F.col(column), path), op, value))


def ndjson_project(df: DataFrame, column: str, paths: list[str], keep: list[str] | None = None) -> DataFrame:
    return df.select(*(keep or []), *(F.get_json_object(column, "$." + p).alias(p) for p in paths))


def infer_schema(df: DataFrame) -> DataFrame:
    """(column, type) of string columns: integer, float, boolean or string; one aggregate over all rows."""
    tests = (("integer", r"^[+-]?\d+$"), ("float", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), ("boolean", r"^(true|false)$"))
    filled = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    aggs = []
    for c in df.columns:
        some = F.count_if(filled(c))
        label = F.lit("string")
        for name, rx in reversed(tests):
            label = F.when((some > 0) & (F.count_if(filled(c) & F.col(c).cast("string").rlike(rx)) == some), name).otherwise(label)
        aggs.append(F.struct(F.lit(c).alias("column"), label.alias("type")).alias(c))
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*(F.col(f"`{c}`") for c in df.columns))))


def partition_manifest(df: DataFrame, column: str) -> DataFrame:
    """Rows for each non-null value of a column: what a partitioned write would hold."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("num_rows"))


def column_statistics(df: DataFrame) -> DataFrame:
    """(column, min, max, null_count, num_values) of every column, as strings."""
    stats = [F.struct(F.lit(c).alias("column"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"), F.count_if(F.col(c).isNull()).alias("null_count"), F.count("*").alias("num_values")).alias(c) for c in df.columns]
    return df.agg(*stats).select(F.inline(F.array(*(F.col(f"`{c}`") for c in df.columns))))


def columnar_to_row(df: DataFrame, name: str = "row") -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias(name))


def compare_schemas(a: DataFrame, b: DataFrame) -> DataFrame:
    """(field, change) between two (column, type) tables."""
    both = a.withColumnRenamed("type", "was").join(b.withColumnRenamed("type", "now"), "column", "full")
    change = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "changed")
    return both.withColumn("change", change).where("change is not null").select(F.col("column").alias("field"), "change")
