"""Aggregates over columns, and byte statistics over blobs as shuffled counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = 4096
FEW = 1 << 18


def percentile(c: Column, p: float) -> Column:
    """Exact, with linear interpolation at rank p/100 * (n - 1); for groups whose distinct values fit into a task."""
    return F.percentile(c, p / 100)


def exact_percentiles(df: DataFrame, column: str, percents: list[float]) -> list[float | None]:
    """The same over a column of any size: [None, ...] without values.

    Counts over SPLITS equal steps of the range tell the step that holds a rank; it is split again until at most FEW values or one
    value remain, so no task or driver holds more.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n = values.count()
    if not n:
        return [None] * len(percents)
    spots = [p / 100 * (n - 1) for p in percents]
    found = _at_ranks(values, sorted({r for x in spots for r in (int(x), min(int(x) + 1, n - 1))}))
    return [found[int(x)] + (found[min(int(x) + 1, n - 1)] - found[int(x)]) * (x - int(x)) for x in spots]


def _at_ranks(values: DataFrame, ranks: list[int]) -> dict[int, float]:
    """The values at ranks (from 0) of rows v."""
    ends = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    low, high, n = ends
    if low == high:
        return dict.fromkeys(ranks, low)
    if n <= FEW:
        ordered = np.sort(np.array([r[0] for r in values.collect()]))
        return {r: float(ordered[r]) for r in ranks}
    step = F.least(F.floor((F.col("v") / 2 - low / 2) / (high / 2 - low / 2) * SPLITS), F.lit(SPLITS - 1)).cast("int")
    stepped = values.withColumn("step", step)
    out, before = {}, 0
    for row in sorted(stepped.groupBy("step").agg(F.count("*").alias("n")).collect()):
        inside = [r - before for r in ranks if before <= r < before + row["n"]]
        if inside:
            out |= {r + before: v for r, v in _at_ranks(stepped.where(F.col("step") == row["step"]).select("v"), inside).items()}
        before += row["n"]
    return out


def entropy(df: DataFrame, column: str, name: str = "entropy") -> DataFrame:
    """Shannon entropy in bits of a column's values; counts are summed before the shuffle."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    # H = log2(N) - sum(n log2 n) / N, so one more aggregate gives it.
    total = counts.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select(F.coalesce(F.log2("t") - F.col("s") / F.col("t"), F.lit(0.0)).alias(name))


def byte_histogram(df: DataFrame, content: str) -> DataFrame:
    """(byte, n) over all blobs, all 256 bytes; each Arrow batch gives its 256 counts."""
    def run(batches):
        for batch in batches:
            col = batch.column(0)
            _, _, data = col.buffers()
            cuts = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int32)
            raw = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None else np.zeros(0, np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(np.bincount(raw, minlength=256))], ["byte", "n"])

    blobs = df.select(F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content"))
    every = df.sparkSession.range(256).select(F.col("id").cast("int").alias("byte"), F.lit(0).cast("long").alias("n"))
    return blobs.mapInArrow(run, "byte int, n long").union(every).groupBy("byte").agg(F.sum("n").alias("n"))


def frequency(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def cardinality(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    return df.agg((F.approx_count_distinct(column) if approximate else F.count_distinct(column)).alias("n"))
