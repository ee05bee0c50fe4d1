"""Structured Streaming: unbounded sources, event time, state.

These are the forms that chunk tables cannot have: windows with watermarks, duplicates within a horizon, quiet gaps,
silence alarms, fan-out to several sinks.  State is keyed and bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None, max_bytes: str | None = None) -> DataFrame:
    """A file source; the limits bound each micro-batch and so the rate."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files is not None:
        r = r.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        r = r.option("maxBytesPerTrigger", max_bytes)
    return r.load(path)


def window_counts(df: DataFrame, ts: str, size: str, keys: list[str], late: str = "10 minutes", slide: str | None = None, value: str | None = None) -> DataFrame:
    """Counts (and sums) in tumbling or sliding windows of event time."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    out = df.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", *(["total"] if value else []))


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Sessions of events no further apart than ``gap``."""
    out = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def debounce(df: DataFrame, ts: str, gap: str, keys: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    """The last value before each quiet gap."""
    out = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))
    return out.select(*keys, ts, value)


def deduplicate(df: DataFrame, keys: list[str], ts: str, horizon: str = "1 hour") -> DataFrame:
    """Rows whose keys were not seen within the horizon, which also bounds the state."""
    return df.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


def silence_alarm(df: DataFrame, key: str, timeout_ms: int) -> DataFrame:
    """(key, seen, silent): a row whenever a key is heard of, and one when it has been silent for ``timeout_ms``."""
    kind = df.schema[key].dataType.simpleString()

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "seen": [seen], "silent": [True]})
            return
        seen += sum(len(r) for r in rows)
        state.update((seen,))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({key: [k[0]], "seen": [seen], "silent": [False]})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seen long, silent boolean", "seen long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def fan_out(df: DataFrame, sinks: list, checkpoint: str):
    """One query that gives every micro-batch to several sinks, functions of (DataFrame, batch id)."""
    def each(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        for sink in sinks:
            sink(kept, batch_id)
        kept.unpersist()

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write what is there into Parquet, exactly once, and stop."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
