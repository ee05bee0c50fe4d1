"""Helpers shared by the operators: staged tables, connected components, bounded semi-join filters."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; set here only where the session has none and runs on one machine, as in tests."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="heddle-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/heddle/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    _staged.append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    out.staged_path = path  # type: ignore[attr-defined]
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "staged_path", None)
        if path:
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage: executors drop the shuffles and broadcasts of finished steps only once their handles are collected."""
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str:
    """Return what native code of the driver's JVM has freed to the system and say so; its allocator keeps it, some 100 MB, through all later steps.

    JVMs without that command keep it, and the answer is empty.
    """
    gateway = spark.sparkContext._gateway
    jvm, kind = gateway.jvm, gateway.jvm.java.lang.Class.forName
    try:
        # The server's own class is not exported, so its method is that of the interface.
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        kinds, args = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = kind(name)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return kind("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, args)
    except Py4JError:
        return ""


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def bit_filter(df: DataFrame, key: str, ids: DataFrame, id_col: str, bits: int = 1 << 22, inside: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``ids``: a semi-join reducer of fixed size.

    The broadcast side is a bit table of ``bits`` bits (at most bits/64 rows of 12 bytes, whatever the
    number of ids), so it may let rows through that are not in ``ids`` but never loses one.
    An exact join must follow.  ``inside=False`` gives the rows left out, which are certainly not in ``ids``.
    """
    slot = lambda c: F.pmod(F.xxhash64(c.cast("string")), F.lit(bits))
    table = (
        ids.select(slot(F.col(id_col)).alias("_s"))
        .groupBy(F.shiftright("_s", 6).cast("int").alias("_w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_s & 63 as int))")).alias("_m"))
    )
    table = narrow(table, bits // 64)
    hit = F.expr("(shiftrightunsigned(_m, cast(_s & 63 as int)) & 1L) = 1L")
    kept = df.withColumn("_s", slot(F.col(key))).join(F.broadcast(table), F.shiftright("_s", 6).cast("int") == F.col("_w"), "inner" if inside else "left")
    kept = kept.where(hit if inside else ~F.coalesce(hit, F.lit(False)))
    return kept.drop("_s", "_w", "_m")


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """At most one task for 50,000 rows, and eight at least: small tables need not run in as many tasks as large ones."""
    return df.coalesce(max(8, min(rows // 50_000, 1 << 20)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps over staged edge tables; every step is a map-side combined
    minimum and an equi-join, so a hub holding most edges is only a skewed join, which AQE splits.
    Only nodes that occur in an edge with two different ends are returned.
    """
    def tidy(df: DataFrame, rows: int) -> DataFrame:
        return stage(narrow(df.where("u <> v").distinct(), rows), "star")

    def rough(df: DataFrame) -> tuple:
        """(edges, whether some node is not simply the root or a leaf of a star)."""
        ends = df.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(df.select("v", F.lit(0), F.lit(1)))
        per = narrow(ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")), rows)
        return tuple(per.agg(F.coalesce(F.sum("up"), F.lit(0)), F.coalesce(F.max(F.expr("up + down > 1 and up > 0")), F.lit(False))).first())

    rows = 1 << 40
    e = tidy(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), rows)
    rows, more = rough(e)
    while more:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = narrow(both.groupBy("u").agg(F.min("v").alias("m")), rows).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = narrow(large.distinct(), rows)
        low = narrow(large.groupBy("u").agg(F.min("v").alias("m")), rows)
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        new = tidy(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), rows)
        unstage(e)
        e = new
        rows, more = rough(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
