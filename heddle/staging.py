"""Tables written into the folder that the cluster shares, in place of lineage that grows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, if Spark runs on one machine."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="heddle-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/heddle/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path  # type: ignore[attr-defined]
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "staged_path", None)
    if path:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
