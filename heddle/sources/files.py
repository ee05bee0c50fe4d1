"""Readers and writers of tables, with the semantics of the text formats.

Readers plan a scan and nothing more, so filters and column choices made later reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import InvalidParam


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", has_header: bool = True, schema=None) -> DataFrame:
    """All columns are strings unless a schema is given; a row of another length is an error.  Without a header: col0, col1, ..."""
    r = spark.read.option("sep", delimiter).option("header", has_header).option("mode", "FAILFAST").option("escape", '"').option("multiLine", True).option("emptyValue", "").option("nullValue", "\0")
    df = (r.schema(schema) if schema is not None else r.option("inferSchema", False)).csv(path)
    if schema is not None:
        return df
    df = df.na.fill("")  # a text table has no null: an empty field is the empty string
    return df if has_header else df.toDF(*(f"col{i}" for i in range(len(df.columns))))


def write_csv(df: DataFrame, path: str, delimiter: str = ",", mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("sep", delimiter).option("escape", '"').option("emptyValue", "").csv(path)


def read_tsv(spark: SparkSession, path: str, has_header: bool = True, schema=None) -> DataFrame:
    return read_csv(spark, path, "\t", has_header, schema)


def read_ndjson(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Blank lines are skipped, a bad line is an error."""
    r = spark.read.option("mode", "FAILFAST")
    return (r.schema(schema) if schema is not None else r).json(path)


def write_ndjson(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def read_parquet(spark: SparkSession, *paths: str, merge: bool = False) -> DataFrame:
    return spark.read.option("mergeSchema", merge).parquet(*paths)


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", partition_by: list[str] | None = None, mode: str = "error") -> None:
    w = df.write.mode(mode).option("compression", compression)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_orc(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.orc(list(paths))


def write_orc(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).orc(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema=None) -> DataFrame:
    r = spark.read.option("rowTag", row_tag).option("mode", "FAILFAST")
    return (r.schema(schema) if schema is not None else r).xml(path)


def write_xml(df: DataFrame, path: str, root: str = "root", row_tag: str = "row", mode: str = "error") -> None:
    df.write.mode(mode).option("rootTag", root).option("rowTag", row_tag).xml(path)


def read_blobs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, content): whole files as binary."""
    r = spark.read.format("binaryFile")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path).select("path", "length", "content")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line); lines of one file have no order in a table, so order-dependent operators start from blobs."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def read_postgres_copy(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("nullValue", "\\N").option("quote", "").csv(path)


def write_postgres_copy(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("sep", "\t").option("nullValue", "\\N").option("emptyValue", "").option("quote", "").csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, **options) -> DataFrame:
    """A database table read in parallel by ranges of a key; its driver must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions, **options).load()


_TABLES = {
    "sam": ("@", "qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen bigint, seq string, qual string"),
    "vcf": ("#", "chrom string, pos bigint, id string, ref string, alt string, qual string, filter string, info string"),
    "bed": ("#", "chrom string, start bigint, end bigint, name string, score string, strand string"),
    "gff": ("#", "seqid string, source string, type string, start bigint, end bigint, score string, strand string, phase string, attributes string"),
}


def read_bio_table(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """SAM, VCF, BED or GFF as typed columns; header lines are comments."""
    if fmt not in _TABLES:
        raise InvalidParam(f"unknown format {fmt}")
    mark, schema = _TABLES[fmt]
    df = spark.read.schema(schema).option("sep", "\t").option("comment", mark).option("quote", "").csv(path)
    return df.withColumn("alt", F.split("alt", ",")) if fmt == "vcf" else df


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, sequence, length): records are split at '>' by the reader, so large files are read in parallel."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"\A\s*(\S*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"\A[^\n]*\n?", ""), r"\s", "")
    return rows.select(head.alias("id"), seq.alias("sequence"), F.length(seq).alias("length"))


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
