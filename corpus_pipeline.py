"""Cleaning pipeline over ``documents``: toxicity, line dedup, near-duplicate documents, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a table that ``run`` writes as Parquet to the shared folder and reads
again for the next one.  All stages but the last return the columns of ``documents``; the last adds n_words, posteriors
and rate.

Rows with null or empty texts pass every stage, with rate 1; so do texts of any length, which are read whole.  Rows that repeat
doc_id and text pass toxicity and line dedup alike and become one in near_duplicates; columns beyond those of ``documents``
pass through, whatever their names; an empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from heddle.llm.common import read, stage

TOXIC = 0.3


def recounted(docs: DataFrame) -> DataFrame:
    """n_chars after texts have changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC or more go.  Every label may be learned from."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(docs, model, out="_toxic").where(F.col("_toxic") < TOXIC).drop("_toxic")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat another go from the texts; a document of which no line of words stays goes."""
    return recounted(line_dedup.dedup_lines(docs, drop_emptied=True, short=True))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more) the row of the smallest doc_id stays.

    Rows that repeat doc_id and text are one; other rows of one doc_id go or stay each by its text.  Rows without words or id stay.
    """
    return ngram_join.drop_near_duplicates(docs, n=5, percent=80)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Test passages are cut out of the texts; a document of which no word stays goes."""
    return recounted(decontaminate.remove_contamination(docs, read(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with the rate at which to draw it so that the languages have equal shares of words."""
    return mixing.mix(docs, read(spark, sf_dir, "labels"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
]

#: SQL can express neither the classifiers nor the line stage; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
