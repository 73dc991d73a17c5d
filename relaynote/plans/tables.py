"""The library's inputs from the tables of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..operators import segment
from ..sources import stores

SECTIONS = 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows in as many partitions as the session has cores, at least.

    A small file is one split and so one task, and what is done to a text here costs far more than moving it. A table of
    as many splits as cores stays as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of `documents`, for work on each text."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def sections(spark: SparkSession, sf_dir: str) -> list[config.Section]:
    """The first items of `benchmark` as a section schema; item 2 is optional; hints are the first eight tokens."""
    distinct = F.array_distinct(T.tokens("text"))
    rows = table(spark, sf_dir, "benchmark").filter(F.col("item_id") < SECTIONS)
    return stores.sections_from(rows.select(F.col("item_id").cast("int").alias("section_ord"), F.concat(F.lit("s"), F.col("item_id")).alias("section_id"), F.substring("text", 1, 40).alias("title"), (F.col("item_id") != 2).alias("required"), F.col("text").alias("description"), F.slice(distinct, 1, 8).alias("hints")))


def made_up_confidence() -> Column:
    return ((F.col("job_id") * 7 + F.col("sent_idx") * 13) % 21) / 20.0


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of `documents` with a made-up audio confidence."""
    return segment.split_documents(documents(spark, sf_dir)).withColumn("audio_confidence", made_up_confidence())


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` as recorded segments of five seconds."""
    rows = table(spark, sf_dir, "conversations")
    logprob = -((F.col("conv_id") * 7 + F.col("turn") * 13) % 21) / 10.0
    return rows.select(F.col("conv_id").alias("job_id"), F.col("turn").cast("int").alias("seg_idx"), "text", (F.col("turn") * 5.0).alias("start"), (F.col("turn") * 5.0 + 5).alias("end"), logprob.alias("avg_logprob"), F.col("role").alias("speaker"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of `conversations` as sentences."""
    rows = segments(spark, sf_dir)
    return rows.select("job_id", F.col("seg_idx").alias("sent_idx"), "text").withColumn("audio_confidence", made_up_confidence())
