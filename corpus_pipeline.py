"""A training-corpus pipeline of the operators in relaynote.llm: each stage works on what the stage before it kept.

All stages take null and empty texts, null ids and sources, very long texts, repeated rows, extra columns with any names,
and empty tables, which give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaynote.llm.common import save, unused
from relaynote.llm.line_dedup import line_dedup
from relaynote.llm.mixing import mixed_rows
from relaynote.llm.packing import pack
from relaynote.llm.queries import tokenizer_path
from relaynote.llm.simhash import near_dedup
from relaynote.llm.toxicity import toxicity


def _beside(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that the stage returns, with the columns of docs, those too that have names of the stage's own."""
    clash = [c for c in docs.columns if c.lower() in names]
    aside = dict(zip(clash, unused(docs, *clash)))
    return stage(docs.withColumnsRenamed(aside)).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts (predicted = 0). Null texts are judged as empty ones, repeated rows alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _beside(docs, ("held_out", "score", "predicted"), lambda d: toxicity(d, labels).filter("predicted = 0"))


def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sources share; those of nothing else stay for the near dedup."""
    return _beside(docs, ("n_lines", "n_removed"), line_dedup)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: five words, a cosine similarity of 0.8, as SimHash estimates it.

    The least doc_id stays, a null one last; of rows that repeat doc_id and text one; null and empty texts are one group.
    """
    return near_dedup(docs, measure="cosine").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one of its own."""
    return mixed_rows(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences; a null or empty text is one end token."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_spread_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

#: Trained trees, tokenizers and fitted subsets have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, name)
    return docs
