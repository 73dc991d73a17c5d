"""Embeddings at scale: a store of vectors by the text's digest, so that each different text is encoded once for all runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions, written

#: load() gives a model in each Python worker; encode(model, texts) gives a vector for each text.
Load = Callable[[], Any]
Encode = Callable[[Any, list[str]], list[list[float]]]


class EmbeddingStore:
    """Vectors of one model under `path`, in buckets of the digest of the text.

    A digest is SHA-256 of the UTF-8 text; a null text has no vector. One folder a run is added; compact() of the versions
    puts them together.
    """

    def __init__(self, spark: SparkSession, path: str, load: Load, encode: Encode, buckets: int = 64) -> None:
        self.load, self.encode = load, encode
        self.versions = Versions(spark, path, ["digest"], {"vectors": "digest string, vector array<float>"}, buckets)

    @staticmethod
    def _digest(text: str):  # noqa: ANN205
        return F.sha2(F.col(text).cast("binary"), 256)

    def missing(self, texts: DataFrame, text: str = "text", manifest: dict | None = None) -> DataFrame:
        """(digest, text) of the different texts that the store lacks. Only buckets of the texts' digests are read."""
        rows = texts.filter(F.col(text).isNotNull()).groupBy(self._digest(text).alias("digest")).agg(F.first(text).alias("text"))
        rows = written(rows, "texts")
        held = self.versions.read("vectors", self.versions.touched(rows), manifest)
        return rows.join(held.select("digest"), "digest", "left_anti")

    def add(self, texts: DataFrame, text: str = "text") -> int:
        """Encode what the store lacks, in an iterator UDF with one model per worker; returns how many texts were encoded."""
        load, encode = self.load, self.encode

        @F.pandas_udf("array<float>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for batch in batches:
                yield pd.Series(encode(model, batch.tolist()), index=batch.index, dtype=object)

        encoded = 0

        def change(manifest: dict) -> dict[str, tuple[DataFrame, bool]]:
            nonlocal encoded
            new = written(self.missing(texts, text, manifest), "missing")
            encoded = new.count()
            if not encoded:
                return {}
            parts = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            # the work is in the model and not in the bytes, so small partitions stay apart
            return {"vectors": (written(new.repartition(parts, "digest").select("digest", vectors("text").alias("vector")), "vectors"), False)}

        self.versions.commit("encoder", self.versions.manifest()["batches"].get("encoder", -1) + 1, change)
        return encoded

    def embed(self, rows: DataFrame, text: str = "text", vector: str = "vector") -> DataFrame:
        """rows with the vector of their text, after add(): null texts have none. Rows are not multiplied."""
        self.add(rows, text)
        keyed = rows.withColumn("digest", self._digest(text))
        held = self.versions.read("vectors").withColumnRenamed("vector", vector)
        return keyed.join(held, "digest", "left").drop("digest")
