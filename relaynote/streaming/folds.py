"""Streams: sections' coverage as chunks arrive, reviews' latest state, sentences across batches, the audit log."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import config
from ..operators import chunks as C
from ..operators import sessions
from ..operators.registry import Registry
from ..sources.versions import Versions


def section_stream(documents: DataFrame, sections: Sequence[config.Section], covered: int = 2, threshold: float = 0.2) -> DataFrame:
    """Running analysis per job and section over a stream of documents (doc_id, text); for complete or update mode."""
    best = C.best_section(C.chunk_documents(documents), sections, threshold).filter("section_id is not null")
    rows = best.groupBy("job_id", "section_id").agg(F.count("*").alias("chunk_count"), F.max("score").alias("confidence"))
    return rows.withColumn("status", F.when(F.col("chunk_count") < covered, "partial").otherwise("covered"))


def registry_stream(attempts: DataFrame, registry: Registry, checkpoint: str, writer: str = "units") -> DataStreamWriter:
    """Register a stream of attempts (the registry's key, seq): ids stay known for good, not for a watermark's time."""
    return attempts.writeStream.foreachBatch(lambda batch, k: registry.register(batch, k, writer)).option("checkpointLocation", checkpoint)


def audit_stream(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append a stream of audit entries to a folder of JSON lines."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def coverage_versions(spark: SparkSession, path: str, buckets: int = 32) -> Versions:
    """The table of merged coverage, by job."""
    entry = "struct<session:int,status:string,sentence_count:bigint,confidence:double,risk_score:double>"
    return Versions(spark, path, ["job_id"], {"coverage": f"job_id long, section_id string, {', '.join(f'{c} {entry}' for c in sessions.CANDIDATES)}"}, buckets)


def merge_sessions_into(versions: Versions, writer: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch of session coverage is merged into a version of its own.

    Only the buckets of the batch's jobs are read and written again. A batch that comes again changes nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        if versions.seen(writer, batch_id):
            return
        new = sessions.session_candidates(batch)

        def change(manifest: dict) -> dict[str, tuple[DataFrame, bool]]:
            old = versions.read("coverage", versions.touched(batch), manifest)
            return {"coverage": (sessions.merge_candidates(old, new), True)}

        versions.commit(writer, batch_id, change)

    return merge


def merge_stream(coverage: DataFrame, versions: Versions, checkpoint: str, writer: str = "sessions") -> DataStreamWriter:
    """Merge a stream of session coverage (job_id, section_id, session, status, sentence_count, confidence, risk_score)."""
    return coverage.writeStream.foreachBatch(merge_sessions_into(versions, writer)).option("checkpointLocation", checkpoint)


def sentence_stream(segments: DataFrame) -> DataFrame:
    """job_id, sent_idx, text of sentences from a stream of segments (job_id, seg_idx, text), in the order of seg_idx.

    What follows the last end of a sentence waits in the state of its job for the next segments.
    """
    import re

    ends = re.compile(r"(?<=[.!?])\s+")

    def assemble(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        n, rest = state.get if state.exists else (0, "")
        parts = sorted((r for f in frames for r in zip(f["seg_idx"], f["text"])), key=lambda r: r[0])
        *done, rest = ends.split(" ".join([*([rest] if rest else []), *[t for _, t in parts if t]]).strip())
        if rest.endswith((".", "!", "?")):
            done, rest = [*done, rest], ""
        done = [d for d in done if d]
        state.update((n + len(done), rest))
        yield pd.DataFrame({"job_id": [key[0]] * len(done), "sent_idx": range(n, n + len(done)), "text": done})

    schema = f"job_id {dict(segments.dtypes)['job_id']}, sent_idx int, text string"
    return segments.groupBy("job_id").applyInPandasWithState(assemble, schema, "n int, rest string", "append", "NoTimeout")


def windowed_activity(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts of event types per window, for the job monitor."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
