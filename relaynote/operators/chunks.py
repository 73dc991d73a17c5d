"""Analysis of transcripts by chunks of words, sections and form fields."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import batches
from ..functions import scores as S
from ..functions import text as T
from ..sources.versions import written
from .coverage import section_list

_TOKEN = re.compile(r"\w+")


def field_texts(field: dict) -> list[str]:
    """Label, id with blanks, options and columns of a form field and those within it."""
    out = [str(field[k]) for k in ("label",) if field.get(k)]
    if field.get("id"):
        out.append(field["id"].replace("_", " "))
    out += [str(o) for o in field.get("options") or []] + list(field.get("columns") or [])
    for sub in field.get("fields") or []:
        out += field_texts(sub)
    return out


def hints_of(section: config.Section) -> list[str]:
    return list(dict.fromkeys(h.lower() for h in [*section.hints, *[t for f in section.fields for t in field_texts(f)]] if h))


def chunk_documents(docs: DataFrame, size: int = 120) -> DataFrame:
    return docs.select(F.col("doc_id").alias("job_id"), F.posexplode(T.word_chunks("text", size)).alias("chunk_idx", "chunk"))


def section_text(section: config.Section) -> str:
    return "\n".join(p for p in [section.title, *section.hints, *[t for f in section.fields for t in field_texts(f)]] if p)


def chunk_scores(sections: Sequence[config.Section], text: str = "chunk") -> Column:
    return batches.jaccards(F.array_distinct(T.tokens(text)), [list(dict.fromkeys(_TOKEN.findall(section_text(s).lower()))) for s in sections])


def best_section(chunks: DataFrame, sections: Sequence[config.Section], threshold: float = 0.2) -> DataFrame:
    """chunks with section_ord, section_id, score, has_hint: a section with a hint in the chunk beats any without,
    then the higher score, then the earlier section. Without a hint the score must pass threshold - 0.01.

    The best section comes by a generator: a filter on it is not pushed below, where all would be computed again.
    """
    found = F.col("scores") if "scores" in chunks.columns else chunk_scores(sections)
    rows = chunks.select("job_id", "chunk_idx", "chunk", found.alias("found"), batches.contains_each(F.lower("chunk"), [hints_of(s) for s in sections]).alias("hinted"))
    entry = lambda i, s: F.struct((~F.get("hinted", F.lit(i))).alias("no_hint"), (-F.round(F.get("found", F.lit(i)), 9)).alias("down"), F.lit(s.section_ord).alias("section_ord"), F.lit(s.section_id).alias("section_id"), F.get("found", F.lit(i)).alias("score"))
    fit = F.filter(F.array(*[entry(i, s) for i, s in enumerate(sections)]), lambda e: ~e["no_hint"] | (e["score"] > threshold - 0.01))
    rows = rows.select("job_id", "chunk_idx", "chunk", F.explode(F.array(F.array_min(fit))).alias("best"))
    return rows.select("job_id", "chunk_idx", "chunk", F.col("best.section_ord").alias("section_ord"), F.col("best.section_id").alias("section_id"), F.col("best.score").alias("score"), (~F.col("best.no_hint")).alias("has_hint"))


def dedup_chunks(best: DataFrame) -> DataFrame:
    """Of chunks of a job whose first 100 lower-cased characters agree, the one of the earliest section stays."""
    rows = best.filter("section_id is not null").withColumn("key", F.substring(F.lower(T.strip("chunk")), 1, 100))
    order = Window.partitionBy("job_id", "key").orderBy("section_ord", "chunk_idx")
    return rows.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank", "key")


def section_analysis(best: DataFrame, jobs: DataFrame, sections: Sequence[config.Section], covered: int = 2, with_text: bool = False) -> DataFrame:
    """A row for each job and section: status missing, partial or covered, confidence, chunk count (and text)."""
    used = best.filter("section_id is not null")
    parts = [F.count("*").alias("chunk_count"), F.max("score").alias("top")]
    if with_text:
        parts.append(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_idx", "chunk"))), lambda x: x["chunk"]), "\n").alias("extracted_text"))
    counts = used.groupBy("job_id", "section_id").agg(*parts)
    every = jobs.select("job_id").distinct().select("job_id", F.inline(section_list(sections)))
    rows = every.join(counts, ["job_id", "section_id"], "left")
    count = F.coalesce("chunk_count", F.lit(0))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("top", F.lit(0.0))))
    status = F.when(count == 0, "missing").when(count < covered, "partial").otherwise("covered")
    return rows.withColumns({"chunk_count": count, "confidence": confidence, "status": status}).drop("top")


def explainability(analysis: DataFrame, sections: Sequence[config.Section]) -> DataFrame:
    """Why a section has its status: expected hints of missing ones, else the number of chunks and the top score."""
    table = F.create_map(*[v for s in sections for v in (F.lit(s.section_id), S.literal_tokens(sorted(hints_of(s))[:10]))])
    missing = F.col("status") == "missing"
    return analysis.select(
        "job_id", "section_id", "status",
        F.when(missing, "no matched chunks").alias("reason"),
        F.when(missing, F.element_at(table, F.col("section_id"))).alias("expected_hints"),
        F.when(~missing, F.col("chunk_count")).alias("matched_count"),
        F.when(~missing, F.col("confidence")).alias("top_score"),
    )


def map_fields(best: DataFrame, sections: Sequence[config.Section], least: float = 0.25, min_max: bool = False) -> DataFrame:
    """job_id, section_id, field_id, value, confidence, source_chunk_index: each field's most similar chunk of its
    section, if its score reaches `least`; ties go to the earlier chunk. With min_max a field's scores over the chunks
    of its section are scaled to 0 to 1 first."""
    entries = []
    for s in sections:
        for f in s.fields:
            if f.get("id"):
                text = " ".join([str(f.get("label") or ""), f["id"], *map(str, f.get("options") or []), *(f.get("columns") or [])])
                known = list(dict.fromkeys(_TOKEN.findall(text.lower())))
                entries.append(F.struct(F.lit(s.section_id).alias("section_id"), F.lit(f["id"]).alias("field_id"), S.literal_tokens(known).alias("known")))
    schema = "job_id, section_id, field_id, value, confidence, source_chunk_index"
    used = best.filter("section_id is not null").withColumn("own", F.array_distinct(T.tokens("chunk")))
    if not entries:
        return used.select("job_id", "section_id", F.lit("").alias("field_id"), F.col("chunk").alias("value"), F.lit(0.0).alias("confidence"), F.col("chunk_idx").alias("source_chunk_index")).limit(0)
    fields = F.filter(F.array(*entries), lambda e: e["section_id"] == F.col("section_id"))
    rows = used.select("job_id", "section_id", "chunk_idx", "chunk", "own", F.explode(fields).alias("f"))
    scored = rows.select("job_id", "section_id", F.col("f.field_id").alias("field_id"), "chunk_idx", "chunk", S.jaccard(F.col("own"), F.col("f.known")).alias("confidence"))
    if min_max:
        of = Window.partitionBy("job_id", "section_id", "field_id")
        low, high = F.min("confidence").over(of), F.max("confidence").over(of)
        scored = scored.withColumn("confidence", (F.col("confidence") - low) / (high - low + 1e-9))
    top = scored.groupBy("job_id", "section_id", "field_id").agg(F.min(F.struct((-F.round("confidence", 9)).alias("down"), "chunk_idx", "chunk", "confidence")).alias("x"))
    out = top.filter(F.col("x.confidence") >= least).select("job_id", "section_id", "field_id", F.col("x.chunk").alias("value"), F.col("x.confidence").alias("confidence"), F.col("x.chunk_idx").alias("source_chunk_index"))
    return out.select(*schema.split(", "))


def nearest_sections(vectors: DataFrame, centroids: DataFrame, k: int = 3, accept: float = 0.65) -> DataFrame:
    """vec_id, section, confidence, alternatives (ids above 0.8 of accept), requires_review, by cosine with centroids.

    centroids (section, v) is a schema: its rows are checked to be few and enter as literals.
    """
    known = centroids.orderBy("section").limit(1001).collect()
    if len(known) > 1000:
        raise ValueError("more than 1000 sections")
    entry = [F.struct((-F.round(S.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in r["v"]])), 9)).alias("down"), F.lit(r["section"]).alias("section")) for r in known]
    rows = vectors.select("vec_id", F.slice(F.sort_array(F.array(*entry)), 1, k).alias("best"))
    top = -F.col("best")[0]["down"]
    others = F.filter(F.slice("best", 2, k), lambda e: -e["down"] > accept * 0.8)
    return rows.select("vec_id", F.col("best")[0]["section"].alias("section"), top.alias("confidence"), F.transform(others, lambda e: e["section"]).alias("alternatives"), (top < accept).alias("requires_review"))


def _block(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return vectors, np.sqrt((vectors**2).sum(1))


def _merged_top(scores: np.ndarray, sections: np.ndarray, held: list[list[tuple[float, int]]], k: int) -> list[list[tuple[float, int]]]:
    """For each row the k highest of the scores and of those held, ties to the lesser section."""
    n = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
    out = []
    for row, low, before in zip(scores, least, held):
        if len(before) == k:
            low = max(low, -before[-1][0])
        at = np.nonzero(row >= low)[0]  # more than k where scores are equal
        out.append(sorted(before + [(-float(row[j]), int(sections[j])) for j in at])[:k] if len(at) else before)
    return out


def nearest_of_many(vectors: DataFrame, centroids: DataFrame, k: int = 3, accept: float = 0.65, block_bytes: int = 64 << 20, tile: int = 4096) -> DataFrame:
    """nearest_sections for thousands of sections (section long, v): products of matrices over Arrow batches.

    Sections are broadcast in blocks of about `block_bytes` at most, a pass over the vectors for each, and a row's k best
    so far go with it from block to block. Rows are saved between the passes, so a task has one block at a time, and it
    makes the scores of 1024 rows with `tile` sections at once, however many there are. Vectors that are null, or of another length than the sections', have no section
    and require a review. Without sections that is so for all.
    """
    spark = vectors.sparkSession
    sized = centroids.filter("section is not null and v is not null").select(F.col("section").cast("long").alias("section"), F.col("v").cast("array<double>").alias("v"))
    n, dims = sized.agg(F.count("*"), F.max(F.size("v"))).first()  # one row
    blocks = max(1, -(-n * (dims or 0) * 8 // block_bytes))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.array().cast("array<struct<down:double,section:bigint>>").alias("best"))
    for b in range(blocks if n else 0):
        # sections are dealt by hash, so a block has about its share of them
        part = sized.filter(F.pmod(F.xxhash64("section"), F.lit(blocks)) == b).toArrow()
        if not part.num_rows:
            continue
        matrix = np.array(part.column("v").combine_chunks().to_pylist(), np.float64)
        if b:
            rows = written(rows, "nearest")  # chained passes would run at once, each with its block in a process of its own
        held = spark.sparkContext.broadcast((*_block(matrix), part.column("section").to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known, lengths, sections = held.value
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    lists, best = batch.column("embedding").to_pylist(), batch.column("best").to_pylist()
                    fit = [i for i, v in enumerate(lists) if v is not None and len(v) == known.shape[1] and None not in v]
                    if fit:
                        own, size = _block(np.array([lists[i] for i in fit], np.float64))
                        tops = [[(x["down"], x["section"]) for x in best[i]] for i in fit]
                        for first in range(0, len(known), tile):
                            of = slice(first, first + tile)
                            scores = np.round(own @ known[of].T / (np.outer(size, lengths[of]) + 1e-9), 9)
                            tops = _merged_top(scores, sections[of], tops, k)
                        for i, top in zip(fit, tops):
                            best[i] = [{"down": d, "section": s} for d, s in top]
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(best, batch.schema.field("best").type)], names=batch.schema.names)

        rows = rows.mapInArrow(run, rows.schema)
    first = F.get("best", F.lit(0))
    others = F.filter(F.slice("best", 2, k), lambda e: -e["down"] > accept * 0.8)
    return rows.select("vec_id", first["section"].alias("section"), (-first["down"]).alias("confidence"), F.transform(others, lambda e: e["section"]).alias("alternatives"), F.coalesce(-first["down"] < accept, F.lit(True)).alias("requires_review"))


def accumulate_sessions(analyses: DataFrame, covered: int = 2) -> DataFrame:
    """Analyses of several transcripts of a job folded to one: counts add up, the best confidence stays."""
    rows = analyses.groupBy("job_id", "section_id", "section_ord", "title", "required").agg(F.sum("chunk_count").alias("chunk_count"), F.max("confidence").alias("confidence"))
    return rows.withColumn("status", F.when(F.col("chunk_count") == 0, "missing").when(F.col("chunk_count") < covered, "partial").otherwise("covered"))
