"""All queries of the library over the tables of a folder: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import scores as S
from ..functions import text as T
from ..operators import asof, assemble, chunks, classify, correct, coverage, document, embed, placement, registry, repair, segment, serving, sessions
from ..sources import versions
from ..streaming import folds, states
from . import oracles
from .tables import document_sentences, documents, sections, segments, table, turns

#: Similarities of invented prose are low: thresholds at which all routes occur.
ACCEPT = config.Policy(confidence_accept_threshold=0.12)
SCORING = config.Scoring(similarity_threshold=0.10)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[f.__name__] = f
    return f


def _rounded(x: F.Column, digits: int = 6) -> F.Column:
    """Rounded as SQL engines round doubles: the product with a power of ten, half away from zero, divided again.

    F.round goes by the shortest decimal text, so ties that the product just misses (0.5046875) come out higher.
    """
    return F.round(x * float(10**digits)) / float(10**digits)


def _round(column: str, as_name: str | None = None) -> F.Column:
    return _rounded(F.col(column)).alias(as_name or column.rpartition(".")[2])


def _joined(column: str) -> F.Column:
    return F.array_join(F.col(column), "|").alias(column)


def _classified(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return classify.classify(rows, sections(spark, sf_dir), SCORING)


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.route(_classified(spark, sf_dir, document_sentences(spark, sf_dir)), ACCEPT)


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"))
    rows = classify.ranked(classify.with_context(document_sentences(spark, sf_dir), sections(spark, sf_dir), SCORING), sections(spark, sf_dir), SCORING)
    return coverage.section_coverage(rows, jobs, sections(spark, sf_dir))


def _placed(spark: SparkSession, sf_dir: str, *more: str, primary: tuple[str, ...] = ("section_id", "title")) -> DataFrame:
    """Placed sentences with the columns that placement needs and `more`: what a query does not show is not made or written."""
    of = F.when(F.col("primary").isNotNull(), F.struct(*[F.col(f"primary.{c}") for c in primary])).alias("primary")
    return assemble.place(_routed(spark, sf_dir).select("job_id", "sent_idx", "text", "route", of, *more))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.best_section(chunks.chunk_documents(documents(spark, sf_dir)), sections(spark, sf_dir), 0.05)


def _analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"))
    return chunks.section_analysis(_best(spark, sf_dir), jobs, sections(spark, sf_dir))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = segments(spark, sf_dir).select("job_id", F.col("seg_idx").alias("line_id"), "text")
    return placement.register_units(placement.place_lines(lines, sections(spark, sf_dir), accept=0.05))


# Text


@_query
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_sentences(spark, sf_dir).select("job_id", "sent_idx", "text")


@_query
def long_sentence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.pack_sentences(document_sentences(spark, sf_dir)).select("job_id", "sent_idx", "part_idx", "text")


@_query
def segment_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.align_segments(segments(spark, sf_dir))
    return rows.select("job_id", "sent_idx", "text", "start", "end", "speaker", _round("audio_confidence"), F.array_join(F.transform("segment_ids", lambda i: i.cast("string")), "|").alias("segment_ids"))


@_query
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_documents(documents(spark, sf_dir))


@_query
def clause_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_sentences(spark, sf_dir).select("job_id", "sent_idx", F.posexplode(T.clauses(F.col("text"))).alias("clause_idx", "clause"))


@_query
def url_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("job_id"), F.lit(0).alias("sent_idx"), F.concat(F.lit("see "), F.col("url"), F.lit(" and https://grafana.example/d/1")).alias("text"))
    return assemble.assets(rows).select("job_id", "content", "detected_component")


@_query
def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_sentences(spark, sf_dir)
    return rows.select("job_id", "sent_idx", T.is_causal("text").alias("is_causal"), T.is_protected("text").alias("is_protected"), T.is_referential("text").alias("is_referential"), T.is_implementation("text").alias("is_implementation"), F.array_join(T.evidence("text"), "|").alias("evidence"))


@_query
def glossary_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).withColumn("text", F.concat(F.lit("The API near a customer. "), F.col("text")))
    return rows.select("job_id", "sent_idx", F.array_join(T.ambiguity_warnings("text", config.Glossary(terms=("API", "The"), acronyms=())), "|").alias("warnings"))


# Scores


@_query
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).withColumn("base", classify.section_scores("text", sections(spark, sf_dir)))
    return rows.select("job_id", "sent_idx", F.posexplode("base").alias("section_ord", "base")).withColumn("base", F.round("base", 6))


@_query
def context_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.with_context(turns(spark, sf_dir), sections(spark, sf_dir))
    rows = rows.select("job_id", "sent_idx", F.posexplode(F.arrays_zip("context", "boost", "combined")).alias("section_ord", "x"))
    return rows.select("job_id", "sent_idx", "section_ord", _round("x.context"), _round("x.boost"), _round("x.combined"))


@_query
def classify_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    secs = sections(spark, sf_dir)
    rows = classify.ranked(classify.with_context(document_sentences(spark, sf_dir), secs, SCORING), secs, SCORING)
    second = F.array_join(F.transform("secondary", lambda s: s["section_id"]), "|")
    return rows.select("job_id", "sent_idx", F.col("primary.section_id").alias("section_id"), _round("primary.confidence"), second.alias("secondary"))


@_query
def policy_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("job_id", "sent_idx", F.col("primary.section_id").alias("section_id"), "route", "is_inferred")


@_query
def explainability_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = serving.explainability_log(_classified(spark, sf_dir, turns(spark, sf_dir)))
    return log.select("job_id", "sentence_id", "section_id", _round("confidence"), _joined("alternatives"))


@_query
def transcript_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(S.transcript_quality("text"))))
    return rows.select("doc_id", F.col("total_length").cast("long").alias("total_length"), F.col("word_count").cast("long").alias("word_count"), _joined("issues"), F.col("confidence_score").cast("long").alias("confidence_score"), "status")


@_query
def transcription_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(S.transcription_accuracy("text", "small"), 6).alias("accuracy"))


@_query
def sentence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_sentences(spark, sf_dir).select("job_id", "sent_idx", F.inline(F.array(S.sentence_quality("text"))))
    return rows.select("job_id", "sent_idx", F.col("quality_score").cast("long").alias("quality_score"), F.col("word_count").cast("long").alias("word_count"), _round("avg_word_length"), _joined("issues"), "status")


@_query
def vector_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    parts = rows.select(F.col("label").cast("long").alias("section"), F.posexplode("embedding").alias("i", "x")).groupBy("section", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = parts.groupBy("section").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("v"))
    out = chunks.nearest_sections(rows.select(F.col("vec_id"), "embedding"), centroids)
    return out.select("vec_id", "section", _round("confidence"), F.array_join(F.transform("alternatives", lambda a: a.cast("string")), "|").alias("alternatives"), "requires_review")


@_query
def vector_top3_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth vector is a section's; all are placed among them."""
    rows = table(spark, sf_dir, "embeddings")
    known = rows.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("section"), F.col("embedding").alias("v"))
    out = chunks.nearest_of_many(rows, known)
    return out.select("vec_id", "section", _round("confidence"), F.array_join(F.transform("alternatives", lambda a: a.cast("string")), "|").alias("alternatives"), "requires_review")


# Coverage


@_query
def section_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).select("job_id", "section_id", "required", "sentence_count", _round("confidence"), "status", "risk_score")


@_query
def job_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.job_overview(_coverage(spark, sf_dir)).select("job_id", _round("overall_coverage_percent"), _round("overall_risk_score"), "progress", _joined("missing_required_sections"))


@_query
def coverage_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.coverage_endpoint(_coverage(spark, sf_dir)).select("job_id", _round("coverage_percent"), "missing_required", "requires_attention")


# Assembly


@_query
def sentence_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("job_id", "sent_idx", "destination", "to_idx")


@_query
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.cross_references(_placed(spark, sf_dir)).select("job_id", "from_index", "to_index", "section_id", "note", "from_sentence", "to_sentence")


@_query
def section_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = assemble.ordered_content(assemble.section_content(_placed(spark, sf_dir, "audio_confidence")))
    return content.select("job_id", "section_id", "sentence_count", _round("confidence"), "appearance", "bucket_name", "position", F.array_join("sentences_preview", "|").alias("preview"))


@_query
def flow_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = assemble.flow_coherence(assemble.section_content(_placed(spark, sf_dir, "audio_confidence")))
    return flow.select("job_id", _round("flow_coherence_score"), F.size("flow_issues").cast("long").alias("issues"))


@_query
def ordered_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.markdown(assemble.section_content(_placed(spark, sf_dir, "audio_confidence")))


@_query
def review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.review_list(_placed(spark, sf_dir), 5).select("job_id", "sent_idx", "text")


def _document_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document follows the one before."""
    parent = F.when(F.col("doc_id") % 10 == 9, F.col("doc_id") - 1).alias("parent_job_id")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), parent, F.col("lang").alias("timestamp"), F.col("text").alias("transcript"))


@_query
def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key of the documents, read back from their JSON text."""
    whole = document.document(versions.written(_placed(spark, sf_dir, "audio_confidence", "reason", "evidence", primary=("section_id", "title", "confidence")), "placed"), versions.written(_coverage(spark, sf_dir), "coverage"), _document_jobs(spark, sf_dir), _corrections(spark, sf_dir))
    read = document.as_json(whole).select(F.from_json("document", whole.schema).alias("d")).select("d.*")
    six = lambda x: F.format_string("%.6f", _rounded(x))
    text = lambda *parts: F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    listed = lambda c, f: F.array_join(F.transform(c, f), "|")
    by_key = lambda c, f: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: f(e["key"], e["value"]))), "|")
    return read.select(
        "job_id", "parent_job_id", "timestamp", F.md5("transcript").alias("transcript"), _round("overall_coverage_percent"), _round("overall_risk_score"), _joined("missing_required_sections"),
        *[F.col(c).cast("long").alias(c) for c in ("section_count", "sentence_count", "unassigned_count", "asset_count", "explainability_logs_count", "human_feedback_count")],
        by_key("coverage", lambda k, v: text(k, v["section_title"], v["status"], v["required"], v["sentence_count"], six(v["confidence"]), six(v["risk"]))).alias("coverage"),
        by_key("section_content", lambda k, v: text(k, v["section_id"], v["section_title"], v["sentence_count"], six(v["confidence"]), F.array_join(v["sentences_preview"], "/"))).alias("section_content"),
        listed("ordered_section_content", lambda v: text(v["section_id"], v["section_title"], v["sentence_count"], F.array_join(v["sentences_preview"], "/"), F.array_join(F.transform(v["sentences"], lambda s: s["sent_idx"].cast("string")), "/"))).alias("ordered_section_content"),
        listed("unassigned_sentences", lambda v: v["text"]).alias("unassigned_sentences"),
        listed("review_required_sentences", lambda v: text(v["text"], v["explainability"]["section_id"], six(v["explainability"]["confidence"]))).alias("review_required_sentences"),
        listed("evidence", lambda v: text(v["text"], F.array_join(v["evidence"], "/"))).alias("evidence"),
        listed("assets", lambda v: text(v["type"], v["content"], v["component"])).alias("assets"),
        listed("top_explainability_logs", lambda v: text(v["section_id"], six(v["confidence"]), F.regexp_replace(v["reasoning"], r" \(score=[0-9.]+\)", ""))).alias("top_explainability_logs"),
        _round("flow_coherence_score"), _joined("flow_issues"), F.md5("ordered_markdown").alias("ordered_markdown"),
        listed("cross_references", lambda v: text(v["from_index"], v["from_sentence"], v["to_section"], v["to_sentence"], v["note"])).alias("cross_references"),
    )


@_query
def repair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.repair(turns(spark, sf_dir))
    return rows.select("job_id", "sent_idx", "enhanced_text", F.col("repair").isNotNull().alias("repaired"))


@_query
def repair_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repair_text with a hook in Python, which is asked for what was hardly heard and sees two neighbours on each side."""

    @F.pandas_udf("string")
    def around(text: pd.Series, neighbours: pd.DataFrame, section: pd.Series) -> pd.Series:
        cut = lambda texts: "/".join(t[:12] for t in texts)
        return pd.Series([f"{cut(b)} < {t} > {cut(a)} ({len(n)})" for t, b, a, n in zip(text, neighbours["before"], neighbours["after"], neighbours["text"])])

    rows = repair.repair(turns(spark, sf_dir), hook=around)
    return rows.select("job_id", "sent_idx", "enhanced_text", F.col("repair.confidence").alias("confidence"))


@_query
def multi_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _placed(spark, sf_dir).select("job_id", "sent_idx", "text", F.col("primary.section_id").alias("section_id")).filter("section_id is not null")
    return serving.multi_section(rows).select("job_id", "text_key", _joined("sections"))


# Correction of transcripts


@_query
def correct_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = correct.correct_segments(segments(spark, sf_dir))
    return rows.select("job_id", "seg_idx", "text", F.size("corrections").cast("long").alias("corrections"), F.round(S.correction_confidence("original_text", F.size("corrections")), 6).alias("confidence"))


@_query
def correction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.correction_stats(correct.correct_segments(segments(spark, sf_dir)))


# Chunks


@_query
def chunk_best_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("job_id", "chunk_idx", "section_id", _round("score"), "has_hint")


@_query
def chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.dedup_chunks(_best(spark, sf_dir)).select("job_id", "chunk_idx", "section_id")


@_query
def section_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).select("job_id", "section_id", "chunk_count", _round("confidence"), "status")


@_query
def required_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.required_summary(_analysis(spark, sf_dir))
    return out.select("job_id", _round("coverage_percentage"), _round("confidence_score"), _round("risk_score"), _joined("missing_required_sections"), "recommended_state")


@_query
def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.heatmap(_analysis(spark, sf_dir)).select("job_id", "section_id", _round("heat"))


@_query
def explainability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.explainability(_analysis(spark, sf_dir), sections(spark, sf_dir))
    return out.select("job_id", "section_id", "status", _joined("expected_hints"), "matched_count", _round("top_score"))


def _with_fields(spark: SparkSession, sf_dir: str) -> list[config.Section]:
    """Two form fields for each section, of four of its hints each."""
    made = lambda s, k: {"id": f"f{s.section_ord}_{k}", "label": " ".join(s.hints[4 * k : 4 * k + 4])}
    return [replace(s, fields=(made(s, 0), made(s, 1))) for s in sections(spark, sf_dir)]


@_query
def field_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.map_fields(_best(spark, sf_dir), _with_fields(spark, sf_dir), 0.01)
    return out.select("job_id", "section_id", "field_id", "source_chunk_index", _round("confidence"), "value")


@_query
def field_mapping_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.map_fields(_best(spark, sf_dir), _with_fields(spark, sf_dir), 0.25, min_max=True)
    return out.select("job_id", "section_id", "field_id", "source_chunk_index", _round("confidence"))


@_query
def accumulated_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"))
    parts = [chunks.section_analysis(_best(spark, sf_dir).filter(F.col("chunk_idx") % 2 == k), jobs, sections(spark, sf_dir)) for k in (0, 1)]
    return chunks.accumulate_sessions(parts[0].unionByName(parts[1])).select("job_id", "section_id", "chunk_count", _round("confidence"), "status")


@_query
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.report(_analysis(spark, sf_dir), "tenant", "project", "team")
    heat = F.array_join(F.transform("heatmap", lambda x: F.concat(x["section_id"], F.lit("="), F.format_number(_rounded(x["heat"], 3), 3))), "|")
    return out.select("job_id", "tenant", "project", "team", _round("coverage_percentage"), _round("risk_score"), "recommended_state", heat.alias("heatmap"))


# Lines and clauses


@_query
def clause_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir).select("job_id", "unit_id", "text", "is_split", "start_char", "section_id", _round("similarity"), _round("confidence"))


@_query
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.paragraphs(_units(spark, sf_dir)).select("job_id", "section_id", "paragraph", _round("coherence_score"), "unit_count")


@_query
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark, sf_dir)
    out = placement.quality_metrics(units, placement.paragraphs(units))
    by_section = F.array_join(F.transform(F.map_entries("section_coverage"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")
    return out.select("job_id", "total_sentences", "assigned_sentences", "unclassified_sentences", "duplicate_count", _round("avg_confidence"), _round("min_confidence"), _round("max_confidence"), "split_sentences", _round("coherence_score"), _round("duplicate_rate"), by_section.alias("section_coverage"))


@_query
def feedback_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.learned_factors(_corrections(spark, sf_dir)).select("section_id", F.round("factor", 6).alias("factor"))


@_query
def training_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = placement.training_stats(_corrections(spark, sf_dir))
    return out.select("total_corrections", _joined("sections_corrected"), "last_correction")


def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    return rows.select(
        F.col("doc_id").alias("job_id"), F.lit(0).alias("sent_idx"),
        F.concat(F.lit("s"), F.col("doc_id") % 13).alias("original_section"), F.concat(F.lit("s"), (F.col("doc_id") + F.col("quality") + 1) % 13).alias("corrected_section"),
        F.lit(0.01).alias("confidence_boost"), F.concat(F.lit("u"), F.col("toxic")).alias("user"), F.col("doc_id").alias("timestamp"), F.col("doc_id").alias("at"),
    )


@_query
def feedback_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = segments(spark, sf_dir).select("job_id", F.col("seg_idx").alias("line_id"), "text")
    out = placement.place_with_feedback(lines, sections(spark, sf_dir), placement.learned_factors(_corrections(spark, sf_dir)), accept=0.05)
    return out.select("job_id", "line_id", "section_id", _round("similarity"))


def _timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines, at times among those of the corrections."""
    last = table(spark, sf_dir, "documents").agg(F.max("doc_id").alias("last"))  # one row
    rows = segments(spark, sf_dir).select("job_id", F.col("seg_idx").alias("line_id"), "text").join(F.broadcast(last))
    return rows.select("job_id", "line_id", "text", ((F.col("job_id") * 37 + F.col("line_id") * 101) % F.col("last")).alias("at"))


def _timed_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of which some take a section's whole factor (boost 1) and some turn its sign (boost 2)."""
    boost = F.when(F.col("at") % 91 == 0, 2.0).when(F.col("at") % 401 == 0, 1.0).otherwise(0.01)
    return _corrections(spark, sf_dir).withColumn("confidence_boost", boost)


@_query
def feedback_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = asof.place_as_of(_timed_lines(spark, sf_dir), sections(spark, sf_dir), _timed_corrections(spark, sf_dir), accept=0.05)
    return out.select("job_id", "line_id", "section_id", _round("similarity"))


@_query
def feedback_as_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feedback_as_of, with lines that arrive as files of a stream, each batch with the corrections recorded by then."""
    arrivals = versions.shared_folder(spark, "lines")
    _timed_lines(spark, sf_dir).repartition(3, "job_id").write.parquet(arrivals)
    stream = spark.readStream.schema(spark.read.parquet(arrivals).schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
    placed = versions.Versions(spark, versions.shared_folder(spark, "placed"), ["job_id"], {"placed": "job_id long, line_id int, section_id string, similarity double"}, 4)
    place = asof.place_into(placed, sections(spark, sf_dir), lambda: _timed_corrections(spark, sf_dir), accept=0.05)
    stream.writeStream.foreachBatch(place).option("checkpointLocation", versions.shared_folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return placed.read("placed").select("job_id", "line_id", "section_id", _round("similarity"))


# Sessions and service


@_query
def session_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).withColumns({"start": F.col("sent_idx") * 5.0, "end": F.col("sent_idx") * 5.0 + 5})
    merged = sessions.merge_sentences(rows.filter("sent_idx % 2 = 0"), rows.filter("sent_idx % 2 = 1"))
    return merged.select("job_id", "sent_idx", "session", "start", "end", "text")


@_query
def coverage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    secs, rows = sections(spark, sf_dir), turns(spark, sf_dir)
    ranked = classify.ranked(classify.with_context(rows, secs, SCORING), secs, SCORING)
    part = lambda k: coverage.section_coverage(ranked.filter(F.col("sent_idx") % 2 == k), rows, secs).select("job_id", "section_id", "status", "sentence_count", "confidence", "risk_score")
    return sessions.merge_coverage(part(0), part(1)).select("job_id", "section_id", "status", "sentence_count", _round("confidence"), "risk_score", "from_child")


@_query
def coverage_merge_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coverage_merge, with the two halves of each conversation arriving as files of a stream, the later half first."""
    secs, rows = sections(spark, sf_dir), turns(spark, sf_dir)
    ranked = versions.written(classify.ranked(classify.with_context(rows, secs, SCORING), secs, SCORING), "ranked")
    arrivals = versions.shared_folder(spark, "arrivals")
    for k in (1, 0):
        part = coverage.section_coverage(ranked.filter(F.col("sent_idx") % 2 == k), rows, secs)
        part.select("job_id", "section_id", F.lit(k).alias("session"), "status", "sentence_count", "confidence", "risk_score").coalesce(2).write.mode("append").parquet(arrivals)
    schema = spark.read.parquet(arrivals).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
    merged = folds.coverage_versions(spark, versions.shared_folder(spark, "coverage"), 8)
    folds.merge_stream(stream, merged, versions.shared_folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    out = sessions.merged_sessions(merged.read("coverage"))
    return out.select("job_id", "section_id", "status", "sentence_count", _round("confidence"), "risk_score", "from_child")


@_query
def review_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _routed(spark, sf_dir).select("job_id", "sent_idx", "route", F.col("primary.section_id").alias("section_id"), "audio_confidence")
    fixed = sessions.apply_corrections(rows, _corrections(spark, sf_dir))
    return sessions.recount_coverage(fixed, _coverage(spark, sf_dir)).select("job_id", "section_id", "status", "sentence_count", F.round(F.col("confidence") + 1e-9, 6).alias("confidence"), "risk_score")


@_query
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    secs = sections(spark, sf_dir)
    jobs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"))
    # Behind the scores only whether a text is empty matters, so the texts are not shuffled.
    rows = classify.scored(document_sentences(spark, sf_dir), secs, SCORING).withColumn("text", F.when(T.strip("text") != "", "said").otherwise(""))
    out = serving.sentence_report(classify.ranked(classify.with_context(rows, secs, SCORING), secs, SCORING), jobs, secs)
    return out.select("job_id", _round("coverage_percent"), F.round(F.col("average_confidence") + 1e-9, 6).alias("average_confidence"), "duplicate_rate")


@_query
def reviews_of_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.reviews(assemble.place(classify.route(_classified(spark, sf_dir, turns(spark, sf_dir)), ACCEPT)), 7).select("job_id", "sent_idx", "text")


@_query
def find_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir)
    text = F.concat(F.lit("  "), F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(" "))
    asked = rows.select("job_id", F.col("sent_idx").alias("asked"), F.when(F.col("job_id") % 2 == 1, F.col("sent_idx") + 2).alias("sentence_index"), text.alias("sentence_text"))
    return sessions.find_sentence(asked, rows).select("job_id", "asked", "sent_idx")


@_query
def form(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assemble.place(classify.route(_classified(spark, sf_dir, turns(spark, sf_dir)), ACCEPT))
    content = assemble.section_content(placed).select("job_id", "section_id", F.transform("sentences", lambda s: s["text"]).alias("texts"))
    kinds = ("boolean", "single_select", "multi_select", "text")
    made = [(s.section_id, f"{s.section_id}_{k}", k, list(s.hints)) for s in sections(spark, sf_dir) for k in kinds]
    fields = spark.createDataFrame(made, "section_id string, field_id string, type string, options array<string>")
    out = serving.form(content, fields).filter("job_id is not null")
    return out.select("job_id", "section_id", "field_id", F.get_json_object("value", "$.value").alias("value"))


@_query
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), (F.col("event_id") % 103).alias("progress"), (F.col("event_id") % 997 == 0).alias("failed"))
    return serving.job_states(events)


def _job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as steps of jobs of ten events each: mostly in order, some repeated, left out or failing."""
    steps = F.array(*[F.lit(s) for s in states.STEPS])
    progress = F.get(steps, ((F.col("event_id") + F.when(F.col("user_id") % 11 == 0, 1).otherwise(0)) % 5).cast("int"))
    return table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10).alias("job_id"), F.col("ts").cast("timestamp").alias("at"), "event_id", progress.alias("progress"), (F.col("event_id") % 97 == 0).alias("failed"))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("job_id", "status", "progress", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "reason", "steps")


@_query
def job_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(states.job_states(_job_events(spark, sf_dir)))


@_query
def job_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_state_machine over a stream of three files, in the order of time."""
    events, arrivals = _job_events(spark, sf_dir), versions.shared_folder(spark, "events")
    cuts = events.agg(F.percentile_approx(F.unix_micros("at"), [1 / 3, 2 / 3]).alias("c")).first()["c"]
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = events.filter(F.lit(low is None) | (F.unix_micros("at") > F.lit(low))).filter(F.lit(high is None) | (F.unix_micros("at") <= F.lit(high)))
        part.coalesce(1).write.mode("append").parquet(arrivals)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
    out = versions.shared_folder(spark, "transitions")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", states.PROVIDER)
    try:
        writer = states.transition_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", versions.shared_folder(spark, "progress"))
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return _shown(states.states_of(spark.read.schema(states.TRANSITIONS).parquet(out)))


@_query
def registry_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First registrations of (user, type) of `events`, and how many later attempts were rejected, in three increments."""
    attempts = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("seq"))
    kept = registry.Registry(spark, versions.shared_folder(spark, "registry"), {"user_id": "long", "event_type": "string"}, 8, 1)
    last = attempts.agg(F.max("seq").alias("last")).first()["last"]
    for k in range(3):
        kept.register(attempts.filter(F.floor(F.col("seq") * 3 / (last + 1)) == k), k)
    times = kept.rejected().groupBy("user_id", "event_type").agg(F.sum("times").alias("rejected"))
    return kept.registered().join(times, ["user_id", "event_type"], "left").select("user_id", "event_type", "seq", F.coalesce("rejected", F.lit(0)).alias("rejected"))


@_query
def feedback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"))
    out = sessions.apply_feedback(jobs, _corrections(spark, sf_dir))
    return out.select("job_id", F.col("human_feedback_count").cast("long").alias("feedback_count"), F.array_join(F.transform(F.coalesce("human_feedback", F.array().cast(out.schema["human_feedback"].dataType)), lambda x: x["corrected_section"]), "|").alias("corrected"))


@_query
def merged_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = segments(spark, sf_dir).filter("seg_idx = 0").select("job_id", "text")
    child = first.select((F.col("job_id") - 1).alias("parent_job_id"), F.col("job_id").alias("child_job_id"), F.col("text").alias("child_text"))
    pairs = first.select(F.col("job_id").alias("parent_job_id"), F.col("text").alias("parent_text")).join(child, "parent_job_id")
    return sessions.merge_transcripts(pairs).select("parent_job_id", "child_job_id", "transcript")


@_query
def ingested_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir)
    gaps = rows.select("job_id", "seg_idx", F.when(F.col("seg_idx") % 3 != 0, F.col("text")).alias("text"), F.when(F.col("seg_idx") % 2 == 0, F.col("end")).alias("end"))
    return segment.ingest(gaps).select("job_id", "seg_idx", "text", "start", "end", "avg_logprob", F.round(S.audio_confidence("avg_logprob"), 6).alias("audio_confidence"), "speaker")


@_query
def recommended_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.recommended_model("n_chars").alias("model"))


@_query
def model_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models, their accuracy, and for how many of `documents` each is the one to take."""
    taken = table(spark, sf_dir, "documents").groupBy(S.recommended_model("n_chars").alias("model")).agg(F.count("*").alias("documents"))
    return serving.model_info(spark).join(F.broadcast(taken), "model", "left").select("model", "accuracy", F.coalesce("documents", F.lit(0)).alias("documents"))  # a row per model


@_query
def context_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings` as sentences of jobs of twenty, placed by a blend with their neighbours among five known sections."""
    rows = table(spark, sf_dir, "embeddings")
    known = {f"s{r['vec_id']}": r["embedding"] for r in rows.filter("vec_id < 5").orderBy("vec_id").collect()}  # five rows
    sentences = rows.select(F.floor(F.col("vec_id") / 20).alias("job_id"), (F.col("vec_id") % 20).cast("int").alias("sent_idx"), F.col("embedding").alias("vector"))
    return placement.infer_from_context(sentences, known).select("job_id", "sent_idx", "section_id", _round("similarity"))


@_query
def vector_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    known = [r["embedding"] for r in rows.filter("vec_id < 5").orderBy("vec_id").collect()]
    out = rows.select("vec_id", F.posexplode(classify.vector_scores("embedding", known)).alias("section", "score"))
    return out.select("vec_id", "section", _round("score"))


_LETTERS = "etaoinshrd"


def _letter_counts(letters: str, texts: list[str]) -> list[list[float]]:
    """A stand-in for a sentence encoder: how often each letter occurs, and one."""
    return [[1.0, *[float(t.count(x)) for x in letters]] for t in texts]


@_query
def embedding_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by their cosine with the sections' texts; vectors come from a store, half of which an earlier run has filled."""
    rows, secs = turns(spark, sf_dir), sections(spark, sf_dir)
    store = embed.EmbeddingStore(spark, versions.shared_folder(spark, "vectors"), lambda: _LETTERS, _letter_counts, 8)
    store.add(rows.filter("sent_idx % 2 = 0"))
    known = _letter_counts(_LETTERS, [s.description for s in secs])
    found = store.embed(rows).withColumn("scores", classify.vector_scores("vector", known))
    best = F.array_min(F.transform("scores", lambda x, i: F.struct((-F.round(x, 6)).alias("down"), i.alias("section"))))
    return found.select("job_id", "sent_idx", best["section"].alias("section"), F.round(-best["down"], 6).alias("score"))


@_query
def classification_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, turns(spark, sf_dir)).select("job_id", "sent_idx", F.regexp_replace("reason", r" \(score=.*", "").alias("reason"), F.regexp_replace("detail", r"=[0-9.]+", "").alias("detail"))


@_query
def jobs_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.lit("completed").alias("status"), F.col("text").alias("transcript"))
    return serving.recent_jobs(jobs)


@_query
def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.stores import lines_of

    return lines_of(table(spark, sf_dir, "documents"), "doc_id")


@_query
def job_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return rows.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", _round("value"))


@_query
def audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    return rows.select("event_id", "user_id", "event_type", "props")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.ORACLES.items() if k in _QUERIES}
