"""The whole document of a job: all parts as rows of one tagged union, and one aggregate per job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.versions import written
from . import assemble

#: How many entries of a list a document shows, and characters of a preview.
UNASSIGNED, EVIDENCE, ASSETS, LOGS, PREVIEWS, PREVIEW_CHARS = 5, 10, 10, 5, 3, 100


def _first(rows: DataFrame, order: list[str | Column], most: int) -> DataFrame:
    """The first rows of each job by the order; Spark cuts to `most` before the shuffle as well as after it."""
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def _or_null(rows: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name)


def unassigned(placed: DataFrame) -> DataFrame:
    """job_id, place, text, start, end: sentences to review, alike but for case and white space once, at the place of the
    first of them and with the value of the last."""
    rows = placed.filter("destination = 'review'").select("job_id", "sent_idx", T.key("text").alias("key"), "text", _or_null(placed, "start", "double"), _or_null(placed, "end", "double"))
    value = F.max_by(F.struct("text", "start", "end"), "sent_idx").alias("value")
    return rows.groupBy("job_id", "key").agg(F.min("sent_idx").alias("at"), value).select("job_id", "at", "value.text", "value.start", "value.end")


def logs(placed: DataFrame) -> DataFrame:
    """job_id, sentence_id, action, section_id, reasoning, confidence of each classified sentence."""
    rows = placed.filter("primary is not null")
    reason = "reason" if "reason" in placed.columns else F.lit(None).cast("string")
    return rows.select("job_id", F.col("sent_idx").alias("sentence_id"), F.lit("classified").alias("action"), F.col("primary.section_id").alias("section_id"), (F.col(reason) if isinstance(reason, str) else reason).alias("reasoning"), F.col("primary.confidence").alias("confidence"))


def reviews(placed: DataFrame) -> DataFrame:
    """job_id, place, text, start, end, explainability: the review list, each item with the log whose sentence number is
    the item's place in the list (not the sentence's own number), as served."""
    order = Window.partitionBy("job_id").orderBy("sent_idx")
    rows = placed.filter("destination = 'review'").select("job_id", (F.row_number().over(order) - 1).alias("place"), "text", _or_null(placed, "start", "double"), _or_null(placed, "end", "double"))
    entry = F.struct("action", "section_id", "reasoning", "confidence").alias("explainability")
    return rows.join(logs(placed).select("job_id", F.col("sentence_id").alias("place"), entry), ["job_id", "place"], "left")


def document(placed: DataFrame, coverage: DataFrame, jobs: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """A row per job of `jobs` (job_id, parent_job_id, timestamp, transcript) with a column for each key of the document.

    placed and coverage are read several times: save them before. feedback (job_id) is counted. A job without sentences
    has empty lists and, if it has no coverage, zeros. Lists of a job meet in one row, as they do in its document; what is
    shown in part (5 unassigned, 10 evidence, 10 assets, 5 logs) is cut before it is gathered.
    """
    content = written(assemble.section_content(placed), "content")
    ordered = assemble.ordered_content(content)
    previews = lambda n: F.transform(F.slice("sentences", 1, n), lambda s: F.substring(s["text"], 1, PREVIEW_CHARS))
    sections = ordered.select("job_id", F.struct(
        "position", "appearance", "section_id", F.col("title").alias("section_title"), "sentence_count", "confidence", previews(PREVIEWS).alias("preview"), previews(5).alias("sentences_preview"), "sentences",
    ).alias("section"))
    held = content.select("job_id", "section_id", F.col("sentence_count").alias("placed"))
    cover = coverage.join(held, ["job_id", "section_id"], "left").select("job_id", F.struct(
        "section_ord", "section_id", F.col("title").alias("section_title"), "status", "required", F.coalesce("placed", "sentence_count").alias("sentence_count"), "confidence", F.col("risk_score").alias("risk"),
    ).alias("cover"))
    links = assemble.cross_references(placed).select("job_id", F.struct("from_index", "from_sentence", F.col("section_id").alias("to_section"), "to_sentence", "note").alias("link"))
    found = placed.select("job_id", "sent_idx", _or_null(placed, "start", "double"), F.posexplode(T.urls("text")).alias("n", "content"))
    shown = _first(found, ["sent_idx", "n"], ASSETS).select("job_id", F.struct(
        "place", F.lit("url").alias("type"), "content", T.component("content").alias("component"), F.col("start").alias("timestamp"),
    ).alias("asset"))
    numbers = placed.groupBy("job_id").agg(
        F.count("*").alias("sentences"), F.sum((F.col("destination") == "review").cast("long")).alias("unassigned"), F.sum(F.col("primary").isNotNull().cast("long")).alias("logs"),
    ).select("job_id", F.struct("sentences", "unassigned", "logs").alias("numbers"))
    parts = [
        jobs.select("job_id", F.struct("parent_job_id", "timestamp", "transcript").alias("job")),
        numbers, sections, cover, links, shown,
        found.groupBy("job_id").agg(F.count("*").alias("asset_count")),
        _first(unassigned(placed), ["at"], UNASSIGNED).select("job_id", F.struct("place", "text", "start", "end").alias("unassigned")),
        reviews(placed).select("job_id", F.struct("place", "text", "start", "end", "explainability").alias("review")),
        placed.filter(F.col("sent_idx") < EVIDENCE).select("job_id", F.struct("sent_idx", "text", "evidence").alias("evidence")),
        _first(logs(placed), ["sentence_id"], LOGS).select("job_id", F.struct("place", "action", "section_id", "reasoning", "confidence").alias("log")),
        assemble.flow_coherence(content).select("job_id", F.struct("flow_coherence_score", "flow_issues").alias("flow")),
        assemble.markdown(content),
    ]
    if feedback is not None:
        parts.append(feedback.groupBy("job_id").agg(F.count("*").alias("feedback")))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    one = lambda c: F.first(c, ignorenulls=True)
    several = lambda c: F.sort_array(F.collect_list(c))
    lists = ("section", "cover", "link", "asset", "unassigned", "review", "evidence", "log")
    single = ("job", "numbers", "asset_count", "flow", "ordered_markdown", *(("feedback",) if feedback is not None else ()))
    rows = union.groupBy("job_id").agg(*[several(c).alias(c) for c in lists], *[one(c).alias(c) for c in single]).filter("job is not null")
    bare = lambda c, *left: F.transform(c, lambda x: x.dropFields(*left))
    covered = F.size(F.filter("cover", lambda x: x["status"] != "missing"))
    n = F.greatest(F.size("cover"), F.lit(1))
    none = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "job_id", F.col("job.parent_job_id").alias("parent_job_id"), F.col("job.timestamp").alias("timestamp"), F.col("job.transcript").alias("transcript"),
        (covered / n * 100).alias("overall_coverage_percent"), (F.aggregate("cover", F.lit(0.0), lambda s, x: s + x["risk"]) / n).alias("overall_risk_score"),
        F.transform(F.filter("cover", lambda x: x["required"] & (x["status"] == "missing")), lambda x: x["section_id"]).alias("missing_required_sections"),
        F.size("section").alias("section_count"), none(F.col("numbers.sentences")).alias("sentence_count"), none(F.col("numbers.unassigned")).alias("unassigned_count"),
        none(F.col("asset_count")).alias("asset_count"), none(F.col("numbers.logs")).alias("explainability_logs_count"), (none(F.col("feedback")) if feedback is not None else F.lit(0)).cast("long").alias("human_feedback_count"),
        F.map_from_entries(F.transform("cover", lambda x: F.struct(x["section_id"], x.dropFields("section_ord", "section_id")))).alias("coverage"),
        F.map_from_entries(F.transform(F.array_sort("section", lambda a, b: a["appearance"].cast("int") - b["appearance"].cast("int")), lambda x: F.struct(x["section_id"], F.struct(
            x["section_id"].alias("section_id"), x["section_title"].alias("section_title"), x["sentence_count"].alias("sentence_count"), x["confidence"].alias("confidence"), x["preview"].alias("sentences_preview"),
        )))).alias("section_content"),
        bare("section", "position", "appearance", "preview").alias("ordered_section_content"), bare("unassigned", "place").alias("unassigned_sentences"),
        bare("review", "place").alias("review_required_sentences"), bare("evidence", "sent_idx").alias("evidence"), bare("asset", "place").alias("assets"), bare("log", "place").alias("top_explainability_logs"),
        F.coalesce("flow.flow_coherence_score", F.lit(1.0)).alias("flow_coherence_score"), F.coalesce("flow.flow_issues", F.array().cast("array<string>")).alias("flow_issues"),
        F.coalesce("ordered_markdown", F.concat(F.lit("# KT Report - "), F.col("job_id").cast("string"), F.lit("\n\n"))).alias("ordered_markdown"), F.col("link").alias("cross_references"),
    )


def as_json(documents: DataFrame) -> DataFrame:
    """job_id and `document`, JSON text with all keys, null ones too."""
    return documents.select("job_id", F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"}).alias("document"))
