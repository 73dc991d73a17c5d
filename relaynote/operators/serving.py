"""The service's queries as views with parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config


def job(jobs: DataFrame, job_id: int | str) -> DataFrame:
    """The row of a job; no row is a 404."""
    return jobs.filter(F.col("job_id") == job_id)


def completed(jobs: DataFrame, job_id: int | str) -> DataFrame:
    """A job's row if it is completed; otherwise no row."""
    return job(jobs, job_id).filter(F.col("status") == "completed")


def recent_jobs(jobs: DataFrame, limit: int = 20, preview: int = 200) -> DataFrame:
    """The last jobs by insertion, newest first, with a preview of the transcript."""
    return jobs.orderBy(F.desc("job_id")).limit(limit).select("job_id", "status", F.substring("transcript", 1, preview).alias("transcript_preview"))


def coverage_endpoint(coverage: DataFrame) -> DataFrame:
    """Per job: percent of sections covered or weak, the number that are missing, and whether it requires attention."""
    n = F.greatest(F.count("*"), F.lit(1))
    have = F.sum(F.col("status").isin("covered", "weak").cast("int"))
    lost = F.sum((F.col("required") & (F.col("status") == "missing")).cast("int"))
    return coverage.groupBy("job_id").agg((have / n * 100).alias("coverage_percent"), lost.alias("missing_required"), (lost > 0).alias("requires_attention"))


def reviews(placed: DataFrame, job_id: int | str) -> DataFrame:
    return job(placed, job_id).filter("destination = 'review'")


def explainability_log(classified: DataFrame, limit: int = 50) -> DataFrame:
    """The first rows of each job's log: sentence_id, section_id, reasoning, confidence, alternatives."""
    rows = classified.filter("primary is not null").withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy("sent_idx")))
    return rows.filter(F.col("place") <= limit).select("job_id", F.col("sent_idx").alias("sentence_id"), F.col("primary.section_id").alias("section_id"), F.col("reason").alias("reasoning"), F.col("primary.confidence").alias("confidence"), "alternatives")


def multi_section(placed: DataFrame, first: int = 3, chars: int = 50) -> DataFrame:
    """Texts (their first characters) among the first sentences of more than one section of a job."""
    order = Window.partitionBy("job_id", "section_id").orderBy("sent_idx")
    rows = placed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= first)
    keys = rows.groupBy("job_id", F.substring("text", 1, chars).alias("text_key")).agg(F.sort_array(F.collect_set("section_id")).alias("sections"))
    return keys.filter(F.size("sections") > 1)


def quality_report(coverage: DataFrame, classified: DataFrame) -> DataFrame:
    """Per job: overall coverage, mean confidence of sentences (0.5 without any), duplicate rate."""
    c = coverage.groupBy("job_id").agg((F.avg(F.when(F.col("status") != "missing", 1.0).otherwise(0.0)) * 100).alias("coverage_percent"))
    s = classified.groupBy("job_id").agg(F.avg(F.coalesce(F.col("primary.confidence"), F.lit(0.5))).alias("mean"))
    return c.join(s, "job_id", "left").select("job_id", "coverage_percent", F.coalesce("mean", F.lit(0.5)).alias("average_confidence"), F.lit(0.0).alias("duplicate_rate"))


def sentence_report(ranked: DataFrame, jobs: DataFrame, sections: Sequence[config.Section]) -> DataFrame:
    """quality_report from sentences with their primary section, in one aggregate, so that they are scored once."""
    covered = F.collect_set(F.col("primary.section_id"))
    s = ranked.groupBy("job_id").agg(covered.alias("covered"), F.avg(F.coalesce(F.col("primary.confidence"), F.lit(0.5))).alias("mean"))
    of = F.filter(F.array(*[F.lit(x.section_id) for x in sections]).cast("array<string>"), lambda x: F.array_contains("covered", x))
    percent = F.size(of) / max(1, len(sections)) * 100
    every = jobs.select("job_id").distinct().filter(F.lit(len(sections) > 0))
    out = every.join(s.withColumn("coverage_percent", percent), "job_id", "left")
    return out.select("job_id", F.coalesce("coverage_percent", F.lit(0.0)).alias("coverage_percent"), F.coalesce("mean", F.lit(0.5)).alias("average_confidence"), F.lit(0.0).alias("duplicate_rate"))


def model_info(spark: SparkSession) -> DataFrame:
    """The transcription models and the accuracy that each is taken to have."""
    return spark.createDataFrame([*config.MODEL_ACCURACY], "model string, accuracy double")


def form(content: DataFrame, fields: DataFrame) -> DataFrame:
    """section_id, field_id, value of form controls from the texts of sections.

    content has section_id and texts (array); fields has section_id, field_id, type, options. Text controls take the
    texts by lines, checkboxes whether there are any, selections the options that occur, tables one row per text.
    """
    joined = fields.join(content, "section_id", "left")
    texts = F.coalesce("texts", F.array().cast("array<string>"))
    lower = F.lower(F.array_join(texts, "\n"))
    chosen = F.filter("options", lambda o: F.contains(lower, F.lower(o)))
    value = (
        F.when(F.col("type") == "boolean", F.to_json(F.struct((F.size(texts) > 0).alias("value"))))
        .when(F.col("type") == "single_select", F.to_json(F.struct(F.get(chosen, F.lit(0)).alias("value"))))
        .when(F.col("type") == "multi_select", F.to_json(F.struct(chosen.alias("value"))))
        .when(F.col("type").isin("table", "list"), F.to_json(F.struct(texts.alias("value"))))
        .otherwise(F.to_json(F.struct(F.array_join(texts, "\n").alias("value"))))
    )
    return joined.select(*[c for c in ("job_id",) if c in content.columns], "section_id", "field_id", value.alias("value"))


def filled_form(values: DataFrame, template: str) -> DataFrame:
    """One JSON document of a filled form: {template_name, sections: [{id, fields}]}."""
    sections = values.groupBy("section_id").agg(F.sort_array(F.collect_list(F.struct("field_id", "value"))).alias("fields"))
    return sections.agg(F.to_json(F.struct(F.lit(template).alias("template_name"), F.sort_array(F.collect_list(F.struct(F.col("section_id").alias("id"), "fields"))).alias("sections"))).alias("document"))


def console_report(content: DataFrame, overview: DataFrame, sentences: int = 5) -> DataFrame:
    """job_id and a short report: coverage, risk, what is missing, and the first sentences of each section."""
    lines = F.array_join(F.transform(F.slice("sentences", 1, sentences), lambda s: F.concat(F.lit("  - "), F.substring(s["text"], 1, 100))), "\n")
    block = F.concat(F.col("title"), F.format_string(" (%d, %.2f)\n", "sentence_count", "confidence"), lines)
    blocks = content.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("appearance", block.alias("b")))).alias("blocks"))
    head = F.format_string("Job %s\nCoverage: %.1f%%\nRisk: %.2f\nMissing: %s\n", F.col("job_id").cast("string"), "overall_coverage_percent", "overall_risk_score", F.array_join("missing_required_sections", ", "))
    body = F.array_join(F.transform(F.coalesce("blocks", F.array().cast("array<struct<appearance:int,b:string>>")), lambda x: x["b"]), "\n")
    return overview.join(blocks, "job_id", "left").select("job_id", F.concat(head, body).alias("report"))


def job_states(events: DataFrame) -> DataFrame:
    """Per job the latest state of its events (job_id, at, progress, failed): completed at 100, failed once it failed."""
    last = events.groupBy("job_id").agg(F.max("progress").alias("progress"), F.max(F.col("failed").cast("int")).alias("f"))
    state = F.when(F.col("f") == 1, "failed").when(F.col("progress") >= 100, "completed").otherwise("processing")
    return last.select("job_id", "progress", state.alias("status"))
