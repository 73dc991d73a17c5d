"""Coverage, confidence and risk of sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import scores as S
from ..functions import text as T


def section_list(sections: Sequence[config.Section]):  # noqa: ANN201
    return F.array(*[F.struct(F.lit(s.section_ord).alias("section_ord"), F.lit(s.section_id).alias("section_id"), F.lit(s.title).alias("title"), F.lit(s.required).alias("required")) for s in sections])


def section_coverage(rows: DataFrame, jobs: DataFrame, sections: Sequence[config.Section], basis: str = "primary") -> DataFrame:
    """A row for each job and section, also without sentences: sentence_count, confidence, status, risk_score.

    rows are classified sentences. Counts are of distinct texts, in two stages, so that a section that most sentences
    of a job fall to is counted in parts. Means are rounded to nine decimals, so that they and the risk do not follow from
    the order of the sum. basis 'placed' leaves out sentences that are routed to review.
    """
    used = rows.filter("route = 'accepted'") if basis == "placed" else rows
    by = ["job_id", "section_id"]
    # Sentences without a section go to '', which no section has: a test for null would be pushed below the scores, and
    # every score computed twice.
    texts = used.groupBy("job_id", F.coalesce("primary.section_id", F.lit("")).alias("section_id"), T.key("text").alias("key")).agg(F.sum("audio_confidence").alias("total"), F.count("*").alias("n"))
    counts = texts.groupBy(*by).agg(F.count("*").alias("sentence_count"), F.round(F.sum("total") / F.sum("n"), 9).alias("confidence"))
    every = jobs.select("job_id").distinct().select("job_id", F.inline(section_list(sections)))
    joined = every.join(counts, by, "left")
    count = F.coalesce("sentence_count", F.lit(0))
    joined = joined.withColumn("sentence_count", count).withColumn("confidence", F.when(count == 0, 0.0).otherwise(F.col("confidence")))
    joined = joined.withColumn("status", S.coverage_status(F.col("sentence_count")))
    return joined.withColumn("risk_score", S.coverage_risk(F.col("status"), F.col("required"), F.col("confidence")))


def job_overview(coverage: DataFrame) -> DataFrame:
    """Per job: overall coverage percent and risk, progress, and the required sections that are missing, in order."""
    missing = F.when(F.col("required") & (F.col("status") == "missing"), F.struct("section_ord", "section_id"))
    covered = F.avg(F.when(F.col("status") != "missing", 1.0).otherwise(0.0)) * 100
    return coverage.groupBy("job_id").agg(
        covered.alias("overall_coverage_percent"),
        F.avg("risk_score").alias("overall_risk_score"),
        F.floor(covered).cast("int").alias("progress"),
        F.transform(F.sort_array(F.collect_list(missing)), lambda x: x["section_id"]).alias("missing_required_sections"),
    )


def _summarised(analysis: DataFrame, *more: Column) -> DataFrame:
    """Per job with required sections what required_summary tells, and `more` aggregates over all its sections."""
    need = F.col("required")
    n = F.sum(need.cast("long"))
    partial = F.sum(F.when(need, F.when(F.col("status") == "partial", 0.5).when(F.col("status") == "covered", 1.0).otherwise(0.0)))
    gone = F.sum((need & (F.col("status") == "missing")).cast("int"))
    names = F.transform(F.sort_array(F.collect_list(F.when(need & (F.col("status") == "missing"), F.struct("section_ord", "section_id")))), lambda x: x["section_id"])
    out = analysis.groupBy("job_id").agg(n.alias("n"), partial.alias("partial"), F.avg(F.when(need, F.col("confidence"))).alias("confidence_score"), gone.alias("gone"), names.alias("missing_required_sections"), *more)
    out = out.filter("n > 0").withColumn("coverage_percentage", F.col("partial") / F.col("n")).withColumn("gap", F.col("gone") / F.col("n") * 0.5)
    risk = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("coverage_percentage") + F.col("gap")))
    state = F.when(F.size("missing_required_sections") > 0, "Completed with Risk").otherwise("Pending Review")
    return out.withColumn("risk_score", risk).withColumn("recommended_state", state)


def required_summary(analysis: DataFrame) -> DataFrame:
    """Per job over required sections: coverage (a fraction), confidence, risk, missing ones; and the state to recommend."""
    return _summarised(analysis).select("job_id", "coverage_percentage", "confidence_score", "risk_score", "missing_required_sections", "recommended_state")


def report(analysis: DataFrame, tenant: str, project: str, team: str) -> DataFrame:
    """One record per job: whose it is, the summary of the required sections, and the heat of every section in order.

    Both come from one aggregate, so the analysis is computed once.
    """
    heats = F.transform(F.sort_array(F.collect_list(F.struct("section_ord", "section_id", _heat().alias("heat")))), lambda x: F.struct(x["section_id"].alias("section_id"), x["heat"].alias("heat")))
    who = {"tenant": F.lit(tenant), "project": F.lit(project), "team": F.lit(team)}
    out = _summarised(analysis, heats.alias("heatmap"))
    return out.select("job_id", "coverage_percentage", "confidence_score", "risk_score", "missing_required_sections", "recommended_state", "heatmap").withColumns(who)


def _heat() -> Column:
    return F.when(F.col("status") == "covered", F.col("confidence")).when(F.col("status") == "partial", 0.5 * F.col("confidence")).otherwise(0.0)


def heatmap(analysis: DataFrame) -> DataFrame:
    return analysis.select("job_id", "section_id", "section_ord", _heat().alias("heat"))
