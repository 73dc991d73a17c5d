"""Placement of lines and clauses in sections, learned corrections, paragraphs and quality metrics."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import scores as S
from ..functions import text as T

_TOKEN = re.compile(r"\w+")
ACCEPT = 0.30


def section_text(section: config.Section) -> str:
    words = section.keywords or section.hints
    return f"{section.title}. {section.description}. Keywords: {' '.join(words)}"


def scores(text: str | Column, sections: Sequence[config.Section], factors: dict[str, float] | None = None) -> Column:
    """array<double>: Jaccard with each section's text, times the section's learned factor."""
    found = S.jaccards(F.array_distinct(T.tokens(text)), [list(dict.fromkeys(_TOKEN.findall(section_text(s).lower()))) for s in sections])
    if not factors:
        return found
    return F.zip_with(found, F.array(*[F.lit(float(factors.get(s.section_id, 1.0))) for s in sections]), lambda x, f: x * f)


def best(found: Column, sections: Sequence[config.Section]) -> Column:
    """struct(section_id, similarity) of the highest score, the earlier section at ties."""
    entry = lambda f, i, s: F.struct((-F.round(F.get(f, F.lit(i)), 9)).alias("down"), F.lit(i).alias("i"), F.lit(s.section_id).alias("section_id"), F.get(f, F.lit(i)).alias("similarity"))
    return T.bound(found, lambda f: F.array_min(F.array(*[entry(f, i, s) for i, s in enumerate(sections)])))


def learned_factors(corrections: DataFrame) -> DataFrame:
    """section_id, factor: every correction takes its boost from the original section and gives it to the corrected one."""
    boost = F.coalesce("confidence_boost", F.lit(0.1))
    down = corrections.filter("original_section is not null").select(F.col("original_section").alias("section_id"), (1 - boost).alias("x"))
    up = corrections.select(F.col("corrected_section").alias("section_id"), (1 + boost).alias("x"))
    return down.unionByName(up).groupBy("section_id").agg(F.product("x").alias("factor"))


def place_with_feedback(lines: DataFrame, sections: Sequence[config.Section], factors: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """lines (job_id, line_id, text) with section_id, similarity: scores times the learned factors, which come as a table.

    A line is joined with the factors by its sections; what is joined is a row per line and section with a common word.
    """
    names = F.array(*[F.struct(F.lit(s.section_ord).alias("ord"), F.lit(s.section_id).alias("section_id")) for s in sections])
    pairs = lines.select("job_id", "line_id", F.inline(F.arrays_zip(names.alias("of"), scores("text", sections).alias("score")))).filter("score > 0")
    pairs = pairs.select("job_id", "line_id", F.col("of.ord").alias("ord"), F.col("of.section_id").alias("section_id"), "score").join(factors, "section_id", "left")
    similarity = F.col("score") * F.coalesce("factor", F.lit(1.0))
    top = pairs.withColumn("similarity", similarity).groupBy("job_id", "line_id").agg(F.min(F.struct((-F.round("similarity", 9)).alias("down"), "ord", "section_id", "similarity")).alias("x"))
    rows = lines.select("job_id", "line_id").join(top.filter(F.col("x.similarity") >= accept), ["job_id", "line_id"], "left")
    return rows.select("job_id", "line_id", F.col("x.section_id").alias("section_id"), F.col("x.similarity").alias("similarity"))


def training_stats(corrections: DataFrame) -> DataFrame:
    return corrections.agg(F.count("*").alias("total_corrections"), F.sort_array(F.collect_set("corrected_section")).alias("sections_corrected"), F.max("timestamp").alias("last_correction"))


def place_lines(lines: DataFrame, sections: Sequence[config.Section], factors: dict[str, float] | None = None, by_scores: bool = False, accept: float = ACCEPT) -> DataFrame:
    """lines (job_id, line_id, text) as units: job_id, line_id, unit_id, clause_idx, text, is_split, start_char,
    end_char, section_id (null below accept), similarity, confidence.

    A line of several clauses is split if their best sections differ (their best scores, if by_scores).
    """
    rows = lines.withColumn("parts", T.clauses(F.col("text")))
    of = F.transform("parts", lambda p: best(scores(p, sections, factors), sections))
    rows = rows.withColumn("of", of)
    what = F.transform("of", lambda o: o["similarity"].cast("string") if by_scores else o["section_id"])
    split = (F.size("parts") > 1) & (F.size(F.array_distinct(what)) > 1)
    rows = rows.withColumn("is_split", split).withColumn("parts", F.when(F.col("is_split"), F.col("parts")).otherwise(F.array("text")))
    rows = rows.select("job_id", "line_id", "is_split", F.col("text").alias("line"), F.posexplode("parts").alias("clause_idx", "text"))
    rows = rows.withColumn("top", best(scores("text", sections, factors), sections))
    ok = F.col("top.similarity") >= accept
    at = F.instr("line", F.col("text")) - 1
    return rows.select(
        "job_id", "line_id",
        F.when(F.col("is_split"), F.concat(F.col("line_id").cast("string"), F.lit("_clause_"), F.col("clause_idx"))).otherwise(F.col("line_id").cast("string")).alias("unit_id"),
        "clause_idx", "text", "is_split", at.alias("start_char"), (at + F.char_length("text")).alias("end_char"),
        F.when(ok, F.col("top.section_id")).alias("section_id"), F.col("top.similarity").alias("similarity"),
        F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("top.similarity") + 1) / 2))).alias("confidence"),
    )


def register_units(units: DataFrame) -> DataFrame:
    """units with `registered`: of rows with one unit_id in a job the first counts, later ones are duplicates."""
    order = Window.partitionBy("job_id", "unit_id").orderBy("line_id", "clause_idx")
    return units.withColumn("registered", F.col("section_id").isNotNull() & (F.row_number().over(order) == 1))


def paragraphs(units: DataFrame, least: float = 0.5) -> DataFrame:
    """Per job and section: the placed units as one paragraph, its coherence and word count.

    Units are joined in order; where neighbours' similarity is below `least` a connector stands between them.
    """
    order = Window.partitionBy("job_id", "section_id").orderBy("line_id", "clause_idx")
    rows = units.filter("registered").withColumn("before", F.lag("text").over(order))
    near = S.jaccard(F.array_distinct(T.tokens("text")), F.array_distinct(T.tokens("before")))
    rows = rows.withColumn("near", F.when(F.col("before").isNotNull(), near))
    joined = F.when(F.col("before").isNull(), F.col("text")).when(F.col("near") < least, F.concat(F.lit(" "), T.connector("text"), F.lit(" "), F.col("text"))).otherwise(F.concat(F.lit(" "), F.col("text")))
    rows = rows.withColumn("piece", joined)
    out = rows.groupBy("job_id", "section_id").agg(F.sort_array(F.collect_list(F.struct("line_id", "clause_idx", "piece"))).alias("p"), F.avg("near").alias("coherence"), F.count("*").alias("unit_count"))
    text = T.repaired_paragraph(F.array_join(F.transform("p", lambda x: x["piece"]), ""))
    return out.select("job_id", "section_id", text.alias("paragraph"), F.coalesce("coherence", F.lit(1.0)).alias("coherence_score"), "unit_count").withColumn("word_count", F.size(T.words("paragraph")))


def quality_metrics(units: DataFrame, made: DataFrame) -> DataFrame:
    """Per job: counts, confidences, duplicate rate, mean coherence of its paragraphs, units by section."""
    ok = F.col("registered")
    again = F.col("section_id").isNotNull() & ~ok
    some = units.groupBy("job_id").agg(
        F.count_distinct("line_id").alias("total_sentences"),
        F.sum(ok.cast("int")).alias("assigned_sentences"),
        F.sum((~ok).cast("int")).alias("unclassified_sentences"),
        F.sum(again.cast("int")).alias("duplicate_count"),
        F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.min(F.when(ok, F.col("confidence"))), F.lit(0.0)).alias("min_confidence"),
        F.coalesce(F.max(F.when(ok, F.col("confidence"))), F.lit(0.0)).alias("max_confidence"),
        F.count_distinct(F.when(F.col("is_split"), F.col("line_id"))).alias("split_sentences"),
    )
    by = made.groupBy("job_id").agg(F.avg("coherence_score").alias("coherence"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("section_id", "unit_count")))).alias("section_coverage"))
    out = some.join(by, "job_id", "left")
    rate = F.when(F.col("assigned_sentences") > 0, F.col("duplicate_count") / F.col("assigned_sentences")).otherwise(0.0)
    return out.withColumn("coherence_score", F.coalesce("coherence", F.lit(0.0))).withColumn("duplicate_rate", rate).drop("coherence")


def metrics_report(metrics: DataFrame) -> DataFrame:
    """job_id and a short report text of each job's metrics."""
    line = F.format_string(
        "Sentences: %d\nAssigned: %d\nUnclassified: %d\nDuplicates: %d\nSplit: %d\nConfidence: %.3f (%.3f to %.3f)\nCoherence: %.3f",
        "total_sentences", "assigned_sentences", "unclassified_sentences", "duplicate_count", "split_sentences", "avg_confidence", "min_confidence", "max_confidence", "coherence_score",
    )
    return metrics.select("job_id", line.alias("report"))


def infer_from_context(vectors: DataFrame, section_vectors: dict[str, Sequence[float]], window: int = 2, weight: float = 0.6, least: float = 0.25) -> DataFrame:
    """job_id, sent_idx, section_id, similarity by a blend of a sentence's vector with the mean of its neighbours'."""
    order = Window.partitionBy("job_id").orderBy("sent_idx")
    near = F.array_compact(F.array(*[f("vector", k).over(order) for k in range(1, window + 1) for f in (F.lag, F.lead)]))
    rows = vectors.withColumn("near", near)
    mean = F.transform("vector", lambda x, i: F.aggregate("near", F.lit(0.0), lambda s, v: s + F.get(v, i)) / F.size("near"))
    blend = F.zip_with("vector", mean, lambda a, b: weight * a + (1 - weight) * b)
    rows = rows.withColumn("blend", F.when(F.size("near") > 0, blend).otherwise(F.col("vector").cast("array<double>")))
    found = F.array(*[F.struct((-S.cosine(F.col("blend"), F.array(*[F.lit(float(x)) for x in v]))).alias("down"), F.lit(i).alias("i"), F.lit(name).alias("section_id")) for i, (name, v) in enumerate(section_vectors.items())])
    rows = rows.withColumn("best", F.array_min(found))
    return rows.select("job_id", "sent_idx", F.when(-F.col("best.down") > least, F.col("best.section_id")).alias("section_id"), (-F.col("best.down")).alias("similarity"))
