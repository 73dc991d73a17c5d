"""Classification of sentences by section, and routing of what needs a review."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import batches
from ..functions import scores as S
from ..functions import text as T

_TOKEN = re.compile(r"\w+")


def section_tokens(section: config.Section) -> list[str]:
    return list(dict.fromkeys(_TOKEN.findall(section.text.lower())))


def section_scores(text: str | Column, sections: Sequence[config.Section]) -> Column:
    """array<double>: the Jaccard similarity with each section, in their order."""
    return batches.jaccards(F.array_distinct(T.tokens(text)), [section_tokens(s) for s in sections])


def vector_scores(vector: str | Column, section_vectors: Sequence[Sequence[float]]) -> Column:
    """array<double>: the cosine with each section's vector, for embeddings that are there as a column."""
    return F.array(*[S.cosine(T.c(vector), F.array(*[F.lit(float(x)) for x in v])) for v in section_vectors])


def scored(sentences: DataFrame, sections: Sequence[config.Section], scoring: config.Scoring = config.Scoring()) -> DataFrame:
    """sentences with base and boost, what their own texts tell; those that are there stay."""
    own = {"base": lambda: section_scores("text", sections), "boost": lambda: batches.boosts(F.lower("text"), [s.hints for s in sections], scoring.boost_step, scoring.boost_most)}
    return sentences.withColumns({c: of() for c, of in own.items() if c not in sentences.columns})


def with_context(sentences: DataFrame, sections: Sequence[config.Section], scoring: config.Scoring = config.Scoring()) -> DataFrame:
    """sentences with array columns over the sections: base, context, boost, combined.

    context is the mean of base over the neighbours up to scoring.context before and behind, without the sentence
    itself; 0 if there is none. A sentence stays one row: neighbours' arrays come by lag and lead over one shuffle on
    job_id, so nothing is multiplied by the number of sections. Base and boost are made ahead of it, so the text only goes
    through the shuffle where it is wanted behind.
    """
    base = scored(sentences, sections, scoring)
    order = Window.partitionBy("job_id").orderBy("sent_idx")
    before = {f"before{k}": F.lag("base", k).over(order) for k in range(scoring.context, 0, -1)}
    near = before | {f"behind{k}": F.lead("base", k).over(order) for k in range(1, scoring.context + 1)}
    blend = batches.blended(F.col("base"), [F.col(c) for c in before], [F.col(c) for c in near if c not in before], F.col("boost"), len(sections), scoring.alpha, scoring.beta)
    rows = base.withColumns(near).withColumn("of", blend).drop(*near)
    return rows.select(*[c for c in rows.columns if c not in ("boost", "of")], F.col("of")["context"].alias("context"), "boost", F.col("of")["combined"].alias("combined"))


def ranked(rows: DataFrame, sections: Sequence[config.Section], scoring: config.Scoring = config.Scoring()) -> DataFrame:
    """rows with `primary` and `secondary`: structs (ord, section_id, title, confidence, similarity) by combined score.

    Ties go to the earlier section. Secondary are the next two: those of at least 0.6 of the threshold where the first
    reaches it, else both. Empty sentences have neither.
    """
    table = F.array(*[F.struct(F.lit(s.section_ord).alias("ord"), F.lit(s.section_id).alias("section_id"), F.lit(s.title).alias("title"), F.lit(s.required).alias("required")) for s in sections])
    at = lambda c, i: F.get(F.col(c), i)
    entry = lambda i: F.struct(*[F.get(table, i)[c].alias(c) for c in ("ord", "section_id", "title", "required")], at("combined", i).alias("confidence"), at("base", i).alias("similarity"), at("context", i).alias("context"), at("boost", i).alias("boost"))
    rows = rows.withColumn("places", batches.highest(F.col("combined"), scoring.top_k))
    said = T.strip("text") != ""
    # The first is made by itself: where the others are not wanted, no lists of them are made.
    first = F.when(said & (F.size("places") > 0), entry(F.get("places", F.lit(0))))
    rest = F.when(said, F.transform(F.slice("places", 2, scoring.top_k), entry))
    passed = first["confidence"] >= scoring.similarity_threshold
    kept = F.when(passed, F.filter(rest, lambda x: x["confidence"] >= 0.6 * scoring.similarity_threshold)).otherwise(rest)
    return rows.withColumn("primary", first).withColumn("secondary", F.coalesce(kept, F.slice(F.array(first), 2, 1))).drop("places")


def classify(sentences: DataFrame, sections: Sequence[config.Section], scoring: config.Scoring = config.Scoring()) -> DataFrame:
    """Sentences with primary and secondary sections, and the reason as text."""
    rows = ranked(with_context(sentences, sections, scoring), sections, scoring)
    p = F.col("primary")
    reason = F.format_string("Matched '%s' to '%s' (score=%.3f)", F.substring("text", 1, 60), p["title"], p["confidence"])
    detail = F.format_string("Semantic=%.3f, Context=%.3f, Keywords=%.3f, Combined=%.3f", p["similarity"], p["context"], p["boost"], p["confidence"])
    rows = rows.withColumn("reason", F.when(p.isNotNull(), reason)).withColumn("detail", F.when(p.isNotNull(), detail))
    return rows.withColumn("alternatives", F.transform(F.slice("secondary", 1, 2), lambda x: x["section_id"])).withColumn("glossary_warnings", T.ambiguity_warnings("text")).drop("base", "context", "boost", "combined")


def route(classified: DataFrame, policy: config.Policy = config.Policy()) -> DataFrame:
    """classified with route ('accepted' or 'review'), review_reason, evidence, is_causal and is_inferred."""
    p = F.col("primary")
    weak = p["confidence"] < policy.confidence_accept_threshold
    conceptual = T.contains_any(F.lower(p["title"]), policy.conceptual_sections)
    misplaced = T.is_implementation("text", policy) & conceptual
    review = p.isNull() | weak | misplaced
    reason = (
        F.when(p.isNull(), "No classification")
        .when(weak, F.format_string("Low semantic confidence (%.2f)", p["confidence"]))
        .when(misplaced, F.format_string("Implementation step in conceptual section '%s'", p["title"]))
    )
    rows = classified.withColumn("route", F.when(F.coalesce(review, F.lit(True)), "review").otherwise("accepted")).withColumn("review_reason", reason)
    rows = rows.withColumn("evidence", T.evidence("text")).withColumn("is_causal", T.is_causal("text"))
    inferred = (F.col("route") == "accepted") & F.col("is_causal") & (F.size("evidence") == 0)
    return rows.withColumn("is_inferred", inferred).withColumn("reason", F.when(inferred, F.concat("reason", F.lit(" [INFERRED]"))).otherwise(F.col("reason")))
