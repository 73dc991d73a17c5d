"""Column functions for similarities, confidences and qualities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from . import text as T


def audio_confidence(avg_logprob: str | Column) -> Column:
    """Clamped (x + 2) / 2; 0.5 without a value."""
    x = T.c(avg_logprob)
    # greatest and least skip nulls, so they can't tell that there is no value
    return F.when(x.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x + 2) / 2)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 0.0).otherwise(both / union)


def jaccards(own: Column, known: Sequence[Sequence[str]]) -> Column:
    """array<double>: the Jaccard similarity of the distinct tokens `own` with each of the known lists; 0 if both are empty.

    Tokens of no list go first, by one look-up in a set of literals for each, so the lists meet short arrays only.
    """
    every = sorted({t for k in known for t in k})
    if not every:
        return F.array(*[F.lit(0.0)] * len(known))
    sizes = F.array(*[F.lit(len(k)) for k in known])
    among = lambda words: lambda t: t.isin(*words)

    def of(x: Column) -> Column:
        counts = F.array(*[F.size(F.filter(x["some"], among(k))) if k else F.lit(0) for k in known])
        union = lambda c, n: n + x["n"] - c
        return F.zip_with(counts, sizes, lambda c, n: F.when(union(c, n) == 0, 0.0).otherwise(c / union(c, n)))

    return T.bound(own, lambda o: T.bound(F.struct(F.size(o).alias("n"), F.filter(o, among(every)).alias("some")), of))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, epsilon: float = 1e-9) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + epsilon)


def literal_tokens(tokens: Sequence[str]) -> Column:
    return F.array(*[F.lit(t) for t in tokens]) if tokens else F.array().cast("array<string>")


def transcript_quality(x: str | Column) -> Column:
    """struct(total_length, word_count, issues, technical_terms, confidence_score, status)."""
    text = F.coalesce(T.c(x), F.lit(""))
    sents = T.sentences(text)
    short = F.size(F.filter(sents, lambda s: F.size(T.words(s)) < 3))
    fragments = (F.size(sents) > 0) & (short > F.size(sents) * 0.3)
    lower = F.lower(text)
    terms = sum((F.contains(lower, F.lit(t)).cast("int") for t in config.QUALITY_TERMS), F.lit(0))
    brief, wordless = F.char_length(text) < 100, ~text.rlike(r"\p{L}")
    score = F.greatest(F.lit(0), 80 - F.when(brief, 20).otherwise(0) - F.when(fragments, 10).otherwise(0) + F.when(terms > 0, 15).otherwise(0))
    score = F.when(wordless, 0).otherwise(score)
    issues = F.array_compact(F.array(F.when(brief, F.lit("transcript_too_short")), F.when(wordless, F.lit("no_valid_text")), F.when(~wordless & fragments, F.lit("excessive_fragments"))))
    status = F.when(wordless, F.lit(None).cast("string")).when(score > 85, "excellent").when(score > 70, "good").when(score > 50, "fair").otherwise("poor")
    return F.struct(F.char_length(text).alias("total_length"), F.size(T.words(text)).alias("word_count"), issues.alias("issues"), F.when(wordless, 0).otherwise(terms).alias("technical_terms"), score.alias("confidence_score"), status.alias("status"))


def transcription_accuracy(x: str | Column, model: str = "base") -> Column:
    text = F.coalesce(T.c(x), F.lit(""))
    n = F.char_length(text)
    length = F.when(n > 5000, 1.0).when(n > 2000, 0.8).when(n > 500, 0.5).otherwise(0.2)
    parts = F.size(F.split(text, "[.!?]+"))
    structure = F.when(parts > 20, 1.0).when(parts > 10, 0.8).when(parts > 5, 0.5).otherwise(0.2)
    special = F.char_length(F.regexp_replace(text, r"[\x20-\x7E]", "")) / F.greatest(F.lit(1), n)
    factors = (length + structure + F.greatest(F.lit(0.0), 1.0 - special * 5)) / 3
    return F.least(F.lit(0.99), F.lit(dict(config.MODEL_ACCURACY).get(model, 0.90)) * (0.8 + factors * 0.2))


def correction_confidence(original: str | Column, corrections: Column) -> Column:
    n = F.size(T.words(original))
    return F.when(F.coalesce(T.c(original), F.lit("")) == "", 0.5).otherwise(F.greatest(F.lit(0.0), 1 - 0.5 * corrections / F.greatest(n, F.lit(1))))


def recommended_model(seconds: str | Column) -> Column:
    return F.when(T.c(seconds) <= 1800, "base").otherwise("small")


def sentence_quality(x: str | Column) -> Column:
    """struct(quality_score, word_count, avg_word_length, issues, status)."""

    # Each step is bound: a text is split to words once, however often its figures are named.
    def counted(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), F.aggregate(w, F.lit(0), lambda s, v: s + F.char_length(v)).alias("chars"))

    def judged(f: Column) -> Column:
        n, mean = f["n"], F.when(f["n"] > 0, f["chars"] / f["n"]).otherwise(0.0)
        issues = F.array_compact(F.array(F.when(n < 3, F.lit("too_short")), F.when(n > 100, F.lit("too_long")), F.when(mean > 20, F.lit("unusual_word_length"))))
        return F.struct(n.alias("n"), mean.alias("mean"), issues.alias("issues"))

    def scored(j: Column) -> Column:
        score = F.greatest(F.lit(0), 100 - 10 * F.size(j["issues"]))
        return F.struct(score.alias("quality_score"), j["n"].alias("word_count"), j["mean"].alias("avg_word_length"), j["issues"].alias("issues"), F.when(score > 70, "acceptable").when(score > 40, "warning").otherwise("review_needed").alias("status"))

    return T.bound(T.bound(T.bound(T.words(x), counted), judged), scored)


def coverage_status(count: Column, weak: str = "weak", most_weak: int = 1) -> Column:
    return F.when(count == 0, "missing").when(count <= most_weak, weak).otherwise("covered")


def coverage_risk(status: Column, required: Column, confidence: Column) -> Column:
    return (
        F.when(status == "missing", F.when(required, 1.0).otherwise(0.5))
        .when(status == "weak", F.when(required, 0.6).otherwise(0.2))
        .otherwise(F.when(confidence > 0.7, 0.0).otherwise(0.1))
    )
