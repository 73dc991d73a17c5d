"""Correction of transcripts by dictionaries, with a record of every correction."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import text as T

CORRECTION = "array<struct<type:string,original:string,corrected:string,rule:string>>"


def _held(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any of the patterns matches: one alternation, so that a text is read once whatever their number."""
    return text.rlike(f"(?iu)(?:{'|'.join(f'(?:{p})' for p in patterns)})") if patterns else F.lit(False)


def correct_phrases(rows: DataFrame, patterns: Sequence[tuple[str, str]] = config.PHRASE_PATTERNS, word_boundaries: bool = False) -> DataFrame:
    """rows with `text` corrected by each pattern in turn, and `corrections` extended by a record for each match.

    A pattern is applied as often as it matched, as a replacement may match again. A text that no pattern matches stays
    as it is, whatever their order, so only texts with a match enter the fold over the patterns: one expression, which
    has them as data, so the plan does not grow with their number.
    """
    out = rows if "corrections" in rows.columns else rows.withColumn("corrections", F.array().cast(CORRECTION))
    if not patterns:
        return out
    whole = lambda p: rf"\b(?:{p})\b" if word_boundaries else p
    steps = F.array(*[F.struct(F.lit(f"(?iu)({whole(p)})").alias("pattern"), F.lit(good).alias("good"), F.lit(p).alias("rule")) for p, good in patterns])
    state = f"struct<text:string,corrections:{CORRECTION},found:array<string>>"
    none = F.array().cast("array<string>")

    def seek(acc: Column, step: Column) -> Column:
        return F.struct(acc["text"].alias("text"), acc["corrections"].alias("corrections"), F.regexp_extract_all(acc["text"], step["pattern"], F.lit(1)).alias("found")).cast(state)

    def replace(acc: Column, step: Column) -> Column:
        times = F.sequence(F.lit(1), F.size(acc["found"]))
        text = F.aggregate(times, acc["text"], lambda t, _: F.regexp_replace(t, step["pattern"], step["good"]))
        records = F.transform(acc["found"], lambda m: F.struct(F.lit("phrase").alias("type"), m.alias("original"), step["good"].alias("corrected"), step["rule"].alias("rule")))
        return F.struct(text.alias("text"), F.concat(acc["corrections"], records).alias("corrections"), none.alias("found")).cast(state)

    # each pattern is there twice: its matches are sought once, then counted, replaced and recorded
    twice = F.flatten(F.transform(steps, lambda x: F.array(F.struct(x.alias("step"), F.lit(True).alias("seeks")), F.struct(x.alias("step"), F.lit(False).alias("seeks")))))
    start = F.struct(F.col("text").alias("text"), F.col("corrections").alias("corrections"), none.alias("found")).cast(state)
    folded = F.aggregate(twice, start, lambda acc, x: F.when(x["seeks"], seek(acc, x["step"])).when(F.size(acc["found"]) > 0, replace(acc, x["step"])).otherwise(acc))
    out = out.withColumn("fixed", F.when(_held(F.col("text"), [whole(p) for p, _ in patterns]), folded))
    return out.withColumns({c: F.coalesce(F.col("fixed")[c], F.col(c)) for c in ("text", "corrections")}).drop("fixed")


def correct_words(rows: DataFrame, words: Sequence[tuple[str, str]] = config.WORD_CORRECTIONS) -> DataFrame:
    """Words that the dictionary has, up to marks at their end, are replaced; the marks stay. Texts without any are only collapsed."""
    table = F.create_map(*[F.lit(v) for pair in words for v in pair])
    bare = lambda w: F.regexp_replace(w, r"[.,!?;:]+$", "")
    out = rows if "corrections" in rows.columns else rows.withColumn("corrections", F.array().cast(CORRECTION))
    entry = lambda w: F.struct(w.alias("word"), bare(w).alias("bare"))
    known = lambda x: F.struct(x["word"].alias("word"), x["bare"].alias("bare"), F.try_element_at(table, F.lower(x["bare"])).alias("good"))
    some = F.col("text").rlike(f"(?iu){'|'.join(re.escape(w) for w, _ in words)}")
    out = out.withColumn("words", F.when(some, F.transform(F.transform(T.words("text"), entry), known)))
    records = F.transform(F.filter("words", lambda x: x["good"].isNotNull()), lambda x: F.struct(F.lit("word").alias("type"), x["bare"].alias("original"), x["good"].alias("corrected"), x["word"].alias("rule")))
    text = F.array_join(F.transform("words", lambda x: F.when(x["good"].isNotNull(), F.concat(x["good"], F.substr(x["word"], F.char_length(x["bare"]) + 1))).otherwise(x["word"])), " ")
    there = F.col("words").isNotNull()
    return out.withColumns({"text": T.collapse(F.when(there, text).otherwise(F.col("text"))), "corrections": F.when(there, F.concat("corrections", records)).otherwise(F.col("corrections"))}).drop("words")


def correct_by_context(rows: DataFrame, rules: Sequence[tuple[str, Sequence[tuple[str, str]]]] = config.CONTEXT_RULES) -> DataFrame:
    """Replacements that need a trigger in the text or a neighbour's: rows have previous_text and next_text.

    What is to be replaced is sought first, so neighbours' texts are only read where it occurs.
    """
    out = rows
    around = F.concat_ws(" ", F.coalesce("previous_text", F.lit("")), "text", F.coalesce("next_text", F.lit("")))
    for trigger, pairs in rules:
        for bad, good in pairs:
            hit = F.when(F.col("text").rlike(f"(?iu){bad}"), around.rlike(f"(?iu){trigger}")).otherwise(False)
            record = F.array(F.struct(F.lit("context").alias("type"), F.lit(bad).alias("original"), F.lit(good).alias("corrected"), F.lit(trigger).alias("rule")))
            out = out.withColumns({"text": F.when(hit, F.regexp_replace("text", f"(?iu){bad}", good)).otherwise(F.col("text")), "corrections": F.when(hit, F.concat("corrections", record)).otherwise(F.col("corrections"))})
    return out


def correct_segments(segments: DataFrame, context: bool = True) -> DataFrame:
    """segments with text corrected, original_text and corrections. Neighbours' original texts are the context.

    Segments are dealt by job into as many partitions as the session shuffles to: the work is in the patterns, not in the
    bytes, so partitions that are small in bytes are not put together.
    """
    order = Window.partitionBy("job_id").orderBy("seg_idx")
    rows = segments.repartition(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), "job_id").withColumn("original_text", F.col("text"))
    if context:
        rows = rows.withColumns({"previous_text": F.lag("original_text").over(order), "next_text": F.lead("original_text").over(order)})
    rows = correct_words(correct_phrases(rows))
    return correct_by_context(rows).drop("previous_text", "next_text") if context else rows


def correction_stats(corrected: DataFrame) -> DataFrame:
    """Per job: segments, segments_corrected, total, and counts by type."""
    of = lambda kind: F.sum(F.size(F.filter("corrections", lambda x: x["type"] == kind)))
    return corrected.groupBy("job_id").agg(
        F.count("*").alias("segments"),
        F.sum((F.size("corrections") > 0).cast("int")).alias("segments_corrected"),
        F.sum(F.size("corrections")).alias("total_corrections"),
        of("phrase").alias("phrase_corrections"),
        of("word").alias("word_corrections"),
        of("context").alias("context_corrections"),
    )
