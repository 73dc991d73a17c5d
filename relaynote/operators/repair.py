"""Conservative repair of sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import text as T


def needs_repair(text: Column, audio: Column, confidence: Column, least_audio: float = 0.4, least_confidence: float = 0.35) -> Column:
    """Low audio confidence, low confidence of the primary section, or a grammar issue."""
    return F.coalesce(audio < least_audio, F.lit(False)) | F.coalesce(confidence < least_confidence, F.lit(False)) | T.has_grammar_issue(text)


def with_neighbours(rows: DataFrame, window: int = 2) -> DataFrame:
    """rows with `neighbours`, a struct of what was said around a sentence of its job: before, after (texts in their
    order, up to `window` each, empty ones left out) and text, all of them joined by blanks."""
    order = Window.partitionBy("job_id").orderBy("sent_idx")
    said = lambda texts: F.filter(F.array(*texts), lambda t: t.isNotNull() & (t != ""))
    before = said([F.lag("text", k).over(order) for k in range(window, 0, -1)])
    after = said([F.lead("text", k).over(order) for k in range(1, window + 1)])
    out = rows.withColumns({"before": before, "after": after})
    return out.withColumn("neighbours", F.struct("before", "after", F.array_join(F.concat("before", "after"), " ").alias("text"))).drop("before", "after")


def repair(rows: DataFrame, glossary: config.Glossary = config.Glossary(), hook: Callable[[Column, Column, Column], Column] | None = None, least_audio: float = 0.3, window: int = 2) -> DataFrame:
    """rows (text, audio_confidence, primary) with enhanced_text and `repair`, a struct where the text changed.

    Sentences with protected terms stay verbatim. `hook`, a column function of text, neighbours (see with_neighbours) and
    section_id such as a pandas UDF, gets the sentences to repair whose audio confidence is below `least_audio`, and no
    others, those of a job together and in their order; what it returns wins, unless it is null or empty. Rows need job_id
    and sent_idx for it. Sentences without an audio confidence do not reach it.
    """
    confidence = F.col("primary")["confidence"] if "primary" in rows.columns else F.lit(None).cast("double")
    wanted = needs_repair(F.col("text"), F.col("audio_confidence"), confidence) & ~T.is_protected("text")
    improved = T.glossary_corrected(T.fix_grammar("text"), "audio_confidence", glossary)
    if hook is None:
        rows = rows.withColumn("enhanced_text", F.when(wanted, improved).otherwise(F.col("text")))
    else:
        section = F.col("primary")["section_id"] if "primary" in rows.columns else F.lit(None).cast("string")
        kept = rows.columns
        marked = with_neighbours(rows, window).withColumn("asks", wanted & F.coalesce(F.col("audio_confidence") < least_audio, F.lit(False)))
        # A Python function in a condition would get every row, so the rows that ask it go a way of their own.
        asked = marked.filter("asks").sortWithinPartitions("job_id", "sent_idx").withColumn("answer", hook(F.col("text"), F.col("neighbours"), section))
        answered = asked.withColumn("enhanced_text", F.when(F.col("answer") != "", F.col("answer")).otherwise(improved))
        others = marked.filter("not asks").withColumn("enhanced_text", F.when(wanted, improved).otherwise(F.col("text")))
        rows = answered.select(*kept, "enhanced_text").unionByName(others.select(*kept, "enhanced_text"))
    action = F.struct(F.lit("multi_stage_repair").alias("reason"), F.col("text").alias("original"), F.col("enhanced_text").alias("improved"), F.lit(0.85 if hook is not None else 0.7).alias("confidence"))
    return rows.withColumn("repair", F.when(F.col("enhanced_text") != F.col("text"), action))
