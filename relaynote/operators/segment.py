"""From transcripts to sentences with places and times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S
from ..functions import text as T


def ingest(segments: DataFrame) -> DataFrame:
    """Segments with defaults for what is missing: empty text, times 0, avg_logprob -1."""
    defaults = {"text": F.lit(""), "start": F.lit(0.0), "end": F.lit(0.0), "avg_logprob": F.lit(-1.0), "speaker": F.lit(None).cast("string")}
    have = {k: F.coalesce(F.col(k), v) if k in segments.columns and k not in ("avg_logprob", "speaker") else F.col(k) if k in segments.columns else v for k, v in defaults.items()}
    return segments.select("job_id", "seg_idx", *[v.alias(k) for k, v in have.items()])


def split_documents(docs: DataFrame, job_id: str = "doc_id", text: str = "text") -> DataFrame:
    """job_id, sent_idx, text of the sentences of plain documents. No shuffle: a document is split where it lies."""
    return docs.select(F.col(job_id).alias("job_id"), F.posexplode(T.sentences(F.col(text))).alias("sent_idx", "text"))


def pack_sentences(sentences: DataFrame, most: int = T.LONG_SENTENCE) -> DataFrame:
    """Sentences of over `most` characters cut to chunks; part_idx counts the chunks of a sentence."""
    return sentences.select("job_id", "sent_idx", F.posexplode(T.pack_long(F.col("text"), most)).alias("part_idx", "text"))


def running_total(rows: DataFrame, order: str, value: str, bucket: int = 1024) -> DataFrame:
    """rows with `before`, the sum of value over the rows of the job with a lesser `order` (whole numbers from 0).

    Sums of buckets of the order come first, so that a long session is summed in parts and no task has all its rows.
    """
    dealt = rows.withColumn("bucket", F.floor(F.col(order) / bucket))
    starts = dealt.groupBy("job_id", "bucket").agg(F.sum(value).alias("total"))
    earlier = Window.partitionBy("job_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("job_id", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("start_at"))
    within = Window.partitionBy("job_id", "bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    out = dealt.join(starts, ["job_id", "bucket"]).withColumn("before", F.col("start_at") + F.col("within"))
    return out.drop("bucket", "start_at", "within")


def align_segments(segments: DataFrame, lossless: bool = True, most: int = T.LONG_SENTENCE) -> DataFrame:
    """job_id, sent_idx, text, raw_text, start, end, speaker, audio_confidence, segment_ids.

    A job's segments are read as one text, joined by blanks in the order of seg_idx, and split to sentences; a sentence
    takes the times of the segments that it touches, the mean of their confidences and their speaker if they have but
    one. Chunks of a long sentence have its place; those joined from several comma parts are left out unless lossless,
    as their text does not occur in the transcript.

    Each segment is split where it lies. The number of sentence ends in the segments before tells which sentence a piece
    belongs to, so pieces meet by job and sentence and no job is gathered.
    """
    segs = segments.withColumns({"words": F.coalesce("text", F.lit("")), "confidence": S.audio_confidence("avg_logprob")})
    segs = segs.withColumn("pieces", F.split("words", r"(?<=[.!?])(?U)\s+"))
    closed = F.substring("words", -1, 1).isin(".", "!", "?").cast("int")
    segs = segs.withColumn("ends", F.size("pieces") - 1 + closed).select("job_id", "seg_idx", "start", "end", "speaker", "confidence", "pieces", "ends")
    rows = running_total(segs, "seg_idx", "ends").select("job_id", "seg_idx", "start", "end", "speaker", "confidence", "before", F.posexplode("pieces").alias("place", "piece"))
    part = F.struct("seg_idx", "piece", "start", "end", "speaker", "confidence")
    whole = rows.groupBy("job_id", (F.col("before") + F.col("place")).alias("long_idx")).agg(F.sort_array(F.collect_list(part)).alias("of"))
    # Segments before a sentence's first and behind its last word are not touched; those in between are, if blank.
    said = F.filter(F.transform("of", lambda x, i: F.when(T.strip(x["piece"]) != "", i)), lambda i: i.isNotNull())
    whole = whole.withColumn("raw", T.strip(F.array_join(F.transform("of", lambda x: x["piece"]), " "))).withColumn("said", said).filter(F.size("said") > 0)
    whole = whole.withColumn("of", F.slice("of", F.array_min("said") + 1, F.array_max("said") - F.array_min("said") + 1))
    whole = whole.withColumn("parts", T.pack_long(F.col("raw"), most))
    if not lossless:
        whole = whole.withColumn("parts", F.filter("parts", lambda x: F.contains(F.col("raw"), x)))
    numbered = running_total(whole.withColumn("n", F.size("parts")), "long_idx", "n")
    confidence = F.aggregate("of", F.lit(0.0), lambda s, g: s + g["confidence"]) / F.size("of")
    speakers = F.array_distinct(F.filter(F.transform("of", lambda g: g["speaker"]), lambda s: s.isNotNull() & (s != "")))
    out = numbered.select("job_id", "of", "before", F.posexplode("parts").alias("part_idx", "raw_text"))
    return out.select(
        "job_id",
        (F.col("before") + F.col("part_idx")).cast("int").alias("sent_idx"),
        T.collapse("raw_text").alias("text"),
        "raw_text",
        F.get("of", F.lit(0))["start"].alias("start"),
        F.element_at("of", -1)["end"].alias("end"),
        F.when(F.size(speakers) == 1, F.get(speakers, F.lit(0))).alias("speaker"),
        confidence.alias("audio_confidence"),
        F.transform("of", lambda g: g["seg_idx"]).alias("segment_ids"),
    )
