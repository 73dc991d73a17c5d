"""Follow-up sessions and human corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T


def merge_transcripts(pairs: DataFrame) -> DataFrame:
    """pairs (parent_job_id, child_job_id, parent_text, child_text) with `transcript`."""
    return pairs.withColumn("transcript", F.concat("parent_text", F.lit("\n\n[SESSION 2]\n"), "child_text"))


def merge_sentences(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Sentences of both sessions, keyed by job_id; the child's follow, its times behind the parent's end."""
    last = parent.groupBy("job_id").agg(F.max("end").alias("shift"), (F.max("sent_idx") + 1).alias("next"))
    moved = child.join(last, "job_id", "left")
    shift, follow = F.coalesce("shift", F.lit(0.0)), F.coalesce("next", F.lit(0))
    moved = moved.withColumns({"start": F.col("start") + shift, "end": F.col("end") + shift, "sent_idx": (F.col("sent_idx") + follow).cast("int")}).drop("shift", "next")
    return parent.withColumn("session", F.lit(1)).unionByName(moved.withColumn("session", F.lit(2)))


def merge_coverage(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Full outer by job and section: the child's row wins if covered, or weak where the parent's is missing."""
    names = [c for c in parent.columns if c not in ("job_id", "section_id")]
    p = parent.select("job_id", "section_id", F.struct(*names).alias("p"))
    k = child.select("job_id", "section_id", F.struct(*names).alias("k"))
    both = p.join(k, ["job_id", "section_id"], "full_outer")
    up = F.col("p").isNull() | (F.col("k.status") == "covered") | ((F.col("k.status") == "weak") & (F.col("p.status") == "missing"))
    won = F.when(F.coalesce(up, F.lit(False)), F.col("k")).otherwise(F.col("p"))
    return both.withColumn("x", won).select("job_id", "section_id", *[F.col(f"x.{n}").alias(n) for n in names], F.coalesce(up, F.lit(False)).alias("from_child"))


#: What a merged section may still come to depend on, as structs that begin with the session's number.
CANDIDATES = ("first_session", "first_weak", "last_covered")


def session_candidates(rows: DataFrame) -> DataFrame:
    """rows (job_id, section_id, session, status, and more) of any number of sessions, as one row per job and section.

    Session 0 is the parent. Merged one after the other, as merge_coverage does with two, a section is that of the last
    session that covers it, else of the first where it is weak, else of the first. These three are kept, not the winner,
    so sessions may come in any order, and again, and meet by partial aggregates: no section's rows are sorted.
    """
    names = [c for c in rows.columns if c not in ("job_id", "section_id", "session")]
    entry = F.struct("session", *names)
    return rows.groupBy("job_id", "section_id").agg(
        F.min(entry).alias("first_session"),
        F.min(F.when(F.col("status") == "weak", entry)).alias("first_weak"),
        F.max(F.when(F.col("status") == "covered", entry)).alias("last_covered"),
    )


def merge_candidates(one: DataFrame, two: DataFrame) -> DataFrame:
    """The candidates of both; merging the same sessions again changes nothing."""
    first, weak, covered = CANDIDATES
    return one.unionByName(two).groupBy("job_id", "section_id").agg(F.min(first).alias(first), F.min(weak).alias(weak), F.max(covered).alias(covered))


def merged_sessions(candidates: DataFrame) -> DataFrame:
    """job_id, section_id, the winning session's columns, and from_child."""
    names = [f.name for f in candidates.schema["first_session"].dataType.fields if f.name != "session"]
    won = candidates.withColumn("x", F.coalesce("last_covered", "first_weak", "first_session"))
    return won.select("job_id", "section_id", *[F.col(f"x.{n}").alias(n) for n in names], (F.col("x.session") > 0).alias("from_child"))


def latest_corrections(corrections: DataFrame) -> DataFrame:
    """The latest correction of each sentence (job_id, sent_idx, corrected_section, user, at)."""
    newest = F.max_by(F.struct("corrected_section", "user"), F.struct("at", "corrected_section")).alias("x")
    return corrections.groupBy("job_id", "sent_idx").agg(newest).select("job_id", "sent_idx", "x.corrected_section", "x.user")


def find_sentence(requests: DataFrame, sentences: DataFrame) -> DataFrame:
    """requests (job_id, sentence_index or sentence_text) with sent_idx: by the index, else the first sentence with that
    text, trimmed and without regard to case."""
    by_text = sentences.groupBy("job_id", F.lower(T.strip("text")).alias("wanted")).agg(F.min("sent_idx").alias("by_text"))
    rows = requests.withColumn("wanted", F.lower(T.strip("sentence_text")))
    known = sentences.select("job_id", F.col("sent_idx").alias("sentence_index"), F.col("sent_idx").alias("by_index"))
    rows = rows.join(by_text, ["job_id", "wanted"], "left").join(known, ["job_id", "sentence_index"], "left")
    return rows.withColumn("sent_idx", F.coalesce("by_index", "by_text")).drop("wanted", "by_text", "by_index")


def apply_corrections(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """rows (job_id, sent_idx, section_id, route) as they are after the latest corrections: corrected ones are accepted."""
    out = rows.join(latest_corrections(corrections), ["job_id", "sent_idx"], "left")
    moved = F.col("corrected_section").isNotNull()
    return out.withColumns({"section_id": F.coalesce("corrected_section", "section_id"), "route": F.when(moved, "accepted").otherwise(F.col("route")), "corrected": moved}).drop("corrected_section", "user")


def recount_coverage(rows: DataFrame, coverage: DataFrame) -> DataFrame:
    """coverage with counts of accepted rows (not of distinct texts), confidences, status and risk after corrections."""
    counts = rows.filter("route = 'accepted'").groupBy("job_id", "section_id").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("audio_confidence", F.lit(0.5))), 9).alias("c"))
    out = coverage.join(counts, ["job_id", "section_id"], "left")
    n = F.coalesce("n", F.lit(0))
    out = out.withColumns({"sentence_count": n, "confidence": F.when(n == 0, 0.0).otherwise(F.col("c")), "status": S.coverage_status(n)}).drop("n", "c")
    return out.withColumn("risk_score", S.coverage_risk(F.col("status"), F.col("required"), F.col("confidence")))


def apply_feedback(jobs: DataFrame, feedback: DataFrame) -> DataFrame:
    """jobs with human_feedback, the array of a job's feedback rows in order, and human_feedback_count."""
    order = F.struct("at", "sent_idx", F.col("original_section").alias("original_section"), "corrected_section", "user")
    rows = feedback.groupBy("job_id").agg(F.sort_array(F.collect_list(order)).alias("human_feedback"))
    return jobs.join(rows, "job_id", "left").withColumn("human_feedback_count", F.coalesce(F.size("human_feedback"), F.lit(0)))
