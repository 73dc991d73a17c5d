"""Placement of sentences in sections, cross references, flow order, Markdown and nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import text as T
from ..sources.versions import forget, written


def token_postings(marked: DataFrame) -> DataFrame:
    """job_id, token, sent_idx, frequency (sentences of the job with the token), last: the latest earlier one of them."""
    tokens = marked.select("job_id", "sent_idx", F.explode(F.array_distinct(T.tokens("text"))).alias("token"))
    order = Window.partitionBy("job_id", "token").orderBy("sent_idx")
    counts = tokens.groupBy("job_id", "token").agg(F.count("*").alias("frequency"))
    return tokens.withColumn("last", F.lag("sent_idx").over(order)).join(counts, ["job_id", "token"])


def overlap_prefixes(postings: DataFrame, asked: DataFrame, overlap: float, most: int) -> DataFrame:
    """job_id, from_idx, own (its tokens, the rarest in the job first), needed, last of each asked sentence (job_id, from_idx).

    needed is max(1, min(most, int(overlap * tokens))), last the latest earlier sentence with any of the tokens.
    """
    of = postings.join(asked.select("job_id", F.col("from_idx").alias("sent_idx")), ["job_id", "sent_idx"])
    rows = of.groupBy("job_id", F.col("sent_idx").alias("from_idx")).agg(F.sort_array(F.collect_list(F.struct("frequency", "token"))).alias("ranked"), F.max("last").alias("last"))
    needed = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.size("ranked") * overlap))).cast("int")
    return rows.select("job_id", "from_idx", F.col("ranked.token").alias("own"), needed.alias("needed"), "last")


def overlap_candidates(prefixes: DataFrame, postings: DataFrame, reach: int | None) -> DataFrame:
    """(job_id, from_idx, sent_idx), a row for each token that both have, of the prefixes of sentences that need two tokens or more.

    A sentence that shares `needed` of n tokens has one of any n - needed + 1 of them, so the rarest ones of so many are
    looked up, and the job's most common words meet nothing. With `reach` only the blocks of so many sentences that hold
    the asked one and the one before are looked at.
    """
    probes = prefixes.filter("needed > 1").select("job_id", "from_idx", F.explode(F.slice("own", 1, F.size("own") - F.col("needed") + 1)).alias("token"))
    held, by = postings.select("job_id", "token", "sent_idx"), ["job_id", "token"]
    if reach is not None:
        at = F.floor(F.col("from_idx") / reach)
        probes, held, by = probes.withColumn("block", F.explode(F.array(at, at - 1))), held.withColumn("block", F.floor(F.col("sent_idx") / reach)), [*by, "block"]
    return probes.join(held, by).filter("sent_idx < from_idx").select("job_id", "from_idx", "sent_idx")


#: Sentences back that are looked at first, then further back by those without a match, at last the whole job.
REACHES = (64, 1024, None)


def latest_overlap(marked: DataFrame, asked: DataFrame, overlap: float = 0.3, most: int = 5) -> DataFrame:
    """job_id, sent_idx (the asked one), by_tokens: the latest earlier sentence that shares as many tokens as needed.

    Where one token is enough, it is the latest holder of any; else candidates by rare tokens are verified on whole sets,
    near ones first: the latest match is right whatever lies further back, so only sentences without one look on.
    """
    jobs = marked.join(asked.select("job_id").distinct(), "job_id", "left_semi")
    postings = written(token_postings(jobs), "postings")
    prefixes = written(overlap_prefixes(postings, asked, overlap, most), "prefixes")
    sets = postings.groupBy("job_id", "sent_idx").agg(F.collect_list("token").alias("tokens"))  # of one sentence
    found, left = prefixes.filter("needed = 1 and last is not null").select("job_id", "from_idx", F.col("last").alias("by_tokens")), prefixes
    for reach in REACHES:
        pairs = overlap_candidates(left, postings, reach).distinct().join(left.select("job_id", "from_idx", "own", "needed"), ["job_id", "from_idx"])
        pairs = pairs.join(sets, ["job_id", "sent_idx"]).filter(F.size(F.array_intersect("own", "tokens")) >= F.col("needed"))
        here = written(pairs.groupBy("job_id", "from_idx").agg(F.max("sent_idx").alias("by_tokens")), "matches")
        found, left = found.unionByName(here), left.join(here, ["job_id", "from_idx"], "left_anti")
    return found.withColumnRenamed("from_idx", "sent_idx")


def place(rows: DataFrame, drop_unmatched_references: bool = False, overlap: float = 0.3, most: int = 5) -> DataFrame:
    """rows with `destination` - placed, duplicate, reference, review, duplicate_review, empty, dropped - and to_idx.

    Review rows come once per text. A referential sentence with a section refers to its antecedent: the latest earlier
    sentence with the same primary section; without one, the latest earlier sentence that shares
    max(1, min(most, int(overlap * tokens))) tokens. With an antecedent it becomes a reference; without one it is placed
    (dropped, if asked for). Of texts alike within a section the first is placed, later ones refer to it.

    All but the look-up by tokens follows from windows within a job, over one shuffle of the rows as they were written first,
    so that scores are computed once and their own shuffle is gone by then. Only the first sentence of a section in its job can
    need the look-up, so it comes first in its group of like texts too: it and the rows of its group are joined with what
    was found, no others.
    """
    section = F.col("primary")["section_id"]
    earlier = Window.partitionBy("job_id", section).orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, -1)
    accepted = F.coalesce((F.col("route") == "accepted") & F.col("primary").isNotNull(), F.lit(False))
    classified = written(rows, "classified")
    work = classified.repartition("job_id").withColumn("_same", F.when(section.isNotNull(), F.max("sent_idx").over(earlier)))
    work = work.withColumn("_refers", F.coalesce(T.is_referential("text"), F.lit(False)) & section.isNotNull())
    kind = F.when(~accepted, F.when(T.strip("text") == "", "empty").otherwise("review")).when(F.col("_refers") & F.col("_same").isNotNull(), "reference").otherwise("placed")
    work = work.withColumn("_kind", kind).withColumn("_open", F.col("_refers") & F.col("_same").isNull())
    placed, review = F.col("_kind") == "placed", F.col("_kind") == "review"
    work = work.withColumn("_of", F.when(placed, section)).withColumn("_key", F.when(placed, T.key("text")).when(review, T.strip("text")))
    group = Window.partitionBy("job_id", "_kind", "_of", "_key")
    first, opens = F.min(F.when(~(placed & F.col("_open")), F.col("sent_idx"))).over(group), F.min(F.when(F.col("_open"), F.col("sent_idx"))).over(group)
    work = work.withColumn("_first", first).withColumn("_opens", opens)
    # The row whose antecedent is looked up by tokens and that this one depends on: itself, or the first of its group.
    work = work.withColumn("_asks", F.when(F.col("_open"), F.col("sent_idx")).when(placed, F.col("_opens")))
    work = work.withColumn("_ante", F.when(F.col("_refers"), F.col("_same"))).drop("_same", "_refers", "_of", "_key", "_opens")
    work = written(work, "marked")
    forget(classified)
    asked = written(work.filter("_open").select("job_id", F.col("sent_idx").alias("from_idx")), "asked")  # few: Spark sees their size
    found = latest_overlap(work.select("job_id", "sent_idx", "text"), asked, overlap, most)
    found = found.select(F.col("job_id").alias("_job"), F.col("sent_idx").alias("_from"), "by_tokens")
    open_ = work.filter("_asks is not null").join(found, (F.col("job_id") == F.col("_job")) & (F.col("_asks") == F.col("_from")), "left").drop("_job", "_from")
    both = work.filter("_asks is null").withColumn("by_tokens", F.lit(None).cast(work.schema["sent_idx"].dataType)).unionByName(open_)

    ante = F.when(F.col("_open"), F.col("by_tokens")).otherwise(F.col("_ante"))
    asks_placed = F.col("_asks").isNotNull() & F.col("by_tokens").isNull() & F.lit(not drop_unmatched_references)
    both = both.withColumn("_ante", ante).withColumn("_first", F.when(placed & asks_placed, F.least("_asks", "_first")).otherwise(F.col("_first")))
    unplaced = placed & F.col("_open")
    both = both.withColumn("_kind", F.when(unplaced & F.col("_ante").isNotNull(), "reference").when(unplaced & F.lit(drop_unmatched_references), "dropped").otherwise(F.col("_kind")))
    again = F.col("_kind").isin("placed", "review") & (F.col("_first") < F.col("sent_idx"))
    destination = F.when(again & placed, "duplicate").when(again, "duplicate_review").otherwise(F.col("_kind"))
    out = both.withColumn("destination", destination).withColumn("to_idx", F.when(again, F.col("_first")).otherwise(F.col("_ante")))
    return out.select(*rows.columns, "destination", "to_idx")


def cross_references(placed: DataFrame) -> DataFrame:
    """job_id, from_index, from_sentence, to_index, to_sentence, section_id, note, for references and duplicates."""
    out = placed.filter("destination in ('reference', 'duplicate')")
    note = F.when(F.col("destination") == "reference", "referential_link").otherwise("duplicate_reference")
    out = out.select("job_id", F.col("sent_idx").alias("from_index"), F.col("text").alias("from_sentence"), F.col("to_idx").alias("to_index"), F.col("primary")["section_id"].alias("section_id"), note.alias("note"))
    to = placed.select("job_id", F.col("sent_idx").alias("to_index"), F.col("text").alias("to_sentence"))
    return out.join(to, ["job_id", "to_index"], "left")


def flow_bucket(title: Column, section_id: Column) -> Column:
    """Number of the flow bucket; sections that match none go to the last."""
    out = F.lit(len(config.FLOW_BUCKETS) - 1)
    for k in reversed(range(len(config.FLOW_BUCKETS))):
        words = config.FLOW_BUCKETS[k][1]
        out = F.when(T.contains_any(F.lower(title), words) | T.contains_any(F.lower(section_id), words), F.lit(k)).otherwise(out)
    return out


def is_in_flow(title: Column, section_id: Column) -> Column:
    words = [w for _, ws in config.FLOW_BUCKETS for w in ws]
    return T.contains_any(F.lower(title), words) | T.contains_any(F.lower(section_id), words)


def section_content(placed: DataFrame) -> DataFrame:
    """Per job and section with placed sentences: count, mean confidence, first appearance, sentences in order.

    The mean is of whole millionths, so it does not follow from the order of the sum.
    """
    mean = F.sum(F.round(F.col("audio_confidence") * 1_000_000).cast("long")) / F.count("audio_confidence") / 1_000_000
    rows = placed.filter("destination = 'placed'")
    sentence = F.struct("sent_idx", F.col("enhanced_text" if "enhanced_text" in placed.columns else "text").alias("text"), "audio_confidence")
    return rows.groupBy("job_id", F.col("primary.section_id").alias("section_id"), F.col("primary.title").alias("title")).agg(
        F.count("*").alias("sentence_count"), mean.alias("confidence"), F.min("sent_idx").alias("appearance"), F.sort_array(F.collect_list(sentence)).alias("sentences")
    )


def flow_coherence(content: DataFrame) -> DataFrame:
    """Per job: the share of sections that come in non-decreasing bucket order, and the issues."""
    order = Window.partitionBy("job_id").orderBy("appearance")
    rows = content.withColumn("bucket", flow_bucket(F.col("title"), F.col("section_id"))).withColumn("before", F.lag("bucket").over(order))
    bad = F.col("bucket") < F.col("before")
    issue = F.when(bad, F.struct("appearance", F.format_string("Section '%s' appears out of flow (bucket %d < prev %d)", "section_id", "bucket", "before").alias("issue")))
    return rows.groupBy("job_id").agg(F.avg(F.when(bad, 0.0).otherwise(1.0)).alias("flow_coherence_score"), F.transform(F.sort_array(F.collect_list(issue)), lambda x: x["issue"]).alias("flow_issues"))


def ordered_content(content: DataFrame, preview: int = 5) -> DataFrame:
    """content with bucket, its name, position in the flow and previews of the first sentences."""
    rows = content.withColumn("bucket", flow_bucket(F.col("title"), F.col("section_id"))).withColumn("matched", is_in_flow(F.col("title"), F.col("section_id")))
    names = F.array(*[F.lit(n) for n, _ in config.FLOW_BUCKETS])
    order = Window.partitionBy("job_id").orderBy("bucket", (~F.col("matched")).cast("int"), "appearance")
    rows = rows.withColumn("bucket_name", F.get(names, F.col("bucket"))).withColumn("position", F.row_number().over(order))
    return rows.withColumn("sentences_preview", F.transform(F.slice("sentences", 1, preview), lambda s: F.substring(s["text"], 1, 100)))


def markdown(content: DataFrame) -> DataFrame:
    """Per job one Markdown text; sections that match no bucket come last, under a heading of their own."""
    rows = ordered_content(content).withColumn("group", F.struct(F.when(F.col("matched"), F.col("bucket")).otherwise(len(config.FLOW_BUCKETS)).alias("g"), F.col("bucket_name").alias("name")))
    lines = F.array_join(F.transform("sentences", lambda s: F.concat(F.lit("- "), s["text"])), "\n")
    block = F.concat(F.lit("### "), F.col("title"), F.lit("\n"), lines, F.lit("\n"))
    groups = rows.groupBy("job_id", "group").agg(F.sort_array(F.collect_list(F.struct("appearance", block.alias("block")))).alias("blocks"))
    body = F.concat(F.lit("## "), F.col("group.name"), F.lit("\n"), F.array_join(F.transform("blocks", lambda b: b["block"]), "\n"))
    jobs = groups.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct(F.col("group.g").alias("g"), body.alias("body")))).alias("parts"))
    return jobs.select("job_id", F.concat(F.lit("# KT Report - "), F.col("job_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform("parts", lambda p: p["body"]), "\n")).alias("ordered_markdown"))


def assets(rows: DataFrame) -> DataFrame:
    """job_id, sentence_id, content, detected_component of the URLs in texts."""
    found = rows.select("job_id", F.col("sent_idx").alias("sentence_id"), F.explode(T.urls("text")).alias("content"))
    return found.select("job_id", "sentence_id", F.lit("url").alias("asset_type"), "content", T.component("content").alias("detected_component"))


def review_list(placed: DataFrame, most: int | None = None) -> DataFrame:
    """Sentences to review, once per text, with the reason and evidence if they are there; `most` per job if given."""
    out = placed.filter("destination = 'review'").select("job_id", "sent_idx", "text", *[c for c in ("review_reason", "evidence") if c in placed.columns], "enhanced_text" if "enhanced_text" in placed.columns else F.col("text").alias("enhanced_text"))
    if most is None:
        return out
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy("sent_idx"))).filter(F.col("rank") <= most).drop("rank")


def documents(placed: DataFrame, coverage: DataFrame, overview: DataFrame) -> DataFrame:
    """job_id and `document`, the JSON text of each job of `overview`, where no more is known of the jobs."""
    from .document import as_json, document  # which is built on this module

    jobs = overview.select("job_id", *[F.lit(None).cast(kind).alias(name) for name, kind in (("parent_job_id", coverage.schema["job_id"].dataType), ("timestamp", "string"), ("transcript", "string"))])
    return as_json(document(placed, coverage, jobs))
