"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

1. Every partition of the scan is a memtable, bounded by spark.sql.files.maxPartitionBytes. Its rows (digest, doc_id)
   are flushed as a run: a Parquet file sorted by digest. A run has a filter: words of 64 bits, a bit for each digest.
2. The filters are merged first. A word with fewer bits than digests may hide a digest that occurs twice; digests of
   other words occur once, are never read by a merge and stay in their run. The rest goes through tiered compaction:
   each tier merges FANOUT runs by digest and keeps the identifier that stays and the group's size, until one run is
   left. Partial aggregation runs before each shuffle, so a digest that a third of all rows share costs a row a task.
3. Rows whose digest the last run holds more than once are hits. A bitmap of fixed size finds their texts in a second
   scan, so only texts of copies are shuffled, and each is compared with its keeper's bytes. The keeper is repeated by
   the salts of its group. Rows that differ from the keeper in spite of an equal digest are regrouped by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bit_filter, filter_bits, flag_contained, forget, may_contain, save

ROWS_PER_SALT = 1000
FANOUT = 16
#: Bits of a run's filter in all; only words with a bit set are kept.
SLOTS = 1 << 32


def _word() -> Column:
    return F.floor(F.pmod(F.xxhash64("digest"), F.lit(SLOTS)) / 64)


def run_filters(runs: DataFrame) -> DataFrame:
    """run, word, bits and n: which digests a run may hold, and how many rows it has in each word of its filter."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("digest"), F.lit(64)).cast("int"))
    return runs.groupBy("run", _word().alias("word")).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))


def contested(runs: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows of runs whose digest may occur twice by the merged filters: all that do, and few others."""
    words = save(filters.groupBy("word").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n")).filter(F.col("n") > F.bit_count("bits")).select("word"), "words")
    bits = filter_bits(words.count())
    return may_contain(runs.withColumn("word", _word()), F.col("word"), bit_filter(words, "word", bits), bits).drop("word")


def compacted(runs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """digest, keep_id and group_size of the one run that merging all runs (run, digest, doc_id) in tiers leaves."""
    level = save(runs.groupBy("run", "digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).sortWithinPartitions("digest"), "tier")
    left = (level.agg(F.max("run")).first()[0] or 0) + 1
    while left > 1:
        merged = level.groupBy(F.floor(F.col("run") / fanout).alias("run"), "digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        level, before, left = save(merged.sortWithinPartitions("digest"), "tier"), level, -(-left // fanout)
        forget(before)
    return level.drop("run")


def exact_dedup(docs: DataFrame, digest: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The largest doc_id of a group
    stays. A null doc_id counts in group_size and never stays, unless the whole group has none: then keep_id is null
    and every row is kept. Rows that repeat doc_id and text count each, and all have the same `kept`. Very long texts are
    compared whole, by their digest and then by their bytes. An empty table gives an empty result; other columns are ignored. `digest` (of the column `norm`) is for tests of collisions.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    norm = ascii_lower(F.col("text"))
    sha = F.sha2(F.col("norm"), 256)
    short = F.unhex(sha) if digest is None else digest.cast("string").cast("binary")
    runs = base.withColumn("norm", norm).select("doc_id", short.alias("digest"), F.unhex(sha).alias("sha"))
    runs = save(runs.withColumn("run", F.spark_partition_id()).sortWithinPartitions("digest"), "runs")
    filters = save(run_filters(runs), "filters")
    level = compacted(contested(runs, filters), fanout)
    hits = save(level.filter("group_size > 1"), "hits")
    forget(filters, level)
    bits = filter_bits(hits.count())
    pages = save(bit_filter(hits, "digest", bits), "hit-filter")

    # The bytes of hits. The salt follows from the group's size and the row itself.
    texts = may_contain(base.withColumn("norm", norm).withColumn("digest", short), F.col("digest"), pages, bits)
    salts = F.ceil(F.col("group_size") / ROWS_PER_SALT)
    texts = texts.select("doc_id", "digest", "norm").join(hits, "digest")
    texts = save(texts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts)), "hits")
    keepers = texts.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("norm").alias("keeper"), F.first("group_size").alias("of"))
    keepers = keepers.select("digest", "keeper", F.explode(F.sequence(F.lit(0), F.ceil(F.col("of") / ROWS_PER_SALT) - 1)).alias("salt"))
    checked = texts.select("doc_id", "digest", "norm", "salt").join(keepers, ["digest", "salt"])
    wrong = save(checked.filter("norm <> keeper").select("doc_id", "digest", F.sha2("norm", 256).alias("other"), "norm"), "collisions")

    wrong_groups = wrong.groupBy("digest", "norm").agg(F.max("doc_id").alias("own_keep"), F.count("*").alias("own_size"))
    wrong_rows = wrong.select("digest", "other", "norm").distinct().join(wrong_groups, ["digest", "norm"]).select("digest", F.unhex("other").alias("sha"), "own_keep", "own_size")
    fewer = wrong.groupBy("digest").agg(F.count("*").alias("fewer"))
    right = hits.join(fewer, "digest", "left").select("digest", "keep_id", (F.col("group_size") - F.coalesce("fewer", F.lit(0))).alias("size"))
    # Only rows that may be hits are dealt by digest once more.
    flagged = flag_contained(runs.drop("run"), F.col("digest"), pages, "hit", bits)
    joined = flagged.filter("hit").join(right, "digest", "left").join(wrong_rows, ["digest", "sha"], "left")
    none = {c: F.lit(None).cast("long") for c in ("keep_id", "size", "own_keep", "own_size")}
    out = joined.unionByName(flagged.filter("not hit").withColumns(none))
    keep = F.when(F.col("own_size").isNotNull(), F.col("own_keep")).when(F.col("size").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("own_size", "size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
