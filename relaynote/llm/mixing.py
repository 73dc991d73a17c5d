"""Mixing of sources to target weights by subset-sum budget fitting.

Rows are counted by exact length within each source. A source's target takes whole passes over the source first. The
rest is a budget: of all but ROOM words of it every length gives its share of documents, and a bounded-knapsack dynamic
program over what is left of the length counts fits all that remains. A budget of up to ROOM words is fitted by the program
alone, so no other choice of documents comes nearer. The documents of a length are those with the least seeded hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, rank_within, save

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 7
#: Words of a budget that are left to the dynamic program, at every size.
ROOM = 1 << 16


def fit(lengths: list[int], counts: list[int], budget: float, room: int = ROOM) -> list[int]:
    """How many documents of each length to take so that the words come as near to the budget as the program finds.

    Up to a budget of `room` that is the nearest sum there is.
    """
    total = sum(n * x for n, x in zip(counts, lengths))
    if total == 0 or budget <= 0:
        return [0] * len(lengths)
    early = max(0.0, min(budget, total) - room)
    share, rest, take = early / total, 0.0, [0] * len(lengths)
    order = sorted((i for i, x in enumerate(lengths) if x), key=lambda i: -lengths[i])
    for i in order:  # words short of the share so far are carried on to the next length
        rest += share * counts[i] * lengths[i]
        take[i] = min(counts[i], int(rest // lengths[i]))
        rest -= take[i] * lengths[i]
    rest = budget - sum(k * x for k, x in zip(take, lengths))
    more = _subset(lengths, [n - k for n, k in zip(counts, take)], rest)
    take = [k + m for k, m in zip(take, more)]
    rest -= sum(m * x for m, x in zip(more, lengths))
    if rest <= -1:  # too many words: give some back
        back = _subset(lengths, take, -rest)
        over = rest + sum(m * x for m, x in zip(back, lengths))
        if abs(over) < -rest:
            take, rest = [k - m for k, m in zip(take, back)], over
    # Where what is left is too long: one document more, and others back until the words fit.
    last = min((i for i in order if take[i] < counts[i] and lengths[i] > rest), key=lambda i: lengths[i], default=None)
    if rest >= 1 and last is not None:
        back = _subset(lengths, take, lengths[last] - rest)
        over = rest - lengths[last] + sum(m * x for m, x in zip(back, lengths))
        if abs(over) < rest:
            take = [k - m for k, m in zip(take, back)]
            take[last] += 1
    return take


def _subset(lengths: list[int], counts: list[int], goal: float) -> list[int]:
    """Counts, up to those given, whose words come nearest to the goal: a bounded knapsack up to twice the goal."""
    take = [0] * len(lengths)
    room, aim = int(2 * max(goal, 0)), int(max(goal, 0))
    # A bit of reach for each sum that can be made; an item is 1, 2, 4, ... documents of a length. Of each sum the item is
    # kept that first made it: what it was added to was made by items before, so every item is used once at most.
    reach, mask, items, first = 1, (1 << (room + 1)) - 1, [], np.full(room + 1, -1, np.int32)
    for i in sorted((i for i, x in enumerate(lengths) if x), key=lambda i: lengths[i]):
        left, pack, x = counts[i], 1, lengths[i]
        while left > 0 and pack * x <= room:
            n = min(pack, left)
            new = reach << n * x & mask & ~reach
            if new:
                bits = np.frombuffer(new.to_bytes(room // 8 + 1, "little"), np.uint8)
                at = np.nonzero(bits)[0]
                made = np.unpackbits(bits[at], bitorder="little").reshape(-1, 8)
                byte, bit = np.nonzero(made)
                first[8 * at[byte] + bit] = len(items)
                items.append((i, n))
                reach |= new
            left -= n
            pack *= 2
        if reach >> int(goal + 0.5) & 1:
            break
    sums = [_highest(reach & ((1 << (aim + 1)) - 1)), *([aim + 1 + _lowest(reach >> (aim + 1))] if reach >> (aim + 1) else [])]
    nearest = min(sums, key=lambda s: (abs(s - goal), s))
    while nearest:
        i, n = items[first[nearest]]
        take[i] += n
        nearest -= n * lengths[i]
    return take


def _highest(bits: int) -> int:
    return bits.bit_length() - 1


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) with `target`: shares by weight, in the order of the names, null last, cut at `most` passes."""
    ranked = save(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.col("_part") * F.lit(1 << 33)), "sources")
    # one row per partition: not more than there are partitions
    counts = sorted((r["_part"], r["n"]) for r in ranked.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    start = F.coalesce(*[F.when(F.col("_part") == p, F.lit(s)) for p, s in starts], F.lit(0)) if starts else F.lit(0)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_at") + start) % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap"))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:
        full = F.col("weight") * level > F.col("cap")
        x = weighed.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("cut"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"), F.sum(full.cast("long")).alias("n")).first()
        if x["n"] == capped or not x["open"]:
            break
        capped, level = x["n"], (total - x["cut"]) / x["open"]
    return weighed.select("source", "source_size", F.least(F.col("weight") * level, F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, source, hash, size, source_size, target, passes, taken (size times passes).

    size counts the words of the text (null: 0). Rows are taken floor(target / source_size) times, and those that the
    fitting selects once more; `most` times at most. Rows without words are never taken. A null source is a source of
    its own, the last. Repeated rows are rows of their own. hash follows from doc_id and text and orders the rows of a
    length, so reruns agree. An empty table gives an empty result.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    small = save(docs.select("doc_id", "source", words.alias("size"), row_hash(seed).alias("hash")), "sized")
    lengths = save(small.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    targets = save(source_targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most), "targets")

    def plan(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("size")
        size, target = int(x["source_size"].iloc[0]), float(x["target"].iloc[0])
        passes = min(most, int(target // size)) if size else 0
        more = [0] * len(x) if passes >= most else fit(x["size"].tolist(), x["n"].tolist(), target - passes * size)
        return x[["source", "size", "n", "source_size", "target"]].assign(passes=passes, more=more)

    # A source's group is its length counts: as many rows as it has distinct lengths, not documents.
    both = lengths.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    plans = both.groupBy("source").applyInPandas(plan, "source string, size long, n long, source_size long, target double, passes long, more long")
    plans = save(plans.withColumnsRenamed({"source": "of_source", "size": "of_size"}), "plans")
    planned = small.join(plans, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))).drop("of_source", "of_size")
    sure = planned.filter("more = 0 or more = n").withColumn("_rank", F.lit(0).cast("long"))
    ranked = rank_within(planned.filter("more > 0 and more < n").withColumn("_n", F.col("n")), ["source", "size"], F.col("hash")).drop("_n")
    passes = F.when(F.col("size") == 0, 0).otherwise(F.col("passes") + (F.col("_rank") < F.col("more")).cast("long")).cast("long")
    out = sure.unionByName(ranked).withColumn("passes", passes)
    return out.select("doc_id", "source", "hash", "size", "source_size", "target", "passes", (F.col("size") * F.col("passes")).alias("taken"))


def row_hash(seed: int = SEED) -> Column:
    return F.xxhash64("doc_id", "text", F.lit(seed))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The rows of docs as the mix takes them: a row taken k times occurs k times, a row not taken is left out.

    Rows that repeat doc_id, source and text share their passes: they are alike, so it is the same which of them gets
    more. Rows of equal doc_id and text but different sources are taken each by its own source.
    """
    planned = mix(docs, weights, most, seed).select(F.xxhash64("doc_id", F.col("source").isNull(), "source", "hash").alias("key"), "passes")
    alike = planned.groupBy("key").agg(F.sum("passes").alias("passes"), F.count("*").alias("_n")).filter("passes > 0")
    key = F.xxhash64("doc_id", F.col("source").isNull(), "source", row_hash(seed))
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key")).join(alike, "key")
    several = rank_within(rows.filter("_n > 1"), ["key"], F.xxhash64("key", F.monotonically_increasing_id()))
    several = several.withColumn("passes", F.floor(F.col("passes") / F.col("_n")) + (F.col("_rank") < F.col("passes") % F.col("_n")).cast("long"))
    taken = rows.filter("_n = 1").select("row", "passes").unionByName(several.select("row", "passes")).filter("passes > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int")))).select("row.*")
