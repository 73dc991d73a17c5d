"""Corrections as of a time: a correction counts for what is classified after it.

A factor is the product of all boosts of a section before a time. Products are kept as sums (logarithms in fixed point,
zeros and negative factors counted apart), so they do not follow from the order of rows and can be carried from one part
of the time line to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..sources.versions import Versions, written
from . import placement

#: Logarithms in fixed point: their sums are exact, whatever the order.
POINT = "decimal(38,18)"
SUMS = ("log", "zeros", "minus")


def effects(corrections: DataFrame) -> DataFrame:
    """section_id, at, log, zeros, minus: what all corrections of one time do to a section."""
    boost = F.coalesce("confidence_boost", F.lit(0.1))
    down = corrections.filter("original_section is not null").select(F.col("original_section").alias("section_id"), "at", (1 - boost).alias("x"))
    up = corrections.filter("corrected_section is not null").select(F.col("corrected_section").alias("section_id"), "at", (1 + boost).alias("x"))
    log = F.when(F.col("x") == 0, 0.0).otherwise(F.log(F.abs("x"))).cast(POINT)
    rows = down.unionByName(up).filter("at is not null").select("section_id", "at", log.alias("log"), (F.col("x") == 0).cast("long").alias("zeros"), (F.col("x") < 0).cast("long").alias("minus"))
    return rows.groupBy("section_id", "at").agg(*[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in SUMS])


def factor(log: Column, zeros: Column, minus: Column) -> Column:
    sign = F.when(minus % 2 == 1, -1.0).otherwise(1.0)
    return F.when(zeros > 0, 0.0).otherwise(sign * F.exp(log.cast("double")))


def factors_as_of(times: DataFrame, corrections: DataFrame, parts: int | None = None) -> DataFrame:
    """times (section_id, at) with `factor`, the product of the section's boosts before that time; distinct rows.

    Both time lines become one, with a row for each section and time. It is cut into ranges of (section, time); sums of
    whole ranges, a row for each, are carried to the later ranges of their section, and within a range a window adds what
    came before. So neither a section of many corrections nor a time of many rows is in one task.
    """
    asked = times.select("section_id", "at").filter("section_id is not null and at is not null").distinct()
    line = effects(corrections).withColumn("asked", F.lit(False)).unionByName(asked.select("section_id", "at", *[F.lit(0).cast(POINT if c == "log" else "long").alias(c) for c in SUMS], F.lit(True).alias("asked")))
    line = line.groupBy("section_id", "at").agg(*[F.sum(c).cast(POINT).alias(c) for c in SUMS], F.max("asked").alias("asked"))
    ranges = line.repartitionByRange(*([parts] if parts else []), "section_id", "at")
    line = written(ranges.withColumn("part", F.spark_partition_id()), "time-line")  # each row's range stays what it is
    sums = line.groupBy("section_id", "part").agg(*[F.sum(c).alias(c) for c in SUMS])
    earlier = Window.partitionBy("section_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carries = sums.select("section_id", "part", *[F.coalesce(F.sum(c).over(earlier).cast(POINT), F.lit(0).cast(POINT)).alias(f"{c}_to") for c in SUMS])
    before = Window.partitionBy("section_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    within = line.select("section_id", "part", "at", "asked", *[F.coalesce(F.sum(c).over(before).cast(POINT), F.lit(0).cast(POINT)).alias(c) for c in SUMS])
    both = within.filter("asked").join(carries, ["section_id", "part"])
    return both.select("section_id", "at", factor(*[F.col(c) + F.col(f"{c}_to") for c in SUMS]).alias("factor"))


def place_as_of(lines: DataFrame, sections: Sequence[config.Section], corrections: DataFrame, accept: float = placement.ACCEPT, parts: int | None = None) -> DataFrame:
    """lines (job_id, line_id, text, at) with section_id and similarity, as the corrections before `at` make them.

    A line without a time is placed as if there were no corrections; a correction without a time counts for none.
    """
    names = F.array(*[F.struct(F.lit(s.section_ord).alias("ord"), F.lit(s.section_id).alias("section_id")) for s in sections])
    pairs = lines.select("job_id", "line_id", "at", F.inline(F.arrays_zip(names.alias("of"), placement.scores("text", sections).alias("score")))).filter("score > 0")
    pairs = pairs.select("job_id", "line_id", "at", F.col("of.ord").alias("ord"), F.col("of.section_id").alias("section_id"), "score")
    pairs = written(pairs, "scored-lines")
    pairs = pairs.join(factors_as_of(pairs, corrections, parts), ["section_id", "at"], "left").withColumn("similarity", F.col("score") * F.coalesce("factor", F.lit(1.0)))
    best = F.struct((-F.round("similarity", 9)).alias("down"), "ord", "section_id", "similarity")
    top = pairs.groupBy("job_id", "line_id").agg(F.min(best).alias("x")).filter(F.col("x.similarity") >= accept)
    out = lines.select("job_id", "line_id").join(top, ["job_id", "line_id"], "left")
    return out.select("job_id", "line_id", F.col("x.section_id").alias("section_id"), F.col("x.similarity").alias("similarity"))


def place_into(versions: Versions, sections: Sequence[config.Section], load: Callable[[], DataFrame], accept: float = placement.ACCEPT, writer: str = "lines") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch of lines is placed with the corrections that load() has at that time, and added to `placed`.

    load() is called once a batch, so corrections recorded while the stream runs count for the lines after them. A batch
    that comes again adds nothing.
    """

    def place(batch: DataFrame, batch_id: int) -> None:
        versions.commit(writer, batch_id, lambda manifest: {"placed": (place_as_of(batch, sections, load(), accept), False)})

    return place
