"""Corrections as of a time against a plain product, and as a stream whose corrections come in between."""

import math
import random

import pytest
from pyspark.sql import functions as F

from relaynote import config
from relaynote.operators import asof, placement
from relaynote.sources.versions import Versions

CORRECTIONS = "original_section string, corrected_section string, confidence_boost double, at long"
SECTIONS = [config.Section(i, f"s{i}", t, True, "", (t,)) for i, t in enumerate(("deploy server", "alert metrics", "request flow"))]


def plain(times, corrections):
    out = {}
    for section, at in times:
        x = 1.0
        for original, corrected, boost, when in corrections:
            boost = 0.1 if boost is None else boost
            if when is not None and when < at:
                x *= (1 - boost) if original == section else 1.0
                x *= (1 + boost) if corrected == section else 1.0
        out[section, at] = x
    return out


def made(seed, n, hot):
    rnd = random.Random(seed)
    name = lambda: rnd.choice(["s0"] * hot + ["s1", "s2", None])
    return [(name(), name(), rnd.choice([None, 0.01, 0.3, -0.2, 1.0 if rnd.random() < 0.03 else 0.1, 2.0 if rnd.random() < 0.2 else 0.05]), rnd.choice([rnd.randrange(90), 40, None])) for _ in range(n)]


@pytest.mark.parametrize(("n", "hot", "parts"), [(300, 6, 7), (40, 1, 1), (0, 1, 3)])
def test_factors_are_products_of_what_came_before(spark, n, hot, parts):
    corrections = made(n, n, hot)
    times = [(f"s{k}", at) for k in range(3) for at in range(0, 95, 4)]
    df = spark.createDataFrame(times + times[:9] + [(None, 3), ("s1", None)], "section_id string, at long")
    got = {(r["section_id"], r["at"]): r["factor"] for r in asof.factors_as_of(df, spark.createDataFrame(corrections, CORRECTIONS), parts).collect()}
    want = plain(times, corrections)
    assert set(got) == set(want)
    assert all(math.isclose(got[k], want[k], rel_tol=1e-8, abs_tol=1e-12) for k in want)


def test_a_section_of_all_corrections_is_dealt_over_ranges(spark):
    corrections = spark.range(4000).select(F.lit("s0").alias("original_section"), F.lit("s0").alias("corrected_section"), F.lit(0.001).alias("confidence_boost"), F.col("id").alias("at"))
    line = asof.effects(corrections).repartitionByRange(8, "section_id", "at").withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in line.groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000
    times = spark.createDataFrame([("s0", 4000), ("s0", 1)], "section_id string, at long")
    got = {r["at"]: r["factor"] for r in asof.factors_as_of(times, corrections, 8).collect()}
    assert math.isclose(got[4000], (1 - 0.001**2) ** 4000, rel_tol=1e-7) and math.isclose(got[1], 1 - 0.001**2, rel_tol=1e-9)


def test_lines_are_placed_as_of_their_time_in_batch_and_stream(spark, tmp_path):
    lines = [(1, 0, "deploy server request flow", 10), (1, 1, "deploy server request flow", 30), (2, 0, "alert metrics", None), (2, 1, "nothing", 5), (3, 0, "", 7)]
    early, late = ("s0", "s2", 0.5, 20), ("s2", "s0", 0.9, 40)
    schema = "job_id long, line_id int, text string, at long"
    df = spark.createDataFrame(lines, schema)
    both = spark.createDataFrame([early, late], CORRECTIONS)
    batch = {(r["job_id"], r["line_id"]): (r["section_id"], r["similarity"]) for r in asof.place_as_of(df, SECTIONS, both, accept=0.05).collect()}
    assert batch[1, 0][0] == "s0" and batch[1, 1][0] == "s2"  # the correction at 20 moves the line at 30
    assert batch[2, 0][0] == "s1" and batch[2, 1] == batch[3, 0] == (None, None)
    assert batch[1, 0][1] == next(r["similarity"] for r in asof.place_as_of(df, SECTIONS, both.limit(0), accept=0.05).collect() if r["line_id"] == 0 and r["job_id"] == 1)

    log = str(tmp_path / "corrections")
    spark.createDataFrame([], CORRECTIONS).write.parquet(log)
    for line in lines:
        spark.createDataFrame([line], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    versions = Versions(spark, str(tmp_path / "out"), ["job_id"], {"placed": "job_id long, line_id int, section_id string, similarity double"}, 2)
    place = asof.place_into(versions, SECTIONS, lambda: spark.read.schema(CORRECTIONS).parquet(log), accept=0.05)

    def recorded_meanwhile(rows, batch_id):
        if batch_id == 0:
            both.write.mode("append").parquet(log)
        place(rows, batch_id)
        place(rows, batch_id)  # a repetition adds nothing

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(recorded_meanwhile).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    got = [(r["job_id"], r["line_id"], r["section_id"], r["similarity"]) for r in versions.read("placed").collect()]
    assert sorted(got, key=repr) == sorted(((*k, *v) for k, v in batch.items()), key=repr)


def test_without_corrections_scores_stay(spark):
    df = spark.createDataFrame([(1, 0, "deploy server", 1)], "job_id long, line_id int, text string, at long")
    none = spark.createDataFrame([], CORRECTIONS)
    row = asof.place_as_of(df, SECTIONS, none, accept=0.05).first()
    lines = placement.place_lines(df, SECTIONS, accept=0.05).first()
    assert (row["section_id"], row["similarity"]) == (lines["section_id"], lines["similarity"])
