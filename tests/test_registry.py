"""The lasting registry: increments against one batch, buckets read, repeated batches, a hot id."""

from collections import Counter

from pyspark.sql import functions as F

from relaynote.operators.registry import Registry
from relaynote.streaming import folds

KEY = {"job_id": "long", "unit_id": "string"}
ATTEMPTS = "job_id long, unit_id string, seq long"


def plain(rows):
    first, rejected = {}, Counter()
    for job, unit, seq in rows:
        if job is None or unit is None or (job, unit) in first:
            rejected[job, unit, seq] += 1
        else:
            first[job, unit] = seq
    return first, dict(rejected)


def state(registry):
    first = {(r["job_id"], r["unit_id"]): r["seq"] for r in registry.registered().collect()}
    rejected = {(r["job_id"], r["unit_id"], r["seq"]): r["times"] for r in registry.rejected().groupBy("job_id", "unit_id", "seq").agg(F.sum("times").alias("times")).collect()}
    return first, rejected


def attempts():
    rows = [(k % 7, f"u{k * k % 31}", k) for k in range(300)] + [(1, "hot", 300 + k) for k in range(200)]
    return rows + [(1, "hot", 499), (None, "u1", 500), (2, None, 501), (1, "last", 502)]


def test_three_increments_are_one_batch(spark, tmp_path):
    rows = attempts()
    df = spark.createDataFrame(rows, ATTEMPTS)
    one = Registry(spark, str(tmp_path / "one"), KEY, 8, 1)
    assert one.register(df, 0)
    three = Registry(spark, str(tmp_path / "three"), KEY, 8, 1)
    for k, (low, high) in enumerate(((0, 150), (150, 400), (400, 600))):
        part = df.filter((F.col("seq") >= low) & (F.col("seq") < high))
        assert three.register(part, k) and not three.register(part, k)  # a repetition changes nothing
    assert state(one) == state(three) == plain(rows)


def test_an_increment_reads_only_buckets_that_may_hold_its_ids(spark, tmp_path):
    registry = Registry(spark, str(tmp_path), KEY, 64, 1)
    registry.register(spark.range(4000).select(F.col("id").alias("job_id"), F.lit("a").alias("unit_id"), "id").withColumnRenamed("id", "seq"), 0)
    fresh = spark.range(5000, 5200).select(F.col("id").alias("job_id"), F.lit("a").alias("unit_id"), F.col("id").alias("seq"))
    again = spark.createDataFrame([(5, "a", 9001), (6, "a", 9002)], ATTEMPTS)
    assert registry.register(fresh.unionByName(again), 1)
    holding = set(registry.versions.touched(again))
    assert holding <= set(registry.read_buckets) and len(registry.read_buckets) <= len(holding) + 4
    assert registry.registered().count() == 4200 and registry.rejected().count() == 2
    registry.register(spark.createDataFrame([], ATTEMPTS), 2)
    assert registry.read_buckets == [] and registry.registered().count() == 4200


def test_a_stream_registers_as_the_batch_does(spark, tmp_path):
    rows = attempts()
    for low, high in ((0, 200), (200, 600)):
        spark.createDataFrame([r for r in rows if low <= r[2] < high], ATTEMPTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    registry = Registry(spark, str(tmp_path / "kept"), KEY, 4, 1)
    stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    folds.registry_stream(stream, registry, str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    assert state(registry) == plain(rows)
