"""Versioned tables and the streams that merge into them: restarts, repeated batches, several writers."""

import random

import pytest
from pyspark.sql import functions as F

from relaynote.operators import sessions
from relaynote.sources.versions import Versions
from relaynote.streaming import folds

COVERAGE = "job_id long, section_id string, session int, status string, sentence_count long, confidence double, risk_score double"


def merged_one_by_one(rows):
    """The upgrade rule applied to one session after the other."""
    out = {}
    for job, section, session, status, n, c, r in sorted(rows, key=lambda r: r[2]):
        held = out.get((job, section))
        if held is None or status == "covered" or (status == "weak" and held[0] == "missing"):
            out[job, section] = (status, n, c, r, session > 0)
    return sorted((*k, *v) for k, v in out.items())


def session_rows(seed, jobs=40, most=5):
    rnd = random.Random(seed)
    return [
        (j, f"s{s}", k, rnd.choice(["missing", "weak", "covered"]), rnd.randrange(9), rnd.random(), rnd.random())
        for j in range(jobs) for s in range(4) for k in range(rnd.randrange(1, most + 1))
    ]


def result(versions):
    return sorted(tuple(r) for r in sessions.merged_sessions(versions.read("coverage")).collect())


def test_sessions_merge_in_any_order_and_again(spark):
    rows = session_rows(1)
    df = spark.createDataFrame(rows, COVERAGE)
    want = merged_one_by_one(rows)
    whole = sessions.session_candidates(df)
    assert sorted(tuple(r) for r in sessions.merged_sessions(whole).collect()) == want
    late, early = sessions.session_candidates(df.filter("session >= 2")), sessions.session_candidates(df.filter("session < 2"))
    again = sessions.merge_candidates(sessions.merge_candidates(late, early), late)
    assert sorted(tuple(r) for r in sessions.merged_sessions(again).collect()) == want


def run(stream, versions, checkpoint, merge):
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


@pytest.mark.parametrize("where", ["before the version", "after the version"])
def test_a_restart_in_mid_batch_leaves_the_rows_of_one_run(spark, tmp_path, where):
    rows = session_rows(2)
    for k in range(3):
        spark.createDataFrame(rows[k::3], COVERAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    versions = folds.coverage_versions(spark, str(tmp_path / "table"), 4)
    stream = spark.readStream.schema(COVERAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    failures = [1]
    merge, publish = folds.merge_sessions_into(versions, "w"), versions._publish

    def broken(batch, batch_id):
        if batch_id != 1 or not failures:
            return merge(batch, batch_id)
        failures.pop()
        if where == "after the version":
            merge(batch, batch_id)
        else:
            versions._publish = lambda manifest: (_ for _ in ()).throw(RuntimeError("lost"))
            merge(batch, batch_id)
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(stream, versions, str(tmp_path / "progress"), broken)
    versions._publish = publish
    assert versions.manifest()["version"] == (2 if where == "after the version" else 1)
    run(stream, versions, str(tmp_path / "progress"), broken)
    assert result(versions) == merged_one_by_one(rows)
    assert versions.manifest()["version"] == 3  # one for each batch, none for the repetition
    assert versions.manifest()["batches"] == {"w": 2}


def test_readers_keep_their_version_and_others_buckets_are_not_touched(spark, tmp_path):
    versions = Versions(spark, str(tmp_path), ["k"], {"t": "k long, v long"}, 8)
    first = spark.range(100).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("v"))
    assert versions.commit("w", 0, lambda m: {"t": (first, True)})
    before = versions.manifest()
    old = versions.read("t", manifest=before)
    some = spark.createDataFrame([(7, 1)], "k long, v long")
    buckets = versions.touched(some)

    def change(m):
        return {"t": (versions.read("t", buckets, m).filter("k <> 7").unionByName(some), True)}

    assert versions.commit("w", 1, change) and not versions.commit("w", 1, change) and not versions.commit("w", 0, change)
    assert len(buckets) == 1 and versions.read("t").agg(F.sum("v"), F.count("*")).first() == (1, 100)
    assert old.agg(F.sum("v")).first()[0] == 0
    changed = {b for b, f in versions.manifest()["folders"]["t"].items() if f != before["folders"]["t"][b]}
    assert changed == {str(buckets[0])}
    assert versions.expire(keep=1) == 0  # both folders hold buckets of the last version
    assert versions.read("t").count() == 100


def test_two_writers_make_a_version_each(spark, tmp_path):
    make = lambda: Versions(spark, str(tmp_path), ["k"], {"t": "k long, v long"}, 2)
    one, two = make(), make()
    rows = lambda v: spark.createDataFrame([(1, v)], "k long, v long")

    def beaten(m):
        """The other writer comes first, once."""
        if m["version"] == 0:
            assert two.commit("two", 0, lambda _: {"t": (rows(2), False)})
        return {"t": (rows(1), False)}

    assert one.commit("one", 0, beaten)
    assert one.manifest()["batches"] == {"one": 0, "two": 0} and one.manifest()["version"] == 2
    assert sorted(r["v"] for r in one.read("t").collect()) == [1, 2]
    assert one.compact("t", "keeper", 0) and sorted(r["v"] for r in one.read("t").collect()) == [1, 2]
    assert all(len(f) == 1 for f in one.manifest()["folders"]["t"].values())
    assert one.expire(keep=1) >= 2 and one.read("t").count() == 2


def test_an_empty_table(spark, tmp_path):
    versions = folds.coverage_versions(spark, str(tmp_path), 4)
    assert versions.read("coverage").count() == 0 and result(versions) == []
    merge = folds.merge_sessions_into(versions, "w")
    merge(spark.createDataFrame([], COVERAGE), 0)
    assert result(versions) == []
