"""Placement keeps its shuffles small, writes only what is shown, and drops what it has written and read."""

import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from relaynote.functions import text as T
from relaynote.operators import assemble
from relaynote.plans import catalogue
from relaynote.sources import versions

SF = "/root/testdata/sf0.001"


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_written_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    versions.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if not shuffle_files(spark) - before:
            return
        time.sleep(0.1)
    assert not shuffle_files(spark) - before


def test_forgotten_frames_are_deleted(spark):
    frame = versions.written(spark.range(3), "few")
    path = Path(frame.inputFiles()[0].removeprefix("file://")).parent
    assert path.exists()
    versions.forget(frame)
    assert not path.exists()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_placement_writes_what_is_shown(spark, monkeypatch):
    seen, write = {}, assemble.written

    def kept(df, label):
        seen[label] = df.columns
        return write(df, label)

    monkeypatch.setattr(assemble, "written", kept)
    catalogue.queries()["sentence_placement"](spark, SF)
    assert set(seen["classified"]) == {"job_id", "sent_idx", "text", "route", "primary"}


def test_only_rows_that_wait_for_a_look_up_are_joined(spark):
    section = "named_struct('section_id', s, 'title', s)"
    rows = [
        (1, 0, "Alpha one.", "a", "accepted"), (1, 1, "See above alpha.", "b", "accepted"), (1, 2, "See above alpha.", "b", "accepted"),
        (1, 3, "alpha ONE.", "a", "accepted"), (1, 4, "Weak.", "a", "review"), (1, 5, "Weak.", "b", "review"), (1, 6, "", None, "review"),
        (2, 0, "See above nothing.", "c", "accepted"), (2, 1, "see above  nothing.", "d", "accepted"), (2, 2, "See above nothing.", "d", "accepted"), (2, 3, "Plain.", "c", "accepted"),
        (3, 0, "See above zzz.", "a", "review"), (3, 1, "Other words.", "a", "accepted"), (3, 2, "Other words.", "a", "accepted"), (3, 3, "other words. ", "b", "accepted"),
    ]
    table = spark.createDataFrame(rows, "job_id long, sent_idx int, text string, s string, route string").withColumn("primary", F.expr(f"if(s is null, null, {section})")).drop("s")
    placed = assemble.place(table)
    assert "Window" not in placed._jdf.queryExecution().executedPlan().toString()
    got = {(r["job_id"], r["sent_idx"]): (r["destination"], r["to_idx"]) for r in placed.collect()}
    assert got == {
        (1, 0): ("placed", None), (1, 1): ("reference", 0), (1, 2): ("reference", 1), (1, 3): ("duplicate", 0), (1, 4): ("review", None), (1, 5): ("duplicate_review", 4), (1, 6): ("empty", None),
        (2, 0): ("placed", None), (2, 1): ("reference", 0), (2, 2): ("reference", 1), (2, 3): ("placed", None),
        (3, 0): ("review", None), (3, 1): ("placed", None), (3, 2): ("duplicate", 1), (3, 3): ("placed", None),
    }
    dropped = {(r["job_id"], r["sent_idx"]): r["destination"] for r in assemble.place(table, drop_unmatched_references=True).collect()}
    assert dropped == {k: d for k, (d, _) in got.items()} | {(2, 0): "dropped"}


def test_stripped_columns_are_those_of_the_pattern(spark):
    texts = [None, "", " ", " x ", "x", "x ", "\ty z\n", "é", "a b"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    assert all(r[0] == r[1] for r in rows.select(T.strip("x"), T.strip(F.col("x"))).collect())


def test_words_of_references_are_in_every_pattern():
    from relaynote import config

    said = ("As I mentioned it", "As noted earlier", "as stated earlier", "This connects to it", "see above", "refer to the previous", "as described earlier", "as explained earlier")
    assert all(any(w in t.lower() for w in config.REFERENTIAL_WORDS) for t in said) and len(config.REFERENTIAL_PATTERNS) == 7
