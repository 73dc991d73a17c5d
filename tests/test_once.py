"""Texts are split once, however often what follows names their words, and needles are sought without a pattern."""

from pyspark.sql import functions as F

from relaynote.functions import batches
from relaynote.functions import scores as S
from relaynote.functions import text as T


def plan(spark, column):
    rows = spark.createDataFrame([(0, "x")], "i int, text string").select("i", column.alias("y"))
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_split_their_text_once(spark):
    assert plan(spark, T.word_chunks("text", 3)).count("split(") == 1


def test_sentence_quality_splits_its_text_once(spark):
    assert plan(spark, S.sentence_quality("text")).count("split(") == 1
    rows = spark.createDataFrame([(None,), ("",), ("a b",), ("one two three",)], "text string").select(F.inline(F.array(S.sentence_quality("text"))))
    assert [(r["word_count"], r["issues"]) for r in rows.collect()] == [(None, []), (0, ["too_short"]), (2, ["too_short"]), (3, [])]


def test_needles_are_sought_without_a_pattern(spark):
    assert "RLIKE" not in plan(spark, T.contains_any(F.col("text"), ["a.b", "c|d", "x"]))
    rows = spark.createDataFrame([("a.b",), ("aab",), ("c|d",), ("c",), (None,), ("ax",)], "text string")
    assert [r[0] for r in rows.select(T.contains_any(F.col("text"), ["a.b", "c|d", "x"])).collect()] == [True, False, True, False, None, True]


def test_scores_in_batches_are_those_of_rows(spark):
    known = [["a", "b"], [], ["b", "c", "d"]]
    rows = spark.createDataFrame([(0, ["a", "x"]), (1, []), (2, None), (3, ["b", "c", "d"]), (4, ["y"])], "i int, own array<string>").repartition(2)
    got = {r["i"]: r["x"] for r in rows.select("i", batches.jaccards(F.col("own"), known).alias("x")).collect()}
    assert got == {r["i"]: r["x"] for r in rows.select("i", S.jaccards(F.col("own"), known).alias("x")).collect()}


def test_hints_and_places_in_batches(spark):
    rows = spark.createDataFrame([(0, "one two"), (1, ""), (2, None)], "i int, text string")
    assert [r[0] for r in rows.orderBy("i").select(batches.contains_each(F.col("text"), [["wo"], ["three", "ne t"], []])).collect()] == [[True, True, False], [False] * 3, [False] * 3]
    scores = spark.createDataFrame([(0, [0.1, 0.3, 0.3, 0.2]), (1, [0.0] * 4), (2, None)], "i int, s array<double>")
    assert [r[0] for r in scores.orderBy("i").select(batches.highest(F.col("s"), 3)).collect()][:2] == [[1, 2, 3], [0, 1, 2]]


def test_best_section_is_not_computed_again_by_a_filter(spark):
    from relaynote import config
    from relaynote.operators import chunks

    rows = spark.createDataFrame([(1, 0, "one two")], "job_id long, chunk_idx int, chunk string")
    best = chunks.best_section(rows, [config.Section(0, "s0", "one", hints=("two",))]).filter("section_id is not null")
    assert best._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1 and [r["section_id"] for r in best.collect()] == ["s0"]


def test_the_first_section_is_made_without_lists_of_the_others(spark):
    from relaynote import config
    from relaynote.operators import classify

    arrays = ", ".join(f"{c} array<double>" for c in ("base", "context", "boost", "combined"))
    rows = spark.createDataFrame([("x", *[[0.1, 0.3]] * 4), (" ", *[[0.1, 0.3]] * 4)], f"text string, {arrays}")
    ranked = classify.ranked(rows, [config.Section(k, f"s{k}", f"t{k}") for k in range(2)])
    assert "transform(" not in ranked.select("primary")._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["primary"] and r["primary"]["section_id"], [x["section_id"] for x in r["secondary"]]) for r in ranked.collect()] == [("s1", []), (None, [])]
