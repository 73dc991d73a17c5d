"""The repair hook: who is asked, what it sees of the neighbours, and when its answer counts."""

import pandas as pd
from pyspark.sql import functions as F

from relaynote.operators import repair

ROWS = "job_id long, sent_idx int, text string, audio_confidence double"


def test_the_hook_sees_two_neighbours_on_each_side(spark):
    heard = [0.1, 0.9, 0.2, 0.35, None, 0.1]
    rows = [(1, i, t, a) for i, (t, a) in enumerate(zip(["One.", "Two.", "three", "", "Five.", "six"], heard))] + [(2, 0, "alone", 0.0), (2, 1, "Run kubectl apply now", 0.1), (3, 0, "Fine.", 0.8)]
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def hook(text: pd.Series, neighbours: pd.DataFrame, section: pd.Series) -> pd.Series:
        seen.add(len(text))
        out = [f"{list(b)}{list(a)}{n}" for b, a, n in zip(neighbours["before"], neighbours["after"], neighbours["text"])]
        return pd.Series([None if t == "One." else "" if t == "six" else o for t, o in zip(text, out)])

    got = {(r["job_id"], r["sent_idx"]): r for r in repair.repair(spark.createDataFrame(rows, ROWS), hook=hook).collect()}
    assert len(got) == len(rows)
    asked = {k for k, r in got.items() if (r["audio_confidence"] or 1) < 0.3 or k == (2, 0)} - {(2, 1) for _ in [0] if got[2, 1]["enhanced_text"] == "Run kubectl apply now"}
    assert seen.value == len(asked)  # no other row reaches it
    assert got[1, 2]["enhanced_text"] == "['One.', 'Two.']['Five.']One. Two. Five." and got[1, 2]["repair"]["confidence"] == 0.85
    assert got[1, 0]["enhanced_text"] == "One." and got[1, 0]["repair"] is None  # a null answer leaves the rules' text
    assert got[1, 5]["enhanced_text"] == "Six."  # so does an empty one
    assert got[2, 0]["enhanced_text"] == "[]['Run kubectl apply now']Run kubectl apply now"
    assert got[3, 0]["enhanced_text"] == "Fine." and got[1, 4]["enhanced_text"] == "Five."


def test_without_a_hook_nothing_is_looked_up_around(spark):
    got = repair.repair(spark.createDataFrame([(1, 0, "low voice", 0.1)], ROWS)).first()
    assert got["enhanced_text"] == "Low voice." and got["repair"]["confidence"] == 0.7
    assert repair.repair(spark.createDataFrame([], ROWS)).collect() == []
