"""Decontamination by winnowing against a plain version that looks up every window."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from relaynote.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXT = "id long, text string"


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    lengths, out = {len(k) for k in windows}, []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if of := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= of
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows_of(spark, docs, items, **options):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, window string, n_words int")
    items = spark.createDataFrame([(d, t, "x") for d, t in items], "item_id long, text string, words string")
    return sorted((tuple(r) for r in decontam.decontaminate(docs, items, **options).collect()), key=repr)


def tables(seed):
    rnd = random.Random(seed)
    few = ["a", "b", "ä", "日", "9"]
    passage = " q r s t u v w x y z a b c"
    long = [(i, " ".join(rnd.choice(few) for _ in range(rnd.choice([10, 12, 15])))) for i in range(12)] + [(7, passage), (55, passage)]
    short = [(50, "a b a"), (51, "zz"), (52, None), (53, ""), (54, "..."), (None, "b b b b a a"), (50, "a b a")]
    text = lambda n: "-".join(rnd.choice(few) for _ in range(n))
    docs = [(i, ("Q" if i % 7 == 0 else "") + text(rnd.choice([0, 3, 40, 200])) + rnd.choice(["", " ZZ ", passage])) for i in range(90)]
    docs += [(1, "a A b a"), (1, "a A b a"), (1, "other"), (None, "zz"), (None, None), (3, ""), (900, text(30_000) + passage)]
    return docs, long, short


@pytest.mark.parametrize("most", [decontam.BROADCAST, 1])
def test_hits_are_those_of_the_plain_version(spark, most):
    docs, long, short = tables(2)
    got = rows_of(spark, docs, long + short, most=most)
    assert got == plain(docs, long + short)
    assert sum(r[5] for r in got) > 20


def test_items_of_ten_words_and_more_alone(spark):
    docs, long, _ = tables(5)
    assert rows_of(spark, docs, long) == plain(docs, long)


def test_every_window_keeps_the_least_of_its_grams(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcdef") for _ in range(n)) for n in (0, 9, 10, 11, 60)]
    df = spark.createDataFrame(enumerate(texts), TEXT).select("id", decontam.words(F.col("text")).alias("words"))
    grams = decontam.with_grams(df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))), "h", decontam.GRAM, "grams").collect()
    prints = {r["id"]: r["prints"] for r in decontam.fingerprints(df, [decontam.WINDOW]).collect()}
    for r in grams:
        n, of = len(r["words"]), r["grams"]
        assert len(set(of[: max(0, n - 4)])) == len({tuple(r["words"][k : k + 5]) for k in range(n - 4)})
        assert prints[r["id"]] == [min(of[k : k + 6]) for k in range(n - 9)]


def test_empty_tables(spark):
    docs, long, _ = tables(2)
    assert rows_of(spark, [], []) == []
    assert rows_of(spark, docs, []) == plain(docs, [])
    assert rows_of(spark, [], long) == []
