"""Antecedents by shared tokens: the prefix filter against all pairs, and how many candidates it makes."""

import random
import re

from pyspark.sql import functions as F

from relaynote.functions import text as T
from relaynote.operators import assemble


def plain(rows, asked, overlap, most):
    """The latest earlier sentence of the job that shares enough tokens, by looking at all."""
    sets = {(j, i): set(re.findall(r"\w+", t.lower())) for j, i, t in rows}
    out = {}
    for job, at in asked:
        own = sets[job, at]
        needed = max(1, min(most, int(overlap * len(own))))
        found = [i for (j, i), s in sets.items() if j == job and i < at and len(s & own) >= needed]
        if own and found:
            out[job, at] = max(found)
    return out


def sentences(seed, n, jobs=1, most=24):
    """Sentences of words as common as words are: the k-th in proportion to 1 / k."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(1, 3000)]
    weights = [1 / k for k in range(1, 3000)]
    return [(j, i, " ".join(rnd.choices(words, weights, k=rnd.randrange(0, most)))) for j in range(jobs) for i in range(n)]


def frames(spark, rows, asked):
    return spark.createDataFrame(rows, "job_id long, sent_idx int, text string"), spark.createDataFrame(asked, "job_id long, from_idx int")


def test_the_latest_overlap_is_that_of_all_pairs(spark):
    rows = sentences(1, 120, 3)
    asked = [(j, i) for j, i, _ in rows if i % 3 == 0]
    for overlap, most in ((0.3, 5), (0.6, 20), (0.05, 5)):
        got = assemble.latest_overlap(*frames(spark, rows, asked), overlap, most).collect()
        assert {(r["job_id"], r["sent_idx"]): r["by_tokens"] for r in got} == plain(rows, asked, overlap, most)


def test_candidates_are_under_a_tenth_on_a_long_job(spark, monkeypatch):
    """A job of 10,000 sentences, of which 250 look for an antecedent by their tokens."""
    rows = sentences(2, 10_000)
    asked = [(0, i) for i in range(5, 10_000, 40)]
    marked, asks = frames(spark, rows, asked)
    made, candidates = [], assemble.overlap_candidates

    def counted(*args):
        out = candidates(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(assemble, "overlap_candidates", counted)
    got = {(r["job_id"], r["sent_idx"]): r["by_tokens"] for r in assemble.latest_overlap(marked, asks).collect()}
    assert got == plain(rows, asked, 0.3, 5)
    of = asks.join(marked.withColumnRenamed("sent_idx", "from_idx"), ["job_id", "from_idx"]).select("job_id", "from_idx", F.explode(F.array_distinct(T.tokens("text"))).alias("token"))
    before = of.join(assemble.token_postings(marked), ["job_id", "token"]).filter("sent_idx < from_idx").count()
    assert 0 < sum(made) * 10 < before, (made, before)


def test_no_sentences(spark):
    assert assemble.latest_overlap(*frames(spark, [], [])).collect() == []
