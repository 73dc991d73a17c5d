"""Nearest sections by blocks of matrix products against a plain version, ties and odd vectors too."""

import random

import numpy as np
import pytest

from relaynote.operators import chunks


def plain(vectors, known, k=3, accept=0.65):
    out = {}
    for i, v in vectors:
        best = []
        if v is not None and None not in v and known and len(v) == len(known[0][1]):
            a = np.array(v, float)
            score = lambda w: round(float(a @ w / (np.sqrt(a @ a) * np.sqrt(w @ w) + 1e-9)), 9)
            best = sorted((-score(np.array(w, float)), s) for s, w in known)[:k]
        out[i] = (best[0][1], -best[0][0], [s for d, s in best[1:] if -d > accept * 0.8], -best[0][0] < accept) if best else (None, None, [], True)
    return out


@pytest.mark.parametrize("block_bytes", [64 << 20, 600])
def test_top_three_among_many(spark, block_bytes):
    rnd = random.Random(1)
    make = lambda: [rnd.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]  # noqa: E731  few values: many ties
    known = [(s, make()) for s in range(80)] + [(900, [0.0] * 4)]
    vectors = [(i, make()) for i in range(200)] + [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [1.0]), (303, [0.0] * 4)]
    got = chunks.nearest_of_many(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), spark.createDataFrame(known, "section long, v array<double>"), block_bytes=block_bytes)
    found = {r["vec_id"]: (r["section"], r["confidence"], r["alternatives"], r["requires_review"]) for r in got.collect()}
    want = plain(vectors, known)
    assert set(found) == set(want)
    for i, (s, c, a, q) in want.items():
        assert found[i][0] == s and found[i][2:] == (a, q) and found[i][1] == pytest.approx(c), i


def test_no_sections(spark):
    got = chunks.nearest_of_many(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), spark.createDataFrame([], "section long, v array<double>")).first()
    assert got["section"] is None and got["requires_review"]


def test_tiles_and_blocks_have_the_rows_of_one_matrix(spark):
    """Passes run one after the other: no plan holds two Python stages with a block each."""
    vectors = spark.createDataFrame([(i, [float((i * 7 + d * 3) % 5) for d in range(4)]) for i in range(60)], "vec_id long, embedding array<double>")
    known = vectors.filter("vec_id % 2 = 0").selectExpr("vec_id as section", "embedding as v")
    whole = sorted(map(tuple, chunks.nearest_of_many(vectors, known).collect()))
    tiled = chunks.nearest_of_many(vectors, known, block_bytes=300, tile=3)
    assert tiled._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, tiled.collect())) == whole
