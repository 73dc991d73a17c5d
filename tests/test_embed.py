"""The embedding store: each different text is encoded once, a second run encodes nothing."""

from relaynote.operators.embed import EmbeddingStore


def model():
    """load and encode, made here so that workers need not import this module."""

    def load():
        return {"calls": 0}

    def encode(held, texts):
        held["calls"] += 1
        return [[float(len(t)), float(t.count("a"))] for t in texts]

    return load, encode


def test_a_second_run_encodes_nothing(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path), *model(), 4)
    rows = spark.createDataFrame([(i, f"text {'a' * (i % 5)}" if i % 7 else None) for i in range(60)], "id long, text string")
    assert store.add(rows) == 5  # of 51 rows with a text
    assert store.add(rows) == 0 and store.missing(rows).count() == 0
    more = rows.union(spark.createDataFrame([(90, "fresh"), (91, "fresh"), (92, "")], "id long, text string"))
    got = {r["id"]: (r["text"], r["vector"]) for r in store.embed(more).collect()}
    assert len(got) == 63 and all(v is None if t is None else v == [float(len(t)), float(t.count('a'))] for t, v in got.values())
    assert store.versions.read("vectors").count() == 7
    assert store.add(more) == 0


def test_another_store_object_goes_on_with_the_same_folder(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",)], "text string")
    assert EmbeddingStore(spark, str(tmp_path), *model(), 4).add(rows) == 2
    again = EmbeddingStore(spark, str(tmp_path), *model(), 4)
    assert again.add(spark.createDataFrame([("b",), ("c",)], "text string")) == 1
    assert again.add(spark.createDataFrame([], "text string")) == 0
    assert sorted(r["vector"] for r in again.versions.read("vectors").collect()) == [[1.0, 0.0], [1.0, 0.0], [1.0, 1.0]]
