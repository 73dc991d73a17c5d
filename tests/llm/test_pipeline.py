"""The pipeline on a small folder of tables with planted cases, each stage against a plain version."""

import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from relaynote.llm import mixing, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, cut string"


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def planted(rnd):
    words, bad = [f"word{i}" for i in range(900)], ["vilewort", "grubblob", "smerkan"]
    line = "all rights of this page are reserved by its owners"
    docs, labels = [], []
    for i in range(240):
        body = [rnd.choice(words) for _ in range(rnd.choice([30, 60, 120]))]
        toxic = i % 5 == 0
        for _ in range(8 if toxic else 0):
            body.insert(rnd.randrange(len(body)), f"you {rnd.choice(bad)}")
        text = " ".join(body) + (f"\n{line}" if i % 3 == 0 else "")
        docs.append((i, text, "en", f"s{i % 12}"))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[i][1].upper(), "en", "s1") for i in range(1, 40, 2)]  # copies
    for i in range(41, 80, 2):  # near copies: one word less at the end
        docs.append((1000 + i, docs[i][1].split("\n")[0].rsplit(" ", 1)[0], "en", "s2"))
    docs += [(2000, None, "en", None), (2001, "", "en", "s3"), (2002, docs[1][1], "en", "s1"), (2002, docs[1][1], "en", "s1"), (None, "one text without a number", "en", "s4")]
    return docs, labels, line


def test_stages_do_what_they_say(spark, tmp_path):
    docs, labels, line = planted(random.Random(21))
    rows = [(d, t, lang, s, len(t or ""), 0.5, "own") for d, t, lang, s in docs]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash_near_dedup", "mix_sources", "packing"]
    keep = lambda name, df: corpus_pipeline.save(stages[name](spark, df, str(tmp_path)), name)

    one = keep("toxicity", table)
    assert one.columns == table.columns
    said = {(r["doc_id"], r["text"]): r["predicted"] for r in toxicity.toxicity(table.select("doc_id", "text"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert Counter(map(tuple, one.collect())) == Counter(r for r in rows if said[r[0], r[1]] == 0)
    clean = {d for d, _, _, _ in docs if d is None or d >= 2000 or d % 5}
    assert len({r["doc_id"] for r in one.collect()} & {d for d in range(0, 240, 5)}) <= 5 and len({r["doc_id"] for r in one.collect()} & clean) >= 0.97 * len(clean)

    two = keep("line_dedup", one)
    before, after = {(r["doc_id"], r["text"]) for r in one.collect()}, Counter((r["doc_id"], r["text"]) for r in two.collect())
    sites = {s for d, t, _, s in docs if t and (d, t) in before and line in t.split("\n")}
    want = Counter((r["doc_id"], r["text"].replace(f"\n{line}", "") if r["text"] and len(sites) >= 10 else r["text"]) for r in one.collect())
    assert after == want and two.columns == table.columns

    three = keep("simhash_near_dedup", two)
    left = sorted({(r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in two.collect()})
    sets, root = [shingles(t) for _, _, t in left], list(range(len(left)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(left)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if left[i][2].lower().split() == left[j][2].lower().split() or both and both >= 0.8 * (len(sets[i]) * len(sets[j])) ** 0.5:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    stays = sorted(None if none else d for k, (none, d, _) in enumerate(left) if find(k) == k and not none)
    assert sorted(r["doc_id"] for r in three.collect() if r["doc_id"] is not None) == stays and three.columns == table.columns

    four = keep("mix_sources", three)
    passes = Counter()
    for r in mixing.mix(three).collect():
        passes[r["doc_id"], r["source"]] += r["passes"]
    assert Counter((r["doc_id"], r["source"]) for r in four.collect()) == +passes and four.columns == table.columns

    five = stages["packing"](spark, four, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    pieces = Counter()
    for r in four.collect():
        data = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        for at in range(0, len(data), 4096):
            pieces[r["doc_id"], at, zlib.crc32(data[at : at + 4096].tobytes())] += 1
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in five) == pieces
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    digest = lambda rows: Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows)
    assert digest(whole) == digest(five)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_worker_gives_back_what_the_packing_kept(spark):
    """Workers are used by one stage after the other: the words that the packing keeps must not add to what the next one needs."""
    import weakref

    from relaynote.llm import packing, queries, simhash, toxicity

    class Plan:  # stands for a DataFrame, so that the task's function runs here
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            self.run = run
            return self

        def groupBy(self, *columns):  # noqa: N802
            return self

        def agg(self, *columns):
            return self

    for stage in (lambda p: simhash.sketches(p, 5), lambda p: simhash._windows(p, p, 5), toxicity.unit_counts):
        kept = weakref.ref(packing.load_tokenizer(queries.tokenizer_path()))
        assert packing.load_tokenizer(queries.tokenizer_path()) is kept()  # from task to task of the packing
        plan = Plan()
        plan.join = lambda *_: plan
        stage(plan)
        assert list(plan.run(iter([]))) == []
        assert kept() is None
