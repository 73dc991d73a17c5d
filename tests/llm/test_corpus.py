"""Mixing, packing, language ID, toxicity, top-k, web archives and LM scoring against plain versions."""

import hashlib
import math
import random
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from relaynote.llm import langid, lm_score, mixing, packing, queries, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, size int, score double, start long, row string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, 1, 0.5, 7, "x") for d, t, lang, s in rows], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# Mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names if s not in capped}
        over = {s for s in share if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def test_mix_meets_targets_and_reruns_agree(spark):
    rnd = random.Random(3)
    sources = ["b", "a", "é", "z", "c", None, "tiny"]
    rows = [(i, " ".join(["w"] * rnd.choice([1, 2, 3, 7, 50, 51, 300])), "en", rnd.choice(sources[:6])) for i in range(600)]
    rows += [(1000, "one two", "en", "tiny"), (1001, None, "en", "b"), (1002, " \t\n", "en", "b"), (1003, "x " * 2_000, "en", "z"), (5, rows[5][1], "en", rows[5][3]), (None, "a b c", "en", "c")]
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    want = plain_targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = mixing.mix(table(spark, rows).repartition(3))
    assert rows_of(again, "doc_id", "size", "taken") == sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=repr)
    assert mixing.mix(table(spark, [])).count() == 0
    mixed = Counter((r["doc_id"], r["source"], r["text"]) for r in mixing.mixed_rows(table(spark, rows)).collect())
    text = {d: t for d, t, _, _ in rows}
    kept = Counter()
    for r in got:
        kept[r["doc_id"], r["source"], text[r["doc_id"]]] += r["taken"] // r["size"] if r["size"] else 0
    assert mixed == +kept


def test_mixed_rows_keeps_rows_alike_apart(spark):
    names = "doc_id long, text string, source string, mix_hash string, key string, row string, passes int, _n int, _rank int"
    rows = [(1, "same text", s, f"{s}{k}", "k", f"r{k}", k, 1, 2) for s in ("a", "b", None) for k in range(4)] + [(2, "other words here", "a", "x", "k", "r", 9, 1, 2)]
    docs = spark.createDataFrame(rows, names)
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    counts = Counter(tuple(r) for r in got.collect())
    planned = Counter()
    for r in mixing.mix(docs).collect():
        planned[r["doc_id"], r["source"]] += r["passes"]
    by = Counter()
    for r, n in counts.items():
        by[r[0], r[2]] += n
    assert by == +planned and set(counts) <= set(rows)
    for s in ("a", "b", None):  # rows alike are taken as often, or once more
        taken = [counts[r] for r in rows if r[0] == 1 and r[2] == s]
        assert max(taken) - min(taken) <= 1


def test_fit_is_as_near_as_brute_force():
    from itertools import product

    rnd = random.Random(9)
    for _ in range(200):
        lengths = sorted(rnd.sample(range(1, 60), rnd.randrange(1, 5)))
        counts = [rnd.randrange(1, 4) for _ in lengths]
        budget = rnd.uniform(0, sum(n * x for n, x in zip(counts, lengths)))
        take = mixing.fit(lengths, counts, budget)
        assert all(0 <= k <= n for k, n in zip(take, counts))
        off = abs(sum(k * x for k, x in zip(take, lengths)) - budget)
        best = min(abs(sum(k * x for k, x in zip(c, lengths)) - budget) for c in product(*(range(n + 1) for n in counts)))
        assert off <= best + 1e-9
        # beyond the room, too, the rest is fitted by the program, and by one document less or more
        small = mixing.fit(lengths, counts, budget, room=20)
        assert abs(sum(k * x for k, x in zip(small, lengths)) - budget) <= max(lengths) / 2 + 1
    assert mixing.fit([5, 7], [2, 1], 12.0) == [1, 1] and mixing.fit([100], [1], 90.0) == [1] and mixing.fit([10**6], [1], 4e5) == [0]
    # With short documents left over, the words come out exactly, however large the budget and the longest document.
    for budget in (10_000_001.0, 1_234_567_890.0):
        lengths, counts = [1, 3, 500, 70_001, 2_000_003], [50, 900, 90_000, 9_000, 1_000]
        assert sum(k * x for k, x in zip(mixing.fit(lengths, counts, budget), lengths)) == budget


# Packing


def test_histogram_packing_places_every_length():
    rnd = random.Random(4)
    for _ in range(40):
        histogram = Counter(rnd.randrange(1, 65) for _ in range(rnd.randrange(1, 300)))
        patterns = packing.pack_histogram(dict(histogram), 64)
        assert all(sum(length * n for length, n in p) <= 64 for _, p in patterns)
        placed = Counter()
        for count, p in patterns:
            for length, n in p:
                placed[length] += count * n
        assert placed == histogram


def test_pack_covers_every_token_once(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(5)
    words = ["Alpha", "beta's", "Übung", "naïve", "42x", "<|endoftext|>", "ﬀ", "é", " ", " z", "don't", "—", "日本語", "\x1c", "İ", "ΑΣ"]
    rows = [(i, rnd.choice([" ", "\n", "\t\r\n"]).join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 5, 40, 400]))), "en", "s") for i in range(80)]
    rows += [(100, None, "en", "s"), (101, "", "en", "s"), (102, "very long text " * 5000, "en", "s"), (7, rows[7][1], "en", "s"), (None, "no id", "en", "s")]
    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    ids = {(d, t): np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for d, t, _, _ in rows}
    want = Counter()
    for d, t, _, _ in rows:
        data = ids[d, t]
        for at in range(0, len(data), 512):
            part = data[at : at + 512]
            want[d, at, len(part), zlib.crc32(part.tobytes()), len(data)] += 1
    got = packing.pack(table(spark, rows), path, sequence=512).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert sorted(by) == list(range(len(by)))
    assert packing.pack(table(spark, []), path).count() == 0


def test_word_ids_are_those_of_whole_texts():
    tokenizer = packing.WordIds(queries.tokenizer_path())
    rnd = random.Random(12)
    odd = ["It's I'LL 's't '' x²³ 1234 a<|endoftext|>b <|startoftext|> <|x ñandú ÉCOLE İstanbul ǅ ΣΑΣ é 日本語", "a\xa0b a\x85b \x1cq ﬁ ſtraße ª º µ ŉ € — …“q” soft\xadhy \x00", "", " \n"]
    texts = odd + ["".join(rnd.choice("abÉñ'sS <|>.,!9½\t\x1f\u0301Ω") for _ in range(60)) for _ in range(300)]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.whole.encode_batch(texts, add_special_tokens=False)]
    assert list(tokenizer.of(texts)) == want
    tokenizer.words.size = tokenizer.pre_tokens.size = 1 << 40  # both caches are emptied
    assert list(tokenizer.of(texts)) == want and len(tokenizer.words) < 5000


def test_word_ids_look_up_each_word_of_a_batch_once():
    class Counted(packing._Kept):
        looked = 0

        def __getitem__(self, word):
            self.looked += 1
            return super().__getitem__(word)

    tokenizer = packing.WordIds(queries.tokenizer_path())
    tokenizer.words = Counted(tokenizer.words)
    texts = [" ñandú, the cat\x1f's  " * 300, "", "the cat\n" * 500, " "]
    got = list(tokenizer.of(texts))
    assert got == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.whole.encode_batch(texts, add_special_tokens=False)]
    assert 0 < tokenizer.words.looked <= 5
    assert list(tokenizer.of([])) == [] and list(tokenizer.of([""])) == [b""]


def test_packing_leaves_little_padding(spark):
    rnd = random.Random(13)
    docs = table(spark, [(i, "word " * int(rnd.paretovariate(0.9) * 10 % 3000), "en", "s") for i in range(400)])
    got = packing.pack(docs, queries.tokenizer_path(), sequence=512).collect()
    filled = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= math.ceil(filled / 512 * 1.02) + 1


# Language ID


def test_languages_are_told_apart(spark):
    rnd = random.Random(6)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "er", "ung", "ein"], "cc": ["я", "бо", "ве", "ти"]}
    rows = [(i, " ".join("".join(rnd.choice(syllables[lang]) for _ in range(3)) for _ in range(rnd.choice([3, 40]))), lang, "s") for i in range(300) for lang in [rnd.choice(list(syllables))]]
    odd = [(400, None, "aa", "s"), (401, "", "aa", "s"), (402, "12 !?", "aa", "s"), (403, "ka lo", None, "s"), (404, "Ka! " * 600_000, "aa", "s"), (405, "😀 𝔞", "aa", "s"), (None, "kalomi", "aa", "s")]
    got = {r["doc_id"]: r for r in langid.identify(table(spark, rows + odd)).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [(d, lang) for d, _, lang, _ in rows if got[d]["held_out"]]
    assert {d for d, _ in held} == {d for d, _, _, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(got[d]["lang_pred"] == lang for d, lang in held) >= 0.97 * len(held)
    assert [got[d]["lang_pred"] for d in (400, 401, 402, 403, 404, None)] == ["und", "und", "und", "aa", "aa", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(table(spark, [])).count() == 0
    assert [r["lang_pred"] for r in langid.identify(table(spark, [(2, "abc", None, "s")])).collect()] == ["und"]


def test_filters_hold_all_ngrams_of_each_language(spark):
    rnd = random.Random(16)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "яюэьыъщш"}
    rows = [(i, " ".join("".join(rnd.choice(letters[lang]) for _ in range(rnd.randrange(1, 9))) for _ in range(30)), lang, "s") for i, lang in enumerate(list(letters) * 40)]
    rows += rows[:20] + [(900, None, "aa", "s"), (901, "abcd", None, "s")]
    model = langid.learn(table(spark, rows))
    own = {lang: set(np.concatenate([langid.grams(langid.letter_codes(t)) for _, t, of, _ in rows if of == lang and t]).tolist()) for lang in letters}
    assert model.languages == sorted(own)
    for h in own.values():
        h = np.array(sorted(h), np.uint64)
        said = np.unpackbits(model.languages_of(h), axis=1, bitorder="little")
        for k, lang in enumerate(model.languages):
            there = np.array([x in own[lang] for x in h.tolist()])
            assert said[there, k].all()  # no n-gram is missed
            assert said[~there, k].mean() <= 0.01 if (~there).any() else True
    none = np.random.default_rng(1).integers(0, 1 << 63, 200_000, np.uint64)
    rates = np.unpackbits(model.languages_of(none), axis=1, bitorder="little")[:, :3].mean(axis=0)
    assert np.allclose(rates, model.false_rate, atol=2e-4)


def test_each_language_is_sampled(spark):
    rows = [(i, f"common {i}", "big", "s") for i in range(4000)] + [(i, "one text of many copies", "big", "s") for i in range(2000)] + [(i, f"rare {i}", "small", "s") for i in range(30)]
    got = Counter(r["lang"] for r in langid.sampled(table(spark, rows), 1000).collect())
    assert got["small"] == 30 and 500 <= got["big"] <= 1000


def test_copies_do_not_shrink_the_sample(spark):
    """A language of 301 texts, one of which 30,000 rows hold, is learned from all of them."""
    copies = spark.range(30_000).select(F.lit("held by many").alias("text"), F.lit("few").alias("lang"))
    own = spark.range(300).select(F.concat(F.lit("own "), F.col("id")).alias("text"), F.lit("few").alias("lang"))
    assert langid.sampled(copies.unionByName(own), 5000).count() == 301
    some = langid.sampled(copies.unionByName(own), 100).count()
    assert 60 <= some <= 100  # about the bound, whatever the copies


def test_ngrams_over_a_cut_are_there_once(monkeypatch):
    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice("abé  .\n日") for _ in range(rnd.randrange(80)))
        want = sorted(langid.grams(langid.letter_codes(text)).tolist())
        for size in (3, 7):
            monkeypatch.setattr(langid, "CHUNK", size)
            assert sorted(h for part in langid.text_grams(text) for h in part.tolist()) == want


# Toxicity


def test_a_label_of_few_texts_is_learned_beside_many_copies(spark):
    """40 toxic texts and 20,000 copies of a clean one, with a bound of 200: all 81 texts are in the sample."""
    few = [(i, f"vilewort you grubblob {i}" if i % 2 else f"fine words of calm {i}", i % 2) for i in range(80)]
    rows = spark.createDataFrame(few, "doc_id long, text string, toxic int")
    copies = spark.range(20_000).select(F.col("id"), F.lit("the same clean text").alias("text"), F.lit(0).alias("toxic")).withColumnRenamed("id", "doc_id")
    model = toxicity.fit_toxicity(rows.unionByName(copies), sample_rows=200)
    assert model.trees is not None
    docs = spark.createDataFrame([(1, "vilewort you grubblob again"), (2, "fine words of calm again"), (3, "the same clean text")], "doc_id long, text string")
    scores = {r["doc_id"]: r["_score"] for r in model.score(docs).collect()}
    assert scores[1] > 0.5 > scores[2] and scores[3] < 0.5


def test_features_are_what_they_say():
    of = toxicity.feature_function({"vile": 2.0, "grub~": 3.0})
    text = "You VILE grubblob! w0rd v*le, a.b you you far far far far far vile"
    got = dict(zip("words mean share hits kinds most near near_share capitals marks stops masked unmasked".split(), of(text)))
    lower_words = ["you", "vile", "grubblob", "w0rd", "v", "le", "a", "b", "you", "you", "far", "far", "far", "far", "far", "vile"]
    n, size = len(lower_words), len(text)
    assert got["words"] == pytest.approx(math.log1p(n)) and got["mean"] == pytest.approx((2 + 3 + 2) / n)
    assert got["share"] == pytest.approx(3 / n) and got["hits"] == pytest.approx(math.log1p(3)) and got["kinds"] == pytest.approx(math.log1p(2)) and got["most"] == 3
    assert got["near"] == pytest.approx(2 / n) and got["near_share"] == pytest.approx(2 / 3)
    assert got["capitals"] == pytest.approx(5 / size) and got["marks"] == pytest.approx(1 / size) and got["stops"] == pytest.approx(2 / size)
    assert got["masked"] == pytest.approx(3 / n) and got["unmasked"] == pytest.approx(0 / n)
    assert of("") == [0.0] * 13


def test_toxic_scores_do_not_depend_on_the_order_of_rows(spark):
    rnd = random.Random(17)
    docs = [(i, " ".join(rnd.choice(["vilewort", "you", *(f"w{k}" for k in range(60))]) for _ in range(30)), "en", "s") for i in range(200)]
    docs += [(1000 + i, docs[i][1], "en", "s") for i in range(60)]
    labels = [(d, 0, int("vilewort" in t) if d < 1000 else d % 2) for d, t, _, _ in docs]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = toxicity.toxicity(table(spark, docs).repartition(3, "doc_id"), marks)
    two = toxicity.toxicity(table(spark, docs[::-1]).repartition(5, "text"), marks.repartition(2))
    near = lambda df: sorted((r["doc_id"], round(r["score"], 6)) for r in df.collect())
    assert near(one) == near(two)


def test_toxic_texts_are_found(spark):
    rnd = random.Random(7)
    plain, bad = [f"word{i}" for i in range(300)], ["vilewort", "grubblob", "smerkan"]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [rnd.choice(plain) for _ in range(60)]
        for _ in range(5 if toxic else 0):
            words.insert(rnd.randrange(60), f"you {rnd.choice(bad)}{rnd.choice(['', 's', 'ed'])}")
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 0, int(toxic)))
    docs += [(1000, None, "en", "s"), (1001, "", "en", "s"), (None, "vilewort you grubblob", "en", "s"), (1002, "word1 " * 30_000, "en", "s"), (1, docs[1][1], "en", "s")]
    labels += [(2, 0, None), (99_999, 0, 1), (None, 0, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(table(spark, docs), marks).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert held and sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    empty = toxicity.toxicity(table(spark, []), marks)
    assert empty.count() == 0
    none = toxicity.toxicity(table(spark, docs[:3]), marks.limit(0)).collect()
    assert [r["predicted"] for r in none] == [0, 0, 0]


# Top-k search


def test_top_k_is_exact_with_ties_and_odd_vectors(spark):
    rnd = np.random.default_rng(8)
    rows = [(i, rnd.normal(size=6).astype("float32").tolist(), 0) for i in range(400)]
    rows += [(i, rows[3][1], 0) for i in range(400, 460)]  # many copies
    rows += [(460, None, 0), (461, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (462, [float("nan")] * 6, 0), (463, [float("inf")] * 6, 0), (464, [2.0, 1.0], 0), (500, [], 0), (None, rows[0][1], 0), (5, rows[5][1], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    good = [(d, [math.floor(1024 * float(x)) for x in v]) for d, v, _ in rows if d is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, asks in sorted((d, v) for d, v in good if d % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(asks, v)), d) for d, v in good if d != q)[:10]
        want += [(q, k + 1, d, -s) for k, (s, d) in enumerate(scored)]
    assert rows_of(topk.top_k(vectors), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert rows_of(topk.top_k(vectors, lists=4, block=2), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.top_k(vectors.limit(0)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0], 0)], vectors.schema)).count() == 0


def test_top_k_takes_every_row_where_rows_repeat(spark):
    rnd = np.random.default_rng(9)
    rows = [(i, rnd.normal(size=6).astype("float32").tolist()) for i in range(60)]
    good = {d: [math.floor(1024 * float(x)) for x in v] for d, v in rows}
    for some, copies in ((rows, 2), (rows, 12), (rows[:4], 3)):
        scored = sorted((-sum(a * b for a, b in zip(good[0], good[d])), d) for d, _ in some * copies if d)[:10]
        for parts in (1, 5):
            vectors = spark.createDataFrame(some * copies, "vec_id long, embedding array<float>").repartition(parts)
            assert rows_of(topk.top_k(vectors), "rank", "vec_id", "score") == sorted([(k + 1, d, -s) for k, (s, d) in enumerate(scored)], key=repr)


def test_cutoffs_save_products_and_lose_nothing():
    rnd = np.random.default_rng(10)
    centres = rnd.normal(size=(40, 32))
    x = np.floor(1024 * (centres[rnd.integers(0, 40, 6000)] + 0.3 * rnd.normal(size=(6000, 32)))).astype(np.int64)
    ids, own = np.arange(6000), np.arange(0, 6000, 100)
    gathered = topk.Search(own, x[own], 10, 4)
    gathered.first(ids[: topk.FIRST], ids[: topk.FIRST], x[: topk.FIRST])
    search = topk.Search(own, x[own], 10, 4, gathered.cut)
    for at in range(0, 6000, 1000):
        search.add(ids[at : at + 1000], ids[at : at + 1000], x[at : at + 1000])
    for i, q in enumerate(own):
        scores = x @ x[q]
        best = sorted((-int(scores[j]), j) for j in range(6000) if j != q)[:10]
        assert list(zip((-search.kept[i][2]).tolist(), search.kept[i][0].tolist())) == best
    assert gathered.products + search.products < 0.6 * x.size * len(own)


def test_large_components_do_not_wrap(spark):
    rows = [(0, [1e15, 1e15]), (1, [1e15, -1e15]), (2, [1e3, 1.0]), (3, [-1e30, 0.0]), (4, [3e3, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    v = {d: [min(max(math.floor(1024 * x), -(1 << 63)), (1 << 63) - 1) for x in e] for d, e in rows}
    want = sorted((-min(max(sum(a * b for a, b in zip(v[0], v[d])), -(1 << 63)), (1 << 63) - 1), d) for d in range(1, 5))
    assert rows_of(got, "rank", "vec_id", "score") == [(k + 1, d, -s) for k, (s, d) in enumerate(want)]


# Web archives

PAGES = "page_id long, url string, html string, payload string, key int"


def test_archives_come_back(spark):
    same, other = "é" * 600, "y" * 999
    rows = [(1, "http://a", same, "p", 0), (2, "http://b\r\nX: y", same, "p", 0), (3, None, other, "p", 0), (4, "u", other, "p", 0), (5, "u", None, "p", 0), (6, "u", "", "p", 0), (7, "u", "z" * 1000, "p", 0), (8, "u", "z" * 1000 + "\r\n\r\n", "p", 0), (9, "u", "WARC/1.1\r\n\r\n" * 200_000, "p", 0)]
    rows += [(2, "again", same, "p", 0), (None, "u", same, "p", 0)]
    want = []
    for page, _, html, _, _ in rows:
        data = (html or "").encode()
        keep = max(p for p, _, h, _, _ in rows if h == html and p is not None) if len(data) >= 1000 else None
        revisit = keep is not None and keep != page
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    columns = "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    pages = spark.createDataFrame(rows, PAGES)
    assert rows_of(warc.archive(pages), *columns) == sorted(want, key=repr)
    assert warc.archive(pages.limit(0)).count() == 0
    manifest = warc.write_packages(warc.with_references(pages), package_bytes=500)
    assert manifest.count() > 1
    read = warc.read_packages(manifest).collect()
    assert {(r["page_id"], r["payload"].decode()) for r in read if r["payload"] is not None} == {(p, h or "") for p, _, h, _, _ in rows if not (h == same and p != 2)}


@pytest.mark.parametrize("wide", [False, True])
def test_directory_of_plain_and_zip64_packages(tmp_path, wide, monkeypatch):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("one", b"1" * 300)
        with z.open(zipfile.ZipInfo(warc.ARCHIVE), "w", force_zip64=True) as f:
            f.write(b"2" * 500)
        z.comment = b"PK note"
    store, name = warc.open_store(str(path))
    with store.open_input_file(name) as file:
        members = warc.read_directory(file, file.size())
        assert set(members) == {"one", warc.ARCHIVE}
        for member, data in (("one", b"1" * 300), (warc.ARCHIVE, b"2" * 500)):
            file.seek(warc.member_start(file, members[member][0]))
            assert file.read(members[member][1]) == data


# LM scoring


def plain_model(training, order, kinds, total):
    counts = [Counter() for _ in range(order + 1)]
    for t in training:
        w = [None, *lm_score.tokens(t)]
        for n in range(1, order + 1):
            for i in range(len(w) - n + 1):
                counts[n][tuple(w[i : i + n])] += 1
    counts[1][None,] = len(training)
    least = max(lm_score.LEAST_COUNT, math.ceil(lm_score.GRAM_SHARE * total))
    kept = {g: c for n in range(2, order + 1) for g, c in counts[n].items() if c >= least}
    # an n-gram needs its history
    for n in range(3, order + 1):
        kept = {g: c for g, c in kept.items() if len(g) != n or g[:-1] in kept}
    states = defaultdict(dict)
    for g, c in kept.items():
        states[g[:-1]][g[-1]] = c

    def p(history, word):
        if not history:
            return (counts[1][word,] + 1) / (total + kinds + 1)
        if history not in states:
            return p(history[1:], word)
        all_of = counts[len(history)][history]
        lower = (1 - sum(c - lm_score.DISCOUNT for c in states[history].values()) / all_of) * p(history[1:], word)
        c = states[history].get(word)
        return lower + ((c - lm_score.DISCOUNT) / all_of if c else 0)

    return p, counts[1]


def test_automaton_scores_like_the_plain_model(spark):
    rnd = random.Random(10)
    rows = [(i, rnd.choice([" ", "\n"]).join(rnd.choice(["the", "The", "cat", "sat", "on", "mat", "É", "é", f"rare{rnd.randrange(40)}"]) for _ in range(rnd.randrange(12))), "en", "s") for i in range(200)]
    rows += [(300, None, "en", "s"), (301, "the cat sat " * 3000, "en", "s"), (5, rows[5][1], "en", "s"), (None, "the cat", "en", "s")]
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 == 2
    training = [t for d, t, _, _ in rows if not held(d)]
    total = sum(len(lm_score.tokens(t)) for t in training)
    kinds = len({w for t in training for w in lm_score.tokens(t)})
    p, unigrams = plain_model(training, 3, kinds, total)
    got = lm_score.score(table(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {d: t for d, t, _, _ in rows}
    for r in got:
        w = lm_score.tokens(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(r["doc_id"]), len(w), total)
        assert r["n_known"] == sum(unigrams[x,] > 0 for x in w)
        assert r["base_score"] == pytest.approx(sum(math.log10((unigrams[x,] + 1) / (total + kinds + 1)) for x in w))
        history, want = (None,), 0.0
        for x in w:
            want += math.log10(p(history, x))
            history = (*history, x)[-2:]
        if len(w) < 100:
            assert r["score"] == pytest.approx(want, rel=1e-9)
    # probabilities of all words and one unseen word add up to one
    words = [g[0] for g in unigrams if g[0] is not None]
    for history in ((), (b"the",), (b"the", b"cat"), (None,)):
        assert sum(p(history, x) for x in [*words, b"never seen"]) == pytest.approx(1)
    assert lm_score.score(table(spark, [])).count() == 0
    alone = lm_score.score(table(spark, [(d, "a", "en", "s") for d in range(40) if held(d)][:1])).collect()
    assert [(r["train_tokens"], r["score"]) for r in alone] == [(0, 0.0)]


@pytest.mark.parametrize("cached", [500_000, 2])
def test_rare_ngrams_count_in_a_large_corpus(spark, monkeypatch, cached):
    monkeypatch.setattr(lm_score, "CACHED", cached)
    own = [d for d in range(60) if zlib.crc32(str(d).encode()) % 7 != 2]
    rows = [(own[0], "a " * 2_200_000, "en", "s"), (own[1], "xx yy", "en", "s"), (own[2], "xx yy", "en", "s")]
    got = {r["doc_id"]: r for r in lm_score.score(table(spark, rows)).collect()}
    total, kinds = 2_200_007, 4  # with an end for each text
    base = [math.log10((n + 1) / (total + kinds + 1)) for n in (2, 2, 3)]
    d = lm_score.DISCOUNT
    # the begin has one arc that occurs twice; xx, yy and both longer histories have one continuation that occurs twice
    first = (2 - d) / 3 + (1 - (2 - d) / 3) * 10 ** base[0]
    arc, rest = (2 - d) / 2, 1 - (2 - d) / 2
    second, third = (arc + rest * (arc + rest * 10 ** b) for b in base[1:])
    assert got[own[1]]["base_score"] == pytest.approx(sum(base))
    assert got[own[1]]["score"] == pytest.approx(sum(map(math.log10, (first, second, third))))


def test_ngrams_are_shuffled_in_blocks(spark):
    """A row holds the n-grams of a batch of texts whose keys begin alike; before, each n-gram of a batch was a row."""
    rnd = random.Random(3)
    rows = [(i, " ".join(f"w{rnd.randrange(9000)}" for _ in range(600)), "en", "s") for i in range(100)]
    context, group = spark.sparkContext, f"blocks {rnd.random()}"
    context.setJobGroup(group, group)
    try:
        got = lm_score.gram_counts(table(spark, rows).coalesce(1), 1, 2).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    pairs = Counter(p for _, t, _, _ in rows for w in [lm_score.tokens(t)] for p in zip([None, *w], w))
    assert sorted(r["n"] for r in got if r["size"] == 2) == sorted(n for n in pairs.values() if n > 1)
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    assert 0 < sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) <= 2 << lm_score.PART_BITS < len(pairs)


def test_tokens_found_by_arrow():
    import numpy as np
    import pyarrow as pa

    texts = ["", " ", "a", "  A\x0bb\x0c\r\nC \t", "É é\xa0x\x1cy", "a  a", "\ta"]
    of = lm_score._Hashes()
    got, sizes = lm_score._rows(pa.array(["cut off", *texts])[1:], of)
    want = [[int(lm_score.BEGIN), *map(of.__getitem__, lm_score.tokens(t))] for t in texts]
    assert sizes.tolist() == list(map(len, want)) and np.array_equal(got, np.array(sum(want, []), np.uint64))
