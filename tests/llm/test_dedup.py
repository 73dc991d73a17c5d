"""Exact dedup, line dedup and SimHash against plain versions on small tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from relaynote.llm import common, exact_dedup, line_dedup, simhash

DOCS = "doc_id long, text string, lang string, source string, digest string, size int"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, "x", 1) for d, t, s in rows], DOCS)


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_exact_dedup_groups_like_a_dictionary(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["A b", "a B", "Ä b", "ä b", "", None, "x" * 50_000, f"own {i % 40}"]), "s") for i in range(300)]
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[lower(t)].append(d)
    want = sorted((d, max(g), len(g), d == max(g)) for g in groups.values() for d in g)
    got = exact_dedup.exact_dedup(table(spark, rows))
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept") == sorted(want, key=repr)


def test_exact_dedup_survives_equal_digests(spark):
    rows = [(1, "a", "s"), (2, "A", "s"), (3, "b", "s"), (4, "b", "s"), (5, "c", "s"), (6, "a", "s")]
    got = exact_dedup.exact_dedup(table(spark, rows), digest=F.lit("same"))
    assert rows_of(got, "doc_id", "keep_id", "group_size") == [(1, 6, 3), (2, 6, 3), (3, 4, 2), (4, 4, 2), (5, 5, 1), (6, 6, 3)]


def test_compaction_reads_only_what_the_filters_let_pass(spark):
    rows = [(run, f"d{k}", 100 * run + k) for run in range(7) for k in range(300 * run, 300 * run + 310)] + [(3, "hot", 9_000 + k) for k in range(50)]
    runs = spark.createDataFrame(rows, "run int, digest string, doc_id long")
    filters = exact_dedup.run_filters(runs)
    assert {r["run"] for r in filters.collect()} == set(range(7))
    read = exact_dedup.contested(runs, filters)
    groups = defaultdict(list)
    for _, digest, d in rows:
        groups[digest].append(d)
    twice = {k for k, g in groups.items() if len(g) > 1}
    got = Counter(r["digest"] for r in read.collect())
    assert twice <= set(got) and len(set(got) - twice) <= 5  # of 2020 digests that occur once
    assert all(got[k] == len(groups[k]) for k in twice)
    for fanout in (2, 16):
        level = {r["digest"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.compacted(read, fanout).collect()}
        assert {k: v for k, v in level.items() if k in twice} == {k: (max(groups[k]), len(groups[k])) for k in twice}
    assert exact_dedup.compacted(read.limit(0)).count() == 0


def test_exact_dedup_nulls_repeats_and_no_rows(spark):
    rows = [(None, "a", "s"), (3, "a", "s"), (3, "a", "s"), (None, "b", None), (None, "b", "s")]
    got = exact_dedup.exact_dedup(table(spark, rows))
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept") == sorted([(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, None, 2, True), (None, None, 2, True)], key=repr)
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_spread_lines_go_and_copies_stay_whole(spark):
    own = [f"line {i} of its own, long enough to matter" for i in range(30)]
    rows = [(i, f"{own[i]}\nshared by all\n\nend {i}", f"s{i % 12}") for i in range(24)]
    rows += [(100 + i, "shared by all\nshared by all", f"s{i}") for i in range(3)]
    rows += [(200, None, "s1"), (201, "", None), (202, "shared by all\nlonger than the shared line", None)]
    rows += [(300 + i, f"{own[i]} again\nheld by nine", f"s{i}") for i in range(9)]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert got[3] == (f"{own[3]}\n\nend 3", 4, 1)
    assert got[100] == ("shared by all\nshared by all", 2, 0)
    assert got[200] == (None, 0, 0) and got[201] == ("", 1, 0)
    assert got[202] == ("longer than the shared line", 2, 1)
    assert got[304][0].endswith("held by nine")
    assert len(got) == len(rows)
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def test_pipeline_frees_short_pages_of_long_boilerplate(spark):
    long = "a line of boilerplate that is longer than all else on the page"
    rows = [(i, f"own {i}\n{long}\n\n{long}", f"s{i}") for i in range(12)] + [(100, f"{long}\n\n{long}", "s1"), (101, None, "s1")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_spread_lines(spark, table(spark, rows), "").collect()}
    assert got == {i: f"own {i}\n" for i in range(12)} | {100: f"{long}\n\n{long}", 101: None}


def test_near_threshold_lines_are_counted_exactly(spark):
    lines = spark.createDataFrame([(f"l{n}", f"s{k}") for n in range(1, 40) for k in range(n) for _ in range(3)], "line_hash string, site string")
    assert {r[0] for r in line_dedup.spread_lines(lines, 20).collect()} == {f"l{n}" for n in range(20, 40)}


def plain_fingerprint(text, words):
    w = lower(text).encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [b" ".join(w)]
    votes = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))


def plain_components(marks, bits):
    ids = list(marks)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (marks[a] ^ marks[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(0, 160, 4):
        base = [rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 5, 300]))]
        for k in range(4):
            t = list(base)
            if t and k > 1:
                t[rnd.randrange(len(t))] = "changed"
            rows.append((i + k, ("\t" if k == 1 else " ").join(t).upper() if k < 3 else " ".join(t), "s"))
    rows += [(900, None, "s"), (901, "", "s"), (902, "Ünïcode " * 4000, "s")]
    marks = {d: plain_fingerprint(t, 3) for d, t, _ in rows}
    roots = plain_components(marks, 2)
    got = simhash.simhash_components(table(spark, rows))
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == sorted([(d, f"{marks[d]:016x}", roots[d]) for d in marks], key=repr)
    assert simhash.simhash_components(table(spark, [])).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_anchors_lose_no_pair(spark, bits):
    rnd = random.Random(bits)
    base = [rnd.getrandbits(64) for _ in range(30)]
    marks = sorted({m ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5))) for m in base for _ in range(12)} | {0, 1, 3, (1 << 64) - 1})
    signed = np.array(marks, np.uint64).view(np.int64).tolist()
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for j, b in enumerate(signed[:i]) if (marks[i] ^ marks[j]).bit_count() <= bits}
    got = simhash.near_marks(spark.createDataFrame([(m,) for m in signed], "mark long"), bits)
    assert {(r["a"], r["b"]) for r in got.collect()} == want


def test_components_of_paths_and_stars(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5000), (7, 7)]
    rnd.shuffle(edges)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for part in (range(0, 301), range(1000, 1200), (5000, 5001)):
        assert len({got[i] for i in part}) == 1
    assert len(set(got.values())) == 3


@pytest.mark.parametrize("local", [0, 100, 1 << 18])
def test_components_are_the_same_by_rounds_and_in_one_task(spark, monkeypatch, local):
    monkeypatch.setattr(common, "LOCAL_EDGES", local)
    saves, save = [], common.save
    monkeypatch.setattr(common, "save", lambda df, label, **options: saves.append(label) or save(df, label, **options))
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(400)] + [(rnd.randrange(1000, 1600), rnd.randrange(1000, 1600)) for _ in range(250)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a != b:
            root[find(a)] = find(b)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(root)
    assert len({(got[n], find(n)) for n in got}) == len(set(got.values())) == len({find(n) for n in root})
    assert local < 1000 or len(saves) == 2  # small graphs need no rounds


def shingles(text, n=5):
    w = lower(text).encode().split()
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def test_near_dedup_keeps_one_of_each_group(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(60):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([30, 80, 250, 900]))]
        for k in range(4):
            t = list(base)
            for _ in range(k * len(t) // 150):
                t[rnd.randrange(len(t))] = "edit"
            rows.append((i * 10 + k, " ".join(t).title() if k == 1 else " ".join(t), "s"))
    rows += [(9000, None, "s"), (9001, "", "s"), (9002, "  ", "s"), (9003, "alone", "s"), (9003, "alone", "s"), (None, "alone", "s")]
    sets = {(d, t): shingles(t) for d, t, _ in rows}
    keys = sorted(sets, key=lambda x: (x[0] is None, x[0] or 0))
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            s, t = sets[a], sets[b]
            if s == t or len(s & t) >= 0.8 * len(s | t):
                x, y = sorted((find(a), find(b)), key=keys.index)
                root[y] = x
    want = sorted((k[0] for k in keys if find(k) == k), key=repr)
    got = simhash.near_dedup(table(spark, rows))
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == want
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert simhash.near_dedup(table(spark, [])).count() == 0


def test_near_dedup_connects_a_hot_group_near_the_threshold(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [rnd.choice(vocabulary) for _ in range(300)]
    rows = []
    for i in range(250):
        t = list(base)
        for at in rnd.sample(range(300), 4):
            t[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(t), "s"))
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, s in enumerate(sets):
        for j in range(i):
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = [i for i in range(len(rows)) if find(i) == i]
    got = simhash.near_dedup(table(spark, rows))
    assert sorted(r["doc_id"] for r in got.collect()) == want


def test_columns_with_the_operators_own_names_stay(spark):
    names = ["row_key", "BODY", "least", "root", "number", "flag", "page", "bitmap", "cut", "row_doc", "stays", "_flag"]
    rows = [(1, "one text of a few words", "a"), (2, "One text of a few  words", "b"), (3, None, None), (4, "", "c"), (5, "x\ny", "a"), (5, "x\ny", "a")]
    docs = spark.createDataFrame([(d, t, s, *[f"{d}{n}" for n in names]) for d, t, s in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    got = simhash.near_dedup(docs)
    assert got.columns == docs.columns
    assert rows_of(got, "doc_id", *names) == sorted(((d, *[f"{d}{n}" for n in names]) for d in (1, 3, 5)), key=repr)
    got = line_dedup.line_dedup(docs, min_sites=3)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"] and got.count() == 6
    assert rows_of(got, "doc_id", *names) == rows_of(docs, "doc_id", *names)


def test_near_dedup_by_cosine_finds_planted_copies(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(120):
        base = [f"v{rnd.randrange(3000)}" for _ in range(rnd.choice([12, 40, 300, 1500]))]
        copy = list(base)
        for at in rnd.sample(range(len(base)), max(1, len(base) * 3 // 100)):
            copy[at] = "changed"
        rows += [(2 * i, " ".join(base), "s"), (2 * i + 1, " ".join(copy), "s")]
    near = lambda s, t: len(s & t) >= 0.8 * (len(s) * len(t)) ** 0.5
    want = {2 * i + 1 for i in range(120) if near(shingles(rows[2 * i][1]), shingles(rows[2 * i + 1][1]))}
    kept = {r["doc_id"] for r in simhash.near_dedup(table(spark, rows), measure="cosine").collect()}
    gone = {d for d, _, _ in rows} - kept
    assert gone <= want and len(gone) >= 0.97 * len(want) and len(want) > 40


def test_band_keys_meet_as_often_as_the_similarity_says():
    rnd = np.random.default_rng(3)
    met = 0
    for _ in range(400):
        n = int(rnd.choice([20, 100, 600, 5000]))
        common_part, own = rnd.integers(0, 1 << 63, n, np.uint64) * np.uint64(2), rnd.integers(0, 1 << 63, (2, n // 4), np.uint64) * np.uint64(2)
        x, y = (np.unique(np.concatenate([common_part, o])) for o in own)  # Jaccard similarity 2 / 3
        met += bool(set(simhash.band_keys(x)) & set(simhash.band_keys(y)))
    assert met >= 396


def test_sketches_agree_in_as_many_bins_as_the_similarity_says(spark):
    rnd, rows, alike = np.random.default_rng(4), [], []
    for n in [20, 60, 200, 3000] * 40:
        common_part, own = rnd.integers(0, 1 << 63, n, np.uint64) * np.uint64(2), rnd.integers(0, 1 << 63, (2, n // 4), np.uint64) * np.uint64(2)
        x, y = (simhash.small_sketch(np.unique(np.concatenate([common_part, o]))) for o in own)  # Jaccard similarity 2 / 3
        nibbles = lambda s: [int(v) >> k & 15 for v in s.view(np.uint64) for k in range(0, 64, 4)]
        alike.append(sum(a == b for a, b in zip(nibbles(x), nibbles(y))))
        rows.append((len(rows), n + n // 4, x.tolist(), y.tolist()))
    table = spark.createDataFrame(rows, "id long, n long, x array<long>, y array<long>")
    got = table.select("id", simhash.bins_alike(table.x, table.y).alias("same"), simhash._likely(0.8, "cosine")(table.n, table.n, table.x, table.y).alias("likely")).orderBy("id").collect()
    assert [r["same"] for r in got] == alike
    assert sum(r["likely"] for r in got) >= 0.97 * len(rows)


def test_near_dedup_makes_no_pairs_of_texts_whose_own_windows_are_too_many(spark, monkeypatch):
    rnd, places = random.Random(9), range(10, 290, 20)
    base = [f"v{rnd.randrange(4000)}" for _ in range(300)]
    rows = []
    for i in range(120):  # just below the threshold: all others have the other windows too
        t = list(base)
        for at in places:
            t[at] = f"own{i}x{at}"
        rows.append((i, " ".join(t), "s"))
    sets, compared, alike = [shingles(t) for _, t, _ in rows], [], simhash._alike
    assert 0.75 < len(sets[0] & sets[1]) / len(sets[0]) < 0.8

    def counted(candidates, *rest):
        compared.append(candidates.count())
        return alike(candidates, *rest)

    monkeypatch.setattr(simhash, "_alike", counted)
    assert simhash.near_dedup(table(spark, rows), measure="cosine").count() == 120
    assert sum(compared) < 10 * 120, compared  # those of the stars; there are 7140


def test_near_dedup_counts_windows_of_large_groups_only(spark, monkeypatch):
    rnd, rows, counted, met = random.Random(10), [], [], simhash._met
    for family in range(20):  # six texts each, near one another and below the threshold
        base = [f"v{rnd.randrange(4000)}" for _ in range(300)]
        for k in range(6):
            t = list(base)
            for at in range(10, 290, 18):
                t[at] = f"own{family}x{k}x{at}"
            rows.append((family * 10 + k, " ".join(t), "s"))

    def seen(windows):
        counted.append(windows.count())
        return met(windows)

    monkeypatch.setattr(simhash, "_met", seen)
    got = simhash.near_dedup(table(spark, rows), measure="cosine")
    assert got.count() == len(rows)
    assert counted and not sum(counted)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replicas_of_marks_are_not_broadcast(spark):
    marks = spark.createDataFrame([(k * 977,) for k in range(50)] + [(977 ^ 3,)], "mark long")
    pairs = simhash.near_marks(marks)
    assert "Broadcast" not in executed(pairs)
    assert (977, 977 ^ 3) in {tuple(r) for r in pairs.collect()}


def test_classes_of_marks_are_not_broadcast(spark):
    found = simhash.simhash_components(table(spark, [(1, "a b c d", "s"), (2, "a b c d", "s"), (3, "x y z", "s"), (4, None, "s")]))
    assert "Broadcast" not in executed(found)
    assert [(r["doc_id"], r["component_id"]) for r in found.orderBy("doc_id").collect()] == [(1, 1), (2, 1), (3, 3), (4, 4)]
