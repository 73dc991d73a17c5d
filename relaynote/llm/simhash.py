"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is two blocks of 32 bits. Fingerprints that differ in at most T bits differ in at most T // 2 in
one of the blocks. The anchors of a block are the words of a covering code of radius 1: the Hamming code of length 31,
with the 32nd bit free. Every block has a home anchor within distance 1; a fingerprint near in the block is within
1 + T // 2 of the same anchor. So each fingerprint is stored once at its home anchor and replicated to every anchor
within covering radius plus threshold, and replicas are compared with the homes per anchor.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WordHashes, bit_filter, components, filter_bits, flag_contained, forget, give_back, may_contain, save, unused

SEED = 42
#: Least hashes of a text, and bands that they make: texts of Jaccard similarity 0.64 share none in 3 of 1000 cases.
BINS, BANDS = 128, 32
#: Rows of a group that are compared with all others in the first round after the first star; eight times as many follow.
FIRST_CENTRES = 8
#: Rows of a group that is compared without counting its rows' windows first: it makes so many pairs a row at most.
SMALL_GROUP = 16
#: In the rounds after the first star pairs are made only of texts whose sketches agree in as many bins as similar texts
#: do, less so many standard deviations: 98 of 100 pairs just at the least Jaccard similarity that can do, nearly all above.
DEVIATIONS = 2.0


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of `words` words, repeats included. Fewer words make one shingle, none makes no shingle."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, "<u8")
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(w[i:] for i in range(words))) if len(w) >= words else [w]
    return np.fromiter((digest(join(s), SEED) for s in shingles), "<u8")


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes give zero."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text needs no more memory than this
        votes += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [simhash(shingle_hashes(t.as_py(), words)) for t in batch.column("text")]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "mark": pa.array(np.array(marks, np.uint64).view(np.int64))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, mark long")


def _syndrome(block: np.ndarray) -> np.ndarray:
    """XOR of the places (1 to 31) of the set bits: zero for the words of the Hamming code of length 31."""
    s = np.zeros(block.shape, np.int64)
    for place in range(1, 32):
        s ^= np.where(block >> np.uint64(place - 1) & np.uint64(1), place, 0)
    return s


def _flips(weight: int) -> list[tuple[int, int]]:
    """(mask, syndrome of the mask) of all masks over 32 bits with at most `weight` bits; bit 31 has no syndrome."""
    out = []
    for n in range(weight + 1):
        for places in combinations(range(1, 33), n):
            s = 0
            for p in places:
                s ^= p if p < 32 else 0
            out.append((sum(1 << (p - 1) for p in places), s))
    return out


def anchors(marks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the mark, anchor) of every anchor within `radius` of either block; an anchor has its block in bit 32."""
    index, found = [], []
    for b in (0, 1):
        block = marks >> np.uint64(32 * b) & np.uint64(0xFFFFFFFF)
        s = _syndrome(block)
        for mask, of in _flips(radius):
            at = np.nonzero(s == of)[0]
            index.append(at)
            found.append((block[at] ^ np.uint64(mask)) | np.uint64(b << 32))
    return np.concatenate(index), np.concatenate(found)


def home_anchors(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the mark, anchor): the nearest anchor of either block, which is within distance 1."""
    found = []
    for b in (0, 1):
        block = marks >> np.uint64(32 * b) & np.uint64(0xFFFFFFFF)
        s = _syndrome(block).astype(np.uint64)
        found.append(np.where(s > 0, block ^ (np.uint64(1) << (np.maximum(s, 1) - np.uint64(1))), block) | np.uint64(b << 32))
    return np.tile(np.arange(len(marks)), 2), np.concatenate(found)


def near_marks(marks: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs (a, b), a < b as signed longs, of the distinct fingerprints `mark` that differ in 1 to `bits` bits.

    A mark has tens of replicas, which Spark's estimate of a table's size does not count: left to it, they are broadcast.
    """
    reach = 1 + bits // 2

    def spread(home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = batch.column("mark").to_numpy(zero_copy_only=False).view(np.uint64)
                at, anchor = home_anchors(m) if home else anchors(m, reach)
                yield pa.record_batch({"anchor": pa.array(anchor.view(np.int64)), "a" if home else "b": pa.array(m[at].view(np.int64))})

        return run

    homes = marks.select("mark").mapInArrow(spread(True), "anchor long, a long")
    replicas = marks.select("mark").mapInArrow(spread(False), "anchor long, b long")
    close = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    pairs = homes.join(replicas.hint("merge"), "anchor").filter(close)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_components(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, links.

    Fingerprints of `words`-word shingles link at `bits` or fewer differing bits. component_id is the smallest doc_id
    that links reach. links counts the other distinct fingerprints linked directly. Null and empty texts have the
    fingerprint zero and are linked like any other. A null doc_id never names a component unless it has no other;
    repeated rows count as rows with an equal fingerprint. A bit that is set in just half of the hashes is 0. Very long
    texts are read whole, other columns ignored. An empty table gives an empty result.
    """
    rows = save(fingerprints(docs, words), "fingerprints")
    marks = save(rows.groupBy("mark").agg(F.min("doc_id").alias("least")), "marks")
    pairs = save(near_marks(marks, bits), "pairs")
    roots = components(pairs)
    named = roots.join(marks, roots["node"] == marks["mark"]).select("root", "mark", "least")
    least = named.groupBy("root").agg(F.min("least").alias("of_root"))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("mark")).groupBy("mark").agg(F.count("*").alias("links"))
    linked = named.join(least, "root").join(degree, "mark").select("mark", "of_root", "links")
    classes = save(marks.join(linked, "mark", "left").select("mark", F.coalesce("of_root", "least").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    return rows.join(classes.hint("merge"), "mark").select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id", "links")


# Near copies by the similarity of word shingles


def window_hashes(text: str | None, words: int, of: WordHashes) -> np.ndarray:
    """A hash of each window of `words` words, repeats included. Fewer words make one window, none makes none."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(of.__getitem__, found), np.uint64, len(found))
    n = max(len(h) - words + 1, 1)
    out = np.full(n, min(words, len(h)), np.uint64)
    for k in range(min(words, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


@cache
def _lenders() -> np.ndarray:
    """For each bin an order of all bins, in which an empty one looks for a filled one: the same for all texts."""
    order = np.random.default_rng(1)
    return np.array([order.permutation(BINS) for _ in range(BINS)])


def least_hashes(distinct: np.ndarray) -> np.ndarray:
    """The least of the text's sorted window hashes in each of BINS bins; none if the text has no window.

    One pass of min-wise hashing: the range of the hashes is cut into bins. An empty bin borrows from another.
    """
    if not len(distinct):
        return np.zeros(0, np.uint64)
    start = np.searchsorted(distinct, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
    filled = start < np.append(start[1:], len(distinct))
    least = distinct[np.minimum(start, len(distinct) - 1)]
    if not filled.all():
        empty = np.nonzero(~filled)[0]
        lenders = _lenders()[empty]
        least[empty] = least[lenders[np.arange(len(empty)), filled[lenders].argmax(axis=1)]]
    return least


def band_keys(distinct: np.ndarray) -> np.ndarray:
    """Keys of BANDS bands of the least hashes; texts of Jaccard similarity J share each with J ^ (BINS / BANDS)."""
    least = least_hashes(distinct)
    if not len(least):
        return np.zeros(0, np.int64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, -1).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def small_sketch(distinct: np.ndarray) -> np.ndarray:
    """Four bits of each bin's least hash, 16 bins in a long. Zeros if the text has no window."""
    least = least_hashes(distinct)
    if not len(least):
        return np.zeros(BINS // 16, np.int64)
    bits = (least ^ (least >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)
    return np.bitwise_or.reduce(bits.reshape(-1, 16) << np.arange(0, 64, 4, dtype=np.uint64), axis=1).view(np.int64)


def bins_alike(x: Column, y: Column) -> Column:
    """Bins in which two sketches agree."""
    out = F.lit(BINS)
    for i in range(BINS // 16):
        z = x[i].bitwiseXOR(y[i])
        for shift in (1, 2):  # the lowest bit of four is set if one of them is
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        out = out - F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    return out


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, body (a digest of the words, A-Z lower-cased), mark (SimHash), n (distinct windows), bands and sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        of = WordHashes()
        for batch in batches:
            body, mark, n, bands, sketch = [], [], [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                windows = window_hashes(text, words, of)
                distinct = np.unique(windows)
                body.append(hashlib.sha256(b" ".join(text.encode().lower().split())).digest()[:16])
                mark.append(simhash(windows))
                n.append(len(distinct))
                bands.append(band_keys(distinct))
                sketch.append(small_sketch(distinct))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "body": pa.array(body, pa.binary()), "mark": pa.array(np.array(mark, np.uint64).view(np.int64)), "n": pa.array(n, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": pa.array(sketch, pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, body binary, mark long, n long, bands array<long>, sketch array<long>")


def body_of(text: Column) -> Column:
    """The `body` of sketches() without Python."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+", " "))
    return F.unhex(F.substring(F.sha2(plain, 256), 1, 32))


def _groups(classes: DataFrame, bits: int) -> DataFrame:
    """(part, row_key, n): classes that meet, as they share a band or a SimHash or have SimHashes at `bits` or fewer bits."""
    marks = save(classes.groupBy("mark").agg(F.count("*").alias("rows")), "marks")
    near = near_marks(marks.select("mark"), bits).select(F.xxhash64("a", "b", F.lit(2)).alias("part"), F.explode(F.array("a", "b")).alias("mark"))
    same = marks.filter("rows > 1").select(F.xxhash64("mark", F.lit(1)).alias("part"), "mark")
    by_mark = near.unionByName(same).join(classes.select("mark", "row_key", "n"), "mark").select("part", "row_key", "n")
    by_band = classes.select(F.explode("bands").alias("part"), "row_key", "n")
    many = save(by_band.groupBy("part").agg(F.count("*").alias("rows")).filter("rows > 1").select("part"), "bands")
    count = filter_bits(many.count())
    by_band = may_contain(by_band, F.col("part"), bit_filter(many, "part", count), count).join(many, "part", "left_semi")
    groups = save(by_mark.unionByName(by_band), "groups")
    forget(marks, many)
    return groups


def _similar(similarity: float, measure: str):  # noqa: ANN202
    """Whether texts of n and m distinct windows, `both` of them common, are similar; the same of columns, with a margin."""
    if measure == "jaccard":
        return lambda n, m, both: both >= similarity * (n + m - both), lambda n, m, both: both >= (n + m - both) * similarity - 1e-6
    if measure == "cosine":
        return lambda n, m, both: both >= similarity * math.sqrt(n * m) - 1e-9, lambda n, m, both: both >= F.sqrt(n * m) * similarity - 1e-6
    raise ValueError(f"no such measure: {measure}")


def _likely(similarity: float, measure: str):  # noqa: ANN202
    """Whether texts of n and m distinct windows with sketches x and y agree in as many bins as similar ones do."""
    least = similarity if measure == "jaccard" else similarity**2  # Jaccard similarity, of any two sizes
    p = least + (1 - least) / 16

    def likely(n: Column, m: Column, x: Column, y: Column) -> Column:
        filled = 1 - F.exp(-F.greatest(F.least(n, m), F.lit(1)) / BINS)  # share of bins with a hash of their own
        return bins_alike(x, y) >= BINS * p - DEVIATIONS * F.sqrt(BINS * p * (1 - p) / filled)

    return likely


def _alike(candidates: DataFrame, texts: DataFrame, words: int, similarity: float, measure: str) -> DataFrame:
    """The candidates (a, b) whose texts have the similarity, by their exact sets of windows."""
    similar = _similar(similarity, measure)[0]

    @F.pandas_udf("boolean")
    def alike(left, right):  # noqa: ANN001, ANN202
        import pandas as pd

        give_back()
        seen, of, held = {}, WordHashes(), 0

        def windows(text: str) -> np.ndarray:
            nonlocal held
            if text not in seen:
                if len(seen) > 64 or held > 1 << 20:  # windows of the texts that are kept
                    seen.clear()
                    held = 0
                seen[text] = np.unique(window_hashes(text, words, of))
                held += len(seen[text])
            return seen[text]

        out = []
        for x, y in zip(left, right):
            s, t = windows(x), windows(y)
            out.append(bool(similar(len(s), len(t), len(np.intersect1d(s, t, assume_unique=True)))))
        return pd.Series(out, dtype=bool)

    one = candidates.join(texts.select(F.col("row_key").alias("b"), F.col("text").alias("right")), "b")
    two = one.join(texts.select(F.col("row_key").alias("a"), F.col("text").alias("left")), "a")
    return two.filter(alike("left", "right")).select("a", "b")


def _windows(rows: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(row_key, root, window) of each distinct window of the texts of the rows (row_key, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        of = WordHashes()
        for batch in batches:
            for key, root, text in zip(batch.column("row_key"), batch.column("root"), batch.column("text")):
                windows = np.unique(window_hashes(text.as_py(), words, of))
                same = lambda x: pa.array(np.full(len(windows), x.as_py(), np.int64))
                yield pa.record_batch({"row_key": same(key), "root": same(root), "window": pa.array(windows.view(np.int64))})

    return texts.join(rows, "row_key").select("row_key", "root", "text").mapInArrow(run, "row_key long, root long, window long")


def _met(windows: DataFrame) -> DataFrame:
    """(row_key, met): how many windows of each row (row_key, root, window) also occur in a row of another component.

    No text of another component has more of the row's windows, so a row that has met too few of them needs no pairs.
    """
    shared = windows.groupBy("window").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("window")
    return windows.join(shared, "window", "left_semi").groupBy("row_key").agg(F.count("*").alias("met"))


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """roots (node, root) of the components after further links (a, b): only ends in different components are looked at."""
    if roots is None:
        return components(links)
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = save(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).filter("a <> b"), "ends")
    joined = components(ends)
    new = joined.select("node").join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    step = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
    out = save(roots.unionByName(new).join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
    forget(roots, ends, joined)
    return out


def _roots(groups: DataFrame, texts: DataFrame, small: DataFrame, words: int, similarity: float, measure: str) -> DataFrame:
    """(node, root) of the components of all texts that meet in a group and are similar, directly or by a chain.

    First the rows of a group are compared with one of them, the first in an order that all groups share, so rows alike
    have the same one in most groups. Then, in rounds, some rows outside a group's largest component are compared with
    all its rows in other components, and are then done with. A group is left when it is one component or none of its
    rows remains; eight times as many rows are taken each time, so a group of n rows has log n rounds. No pair is
    compared twice, and in the rounds pairs are only made of texts whose sketches (small: row_key, sketch, bands) are near,
    and, in groups of over SMALL_GROUP rows, of which each has enough windows that occur in other components of such groups
    at all; a row that has too few for any is done with there. Two texts that share several bands make one pair, not one in each of their groups.
    """
    could, likely = _similar(similarity, measure)[1], _likely(similarity, measure)
    first = groups.groupBy("part").agg(F.min(F.struct(F.xxhash64("row_key"), F.col("row_key").alias("x"), F.col("n").alias("nx"))).alias("f"))
    stars = groups.join(first.select("part", "f.x", "f.nx"), "part")
    new = stars.filter((F.col("x") != F.col("row_key")) & could(F.col("n"), F.col("nx"), F.least("n", "nx")))
    groups = save(stars.filter("x <> row_key").select("part", "row_key", "n"), "groups")
    tested = roots = None
    most = FIRST_CENTRES
    for k in range(64):
        pairs = new.select(F.least("x", "row_key").alias("a"), F.greatest("x", "row_key").alias("b")).distinct()
        pairs = save(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = save(_alike(pairs, texts, words, similarity, measure), "links")
        if roots is None or not found.isEmpty():
            roots = _merged(roots, found)
        forget(found)
        named = roots.select(F.col("node").alias("row_key"), "root")
        members = groups.join(named, "row_key", "left").withColumn("root", F.coalesce("root", "row_key"))
        parts = members.groupBy("part", "root").agg(F.count("*").alias("size"))
        open_ = parts.groupBy("part").agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.sum("size").alias("all"), (F.sum("size") - F.max("size")).alias("outside")).filter("outside > 0")
        opened = save(members.join(open_, "part").withColumn("large", F.col("all") > SMALL_GROUP).drop("all"), "opened")
        windows = save(_windows(opened.filter("large").select("row_key", "root").distinct(), texts, words), "windows")
        # The least partner that a row can have is one whose windows are all in the row.
        enough = F.col("met") >= F.col("n") * (similarity if measure == "jaccard" else similarity**2) - 1e-6
        # One hash for all groups: groups with the same rows take the same ones.
        place = F.shiftrightunsigned(F.xxhash64("row_key", F.lit(k)), 33).cast("double") / float(1 << 31)
        met = opened.join(_met(windows), "row_key", "left").withColumn("met", F.when(F.col("large"), F.coalesce("met", F.lit(0))).otherwise(F.col("n")))
        met = met.filter(enough).withColumn("taken", (F.col("root") != F.col("main")) & (place * F.col("outside") < most))
        before, members = groups, save(met.join(small, "row_key"), "members")
        forget(before, opened, windows)
        if members.isEmpty():
            return roots
        centre = members.filter("taken").select("part", F.col("row_key").alias("x"), F.col("root").alias("of"), F.col("n").alias("nx"), F.col("sketch").alias("sx"), F.col("bands").alias("bx"), F.col("met").alias("mx"))
        meets = (F.col("root") != F.col("of")) & could(F.col("n"), F.col("nx"), F.least("met", "mx", "n", "nx")) & likely(F.col("n"), F.col("nx"), F.col("sketch"), F.col("sx"))
        # Texts that share several bands make a pair in the group of the least one only. Each group is carried on to its
        # end, so the pair is made there, in this round or a later one.
        meets = meets & (~F.array_contains("bands", F.col("part")) | (F.array_min(F.array_intersect("bands", "bx")) == F.col("part")))
        new = members.join(centre, "part").filter(meets)
        groups = save(members.filter("not taken").select("part", "row_key", "n"), "groups")
        most *= 8
    raise RuntimeError("groups of similar texts are not done")


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 3, measure: str = "jaccard") -> DataFrame:
    """The rows of docs, all columns, of which one of each group of exact and near copies stays: the smallest doc_id.

    Texts with the same words in the same order, A-Z lower-cased, are copies; so are texts whose sets of windows of
    `words` words have the similarity, directly or by a chain. measure is "jaccard" or "cosine", which is what a SimHash
    estimates. Texts are compared that meet: their SimHashes differ in at most `bits` bits (anchors), or they share a
    band of least hashes, as most texts of such a similarity do. Every link is decided by the exact sets. Null and empty
    texts are copies of each other. Among rows that repeat doc_id and text one stays. A null doc_id goes last. A very
    long text is one row like any other. An empty table gives an empty result. Columns of docs may have any names.
    """
    rows = save(sketches(docs, words), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    classes = rows.groupBy("body").agg(F.min(order).alias("least"), F.count("*").alias("copies"), F.first("mark").alias("mark"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # A class is named by a number that follows from its text, so reruns agree.
    classes = save(classes.withColumn("row_key", F.xxhash64("body")), "classes")
    groups = _groups(classes, bits)

    # The texts of classes that meet others, each by the row of its least doc_id.
    number = lambda c: F.coalesce(c, F.lit(-1))
    wanted = save(groups.select("row_key").distinct().join(classes.select("row_key", "body", number(F.col("least.id")).alias("number")), "row_key"), "wanted")
    size = filter_bits(wanted.count())
    some = docs.select(number(F.col("doc_id").cast("long")).alias("number"), F.coalesce("text", F.lit("")).alias("text"))
    some = may_contain(some, F.col("number"), bit_filter(wanted, "number", size), size).withColumn("body", body_of(F.col("text")))
    texts = save(some.join(wanted, ["number", "body"]).dropDuplicates(["row_key"]).select("row_key", "text"), "texts")
    small = save(classes.join(wanted.select("row_key"), "row_key", "left_semi").select("row_key", "sketch", "bands"), "sketch")
    roots = _roots(groups, texts, small, words, similarity, measure)
    grouped = classes.select("row_key", "least").join(roots.withColumnRenamed("node", "row_key"), "row_key")
    best = grouped.groupBy("root").agg(F.min("least").alias("best"))
    dropped = save(grouped.join(best, "root").filter("least > best").select("row_key", F.lit(True).alias("dropped")), "dropped")

    # Only rows of doc_ids with a row that goes or repeats are looked at again.
    marked = classes.select("row_key", "body", "least", "copies").join(dropped, "row_key", "left").filter("dropped or copies > 1")
    judged = rows.select("doc_id", "body").join(marked, "body").select(number(F.col("doc_id")).alias("number"), "body", ((order == F.col("least")) & F.col("dropped").isNull()).alias("stays"))
    judged = save(judged.groupBy("number", "body").agg(F.max("stays").alias("stays")), "judged")
    forget(rows, classes, groups, wanted, texts, small, roots, dropped)
    size = filter_bits(judged.count())
    own, flag, body, stays = unused(docs, "number", "flag", "body", "stays")
    flagged = flag_contained(docs.withColumn(own, number(F.col("doc_id").cast("long"))), F.col(own), bit_filter(judged, "number", size), flag, size)
    again = flagged.filter(F.col(flag)).withColumn(body, body_of(F.col("text"))).join(judged.withColumnsRenamed({"number": own, "body": body, "stays": stays}), [own, body], "left")
    again = again.filter(F.coalesce(F.col(stays), F.lit(True))).dropDuplicates([own, body])
    return flagged.filter(~F.col(flag)).select(*docs.columns).unionByName(again.select(*docs.columns))
