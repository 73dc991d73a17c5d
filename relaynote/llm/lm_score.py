"""Language-model scores of whole texts by a weighted backoff automaton, held as a distributed table.

All words and all n-grams that occur LEAST_COUNT times, at every size of the corpus, are in the automaton. A history is
a state: it has an arc for each such continuation, with its smoothed probability, and a failure arc to the shorter
history, with the backoff weight. The traversal of a text takes the arc of the longest history that has one, after the
failure arcs of the longer histories. So a text's score is a sum over its n-grams: each word brings its base
log-probability, each n-gram with an arc the difference to what the failure arc would give, and each n-gram that is a
state the weight of its failure arc. These values make one table, keyed by hashes of the n-grams, to which the n-grams
of the texts are joined. The most frequent n-grams are also broadcast, CACHED at most, so that fewer are shuffled; the
result is the same without. N-grams are shuffled in blocks: a row holds all those of a batch of texts whose keys begin
with the same bits, as arrays, so Spark deals and sorts few rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, give_back, save
from .packing import slices
from .toxicity import fold

ORDER = 3
#: n-grams of two words and more are arcs from this count on, whatever the share of the corpus.
GRAM_SHARE, LEAST_COUNT = 0.0, 2
DISCOUNT = 0.75
END = b""  # no word is empty
BEGIN = np.uint64(xxhash.xxh64_intdigest(b" "))  # no word holds a space
#: Bytes and rows of text whose n-grams are counted together before they leave a task; rows have 16-bit numbers there.
BLOCK_BYTES, BLOCK_ROWS = 5 << 19, 1 << 15
#: N-grams are dealt by the first bits of their keys. Values that are brought into one block.
PART_BITS, BLOCK_VALUES = 10, 500_000
#: Values that are broadcast, and bits of the filter of all n-grams that have one: fixed sizes.
CACHED, BITS, PAGE = 500_000, 1 << 27, 1 << 15
#: Parts of the documents that are looked up one after the other, so that the n-grams of one part only are shuffled at a time.
PASSES = 3
#: Documents whose sums a task holds.
HELD = 1 << 21
#: Words whose hashes a task keeps.
WORDS = 200_000


def tokens(text: str | None) -> list[bytes]:
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _rows(texts: pa.Array, of: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the tokens of all texts, each after the begin of its text, and how many each text has with its begin.

    Arrow splits the texts and finds their different words; only those are hashed.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # an empty word at an end that is white space
    words = split.flatten().dictionary_encode()
    hashes = np.fromiter(map(of.__getitem__, words.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(words.dictionary))
    found = hashes[words.indices.to_numpy()]
    some = found != np.uint64(of[END])
    before = np.concatenate(([0], np.cumsum(some)))
    offsets = split.offsets.to_numpy()
    n = np.diff(before[offsets - offsets[0]])
    sizes = n + 2
    last = np.cumsum(sizes) - 1
    out = np.empty(int(sizes.sum()), np.uint64)
    inner = np.ones(len(out), bool)
    out[last], out[last - n - 1] = np.uint64(of[END]), BEGIN
    inner[last] = inner[last - n - 1] = False
    out[inner] = found[some]
    return out, sizes


def _joined(hist: np.ndarray, tail: np.ndarray, size: np.ndarray | np.uint64) -> np.ndarray:
    """Keys of the n-grams of `size` words whose keys without the last and without the first word are given."""
    h = hist * np.uint64(0x9E3779B97F4A7C15) + tail + size
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _ngrams(row: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places of the last words, keys, keys without the last word, keys without the first) of each length of n-gram."""
    begin = row == BEGIN
    yield np.arange(len(row)), row, np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64)
    keys, valid = row, np.ones(len(row), bool)
    for n in range(2, order + 1):
        longer = np.zeros(len(row), np.uint64)
        longer[1:] = _joined(keys[:-1], keys[1:], np.uint64(n))
        now = np.zeros(len(row), bool)
        now[1:] = valid[:-1] & ~begin[1:]
        at = np.nonzero(now)[0]
        yield at, longer[at], keys[at - 1], keys[at]
        keys, valid = longer, now


def key_bits(keyed: DataFrame) -> np.ndarray:
    """A bitmap of BITS bits with one for each key, as bytes: a fixed size, whatever the number of keys."""
    slot = F.col("key").bitwiseAND(F.lit(BITS - 1))
    pages = keyed.groupBy(F.floor(slot / PAGE).alias("page")).agg(F.bitmap_construct_agg(slot % PAGE).alias("bits")).collect()  # BITS / 8 bytes
    bits = np.zeros((BITS // PAGE, PAGE // 8), np.uint8)
    for r in pages:
        bits[r["page"]] = np.frombuffer(r["bits"], np.uint8)[: PAGE // 8]
    return bits.reshape(-1)


def may_have(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the bit of each key, a signed long."""
    bit = key & (BITS - 1)
    return bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of parts of the values, which lie one after the other from 0 to each of the ends."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((np.append(0, ends) * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _parts(key: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Numbers and ends of the parts of sorted keys that begin with the same PART_BITS bits; none is empty."""
    first = key >> np.uint64(64 - PART_BITS)
    ends = np.append(np.nonzero(first[1:] != first[:-1])[0] + 1, len(key))[: len(key)]
    return pa.array(first[ends - 1].astype(np.int32)), ends


def _part_of(at: int) -> int:
    """A part for the documents of a batch of texts, whose sums go through the look-up as they are."""
    return hash((at,)) % (1 << PART_BITS)


def _whole(blocks: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blocks), kind)


def gram_counts(training: DataFrame, least: int, most: int, of_shorter: Broadcast[np.ndarray] | None = None) -> DataFrame:
    """key, hist, tail, size (words, `least` to `most`) and count n of all words, and of n-grams that occur LEAST_COUNT times.

    hist is the key without the last word, 0 for a word; tail that without the first, for a word its own. The begin of a text
    is a word of its own. With a bitmap of_shorter only n-grams whose hist and tail may be in it are counted. hist and tail name
    an n-gram, so only they are shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        of = _Hashes()
        for whole in batches:
            for batch in slices(whole, BLOCK_ROWS, BLOCK_BYTES):
                for size, (_, key, hist, tail) in enumerate(_ngrams(_rows(batch.column("text"), of)[0], most), 1):
                    if size < least:
                        continue
                    if of_shorter is not None:
                        may = may_have(of_shorter.value, hist.view(np.int64)) & may_have(of_shorter.value, tail.view(np.int64))
                        key, hist, tail = key[may], hist[may], tail[may]
                    key, at, n = np.unique(key, return_index=True, return_counts=True)
                    part, ends = _parts(key)
                    tails = tail[at] if size > 1 else key
                    yield pa.record_batch({"part": part, "size": pa.array(np.full(len(ends), size, np.int8)), "hist": _cut(hist[at], ends), "tail": _cut(tails, ends), "n": _cut(n.astype(np.uint32), ends)})

    def counted(size: int, blocks: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        hist, tail, n = (_whole(x, kind) for x, kind in zip(zip(*blocks), ("<u8", "<u8", "<u4")))
        key = _joined(hist, tail, np.uint64(size)) if size > 1 else tail
        order = np.argsort(key)
        key = key[order]
        start = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
        n = np.add.reduceat(n[order].astype(np.int64), start)
        often = (n >= LEAST_COUNT) | (size == 1)
        at, key = order[start[often]], key[start[often]]
        long = lambda x: pa.array(x.view(np.int64))
        return pa.record_batch({"key": long(key), "hist": long(hist[at]), "tail": long(tail[at]), "size": pa.array(np.full(len(key), size, np.int8)), "n": pa.array(n[often])})

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        now, blocks = None, []
        for batch in batches:
            for part, size, *block in zip(*(batch.column(c).to_pylist() for c in ("part", "size", "hist", "tail", "n"))):
                if now != (part, size):
                    if blocks:
                        yield counted(now[1], blocks)
                    now, blocks = (part, size), []
                blocks.append(block)
        if blocks:
            yield counted(now[1], blocks)

    found = training.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "part int, size byte, hist binary, tail binary, n binary")
    return found.repartition("part").sortWithinPartitions("part", "size").mapInArrow(reduced, "key long, hist long, tail long, size byte, n long")


def arcs_and_words(training: DataFrame, order: int) -> list[DataFrame]:
    """key, hist, tail, size and count n of all words, and of all n-grams up to `order` that occur LEAST_COUNT times.

    An n-gram occurs at most as often as its two shorter forms, so one whose forms are too rare is not counted at all.
    """
    out = [save(gram_counts(training, 1, min(2, order)), "grams")]
    for size in range(3, order + 1):
        shorter = training.sparkSession.sparkContext.broadcast(key_bits(out[-1].filter(F.col("size") == size - 1)))
        out.append(save(gram_counts(training, size, size, shorter), "grams"))
        shorter.destroy()
    return out


def places_in(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted keys among the sorted known ones, -1 where there is none."""
    if not len(known):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


def automaton(parts: list[DataFrame], total: int, kinds: int, order: int) -> DataFrame:
    """key, n, value, and for words base: what an n-gram adds to the score, and a word to the base score.

    parts, from arcs_and_words, are forgotten once they are used. As each occurrence of an n-gram is one of its history and of its
    shorter form, these are there too.
    """
    begin = F.col("key") == int(BEGIN.view(np.int64))
    p = F.when(~begin, F.log10(F.col("n") + 1.0) - math.log10(total + kinds + 1))
    levels, level = [], parts[0].filter("size = 1").select("key", "n", F.coalesce(p, F.lit(0.0)).alias("p"), F.coalesce(p, F.lit(0.0)).alias("delta"), p.alias("base"))
    out = None
    for size in range(2, order + 2):
        arcs = parts[min(size - 2, len(parts) - 1)].filter(F.col("size") == size)
        spent = arcs.groupBy("hist").agg(F.sum(F.col("n") - DISCOUNT).alias("spent")).withColumnRenamed("hist", "key")
        back = F.when(F.col("spent").isNull(), 0.0).otherwise(F.log10(F.greatest(1 - F.col("spent") / F.col("n"), F.lit(1e-12))))
        level = save(level.join(spent, "key", "left").withColumn("back", back).drop("spent"), "level")
        levels.append(level)
        if size > 2:
            forget(parts[size - 3])
        done = level.select("key", "n", (F.col("delta") + F.col("back")).alias("value"), "base")
        out = done if out is None else out.unionByName(done)
        histories = level.select(F.col("key").alias("hist"), F.col("n").alias("of"), "back")
        shorter = level.select(F.col("key").alias("tail"), F.col("p").alias("lower"))
        one = arcs.join(histories, "hist").join(shorter, "tail")
        low = F.col("back") + F.col("lower")
        p = F.log10((F.col("n") - DISCOUNT) / F.col("of") + F.pow(F.lit(10.0), low))
        level = one.select("key", "n", p.alias("p"), (p - low).alias("delta"), F.lit(None).cast("double").alias("base"))
    out = save(out, "automaton")
    forget(*parts, *levels)
    return out


def _step() -> Column:
    """Steps of the logarithm of a count: a few hundred at most."""
    return F.floor(F.log2("n") * 8)


def cached_from(table: DataFrame) -> int:
    """The least step of counts from which on at most CACHED rows have such a count."""
    steps = table.groupBy(_step().alias("step")).agg(F.count("*").alias("rows")).collect()
    have, least = 0, 1 << 20
    for r in sorted(steps, key=lambda r: -r["step"]):
        have += r["rows"]
        if have > CACHED:
            break
        least = r["step"]
    return least


def _value_blocks(table: DataFrame) -> DataFrame:
    """part, keys, values, bases: the table's values in blocks, by the keys' first bits."""

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        key, value, base = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]) for c in ("key", "value", "base"))
        key = key.view(np.uint64)
        order = np.argsort(key)
        part, ends = _parts(key[order])
        return pa.record_batch({"part": part, "keys": _cut(key[order], ends), "values": _cut(value[order].astype("<f8"), ends), "bases": _cut(base[order].astype("<f8"), ends)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, have = [], 0
        for batch in batches:
            some.append(batch)
            have += batch.num_rows
            if have >= BLOCK_VALUES:
                yield block(some)
                some, have = [], 0
        if have:
            yield block(some)

    return table.select("key", "value", "base").mapInArrow(run, "part int, keys binary, values binary, bases binary")


def _looked_up(blocks: DataFrame) -> DataFrame:
    """at, kind, docs, rows, own, base, known: sums of the values of the n-grams of each batch of texts.

    blocks: part, kind, at, docs, a, b, c. Kind 0 are keys, values and bases; kind 1 the keys of a batch, how many rows
    have each, and those rows; others are handed on. A task holds the values of one part, and sums of HELD documents.
    """

    def sums(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for at, (own, base, known) in held.items():
            rows = np.nonzero((own != 0) | (known != 0))[0]
            data = [rows.astype("<u2"), own[rows], base[rows], known[rows].astype("<u4")]
            yield pa.record_batch({"at": pa.array([at], pa.int64()), "kind": pa.array([1], pa.int8()), "docs": pa.array([len(own)], pa.int32()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("rows", "own", "base", "known"), data)}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        now, parts, ready, held, have = None, [], None, {}, 0
        for batch in batches:
            for part, kind, at, docs, a, b, c in zip(*(batch.column(x).to_pylist() for x in ("part", "kind", "at", "docs", "a", "b", "c"))):
                if part != now:
                    now, parts, ready = part, [], None
                if kind == 0:
                    parts.append((a, b, c))
                    continue
                if kind == 2:
                    yield pa.record_batch({"at": pa.array([at], pa.int64()), "kind": pa.array([0], pa.int8()), "docs": pa.array([docs], pa.int32()), "rows": pa.array([a], pa.binary()), **{x: pa.array([b""], pa.binary()) for x in ("own", "base", "known")}})
                    continue
                if not parts:
                    continue
                if ready is None:
                    keys, value, base = (_whole(x, t) for x, t in zip(zip(*parts), ("<u8", "<f8", "<f8")))
                    order = np.argsort(keys)
                    ready = keys[order], value[order], np.nan_to_num(base[order]), ~np.isnan(base[order])
                if at not in held:
                    if have > HELD:
                        yield from sums(held)
                        held, have = {}, 0
                    held[at] = np.zeros((3, docs))
                    have += docs
                there, times = places_in(ready[0], np.frombuffer(a, "<u8")), np.frombuffer(b, "<u4").astype(np.int64)
                row, there = np.frombuffer(c, "<u2"), np.repeat(there, times)
                row, there = row[there >= 0], there[there >= 0]
                for total, values in zip(held[at], ready[1:]):
                    np.add.at(total, row, values[there])
        yield from sums(held)

    return blocks.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(run, "at long, kind byte, docs int, rows binary, own binary, base binary, known binary")


def _summed(sums: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, known, base, own of each document, from the sums of its batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = docs = more = None

        def done() -> pa.RecordBatch:
            add = {c: pa.array(docs.column(c).to_numpy() + x.astype(docs.column(c).to_numpy().dtype)) for c, x in zip(("own", "base", "known"), more)}
            return pa.record_batch({c: add.get(c, docs.column(c)) for c in docs.schema.names})

        for batch in batches:
            for at, kind, n, rows, own, base, known in zip(*(batch.column(c).to_pylist() for c in ("at", "kind", "docs", "rows", "own", "base", "known"))):
                if kind == 0:
                    if docs is not None:
                        yield done()
                    now, docs, more = at, pa.ipc.open_stream(rows).read_next_batch(), np.zeros((3, n))
                    continue
                if at != now:
                    raise ValueError("sums without their documents")
                row = np.frombuffer(rows, "<u2")
                for total, data, t in zip(more, (own, base, known), ("<f8", "<f8", "<u4")):
                    total[row] += np.frombuffer(data, t)
        if docs is not None:
            yield done()

    return sums.repartition("at").sortWithinPartitions("at", "kind").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, base double, own double")


def score(docs: DataFrame, folds: int = 7, held_fold: int = 2, order: int = ORDER) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32(doc_id as text) mod folds is held_fold are held out, and so are rows without a doc_id; the others
    are the training corpus. A null text counts as empty: its only token is the end. Repeated rows count each. Without
    training rows every token has probability 1. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    held = F.coalesce(fold("doc_id", folds) == held_fold, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    training = rows.filter(~F.col("held_out"))
    parts = arcs_and_words(training, order)
    words = parts[0].filter((F.col("size") == 1) & (F.col("key") != int(BEGIN.view(np.int64))))
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, kinds = sums["n"], sums["v"]
    table = automaton(parts, total, kinds, order)
    least = cached_from(table)
    often = table.filter(_step() >= least).toPandas().sort_values("key")
    bits = key_bits(table)
    columns = [often[c].to_numpy(t) for c, t in (("key", np.int64), ("value", float), ("base", float))]
    shared = spark.sparkContext.broadcast((*columns, bits))
    del often, columns, bits
    give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back()
        keys, value, base, bits = shared.value
        is_word, base = ~np.isnan(base), np.nan_to_num(base)
        is_word = is_word.astype(float)
        at, of = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33, _Hashes()
        for whole in batches:
            for batch in slices(whole, BLOCK_ROWS, BLOCK_BYTES):
                tokens_, sizes = _rows(batch.column("text"), of)
                count = len(sizes)
                owner = np.repeat(np.arange(count, dtype=np.uint16), sizes)
                wanted = []
                for size, (place, key, hist, tail) in enumerate(_ngrams(tokens_, order), 1):
                    may = may_have(bits, key.view(np.int64))
                    if size > 1:  # an n-gram has a value only if both shorter ones have
                        may &= may_have(bits, hist.view(np.int64)) & may_have(bits, tail.view(np.int64))
                    wanted.append((key[may], owner[place[may]]))
                key, row = (np.concatenate(x) for x in zip(*wanted))
                order_ = np.argsort(key)
                key, row = key[order_], row[order_]
                start = np.nonzero(np.append(True, key[1:] != key[:-1])[: len(key)])[0]
                key, times = key[start], np.diff(np.append(start, len(row)))
                there = places_in(keys, key.view(np.int64))
                each = np.repeat(there, times)
                hit = each >= 0
                own, plain, known = (np.bincount(row[hit], x[each[hit]], count) for x in (value, base, is_word))
                docs_ = pa.record_batch({
                    "doc_id": batch.column("doc_id"),
                    "held_out": batch.column("held_out"),
                    "n_tokens": pa.array(sizes - 1, pa.int64()),
                    "known": pa.array(known.astype(np.int64)),
                    "base": pa.array(plain, pa.float64()),
                    "own": pa.array(own, pa.float64()),
                })
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, docs_.schema) as writer:
                    writer.write_batch(docs_)
                same = lambda x, n, t: pa.array(np.full(n, x, t))
                yield pa.record_batch({"part": same(_part_of(at), 1, np.int32), "kind": same(2, 1, np.int8), "at": same(at, 1, np.int64), "docs": same(count, 1, np.int32), "a": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "b": pa.array([b""], pa.binary()), "c": pa.array([b""], pa.binary())})
                key, times, row = key[there < 0], times[there < 0], row[~hit]
                part, ends = _parts(key)
                n = len(ends)
                yield pa.record_batch({"part": part, "kind": same(1, n, np.int8), "at": same(at, n, np.int64), "docs": same(count, n, np.int32), "a": _cut(key, ends), "b": _cut(times.astype("<u4"), ends), "c": _cut(row.astype("<u2"), np.cumsum(times)[ends - 1])})
                at += count

    known_blocks = save(_value_blocks(table.filter(_step() < least)), "values")
    forget(table)
    known = known_blocks.select("part", F.lit(0).cast("byte").alias("kind"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("docs"), F.col("keys").alias("a"), F.col("values").alias("b"), F.col("bases").alias("c"))
    done = []
    for k in range(PASSES):
        some = rows.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(PASSES)) == k)
        found = some.mapInArrow(run, "part int, kind byte, at long, docs int, a binary, b binary, c binary")
        done.append(save(_summed(_looked_up(known.unionByName(found))), "sums"))
    shared.destroy()
    forget(known_blocks)
    unseen = (F.col("n_tokens") - F.col("known")) * -math.log10(total + kinds + 1)
    return reduce(DataFrame.unionByName, done).select(
        "doc_id", "held_out", "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + unseen).alias("base_score"),
        (F.col("own") + unseen).alias("score"),
    )
