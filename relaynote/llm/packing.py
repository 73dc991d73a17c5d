"""Packing of tokenized documents into sequences by shortest-pack-first over the length histogram.

Documents longer than a sequence are cut into full sequences and a remainder. The histogram of remainders has a row for
each length up to the sequence length, whatever the number of documents. Lengths are placed longest first, always into
the packs that are shortest so far, by counts of packing patterns. Documents then meet the slots of the patterns by
their rank among the remainders of their length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, rank_within, save

SEQUENCE = 4096
END_ID = 2
SEED = 11
#: Bytes of words and their ids that a Python worker keeps, words and pre-tokens each.
CACHED_BYTES = 80 << 20
#: Pre-tokens that are encoded in one call.
JOINED = 512

# The tokenizer's own split into pre-tokens (after the line feed, which parts the words here), and words
# with other characters than those for which Python's and the tokenizer's normalisation and classes surely agree:
# visible ones below U+0180 but for soft hyphen and dotted capital I. Words that may hold a special token are among them.
# Of those characters, in lower case, the letters and the numbers are written out.
_LETTERS, _NUMBERS = r"A-Za-zªµºÀ-ÖØ-öø-ſ", r"0-9²³¹¼-¾"
_PRE_TOKENS = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\n{_LETTERS}{_NUMBERS}]+")
_ODD = re.compile(r"[^\n!-~¡-¬®-įı-ſ]|<\|")
_CUT = 0xFFFFFFFF  # no token


class _Kept(dict):
    """A cache that is emptied beyond CACHED_BYTES."""

    size = 0

    def full(self) -> bool:
        if self.size <= CACHED_BYTES:
            return False
        self.clear()
        self.size = 0
        return True


def _cut(ids: np.ndarray, before: np.ndarray) -> list[bytes]:
    """Parts of ids, as bytes, that begin at 0 and at `before`."""
    data, cuts = ids.astype("<u4").tobytes(), [0, *(before * 4).tolist(), 4 * len(ids)]
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


class _Runs:
    """Runs of ids one after the other, by their numbers; run 0 is empty."""

    def __init__(self) -> None:
        self.ids, self.ends, self.n, self.runs = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), 0, 1

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.n + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.runs + len(lengths) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.n : self.n + len(ids)] = ids
        self.ends[self.runs : self.runs + len(lengths)] = self.n + np.cumsum(lengths)
        self.n, self.runs = self.n + len(ids), self.runs + len(lengths)

    def joined(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the runs in a row, and the length of each."""
        start = self.ends[np.maximum(of - 1, 0)]
        lengths = self.ends[of] - start
        before = np.cumsum(lengths) - lengths
        return self.ids[np.repeat(start - before, lengths) + np.arange(lengths.sum())], lengths


class WordIds:
    """Ids of texts, as little-endian unsigned 32-bit integers, word by word.

    The tokenizer drops white space and treats what lies between by itself, so words are kept, and so are pre-tokens,
    for words that differ in case or punctuation only. A batch of texts is split, and its different words are found,
    by Arrow; only those are looked up one by one. New pre-tokens are encoded together: the last token of each ends
    in the suffix of word ends. Words with odd characters go whole to the tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.split = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.split.normalizer = normalizers.Sequence([])
        self.split.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = self.whole.model.end_of_word_suffix
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        for token, i in self.whole.get_vocab().items():
            self.ends[i] = token.endswith(suffix)
        self.words, self.pre_tokens, self.runs = _Kept({"": 0}), _Kept(), _Runs()

    def _encode(self, pre_tokens: list[str]) -> None:
        for at in range(0, len(pre_tokens), JOINED):
            some = pre_tokens[at : at + JOINED]
            ids = np.array(self.split.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            found = _cut(ids, np.nonzero(self.ends[ids[:-1]])[0] + 1)
            if len(found) != len(some):
                raise ValueError("the tokenizer does not end each pre-token with its suffix")
            self.pre_tokens.update(zip(some, found))
            self.pre_tokens.size += 150 * len(some) + sum(map(len, some)) + sum(map(len, found))  # with the objects' own size, about

    def _keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.words.update(zip(words, range(self.runs.runs, self.runs.runs + len(words))))
        self.words.size += 170 * len(words) + 2 * sum(map(len, words)) + 4 * len(ids)
        self.runs.add(ids, lengths)

    def _add(self, words: list[str]) -> None:
        joined = "\n".join(words)
        if _ODD.search(joined):
            odd = [w for w in words if _ODD.search(w)]
            for at in range(0, len(odd), JOINED):
                found = [e.ids for e in self.whole.encode_batch_fast(odd[at : at + JOINED], add_special_tokens=False)]
                self._keep(odd[at : at + JOINED], np.array([i for x in found for i in x], "<u4"), np.array([len(x) for x in found]))
            words = [w for w in words if w not in self.words]
            joined = "\n".join(words)
        if not words:
            return
        pre = _PRE_TOKENS.findall(joined.lower())
        self.pre_tokens.full()
        self.pre_tokens["\n"] = np.array([_CUT], "<u4").tobytes()
        self._encode([p for p in set(pre) if p not in self.pre_tokens])
        ids = np.frombuffer(b"".join(map(self.pre_tokens.__getitem__, pre)), "<u4")
        ends = np.append(np.nonzero(ids == _CUT)[0], len(ids))
        self._keep(words, ids[ids != _CUT], np.diff(ends, prepend=-1) - 1)

    def runs_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        if self.words.full():
            self.words[""], self.runs = 0, _Runs()
        split = pc.ascii_split_whitespace(texts)  # an empty word at an end that is white space
        words = split.flatten().dictionary_encode()
        known, n = words.dictionary, len(words.dictionary)
        kinds = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), known), "\n")[0].as_py().split("\n") if n else []
        if missing := [w for w in kinds if w not in self.words]:
            self._add(missing)
        number = np.fromiter(map(self.words.__getitem__, kinds), np.int64, n)
        ids, lengths = self.runs.joined(number[words.indices.to_numpy()] if n else np.zeros(0, np.int64))
        before = np.concatenate(([0], np.cumsum(lengths)))
        offsets = split.offsets.to_numpy()
        return ids, np.diff(before[offsets - offsets[0]])

    def of(self, texts: list[str]) -> Iterator[bytes]:
        ids, lengths = self.runs_of(pa.array(texts, pa.string()))
        for end, n in zip(np.cumsum(lengths), lengths):
            yield ids[end - n : end].tobytes()


def load_tokenizer(path: str) -> WordIds:
    """The tokenizer and its words, which a Python worker keeps from task to task."""
    return kept(f"tokenizer {path}", lambda: WordIds(path))


def slices(batch: pa.RecordBatch, rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of `rows` rows, and of about `most` bytes of text unless a single text is longer."""
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(sizes, before + most))))
        yield batch.slice(at, end - at)
        at = end


def pieces(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, and row, the hash of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, 2000, 6 << 20):
                doc, row, out = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), []
                ids, lengths = tokenizer.runs_of(batch.column("text"))
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                data, at = ids.data.cast("B"), 0
                for d, r, n in zip(doc, row, (lengths + 1).tolist()):
                    for start in range(0, n, sequence):
                        length = min(sequence, n - start)
                        out.append((d, r, start, length, zlib.crc32(data[4 * (at + start) : 4 * (at + start + length)]), n))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text", F.lit(SEED)).alias("row"))
    return rows.mapInArrow(run, "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_histogram(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (count, [(length, times), ...]) that hold every length of the histogram as often as it counts.

    by_room holds the open patterns by the room left; the patterns with most room, that is the shortest packs, are
    filled first. Only counts are updated, so the work follows from the number of lengths and patterns.
    """
    by_room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in by_room if r >= length), default=None)
            if room is None:
                # new packs, with as many of this length as fit
                times = sequence // length
                packs, last = divmod(left, times)
                for count, n in ((packs, times), (1, last)):
                    if count and n:
                        by_room.setdefault(sequence - n * length, []).append((count, ((length, n),)))
                break
            count, pattern = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            # Packs of a pattern are equally short, so all get one before any gets two.
            used = min(count, left)
            if used < count:
                by_room.setdefault(room, []).append((count - used, pattern))
            again = pattern[-1][0] == length
            grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if again else (*pattern, (length, 1))
            by_room.setdefault(room - length, []).append((used, grown))
            left -= used
    return [(count, list(pattern)) for room in sorted(by_room) for count, pattern in by_room[room]]


def slots_of(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, times in the pattern, first sequence, offset) of each run of slots of one length."""
    ranks, base, out = dict.fromkeys(histogram, 0), 0, []
    for count, pattern in pack_histogram(histogram, sequence):
        offset = 0
        for length, times in pattern:
            out.append((length, ranks[length], count * times, times, base, offset))
            ranks[length] += count * times
            offset += length * times
        base += count
    return out


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long).

    A document is its token ids and end_id; a null or empty text is end_id alone. Repeated rows are packed each. A
    null doc_id is packed like any other. Pieces of equal length are placed by a seeded hash of their rows, rows alike in any
    order; very long texts are cut to as many sequences as they fill. Other columns are ignored. An empty table gives an
    empty result.
    """
    spark: SparkSession = docs.sparkSession
    found = save(pieces(docs, tokenizer_path, sequence, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `sequence` rows at most
    slots = spark.createDataFrame(slots_of(histogram, sequence), "length long, first long, ranks long, times long, base long, at long")
    starts = slots.groupBy("length").agg(F.sum("ranks").alias("_n"), F.sort_array(F.collect_list(F.struct("first", "times", "base", "at"))).alias("runs"))
    # `sequence` lengths at most; their runs, too, follow from the lengths and not from the number of documents
    counted = found.join(F.broadcast(starts), "length")
    ranked = rank_within(counted.drop("runs"), ["length"], F.xxhash64("row", "start")).drop("_n")
    placed = ranked.join(F.broadcast(starts.drop("_n")), "length")
    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("_rank")), -1)
    placed = placed.withColumn("run", run).withColumn("in_run", F.col("_rank") - F.col("run.first"))
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("run.base") + F.floor(F.col("in_run") / F.col("run.times"))).alias("sequence_id"),
        (F.col("run.at") + F.col("in_run") % F.col("run.times") * F.col("length")).alias("offset"),
    )
