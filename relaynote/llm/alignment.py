"""Alignment of two tokenizers by a sweep over the byte offsets at which their tokens end.

Every document gives end events of tokenizer A and of tokenizer B. Events are moved in blocks, a row for each side and
each BLOCK bytes of the document: a token's length follows from its id, so a block of ids holds the offsets of its
events. The rows of both sides are dealt by document and sorted by offset within partitions, and a state machine reads
them as a stream. Its state is the open group (the tokens since the last offset at which both sides ended), a running
digest and counts, whatever the document's length. Where both sides end, a group closes and its links are emitted.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, save

#: Bytes of a document whose end events make one row a side.
BLOCK = 1 << 20
#: Bytes of segments and their ids that a Python worker keeps.
CACHED_BYTES = 160 << 20
#: Texts whose segments are encoded together, in characters; segments that one call encodes; tokens that are swept together.
TOGETHER, JOINED, SWEPT = 4 << 20, 512, 1 << 20
#: Links of one group that are written out one by one; beyond, equal ids of the group are counted first.
WRITTEN = 1 << 16
#: Pairs of ids, with their counts, that are broadcast at once: 13 bytes each.
BROADCAST = 4 << 20

#: A segment ends where a space follows something other than white space: no token of either side goes over that place.
_CUT, _UNSAFE, _SPACE = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s "), "▁"


class Encoder:
    """Ids of both tokenizers, segment by segment. Each segment, a space and what follows, is encoded once and kept."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.ids_a: dict[str, bytes] = {}
        self.ids_b: dict[str, bytes] = {}
        self.unequal: set[str] = set()
        self.size = 0
        self.bytes_b = piece_bytes(self.b)
        self.lengths = byte_lengths(self.a, self.b)

    def _learn(self, keys: set[str]) -> None:
        if self.size > CACHED_BYTES:
            self.ids_a.clear()
            self.ids_b.clear()
            self.unequal.clear()
            self.size = 0
        keys = [k for k in keys if k not in self.ids_a]
        for k in keys:
            self.size += 350 + 8 * len(k)
        whole = [k for k in keys if k and not k[-1].isspace()]  # what follows these does not change them
        for at in range(0, len(whole), JOINED):
            some = whole[at : at + JOINED]
            if not self._learn_joined(some):
                self._learn_alone(some)
        self._learn_alone([k for k in keys if not k or k[-1].isspace()])

    def _learn_joined(self, keys: list[str]) -> bool:
        """Encode keys as one text, cut where they end. False, with nothing learned, if B does not make up that text."""
        text = f" {' '.join(keys)}"
        joined = text.encode()
        ends = np.cumsum([1 + len(k) for k in joined[1:].split(b" ")] if joined.count(b" ") == len(keys) else [1 + len(k.encode()) for k in keys])
        ids_a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        ids_b = self.b.encode(text[1:], num_threads=1)
        if b"".join(map(self.bytes_b.__getitem__, ids_b)) != joined:
            return False
        cuts = []
        for ids, lengths in zip((ids_a, np.array(ids_b, np.int64)), self.lengths):
            at = np.cumsum(lengths[ids])
            to = np.searchsorted(at, ends)
            if not np.array_equal(at[np.minimum(to, len(at) - 1)], ends):
                return False
            data, to = ids.astype("<u2").tobytes(), (2 * to + 2).tolist()
            cuts.append([data[i:j] for i, j in zip([0, *to], to)])
        self.ids_a.update(zip(keys, cuts[0]))
        self.ids_b.update(zip(keys, cuts[1]))
        return True

    def _learn_alone(self, keys: list[str]) -> None:
        found_a = [e.ids for e in self.a.encode_batch_fast([f" {k}" for k in keys], add_special_tokens=False)]
        found_b = self.b.encode(keys, num_threads=1)
        for key, a, b in zip(keys, found_a, found_b):
            b = b if key else [self.b.piece_to_id(_SPACE)]
            if _SPACE in key or b"".join(map(self.bytes_b.__getitem__, b)) != f" {key}".encode():
                self.unequal.add(key)
            self.ids_a[key], self.ids_b[key] = np.array(a, "<u2").tobytes(), np.array(b, "<u2").tobytes()

    def of(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of A and of B of each text, as unsigned 16-bit integers; none where joined tokens are not the text."""
        split = [([s[1:] for s in _CUT.split(f" {t}")] if t[0] == " " or _UNSAFE.search(t) else t.split(" ")) if t else [] for t in texts]
        at = 0
        while at < len(split):  # so many texts at a time as the cache bears
            new, end, size = set(), at, 0
            while end < len(split) and size < TOGETHER:
                new.update(split[end])
                size += len(texts[end])
                end += 1
            self._learn(new)
            for keys in split[at:end]:
                if self.unequal and not self.unequal.isdisjoint(keys):
                    yield b"", b""
                else:
                    yield b"".join(map(self.ids_a.__getitem__, keys)), b"".join(map(self.ids_b.__getitem__, keys))
            at = end


def piece_bytes(b) -> list[bytes]:
    """The bytes of each id of B: its piece, with U+2581 as a space and <0xHH> as a byte."""
    out = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace(_SPACE, " ").encode())
    return out


def byte_lengths(of_a, of_b) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each token of A (one for each character of its byte-level form) and of B."""
    vocabulary = of_a.get_vocab()
    a = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        a[i] = len(token)
    return a, np.array([len(x) for x in piece_bytes(of_b)], np.int64)


@lru_cache(maxsize=1)
def _encoder(a_path: str, b_path: str) -> Encoder:
    return Encoder(a_path, b_path)


@lru_cache(maxsize=1)
def _lengths(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    import sentencepiece
    from tokenizers import Tokenizer

    return byte_lengths(Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path))


EVENTS = "one long, two long, doc_id long, offset long, side int, ids binary"


def end_events(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """End events of both sides (0: A, 1: B), a row for each `block` bytes; each document has a row of both at offset 0.

    `one` and `two` are the hashes of the text that, with doc_id, tell documents apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(a_path, b_path)
        for batch in batches:
            heads = list(zip(*(batch.column(c).to_pylist() for c in ("one", "two", "doc_id"))))
            out, size = [], 0
            for head, both in zip(heads, encoder.of(batch.column("text").to_pylist())):
                for side, ids in enumerate(both):
                    n = len(ids) // 2
                    if n > block // 64:  # may be over a block
                        at = (np.cumsum(encoder.lengths[side][np.frombuffer(ids, "<u2")]) - 1) // block
                        cuts = [0, *(np.nonzero(np.diff(at))[0] + 1).tolist(), n]
                        rows = [(int(at[i]) * block, ids[2 * i : 2 * j]) for i, j in zip(cuts, cuts[1:])]
                        rows += [(0, b"")] * (rows[0][0] > 0)
                    else:
                        rows = [(0, ids)]
                    out += [(*head, offset, side, part) for offset, part in rows]
                    size += len(ids)
                if size > 8 << 20:
                    yield _batch(out, EVENTS)
                    out, size = [], 0
            if out:
                yield _batch(out, EVENTS)

    rows = docs.select(
        F.xxhash64("text", F.lit(1)).alias("one"), F.xxhash64("text", F.lit(2)).alias("two"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, EVENTS)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows), kinds)], names=list(names))


@lru_cache(maxsize=1)
def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of each number below `most`, left-aligned with a place free, and how many."""
    text = [str(i).encode() for i in range(most)]
    width = len(text[-1]) + 1
    return np.frombuffer(b"".join(t.ljust(width) for t in text), np.uint8).reshape(most, width), np.array([len(t) for t in text])


class _Open:
    """What the state machine holds of the document that it is reading."""

    def __init__(self, ident: tuple) -> None:
        self.ident, self.copies, self.place = ident, 0, None
        self.tail = [np.zeros(0, np.int64)] * 2  # tokens of the open group
        self.part: list = [None, None]
        self.n = [0, 0, 0, 0]  # tokens of A and B, groups, links
        self.digest, self.pairs = hashlib.sha256(), []

    def row(self) -> tuple:
        if not self.pairs:
            pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        elif len(self.pairs) == 1:
            pairs, times = self.pairs[0]
        else:
            pairs, at = np.unique(np.concatenate([p for p, _ in self.pairs]), return_inverse=True)
            times = np.bincount(at, np.concatenate([t for _, t in self.pairs])).astype(np.int64)
        kind = "<u1" if times.max(initial=0) < 256 else "<i8"
        sha = self.digest.hexdigest() if self.n[0] else ""
        return (self.ident[2], self.copies, *self.n, sha, pairs.astype("<u4").tobytes(), times.astype(kind).tobytes())


def closed_part(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> tuple[int, int]:
    """How many tokens of A and of B lie before the last offset at which both end."""
    end_a, end_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    both = np.intersect1d(end_a, end_b, assume_unique=True)
    if not len(both):
        return 0, 0
    return int(np.searchsorted(end_a, both[-1])) + 1, int(np.searchsorted(end_b, both[-1])) + 1


def close_groups(parts: list[tuple[_Open, np.ndarray, np.ndarray]], len_a: np.ndarray, len_b: np.ndarray) -> None:
    """Add the groups and links of each part to its document. In a part, tokens of A and of B make up the same bytes."""
    n_a, n_b = (np.cumsum([0, *(len(p[k]) for p in parts)]) for k in (1, 2))
    if not n_a[-1]:
        return
    a, b = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (1, 2))
    end_a, end_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    ends = np.zeros(end_a[-1] + 1, bool)
    ends[end_a] = True
    cut_b = ends[end_b]
    ends[:] = False
    ends[end_b] = True
    cut_a = ends[end_a]
    last_a, last_b = np.nonzero(cut_a)[0] + 1, np.nonzero(cut_b)[0] + 1  # tokens up to the end of each group
    first_a, first_b = np.concatenate([[0], last_a[:-1]]), np.concatenate([[0], last_b[:-1]])
    in_a, in_b = last_a - first_a, last_b - first_b
    groups = np.arange(len(last_a))
    group_a, group_b = np.repeat(groups, in_a), np.repeat(groups, in_b)

    ids, marks = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    at_a, at_b = np.arange(len(a)) + first_b[group_a], np.arange(len(b)) + last_a[group_b]
    ids[at_a], ids[at_b] = a, b
    marks[at_a], marks[at_b] = np.where(cut_a, ord("|"), ord(",")), np.where(cut_b, ord(";"), ord(","))
    digits, width = _digits(1 << 16)
    chars, width = digits[ids], width[ids]
    chars[np.arange(len(ids)), width] = marks
    text = chars[np.arange(chars.shape[1]) <= width[:, None]].tobytes()
    text_to = np.concatenate([[0], np.cumsum(width + 1)])[n_a + n_b]

    links = in_a * in_b
    of_groups, of_links = (np.concatenate([[0], x]) for x in (np.cumsum(cut_a), np.cumsum(links)))
    few = links <= WRITTEN
    of = np.repeat(groups[few], links[few])
    k = np.arange(len(of)) - np.repeat(np.cumsum(links[few]) - links[few], links[few])
    pair = (a[first_a[of] + k // in_b[of]] << 15) + b[first_b[of] + k % in_b[of]]
    part_of = np.searchsorted(n_a, first_a, side="right") - 1
    keys = np.sort((part_of[of] << 32) + pair)
    new = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
    times, keys = np.diff(np.concatenate([new, [len(keys)]])), keys[new]
    starts = np.searchsorted(keys, np.arange(len(parts) + 1) << 32)
    for p, (doc, one, two) in enumerate(parts):
        if len(one):
            g, h = of_groups[n_a[p]], of_groups[n_a[p + 1]]
            doc.digest.update(b";" * (doc.n[0] > 0) + text[text_to[p] : text_to[p + 1] - 1])
            doc.n = [doc.n[0] + len(one), doc.n[1] + len(two), doc.n[2] + int(h - g), doc.n[3] + int(of_links[h] - of_links[g])]
            doc.pairs.append((keys[starts[p] : starts[p + 1]] & 0xFFFFFFFF, times[starts[p] : starts[p + 1]]))
    for g in groups[~few]:
        some_a, times_a = np.unique(a[first_a[g] : last_a[g]], return_counts=True)
        some_b, times_b = np.unique(b[first_b[g] : last_b[g]], return_counts=True)
        parts[part_of[g]][0].pairs.append((((some_a[:, None] << 15) + some_b).ravel(), (times_a[:, None] * times_b).ravel()))


SWEPT_ROW = "doc_id long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def sweep(events: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Groups and links of each document, from its end events in the order of their offsets.

    Returns per different (doc_id, text) its number of copies, counts, the digest of its groups, and its different
    pairs of ids ((a << 15) + b, unsigned 32-bit) with how often each is linked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        len_a, len_b = _lengths(a_path, b_path)
        doc: _Open | None = None
        parts, done, tokens = [], [], 0

        def block(doc: _Open, last: bool) -> None:
            """Both sides of a block are there: what has closed is swept, the open group is carried on."""
            nonlocal tokens
            a, b = (np.concatenate([t, p]) if p is not None else t for t, p in zip(doc.tail, doc.part))
            doc.part = [None, None]
            to_a, to_b = (len(a), len(b)) if last else closed_part(a, b, len_a, len_b)
            doc.tail = [a[to_a:], b[to_b:]]
            parts.append((doc, a[:to_a], b[:to_b]))
            tokens += to_a + to_b

        def flush() -> list[tuple]:
            nonlocal tokens
            close_groups(parts, len_a, len_b)
            rows = [d.row() for d in done]
            parts.clear()
            done.clear()
            tokens = 0
            return rows

        for batch in batches:
            heads = list(zip(*(batch.column(c).to_pylist() for c in ("one", "two", "doc_id", "offset", "side"))))
            out = []
            for (*ident, offset, side), ids in zip(heads, batch.column("ids")):
                if doc is None or ident != doc.ident:
                    if doc is not None:
                        block(doc, True)
                        done.append(doc)
                    if tokens > SWEPT:
                        out += flush()
                    doc = _Open(ident)
                elif offset != doc.place:
                    block(doc, False)
                    if tokens > SWEPT:
                        out += flush()
                doc.place = offset
                doc.copies += offset == 0 and side == 0
                doc.part[side] = np.frombuffer(ids.as_py(), "<u2").astype(np.int64) if doc.part[side] is None else doc.part[side]
            if out:
                yield _batch(out, SWEPT_ROW)
        if doc is not None:
            block(doc, True)
            done.append(doc)
            yield _batch(flush(), SWEPT_ROW)

    dealt = events.repartition("one", "two", "doc_id").sortWithinPartitions("one", "two", "doc_id", "offset", "side")
    return dealt.mapInArrow(run, SWEPT_ROW)


def pair_counts(swept: DataFrame) -> DataFrame:
    """(pair, n, best) for each linked pair of ids: n documents hold it, best if no pair of its A id is held by more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [np.frombuffer(x, "<u4") for x in part.column("pairs").to_pylist()]
                copies = np.repeat(part.column("copies").to_numpy(), [len(x) for x in found])
                keys, place = np.unique(np.concatenate([keys, *found]).astype(np.int64), return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, copies]), len(keys)).astype(np.int64)
                if len(keys) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

    counts = swept.select("copies", "pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = save(counts.withColumn("a", F.shiftright("pair", 15)), "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # an A id has 32768 pairs at most
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_scores(swept: DataFrame, counts: DataFrame, at_once: int = BROADCAST) -> DataFrame:
    """swept with n_best and count_sum. Counts are broadcast `at_once` pairs at a time, each in a pass of its own."""
    spark = swept.sparkSession
    passes = max(1, -(-counts.count() // at_once))
    scored = swept.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    shared = []
    for k in range(passes):
        # hashed parts are of about equal size: at_once pairs are the stated bound, and no part is twice that
        part = counts.filter(F.pmod(F.xxhash64("pair"), F.lit(passes)) == k).toArrow()
        pair, n, best = (part.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        shared.append(spark.sparkContext.broadcast((pair[order].astype(np.uint32), n[order], best[order].astype(bool))))
        held = shared[-1]

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            pair, n, best = held.value
            for batch in batches:
                found = [np.frombuffer(x, "<u4") for x in batch.column("pairs").to_pylist()]
                sizes = np.array([len(x) for x in found])
                times = [np.frombuffer(x, "<u1" if len(x) == s else "<i8").astype(np.int64) for x, s in zip(batch.column("times").to_pylist(), sizes)]
                sums = np.zeros((2, batch.num_rows), np.int64)
                if sizes.sum() and len(pair):
                    all_pairs, all_times = np.concatenate(found), np.concatenate(times)
                    at = np.minimum(np.searchsorted(pair, all_pairs), len(pair) - 1)
                    known = pair[at] == all_pairs
                    to = np.cumsum(sizes)
                    for s, v in zip(sums, (all_times * (known & best[at]), all_times * np.where(known, n[at], 0))):
                        run_sum = np.concatenate([[0], np.cumsum(v)])
                        s[:] = run_sum[to] - run_sum[to - sizes]
                columns = [batch.column(c) for c in batch.schema.names[:-2]]
                sums = [s + batch.column(c).to_numpy() for s, c in zip(sums, ("n_best", "count_sum"))]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sums)], names=batch.schema.names)

        scored = scored.mapInArrow(run, scored.schema)
    return scored


def align(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK, at_once: int = BROADCAST) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256.

    A encodes a space and the text, B the text. Null and empty texts, and those whose tokens of a side do not make up a
    space and the text, have no tokens: zeros and ''. Rows that repeat doc_id and text count as a document each, and
    so have a row each; a null doc_id is an id like any other. Long texts are swept in blocks. Equally frequent pairs of
    an A id are all best. An empty table gives an empty result, other columns are ignored.
    """
    events = end_events(docs.select("doc_id", "text"), a_path, b_path, block)
    swept = save(sweep(events, a_path, b_path), "swept", compression="zstd")
    counts = save(pair_counts(swept), "counts")
    scored = link_scores(swept, counts, at_once)
    scored = scored.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    forget(counts)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
