"""Language identification with bit-sliced Bloom filters over character n-grams.

Row i of the filter holds one bit for each language: its filter's bit i. The AND of an n-gram's rows gives at once all
languages whose filter contains it. Per-language popcounts over a text, corrected for each filter's false positives,
decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PAGE_BITS, save
from .toxicity import fold

#: A language's filter is learned from this many of its texts at most (rows are picked by a hash threshold).
SAMPLE_ROWS = 5_000
SIZES = (3, 4)
#: Rows of the filters and bits that an n-gram sets: a language takes ROWS / 8 bytes, whatever the number of its n-grams.
ROWS, HASHES = 1 << 22, 3
#: Bytes of all filters, which the driver holds three times and broadcasts: more is an error (over 256 languages).
MOST_BYTES = 1 << 27
MOST_LANGUAGES = MOST_BYTES // (ROWS // 8)
CHUNK = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, every run of other characters one space, a space at either end."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    letter = _letters()[np.minimum(codes, 0xFFFF)]
    for i in np.nonzero(codes > 0xFFFF)[0]:
        letter[i] = chr(codes[i]).isalpha()
    padded = np.full(len(codes) + 2, 32, np.uint64)
    padded[1:-1] = np.where(letter, codes, 32)
    return padded[np.concatenate(([True], (padded[1:] != 32) | (padded[:-1] != 32)))]


def grams(codes: np.ndarray, before: int = 0) -> np.ndarray:
    """A 64-bit hash of each n-gram of the sizes; of those that lie in the first `before` codes none."""
    out, every = [], codes
    for n in SIZES:
        codes = every[max(0, before - n + 1) :]
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _places(h: np.ndarray) -> Iterator[np.ndarray]:
    step = h >> np.uint64(42) | np.uint64(1)
    for k in range(HASHES):
        yield (h + np.uint64(k) * step) & np.uint64(ROWS - 1)


@dataclass
class LanguageFilter:
    languages: list[str]
    rows: np.ndarray  # ROWS x bytes; bit l of a row is language l
    false_rate: np.ndarray

    def languages_of(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the languages whose filter contains it: a row of bytes, bit l of which is language l."""
        found = None
        for p in _places(h):
            found = self.rows[p] if found is None else found & self.rows[p]
        return found

    def shares(self, text: str) -> np.ndarray | None:
        """Each language's share of the text's n-grams, corrected for false positives; None without a letter."""
        hits, n = np.zeros(8 * self.rows.shape[1]), 0
        for h in text_grams(text):
            n += len(h)
            for b, column in enumerate(self.languages_of(h).T):
                hits[8 * b : 8 * b + 8] += np.bincount(column, minlength=256) @ _BITS
        if not n:
            return None
        return np.clip((hits[: len(self.languages)] / n - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        shares = self.shares(text) if text else None
        if shares is None or not len(shares):
            return "und", 0.0
        # of languages with all of a text's n-grams, that with the fewest n-grams
        best, total = int(np.lexsort((self.false_rate, -shares.round(9)))[0]), float(shares.sum())
        return self.languages[best], float(shares[best]) / total if total else 0.0


def parts_of(text: str) -> Iterator[str]:
    """The text in parts of about CHUNK characters, cut at blanks only, so no word ends that does not end in the text."""
    at = 0
    while len(text) - at > CHUNK:
        end = text.rfind(" ", at + 1, at + CHUNK)
        end = end if end > 0 else text.find(" ", at + CHUNK)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def text_grams(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text, as grams() has them, part by part: those that lie over a cut are there as well."""
    carried = np.zeros(0, np.uint64)
    for part in parts_of(text):
        codes = letter_codes(part)
        codes = np.concatenate((carried, codes[1:])) if len(carried) else codes  # the blank at a cut is there once
        h = grams(codes, len(carried))
        carried = codes[1 - max(SIZES) :]
        if len(h):
            yield h


#: Bits of the numbers up to 255.
_BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], float)


def sampled(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """lang and text of the rows to learn from: up to sample_rows a language, each text once."""
    known = rows.filter("text is not null and lang is not null").select("text", "lang")
    # the draw is by text, so the share follows from the number of different texts, whatever the number of copies
    sizes = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError("the filters of all languages take over MOST_BYTES; set SAMPLE_ROWS and ROWS lower")
    # nine tenths are aimed at, as the number is an estimate and the draw is by chance: the bound holds
    share = F.least(F.lit(1.0), 0.9 * sample_rows / F.col("n")) * float(1 << 30)
    sizes = F.broadcast(rows.sparkSession.createDataFrame(sizes, "lang string, n long"))  # MOST_LANGUAGES rows at most
    picked = known.join(sizes, "lang").filter(F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 30)) < share)
    return picked.groupBy("lang", F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text")).select("lang", "text")


def learn(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageFilter:
    """Filters of all n-grams of each language from rows (text, lang), on sample_rows a language at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch, by = whole.slice(at, 200), {}
                for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                    by.setdefault(lang, []).extend(text_grams(text))
                for lang, found in by.items():
                    if found:
                        places = np.unique(np.concatenate(list(_places(np.unique(np.concatenate(found))))))
                        yield pa.record_batch({"lang": pa.array([lang] * len(places)), "place": pa.array(places.view(np.int64))})

    places = sampled(rows, sample_rows).mapInArrow(run, "lang string, place long")
    pages = places.groupBy("lang", F.floor(F.col("place") / PAGE_BITS).alias("page")).agg(F.bitmap_construct_agg(F.col("place") % PAGE_BITS).alias("bits"))
    pages = save(pages, "filters")
    languages = [r["lang"] for r in pages.select("lang").distinct().orderBy("lang").collect()]  # MOST_LANGUAGES at most
    filters = {lang: np.zeros((ROWS // PAGE_BITS, PAGE_BITS // 8), np.uint8) for lang in languages}
    for r in pages.toLocalIterator():  # ROWS / 8 bytes a language
        filters[r["lang"]][r["page"]] = np.frombuffer(r["bits"], np.uint8)[: PAGE_BITS // 8]
    table = np.zeros((ROWS, max(1, -(-len(languages) // 8))), np.uint8)
    for k, lang in enumerate(languages):
        table[:, k // 8] |= np.unpackbits(filters[lang].reshape(-1), bitorder="little") << np.uint8(k % 8)
    rate = [float(np.bitwise_count(filters[lang]).sum() / ROWS) ** HASHES for lang in languages]
    return LanguageFilter(languages, table, np.array(rate))


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Languages are learned from rows with a lang whose crc32(doc_id as text) mod folds is not 0. lang_pred is `und`
    where the text is null or has no letter, or nothing could be learned; ties go to the language with the fewest
    n-grams, then to the first name. score is the language's part of all corrected shares. Repeated rows are alike, and
    are learned once; a null doc_id counts as held out; very long texts are read whole, in parts; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    held = F.coalesce(fold("doc_id", folds) == 0, F.lit(True))
    model = spark.sparkContext.broadcast(learn(docs.filter(~held)))  # MOST_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.value
        for batch in batches:
            found = [of.predict(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
