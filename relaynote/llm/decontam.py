"""Benchmark decontamination by winnowing, in DataFrame operations.

Words make GRAM-grams, each with a hash; every window of WINDOW words keeps the least hash of its grams, its fingerprint.
A span of WINDOW words or more that a document shares with an item holds a whole window, and equal windows have equal
fingerprints: so no such span is missed. Windows whose fingerprint occurs in the benchmark are extended to all their
words and compared with the benchmark's windows word by word. Items of fewer words are one window of all their words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, bit_filter, filter_bits, flag_contained, save

WINDOW, GRAM = 10, 5
#: Fingerprints and windows of the benchmark that are broadcast, about 100 bytes each. Beyond, a filter of fixed size
#: (16 MB) is broadcast and windows are joined by a shuffle.
BROADCAST = 500_000
_ALL = 1 << 30
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of letters, digits and all characters beyond ASCII; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_WORD), "")


def _beside(df: DataFrame, name: str, left: str, right: str, by: int, f: Callable[[Column, Column], Column]) -> DataFrame:
    """df with the array `name`: f of left[i] and right[i + by]. Columns of their own keep arrays from being computed twice."""
    return df.withColumn(name, F.zip_with(left, F.slice(right, by + 1, _ALL), f))


def with_grams(df: DataFrame, hashes: str, n: int, name: str) -> DataFrame:
    """df with the array `name`: a hash of n elements of `hashes` from each place on. The last n - 1 are of no meaning."""
    join = lambda a, b: F.xxhash64(a, b)
    powers, size = {1: hashes}, 1
    while 2 * size <= n:
        df = _beside(df, f"{name}_{2 * size}", powers[size], powers[size], size, join)
        powers[2 * size] = f"{name}_{2 * size}"
        size *= 2
    at, whole = size, powers[size]
    for part in sorted((p for p in powers if n & p and p < size), reverse=True):
        df = _beside(df, f"{name}_to_{at + part}", whole, powers[part], at, join)
        at, whole = at + part, f"{name}_to_{at + part}"
    return df.withColumn(name, F.col(whole))


def with_least(df: DataFrame, values: str, n: int, name: str) -> DataFrame:
    """df with the array `name`: the least of n elements of `values` from each place on."""
    size, whole = 1, values
    while 2 * size <= n:
        df = _beside(df, f"{name}_{2 * size}", whole, whole, size, _least)
        size, whole = 2 * size, f"{name}_{2 * size}"
    if size < n:
        df = _beside(df, f"{name}_{n}", whole, whole, n - size, _least)
        whole = f"{name}_{n}"
    return df.withColumn(name, F.col(whole))


def fingerprints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df (with the array `words`) with the array `prints`: of each length in turn, the fingerprint of each window.

    Windows of WINDOW words have the least of their grams' hashes, shorter ones the hash of all their words.
    """
    kept = df.columns
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    parts = []
    for n in lengths:
        if n == WINDOW:
            df = with_least(with_grams(df, "h", GRAM, "grams"), "grams", WINDOW - GRAM + 1, "least")
        else:
            df = with_grams(df, "h", n, f"of_{n}")
        parts.append(F.slice("least" if n == WINDOW else f"of_{n}", 1, F.greatest(F.size("words") - (n - 1), F.lit(0))))
    return df.select(*kept, F.concat(*parts).alias("prints"))


def window_at(place: Column, lengths: list[int]) -> tuple[Column, Column]:
    """(first word, from 0, and length) of the window at a place in `prints`."""
    start = length = None
    before = F.lit(0)
    for n in lengths:
        of_n = F.greatest(F.size("words") - (n - 1), F.lit(0))
        inside = place < before + of_n
        start = F.when(inside, place - before) if start is None else start.when(inside, place - before)
        length = F.when(inside, F.lit(n)) if length is None else length.when(inside, F.lit(n))
        before = before + of_n
    return start, length


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(item_id as a string, window: its words joined, print) of each different window of the items. A null id is ''."""
    split = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("words"))
    long = fingerprints(split.filter(F.size("words") >= WINDOW), [WINDOW])
    long = long.select("item_id", "words", F.posexplode("prints").alias("at", "print"))
    found = long.select("item_id", F.array_join(F.slice("words", F.col("at") + 1, WINDOW), " ").alias("window"), F.lit(WINDOW).alias("length"), "print")
    short = split.filter((F.size("words") > 0) & (F.size("words") < WINDOW))
    for n in range(1, WINDOW):
        of_n = fingerprints(short.filter(F.size("words") == n), [n])
        found = found.unionByName(of_n.select("item_id", F.array_join("words", " ").alias("window"), F.lit(n).alias("length"), F.col("prints")[0].alias("print")))
    return found.distinct()


def candidates(docs: DataFrame, windows: DataFrame, lengths: list[int], most: int = BROADCAST) -> DataFrame:
    """Per document a row without a window, and a row for each window with a fingerprint of the benchmark.

    Columns: doc_id, text_hash (they tell documents apart), n_words, start, length, window.
    """
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", F.lit(13)).alias("text_hash"), words(F.col("text")).alias("words"))
    if lengths:
        split = fingerprints(split, lengths)
    else:
        split = split.withColumn("prints", F.array().cast("array<long>"))
    none = F.array(F.lit(None).cast("long"))
    rows = split.select("doc_id", "text_hash", "words", F.posexplode(F.concat(none, "prints")).alias("at", "print"))
    prints = windows.select("print").distinct()
    n = prints.count()
    if n <= most:
        rows = rows.join(F.broadcast(prints.withColumn("held", F.lit(True))), "print", "left")
    else:
        bits = filter_bits(n)
        rows = flag_contained(rows, F.col("print"), save(bit_filter(prints, "print", bits), "prints"), "held", bits)
    rows = rows.filter((F.col("at") == 0) | F.col("held"))
    start, length = window_at(F.col("at") - 1, lengths) if lengths else (F.lit(None).cast("int"), F.lit(None).cast("int"))
    found = F.col("at") > 0
    rows = rows.withColumns({"start": F.when(found, start), "length": F.when(found, length)})
    window = F.when(found, F.array_join(F.slice("words", F.col("start") + 1, F.col("length")), " "))
    return rows.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), "start", "length", window.alias("window"))


def decontaminate(docs: DataFrame, items: DataFrame, most: int = BROADCAST) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items (long), items_sha256, contaminated.

    A null or empty text has no words and no hit. Repeated rows have a row each, with equal results; a null doc_id is an
    id like any other. Long texts are read whole. Items of equal item_id count once, a null item_id is the id ''; items
    without words never occur. An empty benchmark hits nothing, an empty table gives an empty result. Other columns are
    ignored.
    """
    windows = save(benchmark_windows(items), "windows")
    lengths = sorted((r["length"] for r in windows.select("length").distinct().collect()), reverse=True)  # WINDOW values at most
    found = save(candidates(docs.select("doc_id", "text"), windows, lengths, most), "candidates")
    small = windows.count() <= most
    hint = F.broadcast if small else (lambda df: df)
    ident = ["doc_id", "text_hash"]
    hits = found.filter("window is not null").select(*ident, "start", "length", "window").distinct()
    hits = save(hits.join(hint(windows.select("window").distinct()), "window"), "hits")

    before = Window.partitionBy(*ident).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    reached = hits.withColumn("reached", F.coalesce(F.max(end).over(before), F.lit(0)))
    covered = reached.groupBy(*ident).agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "reached"))).alias("n_hit"))

    of_doc = hits.select(*ident, "window").distinct().join(hint(windows.select("window", "item_id").distinct()), "window").select(*ident, "item_id").distinct()
    joined = F.array_join(F.sort_array(F.collect_list("item_id")), ",")  # what is hashed is this list
    of_doc = of_doc.groupBy(*ident).agg(F.count("*").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"))

    docs = found.filter("window is null").select(*ident, "n_words")
    for df in (covered, of_doc):
        df = df.withColumnsRenamed({"doc_id": "_doc_id", "text_hash": "_text_hash"})
        docs = docs.join(df, docs["doc_id"].eqNullSafe(df["_doc_id"]) & (docs["text_hash"] == df["_text_hash"]), "left").drop("_doc_id", "_text_hash")
    return docs.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
