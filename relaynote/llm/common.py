"""Helpers that the corpus operators share: shared storage, fixed-size filters, ranks and components."""

from __future__ import annotations

import ctypes
import uuid
import weakref
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Only a local master may do without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "/tmp/checkpoints"
    return f"{path.rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_saved: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


#: Spark's setting that frees a query's shuffle files at its end, not when the driver's garbage is collected.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cut the lineage: write df once as Parquet to the shared folder and read it back. Its shuffle files go at once."""
    conf, path = df.sparkSession.conf, shared_path(df.sparkSession, label)
    before = conf.get(FREES)
    conf.set(FREES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.set(FREES, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _saved[out] = path
    return out


def forget(*frames: DataFrame | None) -> None:
    """Delete the files of frames that save() returned, once nothing will read them any more."""
    for df in frames:
        path = _saved.pop(df, None) if df is not None else None
        if path is not None:
            jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(session.sessionState().newHadoopConf()).delete(where, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores in front as no column of df has them."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name = f"_{name}"
        there.add(name.lower())
        out.append(name)
    return out


_kept: dict[str, Any] = {}


def give_back() -> None:
    """In a Python worker: drop what an earlier operator kept there, and give free memory back to the system.

    Workers are used by one operator after the other, so what one keeps would else add to what the next one needs.
    """
    _kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim is not None:
        trim(0)


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: made once, and dropped when another operator gives back."""
    if name not in _kept:
        give_back()
        _kept[name] = make()
    return _kept[name]


class WordHashes(dict):
    """XXH64 of words; emptied beyond about `most` bytes."""

    size, most = 0, 32 << 20

    def __missing__(self, word: bytes) -> int:
        if self.size > self.most:
            self.clear()
            self.size = 0
        self.size += 200 + len(word)
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. lower() does just that for a text of one-byte characters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


PAGE_BITS = 32768


def filter_bits(keys: int) -> int:
    """Bits of a filter for so many keys: eight a key, 2 MB at least and 16 MB at most. Beyond, more keys pass it."""
    return min(1 << 27, max(1 << 24, 1 << (8 * keys).bit_length()))


def bit_filter(keys: DataFrame, key: str, bits: int = 1 << 24) -> DataFrame:
    """Pages of a bitmap with one bit for each hashed key: `bits` / 8 bytes at most, whatever the number of keys."""
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    return (
        keys.select(F.floor(slot / PAGE_BITS).alias("page"), (slot % PAGE_BITS).alias("bit"))
        .groupBy("page")
        .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    )


def flag_contained(df: DataFrame, key: Column, pages: DataFrame, flag: str, bits: int = 1 << 24) -> DataFrame:
    """df with a boolean `flag`: false if the filter surely lacks the key or the key is null.

    The filter is broadcast: its size has the fixed bound `bits` / 8 bytes.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    page, place, bitmap = unused(df, "page", "place", "bitmap")
    probed = df.withColumns({page: F.when(key.isNotNull(), F.floor(slot / PAGE_BITS)), place: (slot % PAGE_BITS).cast("int")})
    probed = probed.join(F.broadcast(pages.select(F.col("page").alias(page), F.col("bitmap").alias(bitmap))), page, "left")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.col(place) % 8).bitwiseAND(F.lit(1))
    return probed.select(*df.columns, F.coalesce(bit == 1, F.lit(False)).alias(flag))


def may_contain(df: DataFrame, key: Column, pages: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """Rows of df whose key may be in the filter."""
    flag = unused(df, "may")[0]
    return flag_contained(df, key, pages, flag, bits).filter(F.col(flag)).drop(flag)


def rank_within(df: DataFrame, keys: list[str], order: Column, rows_per_bucket: int = 4096) -> DataFrame:
    """Add `_rank` (long, from 0): the place of each row among those with equal keys, by `order` (well spread, unsigned 64-bit hash).

    Expects `_n`, the group's row count. A group of many rows is dealt over hash buckets, each ranked by itself, and the
    buckets' row counts give the start of each: no task gets a whole group.
    """
    top = F.shiftrightunsigned(order, 33).cast("double") / float(1 << 31)
    dealt = df.withColumn("_order", order).withColumn("_bucket", F.floor(top * F.ceil(F.col("_n") / rows_per_bucket)))
    by = [*keys, "_bucket"]
    starts = dealt.filter(F.col("_n") > rows_per_bucket).groupBy(*by).agg(F.count("*").alias("_count"))
    within = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*by, F.coalesce(F.sum("_count").over(within), F.lit(0)).alias("_start"))
    ranked = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("_order")) - 1)
    starts = starts.withColumnsRenamed({k: f"_of_{k}" for k in by})
    same = None
    for k in by:
        one = ranked[k].eqNullSafe(starts[f"_of_{k}"])
        same = one if same is None else same & one
    joined = ranked.join(starts, same, "left")
    return joined.withColumn("_rank", F.col("_place") + F.coalesce("_start", F.lit(0))).drop("_order", "_bucket", "_place", "_start", "_count", *starts.columns)


#: Edges whose components one task finds: 4 MB at most, whatever the number of edges at the start.
LOCAL_EDGES = 1 << 18


def _local_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of LOCAL_EDGES edges or fewer: of two roots that an edge joins, the larger points to the smaller."""
    ends = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches if b.num_rows]
    if not ends:
        return
    ends = np.concatenate(ends, axis=1)
    nodes, at = np.unique(ends, return_inverse=True)
    x, y = at.reshape(ends.shape)
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, further := root[root]):
            root = further
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    yield pa.record_batch({"node": pa.array(nodes), "root": pa.array(nodes[root])})


def _stepped(mapping: DataFrame, points: DataFrame) -> DataFrame:
    """mapping (node, root), each root replaced by where points (node, to) send it."""
    step = points.select(F.col("node").alias("root"), "to")
    return save(mapping.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "mapping")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for each node of the edges (a, b), both long; nodes have the same root if and only if a path joins them.

    Each round, every node points to the neighbour (or itself) with the least seeded hash, pointers are followed twice,
    and edges are redrawn between the nodes pointed to. As the hash differs from round to round, paths shrink by a
    factor each round. Rows are pairs throughout: no node's neighbours are collected. Once LOCAL_EDGES edges or fewer are
    left, one task joins their ends, so small graphs need one round, and large ones few.
    """
    edges = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mapping = None
    for k in range(rounds):
        left = edges.count()
        if not left:
            break
        if left <= LOCAL_EDGES:
            old, found = mapping, save(edges.coalesce(1).mapInArrow(_local_components, "node long, root long"), "mapping")
            mapping = found if old is None else _stepped(old, found.select("node", F.col("root").alias("to")))
            if old is not None:
                forget(old, found)
            forget(edges)
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("id"))
        first = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(rank("b")), F.first(rank("a")))["id"].alias("to")), "points")
        points = first
        for _ in range(2):
            nxt = points.select(F.col("node").alias("to"), F.col("to").alias("further"))
            points = points.join(nxt, "to").select("node", F.col("further").alias("to"))
        points, old, before = save(points, "points"), mapping, edges
        if mapping is None:
            mapping = save(points.select("node", F.col("to").alias("root")), "mapping")
        else:
            mapping = _stepped(mapping, points)
        one = edges.join(points.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        two = one.join(points.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = save(two.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        forget(first, points, old, before)
    else:
        raise RuntimeError("components did not converge")
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapping
