"""Exact top-k search by inner product with a three-phase uniform threshold.

A vector's dimensions are split into lists; a list's local score is the inner product over its dimensions, and an
entry's score is the sum over its lists. Queries are taken in blocks of bounded size, each broadcast to the partitions
of the vectors.
Phase 1: every partition gathers, over its first rows, the k best local scores of each list. The k-th best whole score
of the entries found is a safe cutoff for its query, as is that of any k entries.
Phase 2: the cutoffs are broadcast. Every entry's first local score is computed. An entry can only reach the cutoff if
it has the uniform share cutoff / lists in one list at least, and if its known scores and the greatest that the norms
allow the others together do; the other entries are left.
Phase 3: the remaining local scores of those entries are resolved exactly, list by list, with the same test after each.
The k best of each partition meet in one ranking; while a partition is scanned, its own k-th best score raises the cutoff.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save, shared_path

BLOCK = 1024
LISTS = 4
#: Rows that are scored at once, and rows of a partition from which phase 1 takes its cutoff.
ROWS, FIRST = 4096, 512
_EXACT = float(1 << 53)
_LONG = np.iinfo(np.int64)


def quantized(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and `v`, the components floor(scale * x) as longs; rows null or holding null or non-finite components go."""
    x = lambda c: c.cast("double")
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return rows.filter(~bad).select("vec_id", F.transform("embedding", lambda c: F.floor(x(c) * scale)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers; shorter vectors end in zeros. Components beyond the queries' width meet nothing."""
    if len(column) and column.null_count == 0 and len(flat := column.flatten()) == width * len(column) and all(n == width for n in np.diff(column.offsets.to_numpy())):
        return flat.to_numpy(zero_copy_only=False).reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v[:width]
    return out


def _parts(width: int, lists: int) -> list[slice]:
    cuts = np.linspace(0, width, max(1, min(lists, width)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    if len(ids) > 4 * k:
        some = np.nonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])[0]
        return some[np.lexsort((ids[some], -scores[some]))][:k]
    return np.lexsort((ids, -scores))[:k]


class Search:
    """Scores of a block of queries (own ids, vectors q) over slices of rows; `products` counts multiplications."""

    def __init__(self, own: np.ndarray, q: np.ndarray, k: int, lists: int, cut: np.ndarray | None = None) -> None:
        self.own, self.whole, self.q, self.k = own, q, q.astype(float), k
        self.parts = _parts(q.shape[1], lists)
        self.norms = np.array([np.sqrt((self.q[:, p] ** 2).sum(axis=1)) for p in self.parts])
        self.cut = np.full(len(own), -np.inf) if cut is None else cut.copy()
        none = np.zeros(0, np.int64)
        self.kept = {i: (none, none, none) for i in range(len(own))}  # vec_id, row, score
        self.products = 0

    def _exact(self, x: np.ndarray) -> bool:
        """Whether no sum can leave the integers of floating point."""
        return float(np.abs(self.whole).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(x.shape[1], 1) < _EXACT

    def _large(self, i: int, x: np.ndarray) -> np.ndarray:
        """Whole scores in integers of any size, held to the range of a long."""
        return np.array([min(max(int(s), _LONG.min), _LONG.max) for s in x.astype(object) @ self.whole[i].astype(object)], np.int64)

    def first(self, vec: np.ndarray, row: np.ndarray, x: np.ndarray) -> None:
        """Phase 1: the entries with the k best local scores of each list."""
        local = [self.q[:, p] @ x[:, p].T.astype(float) for p in self.parts]
        self.products += x.size * len(self.own)
        exact = self._exact(x)
        for i in range(len(self.own)):
            other = np.nonzero(vec != self.own[i])[0]
            at = np.unique(np.concatenate([other[_best(row[other], p[i][other], self.k)] for p in local]))
            scores = sum(p[i][at] for p in local).astype(np.int64) if exact else self._large(i, x[at])
            self._keep(i, vec[at], row[at], scores)

    def _keep(self, i: int, vec: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        vec, row, score = (np.concatenate(x) for x in zip(self.kept[i], (vec, row, score)))
        at = _best(vec, score, self.k)
        self.kept[i] = vec[at], row[at], score[at]
        if len(at) == self.k:
            self.cut[i] = max(self.cut[i], float(score[at[-1]]))

    def add(self, vec: np.ndarray, row: np.ndarray, x: np.ndarray) -> None:
        """Phases 2 and 3 over a slice."""
        if not self._exact(x):
            self.products += x.size * len(self.own)
            for i in range(len(self.own)):
                other = np.nonzero(vec != self.own[i])[0]
                self._keep(i, vec[other], row[other], self._large(i, x[other]))
            return
        x = x.astype(float)
        norms = np.array([np.sqrt((x[:, p] ** 2).sum(axis=1)) for p in self.parts])
        known = self.q[:, self.parts[0]] @ x[:, self.parts[0]].T
        self.products += len(self.own) * len(x) * (self.parts[0].stop - self.parts[0].start)
        for i in range(len(self.own)):
            most = self.norms[:, i, None] * norms * (1 + 1e-9) + 1e-3  # no local score is above
            left = most[1:].sum(axis=0)
            share = self.cut[i] / len(self.parts)
            may = (known[i] + left >= self.cut[i]) & ((known[i] >= share) | (most[1:] >= share).any(axis=0)) if len(self.parts) > 1 else known[i] >= self.cut[i]
            at = np.nonzero(may & (vec != self.own[i]))[0]
            score = known[i][at]
            for n, p in enumerate(self.parts[1:], 1):
                score = score + x[at, p] @ self.q[i, p]
                self.products += len(at) * (p.stop - p.start)
                left = left - most[n]
                goes_on = score + left[at] >= self.cut[i]
                at, score = at[goes_on], score[goes_on]
            if len(at):
                self._keep(i, vec[at], row[at], score.astype(np.int64))

    def found(self) -> pa.RecordBatch:
        query = np.concatenate([np.full(len(x[0]), self.own[i]) for i, x in self.kept.items()])
        vec, row, score = (np.concatenate([x[n] for x in self.kept.values()]) for n in range(3))
        return pa.record_batch({n: pa.array(v, pa.int64()) for n, v in (("query_id", query), ("vec_id", vec), ("row", row), ("score", score))})


def _scan(vectors: DataFrame, shared, k: int, lists: int, first: bool) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q, cut = shared.value
        search, left = Search(own, q, k, lists, cut), FIRST
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, min(ROWS, left) if first else ROWS)
                vec, row, x = some.column("vec_id").to_numpy(), some.column("row").to_numpy(), _matrix(some.column("v"), q.shape[1])
                if not first:
                    search.add(vec, row, x)
                elif left > 0:
                    search.first(vec, row, x)
                    left -= some.num_rows
        yield search.found()

    return vectors.mapInArrow(run, "query_id long, vec_id long, row long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, lists: int = LISTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best of each query: rows whose vec_id is divisible by `every`.

    Candidates are all rows but those with the query's vec_id; rows that repeat a vec_id are candidates each. Ties go
    to the smaller vec_id. Vectors that are null or hold null or non-finite components take no part, nor do rows
    without vec_id. Vectors of unequal length are compared over the shorter one. Of rows that repeat a query's vec_id
    the least vector asks. Scores beyond the range of a long are held at its ends. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = save(quantized(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = save(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = -(-asked.count() // block)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = shared_path(spark, "top")
    for b in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()  # about `block` rows
        if not some:
            continue
        ids = np.array([r["vec_id"] for r in some], np.int64)
        q = np.zeros((len(some), max(len(r["v"]) for r in some)), np.int64)
        for i, r in enumerate(some):
            q[i, : len(r["v"])] = r["v"]
        shared = spark.sparkContext.broadcast((ids, q, None))  # about `block` queries
        first = _ranked(_scan(rows, shared, k, lists, True), k).filter(F.col("rank") == k)
        cuts = {r["query_id"]: float(r["score"]) for r in first.select("query_id", "score").collect()}  # one row per query of the block
        shared.destroy()
        shared = spark.sparkContext.broadcast((ids, q, np.array([cuts.get(int(i), -np.inf) for i in ids])))
        _ranked(_scan(rows, shared, k, lists, False), k).select("query_id", "rank", "vec_id", "score").write.parquet(f"{out}/block={b}")
        shared.destroy()
    return spark.read.schema("query_id long, rank int, vec_id long, score long, block int").parquet(out).drop("block")
