"""Scores over sections as Arrow functions: a batch of rows is a matrix, so nothing is interpreted row by row."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import repeat
from operator import contains

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _lists(matrix: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Rows of a matrix as lists. NaN is null."""
    n, k = matrix.shape
    flat = matrix.ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k, pa.int32()), pa.array(flat, kind, mask=np.isnan(flat) if flat.dtype == np.float64 else None))


def _matrix(lists: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of k doubles as rows, null lists as zeros, and which are there."""
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), k))
    if there.any():
        out[there] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return out, there


def _hits(lower: pa.Array, needles: Sequence[Sequence[str]]) -> np.ndarray:
    """For each text and list of needles, how many of the list it contains; none for a null text."""
    out = np.zeros((len(lower), len(needles)))
    there, texts = lower.is_valid().to_numpy(zero_copy_only=False), [t or "" for t in lower.to_pylist()]
    for needle in sorted({x for of in needles for x in of}):
        found = np.fromiter(map(contains, texts, repeat(needle)), bool, len(texts)) & there  # faster than Arrow's match_substring
        if found.any():
            out[found] += [of.count(needle) for of in needles]
    return out


def jaccards(own: Column, known: Sequence[Sequence[str]]) -> Column:
    """array<double>: the Jaccard similarity of the distinct tokens `own` with each of the known lists; 0 if both are empty."""
    every = sorted({t for k in known for t in k})
    if not every:
        return F.array(*[F.lit(0.0)] * len(known))
    member = np.array([[float(t in set(k)) for k in known] for t in every])
    sizes = np.array([float(len(k)) for k in known])

    @F.arrow_udf("array<double>")
    def of(own: pa.Array) -> pa.Array:
        flat = own.flatten()
        at = pc.index_in(flat, value_set=pa.array(every, flat.type))
        hit = at.is_valid().to_numpy(zero_copy_only=False)
        rows, ids = pc.list_parent_indices(own).to_numpy(zero_copy_only=False)[hit], at.drop_null().to_numpy(zero_copy_only=False)
        common = np.zeros((len(own), len(sizes)))
        if len(ids):
            found, start = np.unique(rows, return_index=True)
            common[found] = np.add.reduceat(member[ids], start, axis=0)
        length = pc.list_value_length(own).cast(pa.float64()).to_numpy(zero_copy_only=False)  # NaN without tokens' list
        union = length[:, None] + sizes - common
        return _lists(np.where(union == 0, 0.0, common / np.where(union == 0, 1.0, union)))

    return of(own)


def contains_each(lower: Column, needles: Sequence[Sequence[str]]) -> Column:
    """array<boolean>: whether the text contains one of each list of needles."""
    needles = [list(of) for of in needles]

    @F.arrow_udf("array<boolean>")
    def of(lower: pa.Array) -> pa.Array:
        return _lists(_hits(lower, needles) > 0, pa.bool_())

    return of(lower)


def boosts(lower: Column, hints: Sequence[Sequence[str]], step: float, most: float) -> Column:
    """array<double>: the boost of each list of hints that the text contains."""
    hints = [[h.lower() for h in of] for of in hints]

    @F.arrow_udf("array<double>")
    def of(lower: pa.Array) -> pa.Array:
        return _lists(np.minimum(most, _hits(lower, hints) * step))

    return of(lower)


def blended(base: Column, before: Sequence[Column], behind: Sequence[Column], boost: Column, width: int, alpha: float, beta: float) -> Column:
    """struct(context, combined) of `width` scores: the mean of the neighbours' base, and the blend with base and boost.

    Those before and those behind, each in the order of the text, are added up by themselves, as SQL does for a window
    without its own row: another order gives other last bits, and so other sixth decimals at ties.
    """
    first = len(before)

    @F.arrow_udf("struct<context:array<double>,combined:array<double>>")
    def of(base: pa.Array, boost: pa.Array, *near: pa.Array) -> pa.Array:
        own, _ = _matrix(base, width)
        sums, n = [np.zeros_like(own), np.zeros_like(own)], np.zeros(len(own))
        for k, lists in enumerate(near):
            rows, there = _matrix(lists, width)
            sums[k >= first] += rows
            n += there
        context = (sums[0] + sums[1]) / np.maximum(n, 1.0)[:, None]
        return pa.StructArray.from_arrays([_lists(context), _lists(alpha * own + beta * context + _matrix(boost, width)[0])], ["context", "combined"])

    return of(base, boost, *before, *behind)


def highest(scores: Column, k: int) -> Column:
    """array<int>: the places of the k highest scores of nine decimals, the earlier place at ties."""

    @F.arrow_udf("array<int>")
    def of(scores: pa.Array) -> pa.Array:
        width = len(scores.flatten()) // max(1, len(scores) - scores.null_count)
        rows, _ = _matrix(scores, width)
        order = np.argsort(-np.floor(rows * 1e9 + 0.5), axis=1, kind="stable")[:, :k]
        return _lists(order.astype(np.int32), pa.int32())

    return of(scores)
