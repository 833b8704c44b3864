"""Problem 3: percentiles of very large numeric columns with a stated rank error.

A summary of n values is a sorted list of tuples (v, lo, hi): the rank of v among the values lies in [lo, hi]. Every input
partition makes exact summaries of its rows and compresses them to the uncertainty it is permitted; summaries are merged
pair by pair (ranks add up, uncertainty adds up) and compressed again, level by level, each level within its share of the
error. The uncertainty of a summary can be read off its tuples at any time, so each percentile comes with the rank error it
really has; it never exceeds eps * n. Summaries of days or slices are merged in the same way.

Percentile p is the value at rank ceil(p * n) (nearest rank, at least 1). Groups of up to about 2 / eps values are exact.

Defined results: null and NaN values are left out; a group with none gives no row; a null key is a group of its own; ties
and repeated rows count each; infinities are ordered as usual; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows a leaf holds at once.
BUFFER = 400_000
#: Share of the error that a leaf may use; the levels of merging have the rest.
LEAF_SHARE = 0.25

_TUPLES = "n bigint, v array<double>, lo array<bigint>, hi array<bigint>"
_NAMES = ["n", "v", "lo", "hi"]


def merge_pair(a: tuple, b: tuple) -> tuple:
    """Two summaries (v, lo, hi) of a_n and b_n values as one; of equal values those of ``a`` come first."""
    (av, alo, ahi), (bv, blo, bhi) = a, b
    out_v = np.concatenate([av, bv])

    def ranks(v, lo, hi, ov, olo, ohi, side):
        at = np.searchsorted(ov, v, side)
        low = np.where(at > 0, olo[np.maximum(at - 1, 0)], 0)
        high = np.where(at < len(ov), ohi[np.minimum(at, len(ov) - 1)] - 1, ohi[-1])
        return lo + low, hi + high

    alo, ahi = ranks(av, alo, ahi, bv, blo, bhi, "left")
    blo, bhi = ranks(bv, blo, bhi, av, a[1], a[2], "right")
    order = np.argsort(out_v, kind="stable")
    return out_v[order], np.concatenate([alo, blo])[order], np.concatenate([ahi, bhi])[order]


def compress(s: tuple, gap: int) -> tuple:
    """Drops tuples while neighbours stay within ``gap`` ranks of each other; the extremes stay."""
    v, lo, hi = s
    if gap < 2 or len(v) < 3:
        return s
    keep, i, last = [0], 0, len(v) - 1
    while i < last:
        i = min(max(i + 1, int(np.searchsorted(hi, lo[i] + gap, "right")) - 1), last)
        keep.append(i)
    return v[keep], lo[keep], hi[keep]


def merge_all(parts: list[tuple]) -> tuple:
    """Pair by pair, in a tree."""
    while len(parts) > 1:
        parts = [merge_pair(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _lists(offsets: np.ndarray, v, lo, hi) -> list[pa.Array]:
    at = pa.array(offsets, pa.int32())
    return [pa.ListArray.from_arrays(at, pa.array(x)) for x in (v, lo, hi)]


def _leaf(eps: float, n_keys: int):
    def flush(keys: list[list[pa.Array]], values: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.concat_arrays([k[i] for k in keys]) for i in range(n_keys)]
        value = np.concatenate(values)
        code = np.zeros(len(value), np.int64)
        for c in columns:
            d = c.dictionary_encode()
            code = code * (len(d.dictionary) + 1) + np.asarray(d.indices.fill_null(-1)) + 1
            code = np.unique(code, return_inverse=True)[1]
        order = np.lexsort((value, code))
        code, value = code[order], value[order]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        sizes = np.diff(np.r_[starts, len(code)])
        rank = np.arange(len(code)) - np.repeat(starts, sizes)  # from 0
        step = np.repeat(np.maximum(1, np.floor(2 * eps * sizes)).astype(np.int64), sizes)
        kept = np.flatnonzero((rank % step == 0) | (rank == np.repeat(sizes, sizes) - 1))
        offsets = np.searchsorted(kept, np.r_[starts, len(code)])
        at = rank[kept] + 1
        where = pa.array(order[starts])
        return pa.RecordBatch.from_arrays([*(c.take(where) for c in columns), pa.array(sizes), *_lists(offsets, value[kept], at, at)], names=[*(f"k{i}" for i in range(n_keys)), *_NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, held = [], [], 0
        for batch in batches:
            value = np.asarray(batch.column(n_keys))
            if not len(value):
                continue
            keys.append([batch.column(i) for i in range(n_keys)])
            values.append(value)
            held += len(value)
            if held >= BUFFER:
                yield flush(keys, values)
                keys, values, held = [], [], 0
        if held:
            yield flush(keys, values)

    return run


def _merger(eps: float, n_keys: int):
    """Merges the list of summaries of each row; groups of exact summaries are sorted together, the others pair by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(n_keys)
            parts_at = np.asarray(parts.offsets)
            each = parts.values
            n, lists = np.asarray(each.field("n")), [each.field(x) for x in ("v", "lo", "hi")]
            at = np.asarray(lists[0].offsets)
            v, lo, hi = (np.asarray(x.values) for x in lists)
            total = np.add.reduceat(n, parts_at[:-1])
            first, past = at[parts_at[:-1]], at[parts_at[1:]]
            exact = (past - first) == total
            row = np.repeat(np.arange(batch.num_rows), past - first)
            base = first[0]
            own = v[base : past[-1]]
            order = np.lexsort((own, row))
            sorted_v = own[order]
            out = []
            for r in np.flatnonzero(~exact | (np.floor(2 * eps * total) >= 2)):
                if exact[r]:
                    x = sorted_v[first[r] - base : past[r] - base]
                    ranks = np.arange(1, len(x) + 1)
                    s = (x, ranks, ranks)
                else:
                    s = merge_all([(v[at[p] : at[p + 1]], lo[at[p] : at[p + 1]], hi[at[p] : at[p + 1]]) for p in range(parts_at[r], parts_at[r + 1])])
                out.append((r, compress(s, int(2 * eps * total[r]))))
            rank = np.arange(len(row)) - np.repeat(first - base, past - first) + 1
            pieces, lengths, done = [], np.array(past - first), 0
            for r, s in out:
                a, b = first[r] - base, past[r] - base
                pieces += [(sorted_v[done:a], rank[done:a], rank[done:a]), s]
                lengths[r] = len(s[0])
                done = b
            pieces.append((sorted_v[done:], rank[done:], rank[done:]))
            flat = [np.concatenate([p[i] for p in pieces]) for i in range(3)]
            offsets = np.r_[0, np.cumsum(lengths)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n_keys)), pa.array(total), *_lists(offsets, *flat)], names=[*(f"k{i}" for i in range(n_keys)), *_NAMES])

    return run


def _schema(keys: list[str], tail: str) -> str:
    return ", ".join([*(f"k{i} string" for i in range(len(keys))), tail])


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.toDF(*keys, *_NAMES)


def combine(summaries: DataFrame, keys: list[str], eps: float, by: Column | None = None) -> DataFrame:
    """Merges summaries that agree in ``keys`` (and in ``by``, a group of an earlier level): of partitions, days, slices."""
    groups = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    listed = summaries.groupBy(*groups, *([by.alias("by")] if by is not None else [])).agg(F.collect_list(F.struct(*_NAMES)).alias("parts"))
    return _renamed(listed.select(*(f"k{i}" for i in range(len(keys))), "parts").mapInArrow(_merger(eps, len(keys)), _schema(keys, _TUPLES)), keys)


def summarize(rows: DataFrame, keys: dict[str, Column], value: Column, eps: float = 0.005) -> DataFrame:
    """A summary per key: key columns (text), n, v, lo, hi. ``keys``: name and expression of each key column.

    Leaves are one per input partition; with many of them a level of about the root of their number lies between.
    """
    names = list(keys)
    narrow = rows.select(*(e.cast("string").alias(f"k{i}") for i, e in enumerate(keys.values())), value.cast("double").alias("value")).filter("value is not null and not isnan(value)")
    leaves = _renamed(narrow.mapInArrow(_leaf(eps * LEAF_SHARE, len(names)), _schema(names, _TUPLES)), names)
    wide = rows.rdd.getNumPartitions()
    if wide > 64:
        fan = math.isqrt(wide)
        leaves = combine(leaves, names, eps * (1 + LEAF_SHARE) / 2, F.pmod(F.spark_partition_id(), F.lit(fan)))
    return combine(leaves, names, eps)


def _answers(probabilities: list[float], n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lists = np.asarray(batch.column(n_keys)), [batch.column(n_keys + 1 + i) for i in range(3)]
            if not len(n):
                continue
            at = np.asarray(lists[0].offsets)
            v, lo, hi = (np.asarray(x.values) for x in lists)
            columns, error = [], np.zeros(len(n), np.int64)
            exact = np.diff(at) == n
            for p in probabilities:
                rank = np.maximum(1, np.ceil(np.round(p * n, 6))).astype(np.int64)
                index = at[:-1] + rank - 1
                for r in np.flatnonzero(~exact):
                    off = np.maximum(rank[r] - lo[at[r] : at[r + 1]], hi[at[r] : at[r + 1]] - rank[r])
                    best = int(np.argmin(off))
                    index[r] = at[r] + best
                    error[r] = max(error[r], off[best])
                columns.append(pa.array(v[index]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n_keys)), pa.array(n), *columns, pa.array(error)], names=[f"c{i}" for i in range(n_keys + 2 + len(columns))])

    return run


def percentiles(summaries: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """key columns, n, one column per name in ``wanted``, rank_error: no value is further off its rank than that."""
    kinds = [*(f"c{i} string" for i in range(len(keys))), f"c{len(keys)} bigint", *(f"c{len(keys) + 1 + i} double" for i in range(len(wanted))), f"c{len(keys) + 1 + len(wanted)} bigint"]
    ordered = summaries.select(*keys, *_NAMES)
    return ordered.mapInArrow(_answers(list(wanted.values()), len(keys)), ", ".join(kinds)).toDF(*keys, "n", *wanted, "rank_error")
