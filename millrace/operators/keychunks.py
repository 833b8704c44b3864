"""Problem 2: per-key results when a few keys hold most rows.

Exact offset chunking. Rows are ranged by (key, member, tie) into input partitions of equal size; a hot key is split over many
of them, and so is a hot member of a key, since the tie tells its rows apart. Each partition is written once as a sorted file
in which every row has its place within its key, so the numbers stay the same however often a later task is run. The keys are
counted per input partition; the prefix sums of a key's counts are its offsets, and offset plus place numbers the rows of every
key exactly from 0 on, whichever task reads them. A streaming pass cuts each key at every ``chunk_rows`` of these numbers and
reduces the chunk to a state (rows, runs of members, first and last member, sums). The states of a key are merged in order: a
run that goes over a boundary is counted once.

No task ever holds a hot key or member: the largest holds one input partition, and a key's merge sees one state a chunk and split.

Defined results: a null key is a key of its own; null members count as rows and not as members; a null or NaN value is
left out of sum and count of values; repeated rows count as rows and once as members; an empty table gives no rows.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.common import Cut

_STATE = "kind string, key string, chunk bigint, first_row bigint, n bigint, n_values bigint, total double, runs bigint, first_member bigint, last_member bigint"


def _merge(a: list, b: list) -> list:
    """The state of two neighbouring pieces of one chunk."""
    over = a[9] is not None and a[9] == b[8]
    return [*a[:4], a[4] + b[4], a[5] + b[5], a[6] + b[6], a[7] + b[7] - over, b[8] if a[8] is None else a[8], a[9] if b[9] is None else b[9]]


def _states(chunk_rows: int):
    """Reduces ordered rows (kind, key, member, value, number) to chunk states; only one state is held over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            kind, key, member, value = (batch.column(i) for i in range(4))
            number = np.asarray(batch.column(4))
            known, who = np.asarray(member.is_valid()), np.asarray(member.fill_null(0))
            amount = np.asarray(value.fill_null(float("nan")))
            good = ~np.isnan(amount)
            chunk = number // chunk_rows
            change = np.r_[True, (chunk[1:] != chunk[:-1]) | (number[1:] != number[:-1] + 1)]
            for x in (kind, key):
                codes = np.asarray(x.dictionary_encode().indices.fill_null(-1))
                change[1:] |= codes[1:] != codes[:-1]
            cut = np.flatnonzero(change)
            ends = np.r_[cut[1:], n] - 1
            fresh = known.copy()  # rows that begin a run of their member in their piece
            fresh[1:] &= change[1:] | ~known[:-1] | (who[1:] != who[:-1])
            # members are ordered, nulls first: the last row has one if any has
            first = np.minimum.reduceat(np.where(fresh, np.arange(n), n - 1), cut)
            none = ~known[ends]
            columns = [
                kind.take(pa.array(cut)), key.take(pa.array(cut)), pa.array(chunk[cut]), pa.array(number[cut]), pa.array(ends - cut + 1),
                pa.array(np.add.reduceat(good.astype(np.int64), cut)), pa.array(np.add.reduceat(np.where(good, amount, 0.0), cut)),
                pa.array(np.add.reduceat(fresh.astype(np.int64), cut)), pa.array(who[first], mask=none), pa.array(who[ends], mask=none),
            ]
            rows = [[c[i].as_py() for c in columns] for i in {0, len(cut) - 1}]
            if held and held[:3] == rows[0][:3] and held[3] + held[4] == rows[0][3]:
                rows[0] = _merge(held, rows[0])
                held = None
            out = [held] if held else []
            if len(cut) > 1:
                out.append(rows[0])
                yield pa.RecordBatch.from_arrays([c.slice(1, len(cut) - 2) for c in columns], names=_NAMES)
            held = rows[-1]
            if out:
                yield _batch(out)
        if held:
            yield _batch([held])

    return run


_NAMES = [x.split()[0] for x in _STATE.split(", ")]


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*rows), _STATE.split(", "))], names=_NAMES)


#: Rows of one key and member are told apart by so many ties.
TIES = 4096

_PLACED = "kind string, key string, member bigint, value double, place bigint"


def ranged(narrow: DataFrame, partitions: int) -> DataFrame:
    """kind, key, member, value in sorted partitions of about equal size, whatever repeats how often."""
    tied = narrow.withColumn("tie", F.pmod(F.monotonically_increasing_id(), F.lit(TIES)).cast("int"))
    order = ["kind", "key", "member", "tie"]
    return tied.repartitionByRange(partitions, *order).sortWithinPartitions(*order).drop("tie")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's place within its key in this partition, from 0 on; the rows come sorted by kind and key."""
    last, reached = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        change[0] = True
        for i in (0, 1):
            codes = np.asarray(batch.column(i).dictionary_encode().indices.fill_null(-1))
            change[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(change)
        place = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
        first, final = ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()) for i in (0, n - 1))
        if first == last:
            place[: starts[1] if len(starts) > 1 else n] += reached
        last, reached = final, int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=["kind", "key", "member", "value", "place"])


def per_key(rows: DataFrame, keys: dict[str, Column], member: str, value: str, *, chunk_rows: int = 1_000_000, partitions: int | None = None) -> DataFrame:
    """Rows, distinct members and sum of values for every key of every kind in ``keys`` (kind: expression of the key).

    Result: key_kind, key (as text), n_rows, n_members, n_values, value_sum. All kinds go through one shuffle of narrow rows.
    """
    spark = rows.sparkSession
    cut = Cut(spark, "keychunks")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), e.cast("string").alias("key")) for k, e in keys.items()))
    narrow = rows.select(F.explode(pairs).alias("__p"), F.col(member).cast("bigint").alias("member"), F.col(value).cast("double").alias("value")).select("__p.kind", "__p.key", "member", "value")
    parts = cut(ranged(narrow, partitions).mapInArrow(_places, _PLACED).withColumn("pid", F.spark_partition_id()))

    # keys per input partition; the prefix sums of a key's counts are its offsets. Partitions are ranges, so only the first
    # key of a partition can have rows in an earlier one: there is at most one offset above zero a partition
    counts = parts.groupBy("pid", "kind", "key").agg(F.count("*").alias("n"))
    before = Window.partitionBy("kind", "key").orderBy("pid")
    offsets = counts.withColumn("offset", F.sum("n").over(before) - F.col("n")).filter("offset > 0")
    offsets = offsets.select(F.col("pid").alias("o_pid"), F.col("kind").alias("o_kind"), F.col("key").alias("o_key"), "offset")
    same = (F.col("pid") == F.col("o_pid")) & (F.col("kind") == F.col("o_kind")) & F.col("key").eqNullSafe(F.col("o_key"))
    numbered = parts.join(F.broadcast(offsets), same, "left").select("kind", "key", "member", "value", (F.col("place") + F.coalesce("offset", F.lit(0))).alias("number"))
    states = numbered.mapInArrow(_states(chunk_rows), _STATE)

    order = Window.partitionBy("kind", "key").orderBy("first_row")
    merged = states.withColumn("over", (F.lag("last_member").over(order) == F.col("first_member")).cast("int"))
    return merged.groupBy(F.col("kind").alias("key_kind"), "key").agg(
        F.sum("n").alias("n_rows"),
        (F.sum("runs") - F.coalesce(F.sum("over"), F.lit(0))).alias("n_members"),
        F.sum("n_values").alias("n_values"),
        F.when(F.sum("n_values") > 0, F.round(F.sum("total"), 2)).alias("value_sum"),
    )
