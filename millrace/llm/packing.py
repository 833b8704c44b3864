"""Problem 9: filling containers of fixed capacity with items that are not split.

Only the lengths decide what fits, and there are at most ``capacity`` different ones, so the plan is made from the table of
lengths and counts, whatever the number of items. Minimum bin slack: a container is begun with the longest length left; a
bit set of reachable sums over the lengths that remain finds the fill closest to the capacity, and the counts that give it
are traced back. The fill is used as often as the counts allow, then the next is sought. A fill is used until some length
has fewer left than the fill takes, so the number of fills depends on the lengths and not on the number of items.

Items of one length are numbered exactly by sliced prefix sums (a length that a third of all items share is split over many
tasks), and number and plan give the container.

An item longer than the capacity is cut into full containers and one rest, which is packed as any other item.

Defined results: items of length null, zero or below take no room: they go to a container chosen by a hash of their id
(container 0 if there is no other); ties and repeated rows are items of their own; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.common import Cut, sliced_prefix_sum

#: Ranks within a length stay below this.
_WIDE = 1 << 44


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of remaining lengths with the largest sum up to ``room``: length -> copies."""
    reach, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # length, copies, sums reachable before
    for n in lengths:  # longest first
        if n > room or not counts[n]:
            continue
        left, k = min(counts[n], room // n), 1
        while left:
            k = min(k, left)
            new = (reach | reach << (n * k)) & mask
            if new != reach:
                steps.append((n, k, reach))
                reach = new
            left -= k
            k *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + k
            at -= n * k
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Fills as (how many containers, length -> copies in each)."""
    counts = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(counts, reverse=True)
    fills = []
    first = 0
    while first < len(lengths):
        longest = lengths[first]
        if not counts[longest]:
            first += 1
            continue
        counts[longest] -= 1
        used = best_fill(lengths[first:], counts, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= times * k
        fills.append((times, used))
        lengths = [n for n in lengths[first:] if counts[n]]
        first = 0
    return fills


def _layout(fills: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each stretch of ranks of a length: where it starts (with the length), its first container, copies a container."""
    used: dict[int, int] = {}
    rows, container = [], 0
    for times, fill in fills:
        for n, k in fill.items():
            at = used.get(n, 0)
            rows.append((n * _WIDE + at, container, k))
            used[n] = at + times * k
        container += times
    rows.sort()
    start, first, copies = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    return start, first, copies, container


def _place(layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, first, copies, n = layout.value
        for batch in batches:
            length, rank, spare = (np.asarray(batch.column(i)) for i in (2, 3, 4))
            container = spare % max(n, 1)
            real = length > 0
            key = length[real] * _WIDE + rank[real]
            at = np.searchsorted(start, key, "right") - 1
            container[real] = first[at] + (key - start[at]) // copies[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(container)], names=["id", "part", "length", "container_id"])

    return run


def pack(items: DataFrame, key: str, length: str, capacity: int, slices: int | None = None) -> DataFrame:
    """key, part, length, container_id: one row per item, or per piece of an item longer than the capacity."""
    spark = items.sparkSession
    cut = Cut(spark, "packing")
    size = F.greatest(F.coalesce(F.col(length).cast("bigint"), F.lit(0)), F.lit(0))
    whole = items.select(F.col(key).alias("id"), size.alias("size"))
    parts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("size") / capacity).cast("bigint") - 1, F.lit(0)))
    pieces = whole.select("id", "size", F.explode(parts).alias("part"))
    pieces = cut(pieces.select("id", "part", F.least(F.col("size") - F.col("part") * capacity, F.lit(capacity)).cast("bigint").alias("length")))
    # at most `capacity` rows, whatever the number of items
    counts = {r[0]: r[1] for r in pieces.filter("length > 0").groupBy("length").count().collect()}
    layout = spark.sparkContext.broadcast(_layout(plan(counts, capacity)))
    # so many that no task numbers more than about a million items
    slices = slices or max(64, max(counts.values(), default=0) // 1_000_000)
    ranked = sliced_prefix_sum(pieces.withColumn("one", F.lit(1).cast("bigint")), ["length"], ["id", "part"], "one", "rank", slices)
    ready = ranked.select("id", "part", "length", F.col("rank").cast("bigint").alias("rank"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("spare"))
    kind = items.schema[key].dataType.simpleString()
    return ready.mapInArrow(_place(layout), f"id {kind}, part bigint, length bigint, container_id bigint").withColumnsRenamed({"id": key})
