"""Problem 6: the top N items of every group.

A histogram of the scores of each group gives a lower threshold that at least N different items are sure to reach: every
bin holds a bit map of hashed item ids, maps are or-ed from the best bin down, and the number of bits set never exceeds
the number of different items, however often an item is delivered. Rows below the threshold are dropped where they are
read; the survivors, few for a group of millions, are made unique and ranked exactly with the tie key.

Small groups need no threshold, so only groups of more than ``small`` rows have a histogram; their number is counted and, if
need be, cut to ``max_groups`` by a higher bound on the rows (the other groups are then ranked whole). That many may be broadcast.

Defined results: rows with a null group, item or score, or a NaN score, take no part; an item that is delivered repeatedly
counts once, with its highest score; equal scores are ordered by item, lowest first; a smaller group gives all it has; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.common import Cut

WORD = 64


def score_bin(score: Column, per_doubling: int = 16) -> Column:
    """A monotone bin: logarithmic on both sides of zero, so any range of scores has some thousand bins at most."""
    return F.floor(F.signum(score) * F.log2(1 + F.least(F.abs(score), F.lit(1e300))) * per_doubling).cast("int")


def large_groups(rows: DataFrame, small: int, max_groups: int) -> DataFrame:
    """The groups of more than ``small`` rows, at most ``max_groups`` of them (counted): then those above the mean share."""
    counts = Cut(rows.sparkSession, "topn")(rows.groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") > small))
    groups, total = counts.agg(F.count("*"), F.sum("n")).first()
    # fewer than max_groups groups can have more than total / max_groups rows
    return (counts if groups <= max_groups else counts.filter(F.col("n") > total // max_groups)).select("group")


def thresholds(rows: DataFrame, n: int, *, small: int = 2_000, max_groups: int = 1_000_000, per_doubling: int = 16) -> DataFrame:
    """group, floor: the lowest bin that can hold one of the group's first n items; only for groups of many rows.

    ``rows``: group, item, score.
    """
    words = max(1, -(-4 * n // WORD))
    slot = F.pmod(F.xxhash64("item"), F.lit(words * WORD))
    large = rows.join(F.broadcast(large_groups(rows, small, max_groups)), "group", "left_semi")
    bits = large.select("group", score_bin(F.col("score"), per_doubling).alias("bin"), F.floor(slot / WORD).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(WORD)).cast("int")).alias("bit"))
    # combined before the shuffle: what is left is groups x bins, not rows
    histogram = bits.groupBy("group", "bin").agg(*(F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0).cast("bigint")).alias(f"b{w}") for w in range(words)))
    down = Window.partitionBy("group").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    sure = sum((F.bit_count(F.bit_or(f"b{w}").over(down)) for w in range(words)), F.lit(0))
    return histogram.withColumn("sure", sure).filter(F.col("sure") >= n).groupBy("group").agg(F.max("bin").alias("floor"))


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int, **options) -> DataFrame:
    """group, item, score, rank (from 1) of the first n items of each group."""
    narrow = rows.select(F.col(group).alias("group"), F.col(item).alias("item"), F.col(score).alias("score")).filter("`group` is not null and item is not null and score is not null and not isnan(score)")
    floors = thresholds(narrow, n, **options)
    per_doubling = options.get("per_doubling", 16)
    left = narrow.join(F.broadcast(floors), "group", "left").filter(F.col("floor").isNull() | (score_bin(F.col("score"), per_doubling) >= F.col("floor")))
    unique = left.groupBy("group", "item").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "item"))
    return unique.withColumn("rank", rank).filter(F.col("rank") <= n).select(F.col("group").alias(group), F.col("item").alias(item), F.col("score").alias(score), "rank")
