"""Exact medians of groups of any size.

The built-in median gathers the values of a group in one task, which is best for up to a million rows or so. Groups of more
than ``small`` rows are searched instead: a histogram over the range in which the wanted rank lies is counted where the rows
are read, the bin that holds the rank becomes the next range, and so on until the value of the rank stands alone. Every
round is one scan with partial counts of ``bins`` rows a group; a few rounds do for any number of rows.

Defined results: nulls are left out, NaN is above all other values, an even number of values gives the mean of the middle two;
a group without values has none and gives null; a null key is a group of its own; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.common import Cut


def exact_median(rows: DataFrame, keys: list[str], value: str, *, small: int = 1_000_000, bins: int = 2048, max_groups: int = 200_000) -> DataFrame:
    """keys and ``median``. At most ``max_groups`` large groups (counted) are searched; the bound on ``small`` is raised beyond."""
    cut = Cut(rows.sparkSession, "median")
    k = [f"k{i}" for i in range(len(keys))]
    narrow = rows.select(*(F.col(c).alias(a) for c, a in zip(keys, k)), F.col(value).cast("double").alias("v"))
    sizes = cut(narrow.groupBy(*k).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    large, total = sizes.filter(F.col("n") > small).agg(F.count("*"), F.sum("n")).first()
    if large > max_groups:  # fewer than max_groups groups can be larger than that
        small = total // max_groups
        large = sizes.filter(F.col("n") > small).count()
    heavy = sizes.filter(F.col("n") > small)
    if not large:
        return narrow.groupBy(*k).agg(F.median("v").alias("median")).toDF(*keys, "median")

    def on(other: DataFrame, prefix: str) -> DataFrame:
        return other.withColumnsRenamed({c: f"{prefix}{c}" for c in k})

    def same(prefix: str):
        return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in k), F.lit(True))

    # the wanted ranks: one for an odd number of values, two for an even one
    ranks = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)))
    search = cut(heavy.select(*k, "n", "lo", "hi", F.explode(ranks).alias("at")).withColumn("rank", F.col("at")))
    width = (F.col("hi") - F.col("lo")) / bins
    # infinities and NaN have bins of their own at the ends, and a range that overflows is halved at zero
    inner = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))
    place = F.when(F.col("v") == F.col("lo"), -1).when(F.col("v") == F.col("hi"), bins).when(F.isnan(width) | (width == float("inf")), F.when(F.col("v") < 0, 0).when(F.col("v") < 1e300, 1).otherwise(2)).otherwise(F.coalesce(inner, F.lit(0)))
    while search.filter("lo <> hi").limit(1).count():
        open_ = on(search.filter("lo <> hi").select(*k, "lo", "hi", "at", "rank"), "s_")
        seen = narrow.join(F.broadcast(open_), same("s_") & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        counts = seen.withColumn("bin", place.cast("int")).groupBy(*k, "at", "rank", "bin").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = Window.partitionBy(*k, "at").orderBy("bin")
        counts = counts.withColumn("upto", F.sum("c").over(upto)).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
        found = counts.select(*k, F.col("c").alias("n"), "lo", "hi", "at", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"))
        search = cut(search.filter("lo = hi").select(found.columns).unionByName(found))
    high = search.groupBy(*k).agg(F.avg("lo").alias("median"))
    if not keys:  # one group, and it was searched
        return high
    names = on(heavy.select(*k), "h_")
    low = narrow.join(F.broadcast(names), same("h_"), "left_anti").groupBy(*k).agg(F.median("v").alias("median"))
    return low.unionByName(high).toDF(*keys, "median")
