"""Relational operators as frames: what has no method of its own in the DataFrame API."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.dialect import like_regex
from millrace.plans.explain import enforce_limit  # noqa: F401


def right_semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """The rows of ``right`` that have a partner; its columns."""
    return right.join(left, on, "left_semi")


def right_anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """The rows of ``right`` without a partner; its columns."""
    return right.join(left, on, "left_anti")


def like(column: Column, pattern: str, ignore_case: bool = False) -> Column:
    """LIKE with character classes; without one the built-in operator, which can be pushed into a scan."""
    if "[" in pattern:
        return column.rlike(("(?i)" if ignore_case else "") + like_regex(pattern))
    return column.ilike(pattern) if ignore_case else column.like(pattern)


def _same(left: DataFrame, right: DataFrame) -> tuple[DataFrame, Column]:
    if len(left.columns) != len(right.columns):
        raise ValueError("the branches of a set operation have different numbers of columns")
    renamed = right.toDF(*(f"__r{i}" for i in range(len(right.columns))))
    return renamed, reduce(lambda a, b: a & b, (left[c].eqNullSafe(renamed[f"__r{i}"]) for i, c in enumerate(left.columns)))


def matching_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of ``left``, duplicates included, that is in ``right``; nulls match."""
    return left.join(*_same(left, right), "left_semi")


def missing_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of ``left``, duplicates included, that is not in ``right``; nulls match."""
    return left.join(*_same(left, right), "left_anti")


def union_all(*frames: DataFrame, strict: bool = False) -> DataFrame:
    """By position; ``strict`` demands equal types instead of widening them."""
    if strict and len({tuple(f.dataType for f in x.schema) for x in frames}) != 1:
        raise TypeError("the branches of the union have different types")
    return reduce(DataFrame.union, frames)


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def statistics(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Count, sum, mean, extremes, median and both kinds of variance and deviation per group."""
    c = F.col(column)
    return df.groupBy(*keys).agg(
        F.count(c).alias("count"), F.sum(c).alias("sum"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), F.median(c).alias("median"),
        F.var_samp(c).alias("var_samp"), F.var_pop(c).alias("var_pop"), F.stddev_samp(c).alias("stddev_samp"), F.stddev_pop(c).alias("stddev_pop"),
    )
