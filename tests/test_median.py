"""Exact medians by search against the built-in median."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.median import exact_median

SCHEMA = "g string, v double, n bigint, lo string"


@pytest.mark.parametrize("small", [0, 50, 10**9])
@pytest.mark.parametrize("bins", [2, 7, 2048])
def test_against_the_built_in(spark, small, bins):
    rng = random.Random(bins)
    kinds = {"hot": lambda: rng.gauss(0, 1e6), "ties": lambda: rng.choice([1.0, 2.0]), "wide": lambda: rng.choice([-1e300, 1e-300, 5.0, 1e308, float("inf"), float("-inf")]), None: lambda: rng.randint(0, 9), "two": lambda: 3.0}
    rows = [(g, float(f()), 1, "x") for g, f in kinds.items() for _ in range({"two": 2, "hot": 501}.get(g, 120))]
    rows += [("nan", float("nan"), 1, None)] * 60 + [("nan", 1.0, 1, None)] * 61 + [("none", None, 1, None), ("ties", None, 2, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.g: r["median"] for r in exact_median(df, ["g"], "v", small=small, bins=bins).collect()}
    expected = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert repr(sorted(got.items(), key=str)) == repr(sorted(expected.items(), key=str))


def test_edges(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_median(df, ["g"], "v", small=0).count() == 0
    some = spark.createDataFrame([("a", 1.0, 1, ""), ("a", 4.0, 1, "")], SCHEMA)
    assert [r["median"] for r in exact_median(some, [], "v", small=0).collect()] == [2.5]
