"""Problem 3 against sorting: every value is within the rank error it states, which is within the permitted one."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import quantiles as Q

WANTED = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}


def check(rows, values, eps):
    for r in rows:
        x = sorted(values[r["key"]])
        assert r["n"] == len(x) and r["rank_error"] <= eps * len(x)
        for name, p in WANTED.items():
            rank = max(1, math.ceil(round(p * len(x), 6)))
            low, high = np.searchsorted(x, r[name], "left") + 1, np.searchsorted(x, r[name], "right")
            assert low <= high and (low - r["rank_error"] <= rank <= high + r["rank_error"])


def data(n, seed):
    rng = random.Random(seed)
    rows, values = [], defaultdict(list)
    for _ in range(n):
        k = rng.choice(["hot"] * 8 + ["a", "b", None])
        v = rng.choice([None, float("nan"), 0.0, float("inf"), -5.0, *[rng.gauss(0, 100) for _ in range(8)], 7.0])
        rows.append((k, v, rng.randrange(5), "x"))
        if v is not None and v == v:
            values[k].append(v)
    return rows, values


@pytest.mark.parametrize(("eps", "parts"), [(0.05, 1), (0.02, 7), (0.01, 80)])
def test_against_sorting(spark, monkeypatch, eps, parts):
    rows, values = data(6000, 2)
    df = spark.createDataFrame(rows, "k string, v double, day int, n string").repartition(parts)
    s = Q.summarize(df, {"key": F.col("k")}, F.col("v"), eps)
    got = Q.percentiles(s, ["key"], WANTED).collect()
    assert {r.key for r in got} == set(values)
    check(got, values, eps)
    assert max(len(r.v) for r in s.collect()) < 12 / eps


def test_slices_put_together(spark):
    rows, values = data(5000, 3)
    df = spark.createDataFrame(rows, "k string, v double, day int, n string")
    days = Q.summarize(df, {"key": F.col("k"), "day": F.col("day")}, F.col("v"), 0.01)
    check(Q.percentiles(Q.combine(days, ["key"], 0.02), ["key"], WANTED).collect(), values, 0.02)


def test_empty(spark):
    df = spark.createDataFrame([("a", None), ("b", float("nan"))], "k string, v double")
    for x in (df, df.limit(0)):
        assert Q.percentiles(Q.summarize(x, {"key": F.col("k")}, F.col("v")), ["key"], WANTED).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), min_size=1, max_size=30), min_size=1, max_size=6), st.integers(0, 6))
def test_ranks_stay_within_their_bounds(parts, gap):
    """Merging and compressing keeps lo <= a rank of the value <= hi."""
    summaries = []
    for p in parts:
        v, ranks = np.sort(np.array(p, float)), np.arange(1, len(p) + 1)
        summaries.append(Q.compress((v, ranks, ranks), gap))
    v, lo, hi = Q.compress(Q.merge_all(summaries), gap)
    whole = np.sort(np.concatenate([np.array(p, float) for p in parts]))
    assert v[0] == whole[0] and v[-1] == whole[-1]
    for x, a, b in zip(v, lo, hi):
        first, last = np.searchsorted(whole, x, "left") + 1, np.searchsorted(whole, x, "right")
        assert a <= last and b >= first and 1 <= a <= b <= len(whole)
