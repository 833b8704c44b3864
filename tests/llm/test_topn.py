"""Problem 6 against sorting whole groups."""

import random
from collections import defaultdict

import pytest

from millrace.llm.topn import top_n

SCHEMA = "g string, item bigint, score double, `group` string, rank string"


def brute(rows, n):
    best = defaultdict(dict)
    for g, i, s, *_ in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g][i] = max(s, best[g].get(i, s))
    return {(g, i, s, r) for g, x in best.items() for r, (i, s) in enumerate(sorted(x.items(), key=lambda t: (-t[1], t[0]))[:n], 1)}


@pytest.mark.parametrize(("n", "small", "large"), [(1, 5, 100), (5, 20, 100), (5, 0, 1), (40, 10, 100), (5, 10**9, 10)])
def test_against_sorting(spark, n, small, large):
    rng = random.Random(n)
    scores = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.5, 1e-300, 7.0, 7.0, 7.0, 1e9]
    rows = [(rng.choice(["hot"] * 5 + ["b", "c", None]), rng.choice([None, *range(150)]), rng.choice([*scores, rng.uniform(-10, 10), rng.uniform(0, 1e6)]), "x", "y") for _ in range(3000)]
    rows += [("copies", 1, 5.0, "x", "y")] * 300 + [("copies", 2, 4.0, "x", "y")] * 3 + [("one", 9, 1.0, None, None)]
    got = top_n(spark.createDataFrame(rows, SCHEMA), "g", "item", "score", n, small=small, max_groups=large).collect()
    assert {tuple(r) for r in got} == brute(rows, n) and len(got) == len(brute(rows, n))


def test_empty(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), "g", "item", "score", 5).count() == 0
