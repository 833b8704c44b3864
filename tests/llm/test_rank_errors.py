"""Problem 3: every group's percentiles, the hot ones' too, against exact ranks."""

import math
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import queries as Q

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["p3_percentiles", "p3_from_days"])
def test_every_group_is_within_its_rank_error(spark, name):
    values = defaultdict(list)
    for r in Q._by_department_and_job(spark, D).filter("salary is not null and not isnan(salary)").collect():
        values[r.kind, r.key].append(r.salary)
    got = Q.QUERIES[name](spark, D).collect()
    assert {(r.key_kind, r.key) for r in got} == set(values) and len(got) == len(values)
    for r in got:
        x = np.sort(values[r.key_kind, r.key])
        assert r.n == len(x) and r.rank_error <= Q.EPS * r.n
        for column, p in Q.WANTED.items():
            rank = max(1, math.ceil(round(p * len(x), 6)))
            low, high = np.searchsorted(x, r[column], "left") + 1, np.searchsorted(x, r[column], "right")
            assert low <= high and low - r.rank_error <= rank <= high + r.rank_error
    # groups whose summaries were compressed are among them
    assert sum(r.n for r in got if r.rank_error) > 0.3 * sum(r.n for r in got)
