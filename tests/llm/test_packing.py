"""Problem 9: nothing overflows, nothing is lost or split without need, little room is unused."""

import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing as P


def best_sum(lengths, room):
    reach = {0}
    for n in lengths:
        reach |= {s + n for s in reach if s + n <= room}
    return max(reach)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=14), st.integers(0, 40))
def test_fill_is_the_closest(lengths, room):
    counts = Counter(lengths)
    used = P.best_fill(sorted(counts, reverse=True), counts, room)
    assert all(used[n] <= counts[n] for n in used)
    assert sum(n * k for n, k in used.items()) == best_sum(lengths, room)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 1000), max_size=12))
def test_plan_uses_everything(counts):
    fills = P.plan(dict(counts), 50)
    got = Counter()
    for times, used in fills:
        assert times > 0 and sum(n * k for n, k in used.items()) <= 50
        for n, k in used.items():
            got[n] += times * k
    assert got == Counter(counts)


def test_frame(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 0, -2, 3, 3, 3, 10, 64, 65, 200, rng.randint(1, 64)]), "x") for i in range(1500)] + [(7, 5, "y"), (7, 5, "y"), (None, 9, "z")]
    got = P.pack(spark.createDataFrame(rows, "doc_id bigint, n int, container_id string"), "doc_id", "n", 64, slices=4).collect()
    room, parts = Counter(), defaultdict(list)
    for r in got:
        room[r.container_id] += r.length
        parts[r.doc_id].append((r.part, r.length))
    assert max(room.values()) <= 64
    for i, n, _ in rows[:1500]:
        if i != 7:
            n = max(n or 0, 0)
            assert sorted(parts[i]) == [(k, min(64, n - 64 * k)) for k in range(max(1, -(-n // 64)))]
    assert len(parts[7]) >= 3 and parts[None] == [(0, 9)]
    total = sum(max(n or 0, 0) for _, n, _ in rows)
    used = {c for c, n in room.items() if n}
    assert len(used) <= -(-total // 64) + 1 and set(room) == set(range(len(used)))


def test_edges(spark):
    schema = "doc_id bigint, n bigint"
    assert P.pack(spark.createDataFrame([], schema), "doc_id", "n", 64).count() == 0
    assert [tuple(r) for r in P.pack(spark.createDataFrame([(1, 0)], schema), "doc_id", "n", 64).collect()] == [(1, 0, 0, 0)]
