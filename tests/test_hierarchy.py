"""Problem 4 against walking every chain of managers."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import hierarchy

SCHEMA = "employee_id bigint, manager_id bigint, path string, root string"


def brute(rows):
    links: dict = {}
    for e, m, *_ in rows:
        if e is not None:
            known = [x for x in (links.get(e), m) if x is not None]
            links[e] = min(known) if known else None
    cycles = set()
    for e in links:
        x, seen = links[e], set()
        while x in links and x not in seen and x != e:
            seen.add(x)
            x = links[x]
        if x == e:
            cycles.add(e)
    out = {}
    for e in links:
        path = [e]
        while path[-1] not in cycles and links[path[-1]] in links:
            path.append(links[path[-1]])
        path.reverse()
        out[e] = (path[0], len(path) - 1, path, e in cycles, path[0] in cycles and e not in cycles)
    return cycles, out


CASES = {
    "empty": [],
    "one": [(1, None)],
    "self": [(1, 1), (2, 1), (3, 9)],
    "chain": [(i, i - 1) for i in range(1, 60)],
    "ring": [(i, (i + 1) % 20) for i in range(20)] + [(100 + i, i) for i in range(20)],
    "nulls and repeats": [(None, 3), (1, None), (1, None), (2, 1), (2, 1), (3, 0), (4, 3), (4, 3), (5, 777)],
    "tails": [(i, i - 1) for i in range(1, 40)] + [(0, 0)] + [(100 + i, 99 + i) for i in range(1, 40)] + [(100, 139 - 37)] + [(200 + i, None) for i in range(5)],
    "two parents": [(1, None), (2, None), (3, 2), (3, 1)],
    "hot manager": [(1, None)] + [(i, 1) for i in range(2, 300)] + [(1000 + i, 2 + i) for i in range(50)],
}


@pytest.mark.parametrize(("name", "small", "chunk", "hot"), [*((n, 40, 7, 3) for n in ("chain", "hot manager", "random")), *((n, 1 << 18, 100_000, 1_000_000) for n in [*CASES, "random"])])
def test_against_walking(spark, name, small, chunk, hot):
    """Small settings contract the tour in rounds, cut the sweep into many chunks and salt every parent."""
    rng = random.Random(3)
    rows = CASES.get(name) if name != "random" else [(i, rng.choice([None, 0, rng.randrange(400)])) for i in range(1, 400)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    forest = hierarchy.Forest(df, "employee_id", "manager_id", slices=4, small=small, chunk=chunk, hot=hot)
    cycles, expected = brute(rows)
    assert {r.id for r in forest.on_cycles().collect()} == cycles
    nodes = forest.nodes().collect()
    assert {r.id: (r.root, r.depth, r.path, r.on_cycle, r.below_cycle) for r in nodes} == expected
    below = Counter(a for _, _, path, *_ in expected.values() for a in path[:-1])
    at = {r.id: r for r in nodes}
    assert len({(r.root, r.entry) for r in nodes}) == len(nodes)
    for r in nodes:
        assert r.n_below == below[r.id]
        inside = {x.id for x in nodes if x.root == r.root and r.entry < x.entry <= r.exit} if len(nodes) < 100 else None
        assert inside is None or inside == {x for x, (_, _, p, *_) in expected.items() if r.id in p[:-1]}
        assert all(at[a].entry <= r.entry <= at[a].exit for a in r.path)
    if nodes:
        got = {(r.ancestor, r.id): r.distance for r in forest.descendants().collect()}
        assert got == {(a, e): len(p) - 1 - i for e, (_, _, p, *_) in expected.items() for i, a in enumerate(p[:-1])}
        some = {(r.ancestor, r.id) for r in forest.descendants(F.col("id") % 3 == 0).collect()}
        assert some == {(a, e) for a, e in got if a % 3 == 0}


def test_the_query_has_the_people_below_every_employee(spark):
    from millrace.queries import general

    d = "/root/testdata/sf0.001"
    n_below = {r.employee_id: r.n_below for r in general.QUERIES["p4_hierarchy"](spark, d).collect() if r.n_below}
    pairs = general.QUERIES["p4_below"](spark, d).collect()
    assert Counter(r.manager_id for r in pairs) == n_below
    assert len({(r.manager_id, r.employee_id) for r in pairs}) == len(pairs)
    assert any(m % 100 for m in n_below)
