"""Problem 7: reasons, hot keys without broadcast, additive states."""

import datetime as dt

from millrace.operators import references as R

REFS = [R.Reference("child", "parent", "id", "parents", "code")]


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def tables(spark, children, parents):
    return {
        "child": spark.createDataFrame([(i, p, day(t), "x") for i, p, t in children], "id bigint, parent string, loaded_at timestamp_ntz, key string"),
        "parents": spark.createDataFrame([(c, day(t), day(d)) for c, t, d in parents], "code string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"),
    }


CHILDREN = [(1, "a", 5), (1, " A ", 9), (2, "b", 5), (3, "c", 5), (4, None, 5), (5, "  ", 5), (6, "zz", 5), (7, "d", 5), (8, "d", 50), (None, "zz", 1), (9, "e", None)]
PARENTS = [("A", 1, None), ("B", 1, 3), ("c", 1, 2), ("C", 4, None), ("d", 20, None), (None, 1, None), ("e", 3, None)]
EXPECTED = {(2, "deleted"), (6, "missing"), (7, "late"), (9, "late")}


def test_reasons_on_both_ways(spark):
    t = tables(spark, CHILDREN, PARENTS)
    for options in ({}, {"broadcast_rows": 0, "hot": 0, "salts": 3}, {"broadcast_rows": 0, "hot": 10}):
        got = R.broken_references(t, REFS, **options).collect()
        assert {(r.record_id, r.reason) for r in got} == EXPECTED and len(got) == len(EXPECTED)


def test_states_add_up(spark):
    t = tables(spark, CHILDREN, PARENTS)
    changes = R.deltas(t, REFS)
    whole = R.key_states(changes)
    parts = R.merge_states(R.key_states(changes.filter("d_refs = 1")), R.key_states(changes.filter("d_refs = 0 and d_live = 1")), R.key_states(changes.filter("d_live = -1")))
    order = ["target", "key", "refs", "rows", "live", "first_ref", "first_row", "undated"]
    assert sorted(map(str, whole.select(order).collect())) == sorted(map(str, parts.select(order).collect()))
    assert {r.key for r in R.orphans(whole).collect()} == {"B", "ZZ"}


def test_report_and_empty(spark):
    t = tables(spark, CHILDREN, PARENTS)
    rows = {(r.month, r.reason): r.n_references for r in R.report(R.broken_references(t, REFS)).collect()}
    assert rows == {("2024-01", "deleted"): 1, ("2024-01", "missing"): 1, ("2024-01", "late"): 1, (None, "late"): 1}
    empty = tables(spark, [], [])
    assert R.broken_references(empty, REFS).count() == 0
    assert R.broken_references({"child": t["child"], "parents": empty["parents"]}, REFS).count() == 7
