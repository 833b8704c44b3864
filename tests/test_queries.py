"""Every core query with a DuckDB text gives the same rows; the others run."""

import pytest
from tests.oracle import same

from millrace.queries import general, platform, relational

D = "/root/testdata/sf0.001"
QUERIES = {k: f for m in (relational, platform, general) for k, f in m.QUERIES.items()}
SQL = {k: s for m in (relational, platform, general) for k, s in m.SQL.items()}

#: Columns and rows at least of the queries without SQL; what they hold is tested in their own modules.
WITHOUT_SQL = {"explain_rows": (["plan_type", "plan"], 4), "p1_rejected": (["record_id", "feed", "reason"], 10), "p4_intervals": (["employee_id", "top_id", "entry", "exit"], 2000)}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, D)
    if name in SQL:
        same(df, SQL[name], D)
    else:
        names, least = WITHOUT_SQL[name]
        assert df.columns == names and df.count() >= least


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_core_does_not_need_the_llm_subpackage():
    from pathlib import Path

    import millrace

    for p in Path(millrace.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "millrace.llm" not in p.read_text(), p
