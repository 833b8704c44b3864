"""ORDER BY over all rows of a table, in their order."""

import pytest
from tests.oracle import connect, plain

from millrace.queries import relational

D = "/root/testdata/sf0.001"
TABLES = {"order_by_multi_whole": "db_employees", "order_by_position_whole": "orders", "order_by_hidden_whole": "orders", "order_by_expression_whole": "lineitem"}


@pytest.mark.parametrize("name", ["order_by_multi_whole", "order_by_position_whole", "order_by_alias_whole", "order_by_hidden_whole", "order_by_expression_whole", "union_ordered_whole"])
def test_all_rows_come_in_order(spark, name):
    df = relational.QUERIES[name](spark, D)
    got = [plain(tuple(r)) for r in df.collect()]
    assert got == [plain(r) for r in connect(D).execute(relational.SQL[name]).fetchall()]
    assert len(got) > 40
    if name in TABLES:
        assert len(got) == spark.read.parquet(f"{D}/{TABLES[name]}.parquet").count()
    assert "TakeOrdered" not in df._jdf.queryExecution().executedPlan().toString()
