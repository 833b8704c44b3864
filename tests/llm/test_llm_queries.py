"""Queries of the subpackage on the smallest tables."""

import pytest

from millrace.llm import queries as Q
from tests.oracle import same

D = "/root/testdata/sf0.001"

_PERCENTILES = ["key_kind", "key", "n", *Q.WANTED, "rank_error"]
#: Columns and rows at least of the queries without SQL; what they hold is tested in their own modules.
WITHOUT_SQL = {
    "p3_percentiles": (_PERCENTILES, 20), "p3_from_days": (_PERCENTILES, 20), "p5_found": (["location_id_a", "location_id_b"], 20), "p5_groups": (["location_id", "place_id"], 40), "p8_ids": (["doc_id", "ids"], 100),
    "p9_containers": (["doc_id", "part", "n_tokens", "container_id"], 100), "p10_found": (["doc_id"], 3), "p10_kinds": (["doc_id", "kind"], 3),
}


@pytest.mark.parametrize("name", Q.QUERIES)
def test_query(spark, name):
    df = Q.QUERIES[name](spark, D)
    if name in Q.SQL:
        same(df, Q.SQL[name], D)
    else:
        names, least = WITHOUT_SQL[name]
        assert df.columns == names and df.count() >= least
