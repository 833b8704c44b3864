"""Problem 3: the slices that are put together are the real loading days."""

from pyspark.sql import functions as F

from millrace.llm import quantiles
from millrace.llm import queries as Q

D = "/root/testdata/sf0.01"


def test_each_loading_day_has_a_summary_of_its_own(spark, monkeypatch):
    made, summarize = [], quantiles.summarize
    monkeypatch.setattr(quantiles, "summarize", lambda *a: made.append(summarize(*a)) or made[-1])
    got = {(r.key_kind, r.key): r for r in Q.p3_from_days(spark, D).collect()}
    paid = spark.read.parquet(f"{D}/db_employees.parquet").filter("salary is not null and not isnan(salary)")
    days = {r.d for r in paid.select(F.to_date("loaded_at").cast("string").alias("d")).distinct().collect()}
    assert {r.day for r in made[0].select("day").distinct().collect()} == days
    assert len(days) > 200
    assert {k: r.n for k, r in got.items()} == {(r.key_kind, r.key): r.n for r in Q.p3_percentiles(spark, D).collect()}
    assert all(r.rank_error <= Q.EPS * r.n for r in got.values())
