"""Problem 2 against plain counting, with chunks and partitions that cut keys and members apart."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.operators.keychunks import per_key, ranged

SCHEMA = "k string, member bigint, value double, kind string, number bigint"


def brute(rows):
    out = defaultdict(lambda: [0, set(), 0, 0.0])
    for k, m, v, *_ in rows:
        o = out[k]
        o[0] += 1
        if m is not None:
            o[1].add(m)
        if v is not None and v == v:
            o[2] += 1
            o[3] += v
    return {k: (n, len(m), c, round(s, 2) if c else None) for k, (n, m, c, s) in out.items()}


def test_against_counting(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, 1.5, 2.25, float("nan"), -3.0]), "x", 1) for _ in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for chunk, parts in ((1, 4), (7, 5), (10_000, 1)):
        got = per_key(df, {"k": F.col("k")}, "member", "value", chunk_rows=chunk, partitions=parts).collect()
        assert {r.key: tuple(r)[2:] for r in got} == brute(rows)


def test_edges(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert per_key(df, {"k": F.col("k")}, "member", "value").count() == 0
    one = spark.createDataFrame([(None, None, None, "c", 2)], SCHEMA)
    assert [tuple(r) for r in per_key(one, {"k": F.col("k")}, "member", "value").collect()] == [("k", None, 1, 0, 0, None)]


def test_a_hot_member_of_a_hot_key_is_split(spark):
    """One member holds 90 % of a key with nearly all rows, another key has null members only: partitions stay equal."""
    i = F.col("id")
    rows = spark.range(0, 200_000, numPartitions=4).select(
        F.when(i % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), i % 50)).alias("k"), F.when(i % 10 < 8, 7).when(i % 10 == 9, None).otherwise(i % 97).cast("bigint").alias("member"), (i % 5).cast("double").alias("value")
    )
    narrow = rows.select(F.lit("k").alias("kind"), F.col("k").alias("key"), "member", "value")
    sizes = sorted(r["count"] for r in ranged(narrow, 8).groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
    for chunk in (1000, 1_000_000):
        got = per_key(rows, {"k": F.col("k")}, "member", "value", chunk_rows=chunk, partitions=8).collect()
        assert {r.key: tuple(r)[2:] for r in got} == brute([tuple(r) for r in rows.collect()])

