"""Queries of the language-model operators (problems 3, 5, 6, 8, 9, 10) with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.common import table
from millrace.llm import addresses, packing, quantiles, residue, tokens, topn

CAPACITY = 2048
EPS = 0.005
WANTED = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}

# ---- problem 3


def _by_department_and_job(spark: SparkSession, d: str) -> DataFrame:
    employees = table(spark, d, "db_employees")
    pairs = F.array(F.struct(F.lit("department_id").alias("kind"), F.col("department_id").cast("string").alias("key")), F.struct(F.lit("job_id").alias("kind"), F.nullif(F.upper(F.trim("job_id")), F.lit("")).alias("key")))
    return employees.select(F.explode(pairs).alias("p"), "salary", F.to_date("loaded_at").alias("day")).select("p.kind", "p.key", "salary", "day")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = _by_department_and_job(spark, d)
    summaries = quantiles.summarize(rows, {"key_kind": F.col("kind"), "key": F.col("key")}, F.col("salary"), EPS)
    return quantiles.percentiles(summaries, ["key_kind", "key"], WANTED)


def p3_from_days(spark: SparkSession, d: str) -> DataFrame:
    """The same from summaries of single loading days, each made by itself and then put together, by month first."""
    rows = _by_department_and_job(spark, d)
    days = quantiles.summarize(rows, {"key_kind": F.col("kind"), "key": F.col("key"), "day": F.col("day")}, F.col("salary"), EPS / 2)
    months = quantiles.combine(days.withColumn("month", F.substring("day", 1, 7)), ["key_kind", "key", "month"], EPS * 3 / 4)
    return quantiles.percentiles(quantiles.combine(months, ["key_kind", "key"], EPS), ["key_kind", "key"], WANTED)


def p3_small_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of up to 150 values, whose percentiles are exact."""
    return p3_percentiles(spark, d).filter("n <= 150").drop("rank_error")


def p3_rank_errors(spark: SparkSession, d: str) -> DataFrame:
    """Whether every percentile of every group lies within eps * n ranks of the rank wanted, by counting all values."""
    values = _by_department_and_job(spark, d).filter("salary is not null").groupBy("kind", F.col("key").alias("k"), "salary").agg(F.count("*").alias("c"))
    found = p3_percentiles(spark, d)
    both = values.join(found, (F.col("kind") == F.col("key_kind")) & F.col("k").eqNullSafe(F.col("key")))
    sums = [x for name in WANTED for x in (F.sum(F.when(F.col("salary") < F.col(name), F.col("c")).otherwise(0)).alias(f"{name}_below"), F.sum(F.when(F.col("salary") <= F.col(name), F.col("c")).otherwise(0)).alias(f"{name}_upto"))]
    ranked = both.groupBy("key_kind", "key", "n").agg(*sums)

    def within(name: str, p: float):
        wanted = F.greatest(F.lit(1), F.ceil(F.round(p * F.col("n"), 6)))
        return ((wanted >= F.col(f"{name}_below") + 1 - EPS * F.col("n")) & (wanted <= F.col(f"{name}_upto") + EPS * F.col("n"))).alias(f"{name}_within")

    return ranked.select("key_kind", "key", "n", *(within(name, p) for name, p in WANTED.items()))


_P3_ERRORS_SQL = f"""
    WITH e AS (SELECT 'department_id' AS key_kind, CAST(department_id AS VARCHAR) AS key, salary FROM db_employees UNION ALL SELECT 'job_id', nullif(upper(trim(job_id)), ''), salary FROM db_employees)
    SELECT key_kind, key, count(*) AS n, {", ".join(f"true AS {name}_within" for name in WANTED)} FROM e WHERE salary IS NOT NULL GROUP BY 1, 2"""

_P3_SQL = f"""
    WITH e AS (SELECT 'department_id' AS key_kind, CAST(department_id AS VARCHAR) AS key, salary FROM db_employees UNION ALL SELECT 'job_id', nullif(upper(trim(job_id)), ''), salary FROM db_employees),
    r AS (SELECT *, row_number() OVER w AS rank, count(*) OVER (PARTITION BY key_kind, key) AS n FROM e WHERE salary IS NOT NULL WINDOW w AS (PARTITION BY key_kind, key ORDER BY salary))
    SELECT key_kind, key, n, {", ".join(f"max(CASE WHEN rank = greatest(1, ceil(round({p} * n, 6))) THEN salary END) AS {name}" for name, p in WANTED.items())} FROM r WHERE n <= 150 GROUP BY 1, 2, 3"""

# ---- problem 5


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = addresses.pairs_of(addresses.same_places(table(spark, d, "db_locations")))
    return pairs.select(F.col("id_a").alias("location_id_a"), F.col("id_b").alias("location_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each location that shares its place with another, with the place's number (the least location_id)."""
    groups = addresses.same_places(table(spark, d, "db_locations"))
    names = groups.groupBy("group").agg(F.min("id").alias("place_id"))
    return groups.join(names, "group").select(F.col("id").alias("location_id"), "place_id")


# ---- problem 6


def _best_paid(spark: SparkSession, d: str) -> DataFrame:
    paid = table(spark, d, "db_employees").filter("salary > 0")
    best = topn.top_n(paid, "department_id", "employee_id", "salary", 5)
    known = table(spark, d, "db_departments").select("department_id").distinct()
    return best.join(known, "department_id", "left_semi")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _best_paid(spark, d).select("department_id", "employee_id")


def p6_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _best_paid(spark, d).select("department_id", "employee_id", "salary", F.col("rank").cast("bigint").alias("rank"))


_P6 = """
    WITH e AS (SELECT department_id, employee_id, max(salary) AS salary FROM db_employees WHERE salary > 0 AND employee_id IS NOT NULL AND department_id IN (SELECT department_id FROM db_departments) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY department_id ORDER BY salary DESC, employee_id) AS rank FROM e)"""

# ---- problem 8


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


# ---- problem 9


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Each document's container, and of a text over 2,048 tokens each part's."""
    sizes = tokens.count_tokens(table(spark, d, "documents"))
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY).select("doc_id", "part", F.col("length").alias("n_tokens"), "container_id")


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of the packing: the documents in it, containers over their capacity, documents split though they fit."""
    placed = p9_containers(spark, d)
    full = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > CAPACITY).alias("n_over"))
    whole = placed.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("n"))
    return whole.agg(F.count("*").alias("n_documents"), F.count_if((F.col("parts") > 1) & (F.col("n") <= CAPACITY)).alias("n_split")).crossJoin(F.broadcast(full))


# ---- problem 10


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id").distinct()


def p10_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"))


QUERIES = {
    "p3_percentiles": p3_percentiles,
    "p3_from_days": p3_from_days,
    "p3_rank_errors": p3_rank_errors,
    "p3_small_groups": p3_small_groups,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_ranked": p6_ranked,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p9_checked": p9_checked,
    "p10_found": p10_found,
    "p10_kinds": p10_kinds,
}

SQL = {
    "p3_rank_errors": _P3_ERRORS_SQL,
    "p3_small_groups": _P3_SQL,
    "p9_checked": "SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS n_split, CAST(0 AS BIGINT) AS n_over FROM documents",
    "p6_found": f"{_P6} SELECT department_id, employee_id FROM r WHERE rank <= 5",
    "p6_ranked": f"{_P6} SELECT department_id, employee_id, salary, rank FROM r WHERE rank <= 5",
}
