"""One query per relational operator, as SQL text through the engine; the second text is DuckDB's where it differs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import dialect
from millrace.common import table
from millrace.context import EngineContext
from millrace.functions.aggregates import aggregate
from millrace.operators import median
from millrace.operators import relational as R

TABLES = "region nation customer supplier part orders lineitem events documents embeddings db_employees db_departments db_locations db_jobs db_countries raw_records items".split()


def engine(spark: SparkSession, d: str, sql: str) -> EngineContext:
    """An engine with the tables that a text names."""
    context = EngineContext(spark)
    words = {t.low for t in dialect.tokens(sql)}
    for t in TABLES:
        if t in words:
            context.register_parquet(t, f"{d}/{t}.parquet")
    return context


def text(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: engine(spark, d, sql).sql(sql)


#: name -> text, or (our text, DuckDB's text)
TEXTS: dict[str, str | tuple[str, str]] = {
    # scan, project
    "scan_parquet": "SELECT o_orderkey, o_totalprice FROM orders",
    "select_wildcard": "SELECT * FROM nation",
    "select_qualified_wildcard": "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "project_arithmetic": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS net, l_quantity / 4 AS quarter FROM lineitem",
    "project_modulo": "SELECT o_orderkey, o_orderkey % 7 AS rest FROM orders",
    "column_alias": "SELECT c_name AS who, c_acctbal AS balance FROM customer",
    "bitwise_operators": ("SELECT o_orderkey, o_orderkey & 7 AS a, o_orderkey | 1 AS o, o_orderkey ^ 5 AS x FROM orders", "SELECT o_orderkey, o_orderkey & 7 AS a, o_orderkey | 1 AS o, xor(o_orderkey, 5) AS x FROM orders"),
    "string_concat": "SELECT c_custkey, c_name || '/' || c_mktsegment AS tag FROM customer",
    "scalar_select": "SELECT 1 AS one, 2.5 * 2 AS five, 'x' AS letter, true AS yes",
    "derived_table": "SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) AS t WHERE n > 10",
    "derived_table_column_aliases": "SELECT a, b FROM (SELECT r_regionkey, r_name FROM region) AS t(a, b)",
    # predicates
    "filter_comparisons": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_orderkey <> 7 AND o_custkey < 900",
    "filter_and_or": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5 AND l_returnflag = 'R' OR l_discount > 0.09",
    "filter_in": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "filter_not_in": "SELECT employee_id, job_id FROM db_employees WHERE job_id NOT IN ('WH_ASC', 'CC_LED')",
    "filter_between": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 5 AND 10",
    "filter_not_between": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity NOT BETWEEN 5 AND 45",
    "filter_like": "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%D%'",
    "filter_not_like": "SELECT location_id, city FROM db_locations WHERE city NOT LIKE 'K%'",
    "filter_like_char_class": ("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE '[A-F]%' AND c_name NOT LIKE '%[^0-4]'", "SELECT c_custkey, c_mktsegment FROM customer WHERE regexp_full_match(c_mktsegment, '[A-F].*') AND NOT regexp_full_match(c_name, '.*[^0-4]')"),
    "filter_ilike": "SELECT location_id, city FROM db_locations WHERE city ILIKE 'kleg%'",
    "filter_nulls": "SELECT employee_id, salary FROM db_employees WHERE salary > 10000 OR manager_id = 0",
    "case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "case_searched_no_else": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 1 END AS big FROM orders",
    "case_simple": "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS code FROM lineitem",
    "cast_coercion": "SELECT CAST(r_regionkey AS DOUBLE) AS v FROM region UNION ALL SELECT s_acctbal FROM supplier",
    # joins
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_left": "SELECT e.employee_id, e.loaded_at, d.department_name FROM db_employees e LEFT JOIN (SELECT department_id, min(department_name) AS department_name FROM db_departments GROUP BY department_id) d ON e.department_id = d.department_id",
    "join_right": "SELECT c.country_id, l.n FROM (SELECT country_id, count(*) AS n FROM db_locations GROUP BY country_id) l RIGHT JOIN db_countries c ON l.country_id = c.country_id",
    "join_full": "SELECT d.department_id AS a, e.department_id AS b, e.n FROM (SELECT DISTINCT department_id FROM db_departments) d FULL JOIN (SELECT department_id, count(*) AS n FROM db_employees GROUP BY department_id) e ON d.department_id = e.department_id",
    "join_left_semi": ("SELECT i.item_id, i.item_name FROM items i LEFT SEMI JOIN documents d ON i.item_id = d.item_id", "SELECT i.item_id, i.item_name FROM items i SEMI JOIN documents d ON i.item_id = d.item_id"),
    "join_left_anti": ("SELECT d.doc_id FROM documents d LEFT ANTI JOIN items i ON i.item_id = d.item_id", "SELECT d.doc_id FROM documents d ANTI JOIN items i ON i.item_id = d.item_id"),
    "join_right_semi": ("SELECT d.doc_id FROM items i RIGHT SEMI JOIN documents d ON i.item_id = d.item_id", "SELECT d.doc_id FROM documents d SEMI JOIN items i ON i.item_id = d.item_id"),
    "join_right_anti": ("SELECT d.doc_id FROM items i RIGHT ANTI JOIN documents d ON i.item_id = d.item_id", "SELECT d.doc_id FROM documents d ANTI JOIN items i ON i.item_id = d.item_id"),
    "join_residual_filter": "SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20",
    "join_left_residual": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000",
    "join_theta": "SELECT a.n_name AS a, b.r_name AS b FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey",
    "join_theta_full": "SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM region a FULL JOIN region b ON a.r_regionkey > b.r_regionkey + 1",
    "join_using": "SELECT department_id, d.department_name, e.employee_id FROM db_employees e JOIN db_departments d USING (department_id)",
    "join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_comma": "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey",
    "join_self": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_three_way": "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey",
    # aggregates
    "agg_global": "SELECT count(*) AS n, round(sum(l_quantity), 4) AS q, round(avg(l_extendedprice), 4) AS a, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem",
    "agg_grouped": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS q, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_count_nulls": "SELECT department_id, count(*) AS n, count(salary) AS paid, count(manager_id) AS managed FROM db_employees GROUP BY department_id",
    "agg_sum_int": ("SELECT l_returnflag, sum(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag"),
    "agg_avg_mean": "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS a, round(mean(o_totalprice), 4) AS m FROM orders GROUP BY o_orderpriority",
    "agg_min_max": "SELECT c_nationkey, min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_name) AS first_name FROM customer GROUP BY c_nationkey",
    "agg_median": "SELECT l_returnflag, round(median(l_extendedprice), 4) AS m FROM lineitem GROUP BY l_returnflag",
    "agg_var": ("SELECT l_returnflag, round(var(l_quantity), 4) AS v, round(var_samp(l_quantity), 4) AS vs, round(var_pop(l_quantity), 4) AS vp FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(var_samp(l_quantity), 4) AS v, round(var_samp(l_quantity), 4) AS vs, round(var_pop(l_quantity), 4) AS vp FROM lineitem GROUP BY l_returnflag"),
    "agg_stddev": "SELECT l_returnflag, round(stddev(l_quantity), 4) AS s, round(stddev_samp(l_quantity), 4) AS ss, round(stddev_pop(l_quantity), 4) AS sp FROM lineitem GROUP BY l_returnflag",
    "agg_covar": ("SELECT l_returnflag, round(covar(l_quantity, l_discount), 6) AS c, round(covar_samp(l_quantity, l_tax), 6) AS cs, round(covar_pop(l_quantity, l_tax), 6) AS cp FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(covar_samp(l_quantity, l_discount), 6) AS c, round(covar_samp(l_quantity, l_tax), 6) AS cs, round(covar_pop(l_quantity, l_tax), 6) AS cp FROM lineitem GROUP BY l_returnflag"),
    "group_by_expression": "SELECT o_orderkey % 10 AS k, count(*) AS n FROM orders GROUP BY o_orderkey % 10",
    "group_by_position": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2",
    "group_by_alias": "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY flag",
    "having_alias": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12",
    "having_aggregate": "SELECT job_id, count(*) AS n FROM db_employees GROUP BY job_id HAVING max(salary) > 15000",
    "select_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "count_distinct": "SELECT department_id, count(DISTINCT job_id) AS jobs FROM db_employees GROUP BY department_id",
    "agg_covar_global": "SELECT round(covar_pop(l_quantity, l_tax), 6) AS c, round(stddev_pop(l_tax), 8) AS s FROM lineitem",
    "agg_filter": "SELECT department_id, count(*) FILTER (WHERE salary > 10000) AS high FROM db_employees GROUP BY department_id",
    "group_by_all": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    # sort, limit
    "order_by_multi": ("SELECT employee_id, salary, manager_id, loaded_at FROM db_employees ORDER BY salary, manager_id DESC, employee_id, loaded_at LIMIT 500", "SELECT employee_id, salary, manager_id, loaded_at FROM db_employees ORDER BY salary ASC NULLS FIRST, manager_id DESC NULLS LAST, employee_id, loaded_at LIMIT 500"),
    "order_by_position": "SELECT o_totalprice, o_orderkey FROM orders ORDER BY 1 DESC, 2 LIMIT 25",
    "order_by_alias": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20",
    "order_by_hidden": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30",
    "order_by_expression": "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice * (1 - l_discount) DESC, l_orderkey, l_linenumber LIMIT 15",
    "order_limit": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10",
    "limit_offset": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20",
    "offset_before_limit": ("SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 20 LIMIT 10", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20"),
    # set operations
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union_three_nested": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation) u GROUP BY k",
    "union_ordered": "SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier ORDER BY k DESC LIMIT 40",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT department_id FROM db_employees INTERSECT SELECT department_id FROM db_departments",
    "except": "SELECT department_id FROM db_employees EXCEPT SELECT department_id FROM db_departments",
    "intersect_all": "SELECT job_id FROM db_employees INTERSECT ALL SELECT job_id FROM db_jobs",
    "except_all": "SELECT country_id FROM db_locations EXCEPT ALL SELECT country_id FROM db_countries",
    # subqueries
    "scalar_subquery_uncorrelated": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)",
    "scalar_subquery_correlated": "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice > (SELECT 1.8 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "scalar_subquery_count": "SELECT i.item_id FROM items i WHERE 3 > (SELECT count(*) FROM documents d WHERE d.item_id = i.item_id)",
    "scalar_subquery_select_list": "SELECT n_name, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS customers FROM nation n",
    # extras that come with the engine
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT o_custkey, round(t, 2) AS t FROM big WHERE t > 1500000",
    "exists_subquery": "SELECT i.item_id FROM items i WHERE EXISTS (SELECT 1 FROM documents d WHERE d.item_id = i.item_id AND d.rating = 1)",
    "in_subquery": "SELECT doc_id FROM documents WHERE item_id IN (SELECT item_id FROM items WHERE brand IS NULL)",
    "window_rank": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders",
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
}

#: The ordered texts without their limit: all rows are sorted, where the limited ones only take the first.
ORDERED = ("order_by_multi", "order_by_position", "order_by_alias", "order_by_hidden", "order_by_expression", "union_ordered")
_whole = lambda sql: re.sub(r" LIMIT \d+$", "", sql)
TEXTS |= {f"{k}_whole": _whole(v) if isinstance(v, str) else tuple(map(_whole, v)) for k, v in ((k, TEXTS[k]) for k in ORDERED)}

# ---- the same operators as frames


def frame_right_semi(spark: SparkSession, d: str) -> DataFrame:
    items, documents = table(spark, d, "items").alias("i"), table(spark, d, "documents").alias("d")
    return R.right_semi(items, documents, F.col("i.item_id") == F.col("d.item_id")).select("doc_id")


def frame_like_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(R.like(F.col("p_type"), "[^PS]%")).select("p_partkey", "p_type")


def frame_statistics(spark: SparkSession, d: str) -> DataFrame:
    return R.statistics(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity").select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("sum", "mean", "median", "var_samp", "var_pop", "stddev_samp", "stddev_pop")), "count", "min", "max")


def exact_median(spark: SparkSession, d: str) -> DataFrame:
    """Medians by histogram search, for groups of any size."""
    return median.exact_median(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", small=100).withColumn("median", F.round("median", 4))


def frame_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(aggregate("var", "l_tax"), 6).alias("v"), F.round(aggregate("covar", "l_quantity", "l_tax"), 6).alias("c"))


def frame_matching_all(spark: SparkSession, d: str) -> DataFrame:
    return R.matching_all(table(spark, d, "db_employees").select("job_id"), table(spark, d, "db_jobs").select("job_id"))


def frame_missing_all(spark: SparkSession, d: str) -> DataFrame:
    return R.missing_all(table(spark, d, "db_locations").select("country_id"), table(spark, d, "db_countries").select("country_id"))


def enforced_limit(spark: SparkSession, d: str) -> DataFrame:
    sql = "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 1000"
    return R.enforce_limit(engine(spark, d, sql).sql(sql), 12)


def frame_page(spark: SparkSession, d: str) -> DataFrame:
    return R.page(table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey"), 7, 5)


QUERIES = {k: text(v if isinstance(v, str) else v[0]) for k, v in TEXTS.items()} | {
    "frame_right_semi": frame_right_semi,
    "frame_like_class": frame_like_class,
    "frame_statistics": frame_statistics,
    "exact_median": exact_median,
    "frame_aggregates": frame_aggregates,
    "frame_matching_all": frame_matching_all,
    "frame_missing_all": frame_missing_all,
    "enforced_limit": enforced_limit,
    "frame_page": frame_page,
}

SQL = {k: v if isinstance(v, str) else v[1] for k, v in TEXTS.items()} | {
    "frame_right_semi": "SELECT d.doc_id FROM documents d SEMI JOIN items i ON i.item_id = d.item_id",
    "frame_like_class": "SELECT p_partkey, p_type FROM part WHERE regexp_full_match(p_type, '[^PS].*')",
    "frame_statistics": "SELECT l_returnflag, round(sum(l_quantity), 4) AS sum, round(avg(l_quantity), 4) AS mean, round(median(l_quantity), 4) AS median, round(var_samp(l_quantity), 4) AS var_samp, round(var_pop(l_quantity), 4) AS var_pop, round(stddev_samp(l_quantity), 4) AS stddev_samp, round(stddev_pop(l_quantity), 4) AS stddev_pop, count(l_quantity) AS count, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY 1",
    "exact_median": "SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY 1, 2",
    "frame_aggregates": "SELECT l_linestatus, round(var_samp(l_tax), 6) AS v, round(covar_samp(l_quantity, l_tax), 6) AS c FROM lineitem GROUP BY 1",
    "frame_matching_all": "SELECT job_id FROM db_employees e WHERE EXISTS (SELECT 1 FROM db_jobs j WHERE j.job_id IS NOT DISTINCT FROM e.job_id)",
    "frame_missing_all": "SELECT country_id FROM db_locations l WHERE NOT EXISTS (SELECT 1 FROM db_countries c WHERE c.country_id IS NOT DISTINCT FROM l.country_id)",
    "enforced_limit": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 12",
    "frame_page": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 5",
}
