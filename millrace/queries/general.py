"""Queries of the general data-processing problems (1, 2, 4, 7) with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.common import Cut, table
from millrace.operators import hierarchy, keychunks, records, references

# ---- problem 1


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return records.parse_records(table(spark, d, "raw_records"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return records.rejected(_parsed(spark, d)).select("record_id")


def p1_rejected(spark: SparkSession, d: str) -> DataFrame:
    return records.rejected(_parsed(spark, d))


def p1_employees(spark: SparkSession, d: str) -> DataFrame:
    return records.typed(_parsed(spark, d), "db_employees")


def p1_locations(spark: SparkSession, d: str) -> DataFrame:
    return records.typed(_parsed(spark, d), "db_locations")


def _bad_records_sql() -> str:
    """The contract as one regular expression a feed; existing calendar days by a cast. Nothing stands outside a value's quotes."""
    free = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'
    wrap = lambda x: rf'(?:" *{x} *"| *{x} *)'
    digits, day, salary = wrap("[0-9]+"), wrap("(?:[0-9]{4}-[0-9]{2}-[0-9]{2})?"), wrap(r"(?:[0-9]+(?:\.[0-9]+)?)?")
    employee = ",".join([digits, *[free] * 4, day, free, salary, *[free] * 3])
    location = ",".join([digits, *[free] * 5])
    street = rf"^(?:{digits}),({free}),(?:{free}),(?:{free}),(?:{free}),(?:{free})$"
    the_day = rf"^(?:{digits})(?:,{free}){{4}},({day}),"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"""
        WITH r AS (SELECT record_id, feed, regexp_replace(raw_line, '\\r\\z', '') AS x FROM raw_records),
        s AS (
            SELECT record_id, CASE
                WHEN x IS NULL THEN false
                WHEN feed = 'db_employees' THEN regexp_full_match(x, {quoted(employee)})
                    AND (trim(regexp_extract(x, {quoted(the_day)}, 1), ' "') = '' OR (TRY_CAST(trim(regexp_extract(x, {quoted(the_day)}, 1), ' "') AS DATE) IS NOT NULL
                        AND trim(regexp_extract(x, {quoted(the_day)}, 1), ' "') NOT LIKE '0000%'))
                WHEN feed = 'db_locations' THEN regexp_full_match(x, {quoted(location)})
                    AND regexp_matches(regexp_extract(x, {quoted(street)}, 1), '\\p{{L}}')
                    AND NOT regexp_matches(regexp_extract(x, {quoted(street)}, 1), '[\\x00-\\x09\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}\\x{{fffd}}]')
                ELSE false END AS good FROM r)
        SELECT record_id FROM s WHERE NOT good"""


def _typed_records_sql(feed: str) -> str:
    """The valid records of a feed, taken apart by one regular expression, unquoted and cast."""
    free = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'
    names = [c for c, _ in records.FEEDS[feed]]
    pattern = ",".join(f"({free})" for _ in names).replace("'", "''")
    columns = []
    for name, kind in records.FEEDS[feed]:
        raw = f"trim(v.{name}, ' ')"
        text = f"nullif(CASE WHEN {raw} LIKE '\"%' THEN trim(replace(substr({raw}, 2, length({raw}) - 2), '\"\"', '\"'), ' ') ELSE {raw} END, '')"
        if kind == "bigint":
            text = f"CASE WHEN regexp_full_match({text}, '[+-]?[0-9]+') THEN TRY_CAST({text} AS BIGINT) END"
        elif kind != "string":
            text = f"TRY_CAST({text} AS {kind.upper()})"
        columns.append(f"{text} AS {name}")
    listed = ", ".join(f"'{n}'" for n in names)
    return f"""
        SELECT record_id, {", ".join(columns)} FROM (
            SELECT record_id, regexp_extract(regexp_replace(raw_line, '\\r\\z', ''), '^{pattern}$', [{listed}]) AS v FROM raw_records
            WHERE feed = '{feed}' AND record_id NOT IN ({_bad_records_sql()}))"""


# ---- problem 2


def p2_per_key(spark: SparkSession, d: str) -> DataFrame:
    keys = {"department_id": F.col("department_id"), "job_id": F.nullif(F.upper(F.trim("job_id")), F.lit(""))}
    return keychunks.per_key(table(spark, d, "db_employees"), keys, "employee_id", "salary")


_P2_SQL = """
    SELECT kind AS key_kind, k AS key, count(*) AS n_rows, count(DISTINCT employee_id) AS n_members, count(salary) AS n_values, round(sum(salary), 2) AS value_sum
    FROM (SELECT 'department_id' AS kind, CAST(department_id AS VARCHAR) AS k, employee_id, salary FROM db_employees
          UNION ALL SELECT 'job_id', nullif(upper(trim(job_id)), ''), employee_id, salary FROM db_employees)
    GROUP BY 1, 2"""

# ---- problem 4


def _forest(spark: SparkSession, d: str) -> hierarchy.Forest:
    return hierarchy.Forest(table(spark, d, "db_employees"), "employee_id", "manager_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _forest(spark, d).on_cycles().select(F.col("id").alias("employee_id"))


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    nodes = _forest(spark, d).nodes()
    return nodes.select(F.col("id").alias("employee_id"), F.col("root").alias("top_id"), "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "n_below", "on_cycle", "below_cycle")


def p4_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Entry and exit of every employee in the tour of their tree: all people below have an entry in (entry, exit]."""
    return _forest(spark, d).nodes().select(F.col("id").alias("employee_id"), F.col("root").alias("top_id"), "entry", "exit")


def p4_nesting(spark: SparkSession, d: str) -> DataFrame:
    """How far each employee's interval reaches, and whether it lies inside the manager's: no two of one tree cross."""
    all_ = _forest(spark, d).intervals()
    up = all_.select(F.col("id").alias("up"), F.col("at").alias("u_at"), F.col("last").alias("u_last"))
    inside = (F.col("at") > F.col("u_at")) & (F.col("last") <= F.col("u_last"))
    return all_.join(up, "up", "left").select(F.col("id").alias("employee_id"), (F.col("last") - F.col("at")).alias("reach"), inside.alias("inside_manager"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All people below the employees whose id is divisible by 100 only, as its SQL has it; ``p4_below`` has every employee's."""
    return _pairs(_forest(spark, d).descendants(F.col("id") % 100 == 0))


def p4_below(spark: SparkSession, d: str) -> DataFrame:
    """All people below each employee, one row a pair."""
    return _pairs(_forest(spark, d).descendants())


def _pairs(below: DataFrame) -> DataFrame:
    return below.select(F.col("ancestor").alias("manager_id"), F.col("id").alias("employee_id"), "distance")


_LINKS = "WITH RECURSIVE l AS (SELECT employee_id AS e, min(manager_id) AS m FROM db_employees WHERE employee_id IS NOT NULL GROUP BY 1), w(s, c) AS (SELECT e, m FROM l UNION SELECT w.s, l.m FROM w JOIN l ON w.c = l.e), cyc AS (SELECT DISTINCT s FROM w WHERE s = c)"
_TREE = f"""{_LINKS},
    t(e, top, depth, path, on_cycle, below_cycle) AS (
        SELECT e, e, 0, [e], e IN (SELECT s FROM cyc), false FROM l WHERE e IN (SELECT s FROM cyc) OR m IS NULL OR m NOT IN (SELECT e FROM l)
        UNION ALL SELECT l.e, t.top, t.depth + 1, list_append(t.path, l.e), false, t.on_cycle OR t.below_cycle FROM t JOIN l ON l.m = t.e WHERE l.e NOT IN (SELECT s FROM cyc))"""
_P4_SQL = f"""{_TREE}, b AS (SELECT a, count(*) AS n FROM (SELECT unnest(path) AS a FROM t) GROUP BY 1)
    SELECT t.e AS employee_id, top AS top_id, depth, array_to_string(path, '/') AS path, b.n - 1 AS n_below, on_cycle, below_cycle FROM t JOIN b ON b.a = t.e"""
_P4_NESTING_SQL = f"""{_TREE}, b AS (SELECT a, count(*) AS n FROM (SELECT unnest(path) AS a FROM t) GROUP BY 1)
    SELECT t.e AS employee_id, b.n - 1 AS reach, CASE WHEN depth > 0 THEN true END AS inside_manager FROM t JOIN b ON b.a = t.e"""
_P4_BELOW_SQL = f"""{_TREE}, u AS (SELECT e, depth, unnest(path) AS a FROM t)
    SELECT u.a AS manager_id, u.e AS employee_id, u.depth - t.depth AS distance FROM u JOIN t ON t.e = u.a WHERE u.a % 100 = 0 AND u.a <> u.e"""
_P4_ALL_BELOW_SQL = f"""{_TREE}, u AS (SELECT e, depth, unnest(path) AS a FROM t)
    SELECT u.a AS manager_id, u.e AS employee_id, u.depth - t.depth AS distance FROM u JOIN t ON t.e = u.a WHERE u.a <> u.e"""

# ---- problem 7

REFERENCES = [
    references.Reference("db_employees", "department_id", "employee_id", "db_departments", "department_id"),
    references.Reference("db_employees", "job_id", "employee_id", "db_jobs", "job_id"),
    references.Reference("db_departments", "location_id", "department_id", "db_locations", "location_id"),
    references.Reference("db_locations", "country_id", "location_id", "db_countries", "country_id"),
]


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in ("db_employees", "db_departments", "db_jobs", "db_locations", "db_countries")}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return references.broken_references(_tables(spark, d), REFERENCES).select("table_name", "field_name", "record_id").distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return references.report(references.broken_references(_tables(spark, d), REFERENCES))


def p7_orphan_keys(spark: SparkSession, d: str) -> DataFrame:
    """The orphan report by key, from the states of two halves of the deltas put together."""
    changes = Cut(spark, "deltas")(references.deltas(_tables(spark, d), REFERENCES))
    # every delta is in one of the two: this shows that states of separate slices add up
    half = F.pmod(F.xxhash64("target", "key", "ref_at", "row_at"), F.lit(2))
    states = references.merge_states(references.key_states(changes.filter(half == 0)), references.key_states(changes.filter(half == 1)))
    return references.orphans(states).select("target", "key", F.col("refs").cast("bigint").alias("refs"))


_P7 = """
    WITH r AS (
        SELECT 'db_employees' AS table_name, 'department_id' AS field_name, 'db_departments' AS target, employee_id AS record_id, CAST(department_id AS VARCHAR) AS k, loaded_at FROM db_employees
        UNION ALL SELECT 'db_employees', 'job_id', 'db_jobs', employee_id, nullif(upper(trim(job_id)), ''), loaded_at FROM db_employees
        UNION ALL SELECT 'db_departments', 'location_id', 'db_locations', department_id, CAST(location_id AS VARCHAR), loaded_at FROM db_departments
        UNION ALL SELECT 'db_locations', 'country_id', 'db_countries', location_id, nullif(upper(trim(country_id)), ''), loaded_at FROM db_locations),
    f AS (SELECT table_name, record_id, min(loaded_at) AS first FROM r GROUP BY 1, 2),
    x AS (SELECT DISTINCT table_name, field_name, target, record_id, k, first FROM r JOIN f USING (table_name, record_id) WHERE k IS NOT NULL AND record_id IS NOT NULL),
    p AS (
        SELECT 'db_departments' AS target, CAST(department_id AS VARCHAR) AS k, loaded_at, deleted_at FROM db_departments
        UNION ALL SELECT 'db_jobs', nullif(upper(trim(job_id)), ''), loaded_at, deleted_at FROM db_jobs
        UNION ALL SELECT 'db_locations', CAST(location_id AS VARCHAR), loaded_at, deleted_at FROM db_locations
        UNION ALL SELECT 'db_countries', nullif(upper(trim(country_id)), ''), loaded_at, deleted_at FROM db_countries),
    s AS (SELECT target, k, min(loaded_at) AS first_row, count(*) - count(deleted_at) AS live FROM p WHERE k IS NOT NULL GROUP BY 1, 2),
    y AS (SELECT x.*, CASE WHEN s.k IS NULL THEN 'missing' WHEN live = 0 THEN 'deleted' WHEN first_row > first THEN 'late' END AS reason FROM x LEFT JOIN s ON s.target = x.target AND s.k = x.k)"""

QUERIES = {
    "p1_found": p1_found,
    "p1_rejected": p1_rejected,
    "p1_employees": p1_employees,
    "p1_locations": p1_locations,
    "p2_per_key": p2_per_key,
    "p4_found": p4_found,
    "p4_hierarchy": p4_hierarchy,
    "p4_intervals": p4_intervals,
    "p4_nesting": p4_nesting,
    "p4_descendants": p4_descendants,
    "p4_below": p4_below,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_orphan_keys": p7_orphan_keys,
}

SQL = {
    "p1_found": _bad_records_sql(),
    "p1_employees": _typed_records_sql("db_employees"),
    "p1_locations": _typed_records_sql("db_locations"),
    "p2_per_key": _P2_SQL,
    "p4_found": f"{_LINKS} SELECT s AS employee_id FROM cyc",
    "p4_hierarchy": _P4_SQL,
    "p4_nesting": _P4_NESTING_SQL,
    "p4_descendants": _P4_BELOW_SQL,
    "p4_below": _P4_ALL_BELOW_SQL,
    "p7_found": f"{_P7} SELECT DISTINCT table_name, field_name, record_id FROM y WHERE reason IS NOT NULL",
    "p7_report": f"{_P7} SELECT table_name, field_name, strftime(first, '%Y-%m') AS month, reason, count(*) AS n_references, count(DISTINCT k) AS n_keys FROM y WHERE reason IS NOT NULL GROUP BY 1, 2, 3, 4",
    "p7_orphan_keys": f"{_P7} SELECT target, k AS key, count(*) AS refs FROM y WHERE reason IN ('missing', 'deleted') GROUP BY 1, 2",
}
