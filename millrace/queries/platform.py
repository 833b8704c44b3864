"""Sources, sinks, caches and workbooks: each writes data to the shared folder, reads it back through the engine and sums it up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import infer, sinks
from millrace.cache import CacheOptions, DurableCache, MemoryCache
from millrace.common import shared_dir, table
from millrace.context import EngineContext
from millrace.sources import database, memory
from millrace.sources.options import CsvOptions, ParquetOptions
from millrace.streaming.windows import tumbling_counts
from millrace.workbook import Query, TableReference, Workbook


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/platform-{uuid.uuid4().hex}"


_SUMS = "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first, max(o_orderdate) AS last FROM t GROUP BY o_orderstatus"
_SUMS_SQL = _SUMS.replace("FROM t", "FROM orders")


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path, context = _place(spark), EngineContext(spark)
    sinks.write_csv(table(spark, d, "orders"), path, delimiter=";")
    context.register_csv("t", path, options=CsvOptions(delimiter=";"))
    return context.sql(_SUMS)


def csv_directory(spark: SparkSession, d: str) -> DataFrame:
    path, context = _place(spark), EngineContext(spark)
    sinks.write_csv(table(spark, d, "customer").repartition(4), path)
    context.register_csv_directory("t", path)
    return context.sql("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM t GROUP BY c_mktsegment")


def csv_headerless(spark: SparkSession, d: str) -> DataFrame:
    path, context = _place(spark), EngineContext(spark)
    sinks.write_csv(table(spark, d, "nation"), path, header=False)
    context.register_csv("t", path, options=CsvOptions(header=False))
    return context.sql("SELECT column_1 AS n_nationkey, column_2 AS n_name, column_3 AS n_regionkey FROM t")


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path, context = _place(spark), EngineContext(spark)
    sinks.write_json(table(spark, d, "orders"), path)
    context.register_json("t", path)
    return context.sql(_SUMS)


def json_nested_text(spark: SparkSession, d: str) -> DataFrame:
    """Nested values are read back as their text."""
    path, context = _place(spark), EngineContext(spark)
    nested = table(spark, d, "nation").select("n_nationkey", F.array("n_regionkey", "n_nationkey").alias("pair"))
    sinks.write_json(nested, path)
    context.register_json_directory("t", path)
    return context.sql("SELECT n_nationkey, pair FROM t")


def _written(spark: SparkSession, lines: DataFrame) -> str:
    """A folder of text files with these lines, one file each partition."""
    path = _place(spark)
    lines.write.text(path)
    return path


def csv_late_value(spark: SparkSession, d: str) -> DataFrame:
    """A value that first shows far down the file still decides its column's type, and none is lost."""
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").coalesce(1).orderBy(key)
    text = rows.select(F.concat_ws(",", key, F.when(key == 901, "late").otherwise((key % 7).cast("string")), F.when(key % 1000 == 999, "1.5").otherwise("2")).alias("value"))
    context = EngineContext(spark)
    context.register_csv("t", _written(spark, text), options=CsvOptions(header=False))
    return context.sql("SELECT column_2 AS kind, sum(column_3) AS total, count(*) AS n FROM t GROUP BY column_2")


def csv_multiline(spark: SparkSession, d: str) -> DataFrame:
    """Line breaks, quotes and delimiters inside quotes come back as they were; nobody has to say that there are any."""
    path, context = _place(spark), EngineContext(spark)
    note = F.concat(F.col("c_name"), F.lit('\nsaid "yes", twice'))
    sinks.write_csv(table(spark, d, "customer").select("c_custkey", note.alias("note"), "c_acctbal"), path)
    context.register_csv("t", path)
    return context.sql("SELECT c_custkey, note, c_acctbal FROM t")


def json_late_property(spark: SparkSession, d: str) -> DataFrame:
    """A property that only a late line has is a column."""
    key = F.col("o_orderkey")
    late = F.when(key >= 901, F.format_string(', "late": %d', key)).otherwise("")
    lines = table(spark, d, "orders").coalesce(1).orderBy(key).select(F.concat(F.lit('{"id": '), key.cast("string"), late, F.lit("}")).alias("value"))
    context = EngineContext(spark)
    context.register_json("t", _written(spark, lines))
    return context.sql("SELECT count(*) AS n, count(late) AS n_late, sum(late) AS total FROM t")


def json_trailing_comma(spark: SparkSession, d: str) -> DataFrame:
    """Lines with comments and with commas before closing brackets are read; a comma inside a string stays."""
    lines = table(spark, d, "nation").select(F.format_string('{"k": %d, "name": "%s, ]x,}", /* a note */ "r": [%d, ],}', "n_nationkey", "n_name", "n_regionkey").alias("value"))
    context = EngineContext(spark)
    context.register_json("t", _written(spark, lines))
    return context.sql("SELECT k, name, r FROM t")


def avro_decimals(spark: SparkSession, d: str) -> DataFrame:
    path, context = _place(spark), EngineContext(spark)
    sinks.write_avro(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").alias("balance")), path)
    context.register_avro("t", path)
    return context.sql("SELECT c_custkey, cast(balance * 2 AS double) AS twice FROM t WHERE balance < 0 OR balance > 5000")


def parquet_merged(spark: SparkSession, d: str) -> DataFrame:
    """Files with different columns read as one table."""
    path, context = _place(spark), EngineContext(spark)
    sinks.write_parquet(table(spark, d, "nation").select("n_nationkey", "n_name"), f"{path}/a")
    sinks.write_parquet(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), f"{path}/b")
    context.register_parquet("t", f"{path}/a", f"{path}/b", options=ParquetOptions(merge_schema=True))
    return context.sql("SELECT n_nationkey, max(n_name) AS n_name, max(n_regionkey) AS n_regionkey, count(*) AS n FROM t GROUP BY n_nationkey")


def writers(spark: SparkSession, d: str) -> DataFrame:
    """One frame to writers of every kind and back from each."""
    path, context = _place(spark), EngineContext(spark)
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    sinks.write_all(rows, *(sinks.FileWriter(f, f"{path}/{f}") for f in ("csv", "json", "parquet", "avro")), sinks.MemoryWriter(context, "memory"))
    for f in ("csv", "json", "parquet", "avro"):
        getattr(context, f"register_{f}")(f, f"{path}/{f}")
    return context.sql(" UNION ALL ".join(f"SELECT '{f}' AS format, count(*) AS n, round(sum(s_acctbal), 2) AS total, max(s_name) AS last FROM {f}" for f in ("csv", "json", "parquet", "avro", "memory")))


def profiled(spark: SparkSession, d: str) -> DataFrame:
    """What the profiler counts of a query while it runs."""
    context = EngineContext(spark)
    context.register_parquet("orders", f"{d}/orders.parquet")
    rows, step = context.run("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
    assert step.rows == len(rows) and step.batches and step.seconds >= sum(s.seconds for s in step.steps) > 0
    return spark.createDataFrame([(step.name, step.rows)], "name string, rows bigint")


def parquet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path, context = _place(spark), EngineContext(spark)
    sinks.write_parquet(table(spark, d, "orders"), path, partition_by=["o_orderstatus"])
    context.register_parquet("t", path)
    return context.sql(_SUMS)


def avro_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path, context = _place(spark), EngineContext(spark)
    sinks.write_avro(table(spark, d, "orders"), path)
    context.register_avro("t", path)
    return context.sql(_SUMS)


def memory_table(spark: SparkSession, d: str) -> DataFrame:
    context = EngineContext(spark)
    context.register_rows("t", [(1, "red", 1.5), (2, None, 2.5), (3, "blue", None)], "id bigint, color string, size double")
    return context.sql("SELECT id, color, size * 2 AS twice FROM t")


def memory_writer(spark: SparkSession, d: str) -> DataFrame:
    context = EngineContext(spark)
    sinks.write_memory(table(spark, d, "customer"), context, "kept")
    return context.sql("SELECT c_nationkey, count(*) AS n FROM kept GROUP BY c_nationkey")


def multi_source(spark: SparkSession, d: str) -> DataFrame:
    context = EngineContext(spark)
    orders = table(spark, d, "orders")
    context.register("t", memory.several(orders.filter("o_orderkey % 2 = 0"), orders.filter("o_orderkey % 2 = 1")))
    return context.sql("SELECT o_orderpriority, count(*) AS n FROM t GROUP BY o_orderpriority")


def file_query_source(spark: SparkSession, d: str) -> DataFrame:
    context = EngineContext(spark)
    context.register_file_query("rich", "file", table(spark, d, "customer"), "SELECT c_custkey, c_nationkey FROM file WHERE c_acctbal > 5000")
    context.register_parquet("nation", f"{d}/nation.parquet")
    return context.sql("SELECT n.n_name, count(*) AS n FROM rich r JOIN nation n ON r.c_nationkey = n.n_nationkey GROUP BY n.n_name")


def nested_query_source(spark: SparkSession, d: str) -> DataFrame:
    context = EngineContext(spark)
    context.register_parquet("orders", f"{d}/orders.parquet")
    context.register_query("per_customer", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
    return context.sql("SELECT n, count(*) AS customers FROM per_customer GROUP BY n")


def generic_reader(spark: SparkSession, d: str) -> DataFrame:
    """A reader of our own that produces the numbers below 1,000 in four parts."""
    reader = memory.FunctionReader("v bigint, square bigint", lambda part, parts: ((i, i * i) for i in range(part, 1000, parts)), parts=4)
    context = EngineContext(spark)
    context.register("t", memory.read_with(spark, reader))
    return context.sql("SELECT v % 10 AS k, sum(square) AS s FROM t GROUP BY v % 10")


def jdbc_source(spark: SparkSession, d: str) -> DataFrame:
    connection = database.Jdbc(address=f"jdbc:derby:memory:m{uuid.uuid4().hex};create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    database.write(table(spark, d, "nation"), connection, "nation_copy", mode="overwrite")
    context = EngineContext(spark)
    context.register_database("t", connection, "select * from nation_copy")
    return context.sql("SELECT n_regionkey, count(*) AS n FROM t GROUP BY n_regionkey")


def jdbc_split(spark: SparkSession, d: str) -> DataFrame:
    """A query read in four ranges of a column at once, described by a table reference."""
    address, driver = f"jdbc:derby:memory:m{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    database.write(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), database.Jdbc(address=address, driver=driver), "customer_copy", mode="overwrite")
    reference = TableReference("t", "database", "select * from customer_copy", options={"system": "jdbc", "address": address, "driver": driver, "split": ["c_custkey", 0, 1500, 4]})
    context = EngineContext(spark)
    TableReference.from_json(reference.to_json()).build(context)
    assert context.table("t").rdd.getNumPartitions() == 4
    return context.sql("SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM t GROUP BY c_nationkey")


def workbook_chain(spark: SparkSession, d: str) -> DataFrame:
    book = Workbook(
        [TableReference("orders", "parquet", f"{d}/orders.parquet"), TableReference("customer", "parquet", f"{d}/customer.parquet", "SELECT c_custkey, c_mktsegment FROM customer")],
        [
            Query("spent", "SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey", 0),
            Query("by_segment", "SELECT c.c_mktsegment, count(*) AS n, round(sum(s.total), 2) AS total FROM spent s JOIN customer c ON s.o_custkey = c.c_custkey GROUP BY c.c_mktsegment", 1),
        ],
    )
    return book.start(spark).execute_all()[-1].df


def durable_cache(spark: SparkSession, d: str) -> DataFrame:
    """The second read is answered by the copy: its source would fail."""
    cache = DurableCache(spark, CacheOptions(_place(spark), "customers", 60))
    cache.read(lambda: table(spark, d, "customer"))

    def fail() -> DataFrame:
        raise AssertionError("the copy wasn't used")

    return cache.read(fail).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def memory_cache(spark: SparkSession, d: str) -> DataFrame:
    cache = MemoryCache()
    first = cache.read("part", lambda: table(spark, d, "part"))
    assert cache.read("part", lambda: None) is first
    return first.groupBy("p_brand").agg(F.count("*").alias("n"))


def type_inference(spark: SparkSession, d: str) -> DataFrame:
    """Text columns climb the ladder; what doesn't fit the type becomes null."""
    texts = spark.createDataFrame(
        [("true", "1", "1", "2020-01-01", "2020-01-01T10:00:00", "1", ""), ("false", "2", "2.5", "2021-02-03", "2021-02-03T11:22:33.123456", "x", "7")],
        "flag string, whole string, real string, day string, moment string, mixed string, blank string",
    )
    typed = infer.infer(texts)
    kinds = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in typed.schema], "name string, type string")
    return kinds


def explain_rows(spark: SparkSession, d: str) -> DataFrame:
    context = EngineContext(spark)
    context.register_parquet("orders", f"{d}/orders.parquet")
    return context.sql("EXPLAIN SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey")


def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    return tumbling_counts(table(spark, d, "events")).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (csv_round_trip, csv_directory, csv_headerless, csv_late_value, csv_multiline, json_round_trip, json_late_property, json_trailing_comma, avro_decimals, parquet_merged, writers, profiled, jdbc_split, json_nested_text, parquet_round_trip, avro_round_trip, memory_table, memory_writer, multi_source, file_query_source, nested_query_source, generic_reader, jdbc_source, workbook_chain, durable_cache, memory_cache, type_inference, explain_rows, hourly_events)}

SQL = {
    "csv_round_trip": _SUMS_SQL,
    "csv_directory": "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment",
    "csv_headerless": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "json_round_trip": _SUMS_SQL,
    "json_nested_text": "SELECT n_nationkey, '[' || n_regionkey || ',' || n_nationkey || ']' AS pair FROM nation",
    "parquet_round_trip": _SUMS_SQL,
    "avro_round_trip": _SUMS_SQL,
    "csv_late_value": "SELECT CASE WHEN o_orderkey = 901 THEN 'late' ELSE CAST(o_orderkey % 7 AS VARCHAR) END AS kind, sum(CASE WHEN o_orderkey % 1000 = 999 THEN 1.5 ELSE 2.0 END) AS total, count(*) AS n FROM orders GROUP BY 1",
    "csv_multiline": "SELECT c_custkey, c_name || chr(10) || 'said \"yes\", twice' AS note, c_acctbal FROM customer",
    "json_late_property": "SELECT count(*) AS n, count(CASE WHEN o_orderkey >= 901 THEN 1 END) AS n_late, CAST(sum(CASE WHEN o_orderkey >= 901 THEN o_orderkey END) AS BIGINT) AS total FROM orders",
    "json_trailing_comma": "SELECT n_nationkey AS k, n_name || ', ]x,}' AS name, '[' || n_regionkey || ']' AS r FROM nation",
    "avro_decimals": "SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(12,2)) * 2 AS DOUBLE) AS twice FROM customer WHERE CAST(c_acctbal AS DECIMAL(12,2)) < 0 OR CAST(c_acctbal AS DECIMAL(12,2)) > 5000",
    "parquet_merged": "SELECT n_nationkey, n_name, n_regionkey, CAST(2 AS BIGINT) AS n FROM nation",
    "writers": " UNION ALL ".join(f"SELECT '{f}' AS format, count(*) AS n, round(sum(s_acctbal), 2) AS total, max(s_name) AS last FROM supplier" for f in ("csv", "json", "parquet", "avro", "memory")),
    "profiled": "SELECT 'query' AS name, count(DISTINCT o_custkey) AS rows FROM orders",
    "jdbc_split": "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey",
    "memory_table": "SELECT * FROM (VALUES (1, 'red', 3.0), (2, NULL, 5.0), (3, 'blue', NULL)) t(id, color, twice)",
    "memory_writer": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey",
    "multi_source": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "file_query_source": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 GROUP BY n_name",
    "nested_query_source": "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n",
    "generic_reader": "SELECT i % 10 AS k, CAST(sum(i * i) AS BIGINT) AS s FROM range(1000) t(i) GROUP BY i % 10",
    "jdbc_source": "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey",
    "workbook_chain": "SELECT c_mktsegment, count(DISTINCT o_custkey) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "durable_cache": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment",
    "memory_cache": "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand",
    "type_inference": "SELECT * FROM (VALUES ('flag', 'boolean'), ('whole', 'bigint'), ('real', 'double'), ('day', 'date'), ('moment', 'timestamp'), ('mixed', 'string'), ('blank', 'bigint')) t(name, type)",
    "hourly_events": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
