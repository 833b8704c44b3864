"""Registry, dialect, inference, sources and sinks, caches, workbooks, profiler."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace import dialect, infer, sinks
from millrace.cache import CacheOptions, DurableCache
from millrace.context import EngineContext, QueryOptions
from millrace.plans import explain as plans
from millrace.profile import Profiler
from millrace.sources import avro, database, files, memory
from millrace.sources import options as O
from millrace.workbook import Query, TableReference, TableSchema, Workbook


@pytest.fixture
def context(spark):
    c = EngineContext(spark)
    c.register_rows("t", [(1, "a", 1.0), (2, "b", None), (3, None, 3.0)], "id bigint, name string, v double")
    return c


def test_registry(spark, context):
    with pytest.raises(ValueError):
        context.register_rows("T", [(1,)], "x int")
    other = EngineContext(spark)
    other.register_rows("t", [(9,)], "id bigint")
    assert other.sql("select id from t").collect()[0][0] == 9
    assert context.sql("select max(id) as m from t").collect()[0][0] == 3
    assert context.tables == ["t"]
    context.drop("t")
    assert context.tables == []


def test_statements(context):
    for bad in ("select 1; select 2", "drop table t", "create table x (a int)", "explain explain select 1", ""):
        with pytest.raises(ValueError):
            context.sql(bad)
    assert context.sql("select ';' as x;").collect()[0][0] == ";"
    assert context.sql("select id from t", QueryOptions(max_results=2)).count() == 2
    assert context.sql("select id from t", QueryOptions(modify=[lambda df: df.filter("id > 1")])).count() == 2
    lines = context.explain("select id from t where id > 1").collect()
    assert {r.plan_type for r in lines} == {"logical", "physical"}


def test_dialect():
    r = dialect.rewrite
    assert r("select a from t order by a offset 5 rows limit 2") == "select a from t order by a LIMIT 2 OFFSET 5"
    assert r("select 'offset 5 limit 2', \"a b\" from t -- var(x)") == "select 'offset 5 limit 2', `a b` from t -- var(x)"
    assert r("select var(x), covar(x, y), variance(x) from t") == "select var_samp(x), covar_samp(x, y), variance(x) from t"
    assert "b LEFT semi JOIN a" in r("select * from a right semi join b on a.x = b.x where b.y = 1")
    assert "c LEFT anti JOIN (a join b on a.x = b.x)" in r("select * from a join b on a.x = b.x right anti join c using (x)")
    assert "from a, c LEFT semi JOIN b" in r("select * from a, b right semi join c using (x)")
    assert r("select * from t where a like 'x%'") == "select * from t where a like 'x%'"
    with pytest.raises(ValueError):
        r("select * from a right semi join b")


@pytest.mark.parametrize(("pattern", "yes", "no"), [("[a-c]%", ["a", "cx"], ["d", "A", ""]), ("%[^0-9]", ["1a"], ["1"]), ("a_[.]c", ["ab.c"], ["abxc"]), ("50[%]", ["50%"], ["505"]), ("it''s [x]", [], ["its x"])])
def test_like_classes(context, pattern, yes, no):
    for text, expected in [(t, True) for t in yes] + [(t, False) for t in no]:
        quoted = text.replace("'", "''")
        assert context.sql(f"select '{quoted}' like '{pattern}' as x").collect()[0][0] is expected
    assert context.sql("select 'B' ilike '[a-c]' as x").collect()[0][0] is True


RUNGS = [
    ("False", "boolean"), ("-40", "bigint"), ("007", "bigint"), ("-.5e3", "double"), ("12.", "double"), ("1999-12-31", "date"), ("1999-12-31 23:59", "timestamp"), ("2024-02-29T00:00:01.25Z", "timestamp"),
    ("3 Mar 2021 04:05:06 GMT", "timestamp"), ("Sun, 07 Nov 2021 10:00:00 GMT", "timestamp"), ("12 apples", "string"), ("1,5", "string"), ("truely", "string"), ("TRUE", "boolean"), ("2023-02-29", "string"), ("2023-13-01 10:00", "string"), ("  ", None),
]


def test_rungs(spark):
    """The rung of a value in Python and in the JVM."""
    assert [infer.value_type(t) for t, _ in RUNGS] == [k for _, k in RUNGS]
    frame = spark.createDataFrame([(t,) for t, _ in RUNGS], "x string")
    assert [r[0] for r in frame.select(infer._rung(F.col("x"))).collect()] == [k for _, k in RUNGS]


def test_a_type_holds_every_value(spark):
    columns = [["true", "1"], ["1", "1.5"], ["2.5", "2020-01-01"], ["2020-01-01", "2020-01-01 10:00"], ["x", "1"], ["", ""]]
    kinds = ["string", "double", "string", "timestamp", "string", "string"]
    assert infer.column_types([list(r) for r in zip(*columns)], 6) == kinds
    texts = spark.createDataFrame([*zip(*columns)], ", ".join(f"c{i} string" for i in range(6)))
    assert infer.types_of(texts) == kinds and infer.types_of(texts.limit(0)) == ["string"] * 6
    # only a sample that was asked for loses what comes later
    late = spark.createDataFrame([("1",)] * 150 + [("abc",), ("1.5",)], "a string").coalesce(1)
    assert infer.infer(late).filter("a is null").count() == 0
    assert infer.infer(late, 100).filter("a is null").count() == 2
    mail = infer.infer(spark.createDataFrame([("Wed, 1 Jan 2020 06:21:15 GMT",)], "b string")).first().b
    assert mail.replace(tzinfo=None) == dt.datetime(2020, 1, 1, 6, 21, 15)


def test_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text("id,name,day\n3,z,2020-01-05\n")
    (tmp_path / "a.csv").write_text('id,name,day\n1,"x, ""y""",2020-01-01\n2,,\n')
    (tmp_path / "c.txt").write_text("no\n")
    df = files.read_csv_directory(spark, str(tmp_path))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "day": "date"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'x, "y"', dt.date(2020, 1, 1)), (2, None, None), (3, "z", dt.date(2020, 1, 5))]
    with pytest.raises(FileNotFoundError):
        files.read_json_directory(spark, str(tmp_path))
    (tmp_path / "h.csv").write_text("1;a\n2;b;extra\n3\n")
    bare = files.read_csv(spark, str(tmp_path / "h.csv"), options=O.CsvOptions(";", header=False))
    assert bare.columns == ["column_1", "column_2"] and bare.count() == 3
    declared = files.read_csv(spark, str(tmp_path / "h.csv"), options=O.CsvOptions(";", header=False), schema="a int, b string")
    assert dict(declared.dtypes) == {"a": "int", "b": "string"}


def test_json(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"d": 1, "a": 1.5, "b": [1, 2], "c": {"k": "v"}}\n{"a": 2, "e": true, "f": "2020-01-01"}\n')
    df = files.read_json(spark, str(tmp_path / "x.json"))
    assert df.columns == ["a", "b", "c", "d", "e", "f"]
    assert dict(df.dtypes) == {"a": "double", "b": "string", "c": "string", "d": "bigint", "e": "boolean", "f": "date"}
    first = df.orderBy("a").first()
    assert json.loads(first.b) == [1, 2] and json.loads(first.c) == {"k": "v"} and first.e is None


ROWS = [(1, True, 5, 1.5, dt.date(2020, 1, 2), dt.datetime(2009, 3, 1, 12), "x"), (2, None, None, None, None, None, None), (-(2**62), False, -3, 2.0, dt.date(1960, 1, 1), dt.datetime(1960, 1, 1, 0, 0, 0, 5), "ünï")]
SCHEMA = "id bigint, flag boolean, i int, f double, day date, at timestamp, s string"


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_avro(spark, tmp_path, codec):
    path = f"file://{tmp_path}/out"
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    avro.write_avro(df, path, codec)
    back = avro.read_avro(spark, path)
    assert back.columns == sorted(df.columns)
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(FileNotFoundError):
        avro.read_avro(spark, f"file://{tmp_path}")


def test_avro_splits(spark, tmp_path):
    path = f"file://{tmp_path}/many"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        avro.write_avro(spark.range(5000).coalesce(1).withColumn("t", F.repeat(F.lit("ab"), 20)), path)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    back = avro.read_avro(spark, path, O.AvroOptions(split_bytes=3000))
    assert back.rdd.getNumPartitions() > 3 and back.agg(F.sum("id"), F.count("*")).first()[:] == (5000 * 4999 // 2, 5000)


@pytest.mark.parametrize("write", [sinks.write_csv, sinks.write_json, sinks.write_parquet])
def test_writers(spark, tmp_path, write):
    df = spark.createDataFrame([("larch", 12), ("a, b", None), (None, -3), ('say "x"', 0)], "tree string, height bigint")
    write(df, f"{tmp_path}/w")
    read = {"write_csv": files.read_csv, "write_json": files.read_json, "write_parquet": files.read_parquet}[write.__name__](spark, f"{tmp_path}/w")
    assert sorted(map(str, read.select("tree", "height").collect())) == sorted(map(str, df.collect()))


def test_json_files_of_a_directory(spark, tmp_path):
    """Properties of every file, comments, commas before closing brackets, late properties."""
    (tmp_path / "a.json").write_text("".join(f'{{"a": {i}}}\n' for i in range(150)) + '{"a": 1, "late": "x, ]", }\n')
    (tmp_path / "b.json").write_text('{"b": [1, 2,], /* c */ "a": 2}\n\n{"b": "q\\"w, }"}\nnot json\n')
    df = files.read_json_directory(spark, str(tmp_path))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "late": "string"}
    assert df.filter("late is not null").first().late == "x, ]"
    assert sorted(r.b for r in df.filter("b is not null").collect()) == ["[1,2]", 'q"w, }']
    assert df.count() == 154


def test_csv_line_breaks_are_found(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,note\n1,"a\nb"\n2,c\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "m.csv")).collect()] == [(1, "a\nb"), (2, "c")]
    (tmp_path / "plain.csv").write_text('id,note\n1,"a ""b"""\n')
    assert not files._breaks_in_quotes(spark, [str(tmp_path / "plain.csv")])


def test_avro_decimals_and_modes(spark, tmp_path):
    from decimal import Decimal as D

    path = f"file://{tmp_path}/d"
    df = spark.createDataFrame([(1, D("1.50")), (2, D("-0.01")), (3, None), (4, D("-129.00")), (5, D("99999999999999999999.99"))], "id int, v decimal(22,2)")
    avro.write_avro(df, path)
    back = avro.read_avro(spark, path)
    assert dict(back.dtypes)["v"] == "decimal(22,2)" and sorted(map(str, back.select("id", "v").collect())) == sorted(map(str, df.collect()))
    with pytest.raises(FileExistsError):
        avro.write_avro(df, path)
    avro.write_avro(df, path, mode="ignore")
    assert avro.read_avro(spark, path).count() == 5
    avro.write_avro(df, path, mode="append")
    assert avro.read_avro(spark, path).count() == 10
    avro.write_avro(df.limit(1), path, mode="overwrite")
    assert avro.read_avro(spark, path).count() == 1
    with pytest.raises(ValueError):
        avro.write_avro(df, path, mode="replace")


def test_parquet_options(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/p/a")
    spark.range(4).withColumn("x", F.lit(1)).write.parquet(f"{tmp_path}/p/b")
    merged = files.read_parquet(spark, f"{tmp_path}/p/a", f"{tmp_path}/p/b", options=O.ParquetOptions(merge_schema=True))
    assert merged.columns == ["id", "x"] and merged.count() == 7
    name = sorted(p.name for p in (tmp_path / "p" / "a").glob("*.parquet"))[0]
    assert files.read_parquet(spark, f"{tmp_path}/p/a", options=O.ParquetOptions(glob=name)).inputFiles()[0].endswith(name)


def test_storages_reach_the_file_systems(spark):
    O.use(spark, O.S3Storage("bucket-a", "key", "secret", "http://here"))
    O.use(spark, O.AzureStorage("account", "box", "azure-key"))
    O.use(spark, O.LocalStorage("/data"))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert conf.get("fs.s3a.bucket.bucket-a.secret.key") == "secret" and conf.get("fs.s3a.bucket.bucket-a.endpoint") == "http://here"
    assert conf.get("fs.azure.account.key.account.dfs.core.windows.net") == "azure-key"


def test_cancellation(spark, context):
    """Another thread stops what runs under the tag, and nothing else."""
    import threading
    import time

    seen = {}

    def stop():
        until = time.time() + 15
        while not seen.get("done") and time.time() < until:
            time.sleep(0.5)
            context.cancel(seen["tag"])
        if not seen.get("done"):
            seen["late"] = True
            spark.sparkContext.cancelAllJobs()

    with context.cancellable() as tag:
        seen["tag"] = tag
        t = threading.Thread(target=stop, daemon=True)
        t.start()
        with pytest.raises(Exception, match="(?i)cancel"):
            spark.range(1 << 38).selectExpr("sum(hash(id) % 7)").collect()
        seen["done"] = True
    t.join(10)
    assert "late" not in seen
    assert context.sql("select count(*) as n from t").first().n == 3


def test_a_query_is_profiled(context):
    rows, step = context.run("select id from t where id > 1")
    assert len(rows) == 2 and step.rows == 2 and step.batches >= 1 and [s.name for s in step.steps] == ["plan", "run"]
    n, step = context.run("select id from t where id > 99", lambda df: len(df.collect()))
    assert n == 0 and step.rows == 0


def test_writers_of_ones_own(spark, context, tmp_path):
    class Counting:
        def write(self, df):
            self.n = df.count()

    own = Counting()
    sinks.write_all(context.table("t"), own, sinks.FileWriter("csv", f"{tmp_path}/w", {"delimiter": ";"}), sinks.MemoryWriter(context, "copy"))
    assert own.n == 3 and context.table("copy").count() == 3
    assert files.read_csv(spark, f"{tmp_path}/w", options=O.CsvOptions(";")).count() == 3


def test_cache_providers(spark, tmp_path):
    """A provider of one's own; the version before the last stays, older ones go."""
    from millrace.cache import LocalProvider

    cache = DurableCache(spark, CacheOptions("", "k"), provider=LocalProvider(str(tmp_path / "c")))
    for i in range(4):
        assert cache.write(spark.range(i)).count() == i
    assert cache.hit() and cache.read(lambda: None).count() == 3
    assert len([n for n in cache.storage.names("k") if not n.endswith(".json")]) == 2
    cache.clear()
    assert not cache.hit()
    hadoop = DurableCache(spark, CacheOptions(f"file://{tmp_path}/h", "k"))
    for i in range(4):
        hadoop.write(spark.range(i))
    assert len(hadoop.storage.names("k")) == 3 and hadoop.read(lambda: None).count() == 3


def test_table_references_of_every_kind(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, s string")
    sinks.write_csv(df, f"{tmp_path}/csv", delimiter=";", header=False)
    sinks.write_json(df, f"{tmp_path}/json")
    sinks.write_parquet(df, f"{tmp_path}/parquet")
    sinks.write_avro(df, f"file://{tmp_path}/avro")
    schema = TableSchema.of(spark.createDataFrame([], "id bigint, s string").schema)
    for kind in ("csv", "json", "parquet", "avro"):
        ref = TableReference("t", kind, f"file://{tmp_path}/{kind}", "select * from t where id = 2", schema, options={"delimiter": ";", "header": False} if kind == "csv" else {})
        got = TableReference.from_json(ref.to_json()).build(EngineContext(spark))
        assert dict(got.dtypes) == {"id": "bigint", "s": "string"} and [tuple(r) for r in got.select("id", "s").collect()] == [(2, "y")], kind


def test_no_cluster_without_a_shared_folder(spark, monkeypatch):
    from millrace import common

    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_dir(Session)
    Session.sparkContext.master = "local[2]"
    assert common.shared_dir(Session).startswith("file:")


def test_connections():
    c = dict(server="h", database="d", user="u", password="p")
    assert database.SqlServer(**c).url() == "jdbc:sqlserver://h:1433;databaseName=d"
    assert database.MySql(**c).url() == "jdbc:mysql://h:3306/d"
    assert database.Postgres(**c).url() == "jdbc:postgresql://h:5432/d"
    assert database.Snowflake(account="a", database="d", warehouse="w").url() == "jdbc:snowflake://a.snowflakecomputing.com/?db=d&warehouse=w"
    assert "password" not in database.Postgres(server="h", database="d").options()
    assert O.S3Storage("b", "k", "s").uri("/x/y") == "s3a://b/x/y" and "k" in O.S3Storage("b", "k", "s").conf().values()
    assert O.AzureStorage("acc", "box").uri("x") == "abfss://box@acc.dfs.core.windows.net/x"
    assert O.LocalStorage("/data").uri("x") == "file:///data/x"


def test_several_and_reader(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([("y", 2)], "s string, i int")
    with pytest.raises(ValueError):
        memory.several(a, b)
    assert memory.several(a, a).count() == 2
    reader = memory.FunctionReader("n bigint", lambda part, parts: ((i,) for i in range(part, 10, parts)), 3)
    assert memory.read_with(spark, reader, "numbers").agg(F.sum("n")).first()[0] == 45


def test_durable_cache(spark, tmp_path):
    now = [1000.0]
    calls = []

    def source():
        calls.append(1)
        return spark.createDataFrame([(len(calls),)], "n int")

    cache = DurableCache(spark, CacheOptions(f"file://{tmp_path}", "k", 10), clock=lambda: now[0])
    assert not cache.hit() and cache.read(source).first()[0] == 1
    assert cache.hit() and cache.read(source).first()[0] == 1
    now[0] += 601
    assert not cache.hit() and cache.read(source).first()[0] == 2
    cache.clear()
    assert not cache.hit()


def test_workbook(spark, tmp_path):
    (tmp_path / "c.csv").write_text("c1,c2\n1,red\n2,blue\n3,red\n")
    ref = TableReference("colors", "csv", f"{tmp_path}/c.csv", "select c2 as color, c1 as n from colors", TableSchema.of(spark.createDataFrame([], "c1 bigint, c2 string").schema))
    assert TableReference.from_json(ref.to_json()) == ref
    run = Workbook([ref], [Query("second", "select color, total from first order by color limit 9", 2, limit=1), Query("first", "select color, sum(n) as total from colors group by color", 1)]).start(spark)
    results = run.execute_all()
    assert [r.name for r in results] == ["first", "second"]
    assert [tuple(r) for r in results[1].df.collect()] == [("blue", 2)]
    assert [r.rows for r in results] == [2, 1]
    assert run.execute("first").df.count() == 2  # again: replaced
    run.close()
    assert [(s.name, s.rows) for s in run.profiler.root.steps] == [("first", 2), ("second", 1), ("first", 2)]


def test_enforced_limit(spark):
    df = spark.range(100)
    assert plans.enforce_limit(df.limit(50), 70).count() == 70
    assert plans.enforce_limit(df, 7).count() == 7
    assert plans.top_node(df.limit(3)) == "GlobalLimit"


def test_profiler(spark):
    p = Profiler()
    rows = p.run("scan", spark.range(50).filter("id > 9"), lambda df: df.collect())
    with p.step("outer"):
        with p.step("inner"):
            pass
    root = p.stop()
    assert len(rows) == 40 and root.steps[0].rows == 40 and root.steps[1].steps[0].name == "inner"
    assert root.seconds >= root.steps[0].seconds and len(root.lines()) == 4
    with pytest.raises(RuntimeError):
        with p.step("late"):
            pass


def test_pushdown(spark, context):
    """Filters and columns reach the scan."""
    context.register_parquet("orders", "/root/testdata/sf0.001/orders.parquet")
    plan = "\n".join(r.plan for r in context.explain("select o_custkey from orders where o_totalprice > 1000").collect())
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "o_orderpriority" not in plan.split("ReadSchema")[1]


def test_streaming_windows(spark, tmp_path):
    from millrace.streaming.windows import tumbling_counts

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = tumbling_counts(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("hours").agg(F.sum("n")).first()[0] == events.count()
