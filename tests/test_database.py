"""Embedded databases on a cluster, where each process would have one of its own: a session of several processes, in a process of its own."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

from millrace.sources import database

REPO = Path(__file__).resolve().parent.parent

HEAD = """
import os
import sys
import traceback
import uuid
import pytest
from pyspark.sql import SparkSession
import __spark_entry__ as e
from millrace.context import EngineContext
from millrace.sources import database
from tests.oracle import same

sys.excepthook = lambda *x: (traceback.print_exception(*x, file=sys.stdout), sys.stdout.flush(), os._exit(1))  # before the executors that end fill the output
D = "/root/testdata/sf0.001"
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "700m", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": "file://PLACE/shared", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.sql.session.timeZone": "UTC"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
derby = lambda: database.Jdbc(address=f"jdbc:derby:memory:m{uuid.uuid4().hex};create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
"""


def on_cluster(place: Path, text: str) -> None:
    (place / "home/work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # the executors' logs go to work in Spark's home
        if p.name != "work":
            (place / "home" / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": f"{place}/home", "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": str(REPO), "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", HEAD.replace("PLACE", str(place)) + text], cwd=place, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stdout + run.stderr[-2000:] * (not run.stdout)


def test_which_are_embedded():
    for url in ("jdbc:derby:memory:m;create=true", "jdbc:derby:/data/d", "jdbc:h2:mem:m", "jdbc:h2:~/d", "jdbc:hsqldb:mem:m", "jdbc:hsqldb:file:d", "jdbc:sqlite:d.db", "JDBC:DuckDB:"):
        assert database.Jdbc(address=url).embedded(), url
    for url in ("jdbc:derby://h:1527/d", "jdbc:h2:tcp://h/d", "jdbc:h2:ssl://h/d", "jdbc:hsqldb:hsql://h/d", "jdbc:hsqldb:https://h/d", "jdbc:oracle:thin:@h:1521/d", ""):
        assert not database.Jdbc(address=url).embedded(), url
    assert not database.Postgres(server="h", database="d").embedded()


def test_embedded_on_a_cluster(tmp_path):
    on_cluster(
        tmp_path,
        """
same(e.queries()["jdbc_source"](spark, D), e.oracle_sql()["jdbc_source"], D)

database.CHUNK = 7
c, t = derby(), spark.range(50, numPartitions=3).selectExpr("id AS k", "if(id % 5 = 0, null, 'n' || id) AS name", "cast(id / 8 as decimal(9, 3)) AS d", "timestamp'2020-01-02 03:04:05.678901' AS at", "id % 2 = 0 AS even")
rows = lambda query, **more: sorted(map(tuple, database.read(spark, c, query, **more).collect()))
database.write(t, c, "t", mode="overwrite")
assert rows("select * from t") == sorted(map(tuple, t.collect()))
assert rows("select * from t where 1 = 0") == [] and database.read(spark, c, "select * from t where 1 = 0").columns == t.columns
assert len(rows("select * from t", max_results=20)) == 20 and len(rows("select * from t", max_results=7)) == 7 and len(rows("select * from t", max_results=70)) == 50
with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
    database.write(t, c, "t", mode="error")
database.write(t, c, "t", mode="ignore")
database.write(t.limit(0), c, "t")
assert len(rows("select * from t")) == 50
database.write(t.selectExpr("at AS AT", "even", "d", "k + 100 AS K"), c, "t")  # columns by name, the one left out is null
assert rows("select * from t where \\"k\\" >= 100") == sorted((r.k + 100, None, r.d, r.at, r.even) for r in t.collect())
database.write(t.limit(3), c, "t", mode="overwrite")
assert len(rows("select * from t")) == 3
""",
    )


def test_split_embedded_on_a_cluster(tmp_path):
    on_cluster(
        tmp_path,
        """
same(e.queries()["jdbc_split"](spark, D), e.oracle_sql()["jdbc_split"], D)

database.CHUNK = 7
c, t = derby(), spark.range(50).selectExpr("if(id % 9 = 0, null, id) AS k", "id AS v")
database.write(t, c, "t")
for low, high, parts in ((0, 50, 4), (10, 20, 3), (0, 2, 9), (0, 50, 1), (100, 200, 5), (0, 50, 30)):  # keys below, between and above, empty ranges, more ranges than keys between
    got = database.read(spark, c, 'select "k" as "k", "v" as "v" from t', split=("k", low, high, parts))
    assert got.rdd.getNumPartitions() == min(parts, high - low) and sorted(r.v for r in got.collect()) == list(range(50)), (low, high, parts)
    assert got.count() == 50 and sum(r.k is None for r in got.collect()) == 6
assert database.read(spark, c, "select * from t", 20, ("k", 0, 50, 4)).count() == 20
assert database.read(spark, c, "select * from t where 1 = 0", split=("k", 0, 50, 4)).count() == 0
""",
    )
