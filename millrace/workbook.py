"""A sequence of named queries in which each result is a table for the next, and the descriptions that make one portable."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.context import EngineContext
from millrace.plans.explain import enforce_limit
from millrace.profile import Profiler
from millrace.sources import database
from millrace.sources.options import AvroOptions, CsvOptions, JsonOptions, ParquetOptions


@dataclass(frozen=True)
class Field:
    name: str
    type: str


@dataclass(frozen=True)
class TableSchema:
    fields: tuple[Field, ...]

    @classmethod
    def of(cls, schema: T.StructType) -> TableSchema:
        return cls(tuple(Field(f.name, f.dataType.simpleString()) for f in schema))

    def ddl(self) -> str:
        return ", ".join(f"`{f.name}` {f.type}" for f in self.fields)


@dataclass(frozen=True)
class TableReference:
    """A table by kind (csv, json, avro, parquet, database), place, and an optional query over it.

    ``options`` are those of the format (delimiter, header, ...), of a database its connection: ``system`` (sqlserver, mysql,
    postgres, snowflake, jdbc) and the fields of that; ``path`` is then the query to send, ``split`` among the options reads
    it in ranges. A password is no part of the description: ``build`` takes it.
    """

    name: str
    kind: str
    path: str = ""
    query: str = ""
    schema: TableSchema | None = None
    tenant: str = ""
    options: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> TableReference:
        raw = json.loads(text)
        if raw["schema"]:
            raw["schema"] = TableSchema(tuple(Field(**f) for f in raw["schema"]["fields"]))
        return cls(**raw)

    def build(self, context: EngineContext, password: str = "") -> DataFrame:
        inner = EngineContext(context.spark)
        if self.kind == "database":
            known = dict(self.options)
            system, split = known.pop("system"), known.pop("split", None)
            kind = {"sqlserver": database.SqlServer, "mysql": database.MySql, "postgres": database.Postgres, "snowflake": database.Snowflake, "jdbc": database.Jdbc}[system]
            df = inner.register_database(self.name, kind(**known, **({"password": password} if password else {})), self.path, split=tuple(split) if split else None)
        else:
            register, kind = {"csv": (inner.register_csv, CsvOptions), "json": (inner.register_json, JsonOptions), "avro": (inner.register_avro, AvroOptions), "parquet": (inner.register_parquet, ParquetOptions)}[self.kind]
            declared = self.schema.ddl() if self.schema else None
            df = register(self.name, self.path, options=kind(**self.options), **({"schema": declared} if declared and self.kind in ("csv", "json") else {}))
            if declared and self.kind in ("avro", "parquet"):  # these have types of their own
                df = inner.register(self.name, df.select(*(F.col(f"`{f.name}`").cast(f.type) for f in self.schema.fields)), replace=True)
        return context.register(self.name, inner.sql(self.query) if self.query else df)


@dataclass
class Query:
    name: str
    sql: str
    index: int = 0
    limit: int = 0


@dataclass
class Result:
    name: str
    df: DataFrame
    rows: int | None = None


@dataclass
class Workbook:
    tables: list[TableReference] = field(default_factory=list)
    queries: list[Query] = field(default_factory=list)

    def start(self, spark: SparkSession, passwords: dict[str, str] | None = None) -> Run:
        """``passwords``: by name of the table."""
        context = EngineContext(spark)
        for t in self.tables:
            t.build(context, (passwords or {}).get(t.name, ""))
        return Run(context, sorted(self.queries, key=lambda q: q.index))


class Run:
    """An open workbook. A query that is run again replaces its former result."""

    def __init__(self, context: EngineContext, queries: list[Query]):
        self.context, self.queries = context, queries
        self.results: dict[str, Result] = {}
        self.profiler = Profiler("workbook")

    def execute(self, name: str) -> Result:
        query = next(q for q in self.queries if q.name == name)
        with self.profiler.step(name) as step:
            df = self.context.sql(query.sql)
            if query.limit:
                df = enforce_limit(df, query.limit)
            if name in self.results:
                self.results[name].df.unpersist()
            df = df.persist()
            # the run itself: what follows reads its kept result
            counted, seen = self.profiler.counted(df, step)
            step.rows = counted.count()
            step.batches = 0 if seen.get["last"] is None else seen.get["last"] + 1
            self.context.register(name, df, replace=True)
        self.results[name] = Result(name, df, step.rows)
        return self.results[name]

    def execute_all(self) -> list[Result]:
        return [self.execute(q.name) for q in self.queries]

    def close(self) -> None:
        for r in self.results.values():
            r.df.unpersist()
        self.profiler.stop()
