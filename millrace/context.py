"""The engine: a registry of named tables and the SQL entry point."""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from millrace import dialect
from millrace.plans import explain as plans
from millrace.profile import Profiler, Step
from millrace.sources import avro, database, files, memory
from millrace.sources.options import AvroOptions, CsvOptions, JsonOptions, ParquetOptions

#: Whose table a view of the session shows now.
_owners: dict[tuple[int, str], weakref.ref] = {}


@dataclass
class QueryOptions:
    """Settings of one query: a cap on its rows (0: none) and hooks on the frame before it is handed out."""

    max_results: int = 0
    modify: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)


class EngineContext:
    """Registers sources as tables and answers SELECT and EXPLAIN over them; duplicate names are an error."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}

    # ---- registry

    @property
    def tables(self) -> list[str]:
        return list(self._tables)

    def register(self, name: str, df: DataFrame, replace: bool = False) -> DataFrame:
        if name.lower() in {t.lower() for t in self._tables} and not replace:
            raise ValueError(f"table {name!r} exists")
        self._tables[name] = df
        self._show(name)
        return df

    def drop(self, name: str) -> None:
        self._tables.pop(name)
        self.spark.catalog.dropTempView(name)

    def table(self, name: str) -> DataFrame:
        return self._tables[name]

    def _show(self, name: str) -> None:
        self._tables[name].createOrReplaceTempView(name)
        _owners[id(self.spark), name.lower()] = weakref.ref(self)

    def register_parquet(self, name: str, *paths: str, options: ParquetOptions | None = None) -> DataFrame:
        return self.register(name, files.read_parquet(self.spark, *paths, options=options))

    def register_csv(self, name: str, *paths: str, options: CsvOptions | None = None, schema: str | None = None) -> DataFrame:
        return self.register(name, files.read_csv(self.spark, *paths, options=options, schema=schema))

    def register_csv_directory(self, name: str, path: str, options: CsvOptions | None = None) -> DataFrame:
        return self.register(name, files.read_csv_directory(self.spark, path, options))

    def register_json(self, name: str, *paths: str, options: JsonOptions | None = None, schema: str | None = None) -> DataFrame:
        return self.register(name, files.read_json(self.spark, *paths, options=options, schema=schema))

    def register_json_directory(self, name: str, path: str, options: JsonOptions | None = None) -> DataFrame:
        return self.register(name, files.read_json_directory(self.spark, path, options))

    def register_avro(self, name: str, path: str, options: AvroOptions | None = None) -> DataFrame:
        return self.register(name, avro.read_avro(self.spark, path, options))

    def register_database(self, name: str, connection: database.Connection, query: str, max_results: int = 0, split: tuple[str, int, int, int] | None = None) -> DataFrame:
        """``split`` (column, low, high, parts) reads the query's result in parallel ranges of a column."""
        return self.register(name, database.read(self.spark, connection, query, max_results, split))

    def register_rows(self, name: str, rows: Iterable, schema: str) -> DataFrame:
        return self.register(name, memory.rows(self.spark, rows, schema))

    def register_query(self, name: str, sql: str) -> DataFrame:
        """A table that is itself a query over registered tables."""
        return self.register(name, self.sql(sql))

    def register_file_query(self, name: str, file_table: str, df: DataFrame, sql: str) -> DataFrame:
        """A query over one file, which it sees as ``file_table``: the file's own engine, apart from this one's tables."""
        inner = EngineContext(self.spark)
        inner.register(file_table, df)
        return self.register(name, inner.sql(sql))

    # ---- queries

    def sql(self, text: str, options: QueryOptions | None = None) -> DataFrame:
        """One SELECT or EXPLAIN statement."""
        found = dialect.statements(text)
        if len(found) != 1:
            raise ValueError(f"one statement is expected, there are {len(found)}")
        words = [t.low for t in dialect.tokens(found[0]) if t.kind not in ("space", "comment")]
        if words[0] == "explain":
            inner = found[0].lstrip()[len("explain") :]
            if [t.low for t in dialect.tokens(inner) if t.kind == "word"][:1] == ["explain"]:
                raise ValueError("EXPLAIN can't be nested")
            return plans.explain(self.sql(inner, options))
        if words[0] not in ("select", "with", "(", "values"):
            raise ValueError(f"only SELECT and EXPLAIN are supported, not {words[0].upper()}")
        for name in self._tables:
            if (owner := _owners.get((id(self.spark), name.lower()))) is None or owner() is not self:
                self._show(name)
        df = self.spark.sql(dialect.rewrite(found[0]))
        options = options or QueryOptions()
        for change in options.modify:
            df = change(df)
        return df.limit(options.max_results) if options.max_results else df

    def run(self, text: str, action: Callable[[DataFrame], object] = DataFrame.collect, options: QueryOptions | None = None, profiler: Profiler | None = None) -> tuple[object, Step]:
        """The action's result, and the query as a step of the profiler: planning and run times, rows and batches."""
        profiler = profiler or Profiler()
        with profiler.step("query") as step:
            with profiler.step("plan"):
                df = self.sql(text, options)
                df._jdf.queryExecution().executedPlan()
            result = profiler.run("run", df, action)
        step.rows, step.batches = step.steps[-1].rows, step.steps[-1].batches
        return result, step

    def explain(self, text: str) -> DataFrame:
        return self.sql(f"EXPLAIN {text}")

    @contextmanager
    def cancellable(self):
        """Actions inside carry a tag; ``cancel(tag)`` from another thread stops them."""
        tag = f"millrace-{uuid4().hex}"
        self.spark.sparkContext.addJobTag(tag)
        try:
            yield tag
        finally:
            self.spark.sparkContext.removeJobTag(tag)

    def cancel(self, tag: str) -> None:
        self.spark.sparkContext.cancelJobsWithTag(tag)
