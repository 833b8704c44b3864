"""Tables of rows in memory, of several sources, and of custom readers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def rows(spark: SparkSession, values: Iterable, schema: str) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


def several(*frames: DataFrame) -> DataFrame:
    """Tables of the same columns as one."""
    names = {tuple(f.columns) for f in frames}
    if len(names) != 1:
        raise ValueError("the tables have different columns")
    return reduce(DataFrame.unionByName, frames)


class RowReader:
    """A custom reader: ``schema`` as DDL and ``read(part, parts)``, which yields the tuples of one part."""

    schema: str = ""
    parts: int = 1

    def read(self, part: int, parts: int) -> Iterator[tuple]:
        raise NotImplementedError


class FunctionReader(RowReader):
    def __init__(self, schema: str, produce: Callable[[int, int], Iterator[tuple]], parts: int = 1):
        self.schema, self.produce, self.parts = schema, produce, parts

    def read(self, part: int, parts: int) -> Iterator[tuple]:
        return self.produce(part, parts)


def read_with(spark: SparkSession, reader: RowReader, name: str = "millrace_rows") -> DataFrame:
    """The rows of a custom reader, read part by part by the executors."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(i) for i in range(reader.parts)]

        def read(self, partition):
            yield from reader.read(partition.value, reader.parts)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return reader.schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()
