"""Writers: CSV, JSON lines, Parquet, Avro and memory. Each writes one file per partition and never gathers rows.

``Writer`` is what a caller may rely on; a writer of one's own needs no more than its ``write``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame

from millrace.context import EngineContext
from millrace.sources.avro import write_avro


def write_csv(df: DataFrame, path: str, *, header: bool = True, delimiter: str = ",", mode: str = "error") -> None:
    df.write.mode(mode).option("header", header).option("sep", delimiter).option("quote", '"').option("escape", '"').option("dateFormat", "yyyy-MM-dd").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path)


def write_json(df: DataFrame, path: str, *, mode: str = "error") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, *, mode: str = "error", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_memory(df: DataFrame, context: EngineContext, name: str) -> DataFrame:
    """A table of the context, kept in executor memory and on disk where that is short."""
    return context.register(name, df.persist())


class Writer(Protocol):
    def write(self, df: DataFrame) -> None: ...


@dataclass(frozen=True)
class FileWriter:
    """Files of a format at a path: csv, json, parquet or avro, with the options of its function."""

    format: str
    path: str
    options: dict = field(default_factory=dict)

    def write(self, df: DataFrame) -> None:
        {"csv": write_csv, "json": write_json, "parquet": write_parquet, "avro": write_avro}[self.format](df, self.path, **self.options)


@dataclass(frozen=True)
class MemoryWriter:
    context: EngineContext
    name: str

    def write(self, df: DataFrame) -> None:
        write_memory(df, self.context, self.name)


def write_all(df: DataFrame, *writers: Writer) -> None:
    """The same rows to several writers, computed once."""
    kept = df.persist() if len(writers) > 1 else df
    try:
        for w in writers:
            w.write(kept)
    finally:
        if kept is not df and not any(isinstance(w, MemoryWriter) for w in writers):
            kept.unpersist()
