"""Caches of source reads: in memory, and durable with an expiry."""

from __future__ import annotations

import json
import shutil
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class CacheOptions:
    """Where durable copies lie, under which key, and for how many minutes one is good (0: for ever)."""

    directory: str
    key: str
    minutes: float = 0


class CacheProvider(Protocol):
    """Where durable copies lie: files by name below ``root``, a URI that Spark reads and writes."""

    root: str

    def exists(self, name: str) -> bool: ...
    def names(self, name: str) -> list[str]: ...
    def read(self, name: str) -> str: ...
    def write(self, name: str, text: str) -> None: ...
    def move(self, a: str, b: str) -> bool: ...
    def delete(self, name: str) -> None: ...


class LocalProvider:
    """A folder of this machine, for local sessions."""

    def __init__(self, folder: str):
        self.folder, self.root = Path(folder), f"file://{Path(folder).resolve()}"

    def exists(self, name: str) -> bool:
        return (self.folder / name).exists()

    def names(self, name: str) -> list[str]:
        return sorted(p.name for p in (self.folder / name).iterdir()) if self.exists(name) else []

    def read(self, name: str) -> str:
        return (self.folder / name).read_text()

    def write(self, name: str, text: str) -> None:
        (self.folder / name).parent.mkdir(parents=True, exist_ok=True)
        (self.folder / name).write_text(text)

    def move(self, a: str, b: str) -> bool:
        (self.folder / a).rename(self.folder / b)
        return True

    def delete(self, name: str) -> None:
        if (self.folder / name).is_dir():
            shutil.rmtree(self.folder / name)
        else:
            (self.folder / name).unlink(missing_ok=True)


class Storage:
    """A folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.system = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.path(name))) if self.exists(name) else []

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.system.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def move(self, a: str, b: str) -> bool:
        return self.system.rename(self.path(a), self.path(b))

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)


class DurableCache:
    """Parquet copies at <directory>/<key>/<version> with a note that names the version, when it was made and when it ends.

    A copy is written aside and becomes visible when the note is written, so readers never see half of one. The version
    before stays for those who still read it; older ones go.
    """

    def __init__(self, spark: SparkSession, options: CacheOptions, clock: Callable[[], float] = time.time, provider: CacheProvider | None = None):
        self.spark, self.options, self.clock = spark, options, clock
        self.storage = provider or Storage(spark, options.directory)

    def _note(self) -> dict | None:
        name = f"{self.options.key}/note.json"
        if not self.storage.exists(name):
            return None
        note = json.loads(self.storage.read(name))
        fresh = note["expires"] is None or self.clock() < note["expires"]
        return note if fresh and self.storage.exists(f"{self.options.key}/{note['version']}") else None

    def hit(self) -> bool:
        return self._note() is not None

    def write(self, df: DataFrame) -> DataFrame:
        """Keeps a copy now and returns it."""
        version, now = uuid.uuid4().hex, self.clock()
        name = f"{self.options.key}/note.json"
        former = json.loads(self.storage.read(name))["version"] if self.storage.exists(name) else None
        df.write.parquet(f"{self.storage.root}/{self.options.key}/{version}")
        note = {"version": version, "created": now, "expires": now + 60 * self.options.minutes if self.options.minutes else None}
        self.storage.write(name, json.dumps(note))
        for old in self.storage.names(self.options.key):
            if old not in ("note.json", version, former) and not old.startswith("."):
                self.storage.delete(f"{self.options.key}/{old}")
        return self._read(version)

    def _read(self, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.storage.root}/{self.options.key}/{version}")

    def read(self, source: Callable[[], DataFrame]) -> DataFrame:
        """The copy if there is a good one, else the source, of which a copy is kept."""
        note = self._note()
        return self._read(note["version"]) if note else self.write(source())

    def clear(self) -> None:
        self.storage.delete(self.options.key)


class MemoryCache:
    """Reads each source once a session; what executors have no memory for goes to their disks."""

    def __init__(self):
        self.kept: dict[str, DataFrame] = {}

    def read(self, key: str, source: Callable[[], DataFrame]) -> DataFrame:
        if key not in self.kept:
            self.kept[key] = source().persist()
        return self.kept[key]

    def clear(self) -> None:
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()
