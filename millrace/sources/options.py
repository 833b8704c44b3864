"""Options of the file formats and descriptions of where files lie."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CsvOptions:
    """``infer_max``: rows looked at for types, 0 for all of them. ``multiline``: whether quoted values hold line breaks; None looks."""

    delimiter: str = ","
    header: bool = True
    infer_max: int = 0
    multiline: bool | None = None


@dataclass(frozen=True)
class JsonOptions:
    """``infer_max``: lines looked at for properties and types, 0 for all of them."""

    infer_max: int = 0


@dataclass(frozen=True)
class ParquetOptions:
    """``merge_schema``: columns of all files instead of one; ``glob``: the names of the files to read, if not all."""

    merge_schema: bool = False
    glob: str = ""


@dataclass(frozen=True)
class AvroOptions:
    infer_max: int = 100
    split_bytes: int = 64 << 20


@dataclass(frozen=True)
class LocalStorage:
    root: str = ""

    def uri(self, path: str) -> str:
        return f"file://{self.root.rstrip('/')}/{path.lstrip('/')}" if self.root else f"file://{path}"

    def conf(self) -> dict[str, str]:
        return {}


@dataclass(frozen=True)
class S3Storage:
    """Objects of a bucket; the keys go to the Hadoop file system, never into a URI."""

    bucket: str
    access_key: str = ""
    secret_key: str = ""
    endpoint: str = ""

    def uri(self, path: str) -> str:
        return f"s3a://{self.bucket}/{path.lstrip('/')}"

    def conf(self) -> dict[str, str]:
        named = {"access.key": self.access_key, "secret.key": self.secret_key, "endpoint": self.endpoint}
        return {f"fs.s3a.bucket.{self.bucket}.{k}": v for k, v in named.items() if v}


@dataclass(frozen=True)
class AzureStorage:
    """Blobs of a container."""

    account: str
    container: str
    key: str = ""

    def uri(self, path: str) -> str:
        return f"abfss://{self.container}@{self.account}.dfs.core.windows.net/{path.lstrip('/')}"

    def conf(self) -> dict[str, str]:
        return {f"fs.azure.account.key.{self.account}.dfs.core.windows.net": self.key} if self.key else {}


def use(spark, storage) -> None:
    """Makes a storage's credentials known to the session's file systems."""
    for k, v in storage.conf().items():
        spark.sparkContext._jsc.hadoopConfiguration().set(k, v)
