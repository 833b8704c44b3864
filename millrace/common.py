"""Shared plumbing: reading test tables, cutting lineage, sliced prefix sums."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    """Whether the driver's process is the only one."""
    return bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset a local master has a temporary one (tests); a cluster has none, so that is an error."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not is_local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _own_dir


class Cut:
    """Lineage cuts: tables written to the shared folder and read back.

    A written Parquet table survives the loss of executors and is pruned by column when it is read again.
    ``drop`` removes one that later steps no longer read; the rest stay for the lazy result.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame, by: str | None = None, **counted: Column) -> DataFrame:
        """The table as written. Each of ``counted`` is an aggregate of its rows, found as an attribute afterwards, that costs no pass of its own."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        seen = Observation()
        if counted:
            df = df.observe(seen, *(c.alias(k) for k, c in counted.items()))
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._millrace_path = path
        for k in counted:
            setattr(out, f"_millrace_{k}", seen.get[k])
        return out

    def drop(self, df: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._millrace_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slice_of(*cols: Column | str, slices: int) -> Column:
    """A slice number in [0, slices) that depends on the values alone, so it is the same whenever a task is run again."""
    return F.pmod(F.xxhash64(*cols), F.lit(slices)).cast("int")


def sliced_prefix_sum(df: DataFrame, keys: list[str], order: list[str], weight: str, out: str, slices: int) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows of the same keys that come before, in the order (slice, order).

    Every key is split into ``slices`` by a hash of ``order``, so a key with a third of all rows is worked on by many
    tasks: sums per (keys, slice) are combined before the shuffle, their prefix sums have at most ``slices`` rows a key,
    and only the rows of one slice are ordered together. Keys may be null (a group of its own).
    """
    df = df.withColumn("__slice", slice_of(*order, slices=slices))
    by = [*keys, "__slice"]
    sums = df.groupBy(*by).agg(F.sum(weight).alias("__w"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(by)), F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__in", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    same = F.lit(True)
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = df.join(sums, same, "left").withColumn(out, F.col("__base") + F.col("__in"))
    return joined.drop("__slice", "__in", "__base", *(f"__k{i}" for i in range(len(by))))
