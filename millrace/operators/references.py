"""Problem 7: references to records that do not exist.

Both sides are read as change deltas of one kind of key: a reference is +1 reference, a delivered target row +1 existence,
its deletion -1. Deltas are summed per key, combined before the shuffle, so a key with a third of all references costs one
row a task. Keys with positive references and zero existence are the current orphans; keys that came after their first
referrer can hold late ones. The state is additive: ``merge_states`` adds a day's deltas to it.

To name the referring records only the suspect keys are needed. Up to ``broadcast_rows`` of them (counted) are broadcast;
beyond that references and suspects are joined with hot keys salted.

Defined results: null or blank keys are no references; records without an id are left out; text keys compare trimmed and
in upper case; a record delivered repeatedly is one reference, dated by its first delivery (a null date sorts first, and a
null date of the target's first row counts as there from the start); if its deliveries name several keys, each counts;
empty tables give no references, or orphans only. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.common import Cut, slice_of


@dataclass(frozen=True)
class Reference:
    """``table.field`` of the record ``record_id`` names ``target.target_key``."""

    table: str
    field: str
    record_id: str
    target: str
    target_key: str


def plain_key(column: str, kind: str) -> Column:
    """The comparable form of a key."""
    text = F.col(column).cast("string")
    return F.nullif(F.upper(F.trim(text)), F.lit("")) if kind == "string" else text


def _targets(df: DataFrame, key: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    return df.select(plain_key(key, kind).alias("key"), F.col("loaded_at").alias("at"), F.col("deleted_at").isNotNull().alias("gone")).filter("key is not null")


def _referrers(df: DataFrame, refs: list[Reference]) -> DataFrame:
    """One row per record and reference: target, table_name, field_name, record_id, key, first (its first delivery)."""
    record = refs[0].record_id
    keys = [plain_key(r.field, df.schema[r.field].dataType.simpleString()).alias(f"k{i}") for i, r in enumerate(refs)]
    narrow = df.select(F.col(record).cast("bigint").alias("record_id"), F.col("loaded_at").alias("at"), *keys).filter("record_id is not null")
    names = [F.collect_set(f"k{i}").alias(f"k{i}") for i in range(len(refs))]
    # a record has one row or a few: repeated deliveries, combined before the shuffle
    records = narrow.groupBy("record_id").agg(F.when(F.count("*") == F.count("at"), F.min("at")).alias("first"), *names)

    def named(r: Reference):
        return lambda k: F.struct(F.lit(r.target).alias("target"), F.lit(r.table).alias("table_name"), F.lit(r.field).alias("field_name"), k.alias("key"))

    pairs = F.flatten(F.array(*(F.transform(f"k{i}", named(r)) for i, r in enumerate(refs))))
    return records.select("record_id", "first", F.explode(pairs).alias("p")).select("p.target", "p.table_name", "p.field_name", "record_id", "p.key", "first")


def referrers(tables: dict[str, DataFrame], refs: list[Reference]) -> DataFrame:
    by_table: dict[str, list[Reference]] = {}
    for r in refs:
        by_table.setdefault(r.table, []).append(r)
    return reduce(DataFrame.unionByName, (_referrers(tables[t], rs) for t, rs in by_table.items()))


def deltas(tables: dict[str, DataFrame], refs: list[Reference], referring: DataFrame | None = None) -> DataFrame:
    """Signed changes: target, key, d_refs, d_rows, d_live and the dates first_ref (latest referrer) and first_row."""
    referring = referrers(tables, refs) if referring is None else referring
    out = referring.select("target", "key", F.lit(1).alias("d_refs"), F.lit(0).alias("d_rows"), F.lit(0).alias("d_live"), F.col("first").alias("ref_at"), F.lit(None).cast("timestamp_ntz").alias("row_at"), F.col("first").isNull().alias("undated"))
    for target, key in dict.fromkeys((r.target, r.target_key) for r in refs):
        rows = _targets(tables[target], key)
        none = F.lit(None).cast("timestamp_ntz").alias("ref_at")
        came = rows.select(F.lit(target).alias("target"), "key", F.lit(0).alias("d_refs"), F.lit(1).alias("d_rows"), F.lit(1).alias("d_live"), none, F.col("at").cast("timestamp_ntz").alias("row_at"), F.lit(False).alias("undated"))
        went = rows.filter("gone").select(F.lit(target).alias("target"), "key", F.lit(0).alias("d_refs"), F.lit(0).alias("d_rows"), F.lit(-1).alias("d_live"), none, F.lit(None).cast("timestamp_ntz").alias("row_at"), F.lit(False).alias("undated"))
        out = out.unionByName(came).unionByName(went)
    return out


def key_states(changes: DataFrame) -> DataFrame:
    """The state of every key: how often it is referred to, its rows and live rows, its first row, its first referrer."""
    return changes.groupBy("target", "key").agg(
        F.sum("d_refs").alias("refs"), F.sum("d_rows").alias("rows"), F.sum("d_live").alias("live"), F.min("ref_at").alias("first_ref"), F.min("row_at").alias("first_row"), F.bool_or("undated").alias("undated")
    )


def merge_states(*states: DataFrame) -> DataFrame:
    """States add up: of separate days, sources or slices."""
    return reduce(DataFrame.unionByName, states).groupBy("target", "key").agg(
        F.sum("refs").alias("refs"), F.sum("rows").alias("rows"), F.sum("live").alias("live"), F.min("first_ref").alias("first_ref"), F.min("first_row").alias("first_row"), F.bool_or("undated").alias("undated")
    )


def orphans(states: DataFrame) -> DataFrame:
    """The current orphan report: keys with references and nothing there."""
    return states.filter("refs > 0 and live = 0")


def broken_references(tables: dict[str, DataFrame], refs: list[Reference], *, broadcast_rows: int = 500_000, hot: int = 1_000_000, salts: int = 64) -> DataFrame:
    """The referring records: table_name, field_name, record_id, key, first, reason (missing, deleted or late)."""
    cut = Cut(next(iter(tables.values())).sparkSession, "references")
    referring = cut(referrers(tables, refs))
    states = key_states(deltas(tables, refs, referring))
    late = (F.col("first_row") > F.col("first_ref")) | (F.col("undated") & F.col("first_row").isNotNull())
    suspects = cut(states.filter((F.col("refs") > 0) & ((F.col("live") == 0) | late)).select("target", "key", "refs", "rows", "live", "first_row"))
    if suspects.count() <= broadcast_rows:
        joined = referring.join(F.broadcast(suspects), ["target", "key"])
    else:
        heavy = F.col("refs") > hot
        spread = suspects.withColumn("salt", F.explode(F.when(heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1)))))
        # hot keys are few by definition (at most rows / hot), so their names can be sent to every task
        hot_keys = suspects.filter(heavy).select("target", "key", F.lit(True).alias("is_hot"))
        marked = referring.join(F.broadcast(hot_keys), ["target", "key"], "left")
        salted = marked.withColumn("salt", F.when(F.col("is_hot"), slice_of("record_id", slices=salts)).otherwise(F.lit(-1))).drop("is_hot")
        joined = salted.join(spread, ["target", "key", "salt"])
    reason = (
        F.when(F.col("rows") == 0, "missing").when(F.col("live") == 0, "deleted")
        .when((F.col("first_row") > F.col("first")) | (F.col("first").isNull() & F.col("first_row").isNotNull()), "late")
    )
    return joined.withColumn("reason", reason).filter("reason is not null").select("table_name", "field_name", "record_id", "key", "first", "reason")


def report(broken: DataFrame) -> DataFrame:
    """Broken references per table, field, month of the record's first delivery and reason."""
    month = F.date_format("first", "yyyy-MM").alias("month")
    return broken.groupBy("table_name", "field_name", month, "reason").agg(F.count("*").alias("n_references"), F.count_distinct("key").alias("n_keys"))
