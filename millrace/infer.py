"""Column types of schemaless text, by a ladder of tests over all rows (or a sample, if one is asked for).

The rungs of all values of all columns are found in one aggregation. A column only climbs, and only where the higher type
holds every value: whole numbers to numbers, days to moments; what mixes otherwise stays text, so no value is lost.
"""

from __future__ import annotations

import datetime
import re
from email.utils import parsedate_to_datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rungs from low to high; a column only ever climbs.
LADDER = ["boolean", "bigint", "double", "date", "timestamp", "string"]

_TESTS = [
    ("boolean", re.compile(r"(?i)(?:true|false)")),
    ("bigint", re.compile(r"[+-]?\d{1,18}")),
    ("double", re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")),
    ("date", re.compile(r"\d{4}-\d{2}-\d{2}")),
    ("timestamp", re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?")),
]


def _is_day(text: str) -> bool:
    try:
        datetime.date.fromisoformat(text)
    except ValueError:
        return False
    return True


def value_type(text: str | None) -> str | None:
    """The rung of one value; None for a blank, which tells nothing."""
    if text is None or not text.strip():
        return None
    text = text.strip()
    if text.startswith('"'):
        return "string"
    for name, test in _TESTS:
        if test.fullmatch(text):
            return name if name not in ("date", "timestamp") or _is_day(text[:10]) else "string"
    try:
        parsedate_to_datetime(text)
    except (ValueError, TypeError, IndexError):
        return "string"
    return "timestamp"


#: Which rungs a type can hold.
_HOLDS = {"bigint": {"bigint"}, "double": {"bigint", "double"}, "boolean": {"boolean"}, "date": {"date"}, "timestamp": {"date", "timestamp"}}


def climb(rungs: set[str]) -> str:
    """The lowest type that holds values of all these rungs; without any it is string."""
    return next((kind for kind, held in _HOLDS.items() if rungs and rungs <= held), "string")


def column_types(rows: list[list[str | None]], width: int) -> list[str]:
    """The type of each column of some rows; a column without values is string."""
    seen: list[set[str]] = [set() for _ in range(width)]
    for row in rows:
        for i, text in enumerate(row[:width]):
            if (rung := value_type(text)) is not None:
                seen[i].add(rung)
    return [climb(x) for x in seen]


def _rung(text: Column) -> Column:
    """The rung of a value as ``value_type`` has it, without leaving the JVM."""
    clean = F.nullif(F.trim(text), F.lit(""))
    out = F.when(clean.isNull(), None)
    for name, test in _TESTS:
        shaped = clean.rlike(f"^(?:{test.pattern})$")
        # a day that doesn't exist is text
        out = out.when(shaped & clean.try_cast(name).isNotNull() if name in ("date", "timestamp") else shaped, F.lit(name))
    return out.when(_mail_time(clean).isNotNull(), F.lit("timestamp")).otherwise(F.lit("string"))


def _mail_time(clean: Column) -> Column:
    # a day name in front can't be parsed and says nothing new
    text = F.when(clean.rlike(r"^(?:[A-Za-z]{3}, *)?[0-9]{1,2} [A-Za-z]{3} [0-9]{4} "), F.regexp_replace(clean, r"^[A-Za-z]{3}, *", ""))
    return F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss z"))


def typed(column: str, kind: str) -> Column:
    """A text column as its type; what doesn't fit becomes null."""
    text = F.col(f"`{column}`")
    if kind == "string":
        return text.alias(column)
    clean = F.nullif(F.trim(text), F.lit(""))
    if kind == "timestamp":
        return F.coalesce(clean.try_cast("timestamp"), _mail_time(clean)).alias(column)
    return clean.try_cast(kind).alias(column)


def types_of(texts: DataFrame) -> list[str]:
    """The type of each text column, from one pass over all rows; a handful of rungs a column comes to the driver."""
    if not texts.columns:
        return []
    found = texts.agg(*(F.collect_set(_rung(F.col(f"`{c}`"))).alias(f"c{i}") for i, c in enumerate(texts.columns))).first()
    return [climb(set(x)) for x in found]


def infer(texts: DataFrame, infer_max: int = 0) -> DataFrame:
    """A frame of text columns with inferred types: of all rows, or of the first ``infer_max``; then later misfits are null."""
    types = types_of(texts) if not infer_max else column_types([list(r) for r in texts.limit(infer_max).collect()], len(texts.columns))
    return texts.select(*(typed(c, t) for c, t in zip(texts.columns, types)))
