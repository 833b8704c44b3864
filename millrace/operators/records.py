"""Problem 1: rows that fail to parse.

Delivered CSV records are parsed in blocks on a columnar path (one Arrow CSV parse and a handful of vectorised checks
for a whole block). The checks are masks over the block's records: valid ones are loaded columnar, whatever stands between
them; a block that the CSV parse itself fails on is bisected down to its failing records. What is left is read by a strict
character-level parser, which names the reason or finds that the record is valid after all (the columnar path
may be too strict, never too lax: a running number in front of each record shows when records were merged or split).

Defined results: a null line is ``null_record``; a feed without a contract, or null, is ``unknown_feed``; an empty line
has too few columns; repeated rows come out as often as they came in; no size is too long; an empty table gives none.
Columns of the input other than the three named are ignored, whatever their names.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Each feed: its columns in order with the type they get, and the checked ones.
FEEDS: dict[str, list[tuple[str, str]]] = {
    "db_employees": [
        ("employee_id", "bigint"), ("first_name", "string"), ("last_name", "string"), ("email", "string"),
        ("phone_number", "string"), ("hire_date", "date"), ("job_id", "string"), ("salary", "double"),
        ("commission_pct", "double"), ("manager_id", "bigint"), ("department_id", "bigint"),
    ],
    "db_locations": [
        ("location_id", "bigint"), ("street_address", "string"), ("postal_code", "string"), ("city", "string"),
        ("state_province", "string"), ("country_id", "string"),
    ],
}

#: Records parsed at once.
BLOCK = 8192

#: By month; 0 and 13 stand for months that don't exist.
_LAST_DAY = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31, 0])

_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
_SALARY = re.compile(r"[0-9]+(\.[0-9]+)?")
_DIGITS = re.compile(r"[0-9]+")
_CONTROL = re.compile(r"[\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffd]")


_COLUMNS = {f: [c for c, _ in cs] for f, cs in FEEDS.items()}


def split_strictly(line: str) -> tuple[list[str] | None, str | None]:
    """The values of one record, or the reason why it can't be split. Spaces around values are removed.

    A quoted value begins and ends with its quotes, so a space outside of them makes it an unquoted value with a quote in it.
    """
    if line.endswith("\r"):
        line = line[:-1]
    if '"' not in line:
        if "\n" in line or "\r" in line:
            return None, "line_break_outside_quotes"
        return [v.strip(" ") for v in line.split(",")], None
    values, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            parts = []
            i += 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None, "unclosed_quote"
                parts.append(line[i:j])
                if j + 1 < n and line[j + 1] == '"':
                    parts.append('"')
                    i = j + 2
                else:
                    i = j + 1
                    break
            if i < n and line[i] != ",":
                return None, "text_after_quote"
            values.append("".join(parts).strip(" "))
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            value = line[i:j]
            if '"' in value:
                return None, "text_before_quote" if value.lstrip(" ")[0] == '"' else "quote_inside_value"
            if "\n" in value or "\r" in value:
                return None, "line_break_outside_quotes"
            values.append(value.strip(" "))
            i = j
        if i >= n:
            return values, None
        i += 1


def _is_day(text: str) -> bool:
    if not _DATE.fullmatch(text):
        return False
    try:
        datetime.date(int(text[:4]), int(text[5:7]), int(text[8:]))
    except ValueError:
        return False
    return True


def _is_address(text: str) -> bool:
    # control characters (category Cc) are U+0000-001F and U+007F-009F
    return any(map(str.isalpha, text)) and _CONTROL.search(text) is None


def diagnose(line: str | None, feed: str | None) -> tuple[list[str] | None, str | None]:
    """(values, None) for a valid record, (None, reason) for any other."""
    if line is None:
        return None, "null_record"
    if feed not in FEEDS:
        return None, "unknown_feed"
    values, reason = split_strictly(line)
    if reason:
        return None, reason
    columns = _COLUMNS[feed]
    if len(values) != len(columns):
        return None, "too_few_columns" if len(values) < len(columns) else "too_many_columns"
    if not _DIGITS.fullmatch(values[0]):
        return None, f"invalid_{columns[0]}"
    row = dict(zip(columns, values))
    if row.get("hire_date") and not _is_day(row["hire_date"]):
        return None, "invalid_hire_date"
    if row.get("salary") and not _SALARY.fullmatch(row["salary"]):
        return None, "invalid_salary"
    if "street_address" in row and not _is_address(row["street_address"]):
        return None, "invalid_street_address"
    return values, None


class _Feed:
    """The columnar path of one feed."""

    def __init__(self, feed: str):
        self.feed, self.columns = feed, [c for c, _ in FEEDS[feed]]
        value = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'
        self.shape = rf"\A{value}(?:,{value}){{{len(self.columns) - 1}}}\z"
        self.types = {"n": pa.string()} | {c: pa.string() for c in self.columns}

    def columns_of(self, lines: pa.Array) -> tuple[list[pa.Array], np.ndarray] | None:
        """The columns of records that have the feed's shape and which of the records are valid; None if the reader takes them otherwise."""
        n = len(lines)
        numbers = pa.array(map(str, range(n)), pa.string())
        block = "\n".join(pc.binary_join_element_wise(numbers, lines, ",").to_pylist()).encode()
        try:
            got = csv.read_csv(
                pa.BufferReader(block),
                csv.ReadOptions(use_threads=False, block_size=len(block) + 16, column_names=["n", *self.columns]),
                csv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
                csv.ConvertOptions(column_types=self.types, strings_can_be_null=False),
            )
        except pa.ArrowInvalid:
            return None
        if got.num_rows != n or not got["n"].combine_chunks().equals(numbers):
            return None
        out = {c: pc.utf8_trim(got[c].combine_chunks(), " ") for c in self.columns}
        ok = [pc.match_substring_regex(out[self.columns[0]], r"\A[0-9]+\z")]
        if "hire_date" in out:
            ok.append(_days(out["hire_date"]))
        if "salary" in out:
            ok.append(pc.match_substring_regex(out["salary"], r"\A(?:[0-9]+(?:\.[0-9]+)?)?\z"))
        if "street_address" in out:
            street = out["street_address"]
            ok.append(pc.match_substring_regex(street, r"\p{L}"))
            ok.append(pc.invert(pc.match_substring_regex(street, r"[\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{fffd}]")))
        return list(out.values()), np.logical_and.reduce([np.asarray(x) for x in ok])

    def pieces(self, lines: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
        """(places, values, reasons) until every record has come once; valid records stay Arrow columns throughout.

        The checks of a block are masks, so its valid records are loaded by the columnar path whatever stands between them; a
        block that the reader fails on is bisected down to its single failing records. Only what is left over is diagnosed.
        """
        bare = pc.replace_substring_regex(lines, r"\r\z", "")
        shaped = np.asarray(pc.match_substring_regex(bare, self.shape))
        left = [np.flatnonzero(~shaped)]
        todo = [at + np.flatnonzero(shaped[at : at + BLOCK]) for at in range(0, len(lines), BLOCK)]
        while todo:
            some = todo.pop()
            if not len(some):
                continue
            if (got := self.columns_of(bare.take(pa.array(some)))) is not None:
                columns, ok = got
                if ok.any():
                    yield some[ok], _side_by_side([x.filter(pa.array(ok)) for x in columns]), pa.nulls(int(ok.sum()), pa.string())
                left.append(some[~ok])
            elif len(some) == 1:
                left.append(some)
            else:
                todo += np.array_split(some, 2)
        rest = np.sort(np.concatenate(left))
        if len(rest):
            values, reasons = zip(*(diagnose(x, self.feed) for x in lines.take(pa.array(rest)).to_pylist()))
            yield rest, pa.array(values, pa.list_(pa.string())), pa.array(reasons, pa.string())

    def parse(self, lines: pa.Array) -> tuple[list[list[str] | None], list[str | None]]:
        """Values and reason of every record in order, as Python lists."""
        values: list = [None] * len(lines)
        reasons: list = [None] * len(lines)
        for at, v, r in self.pieces(lines):
            for i, x, y in zip(at.tolist(), v.to_pylist(), r.to_pylist()):
                values[i], reasons[i] = x, y
        return values, reasons


def _side_by_side(columns: list[pa.Array]) -> pa.Array:
    """Columns of n values as n lists."""
    n, k = len(columns[0]), len(columns)
    order = (np.arange(n)[:, None] + n * np.arange(k)).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.concat_arrays(columns).take(pa.array(order)))


def _days(texts: pa.Array) -> np.ndarray:
    """Which texts are empty or an existing calendar day."""
    written = pc.match_substring_regex(texts, r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    safe = pc.if_else(written, texts, "0000-00-00")
    year, month, day = (np.asarray(pc.utf8_slice_codeunits(safe, a, b).cast(pa.int32())) for a, b in ((0, 4), (5, 7), (8, 10)))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = _LAST_DAY[np.clip(month, 0, 13)] + ((month == 2) & leap)
    return np.asarray(pc.equal(texts, "")) | ((year > 0) & (day >= 1) & (day <= last))


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    feeds = {f: _Feed(f) for f in FEEDS}
    for batch in batches:
        ids, names, lines = batch.columns[0], batch.columns[1], batch.columns[2].cast(pa.string())
        for name in [*feeds, None]:
            if name is None:  # no line or no contract: named at once
                mine = pc.or_kleene(pc.is_null(lines), pc.fill_null(pc.invert(pc.is_in(names, pa.array(list(feeds), pa.string()))), True))
            else:
                mine = pc.and_(pc.fill_null(pc.equal(names, name), False), pc.is_valid(lines))
            where = pc.indices_nonzero(mine)
            if not len(where):
                continue
            own = lines.take(where)
            if name is None:
                nothing = pa.nulls(len(own), pa.list_(pa.string()))
                pieces = [(np.arange(len(own)), nothing, pc.if_else(pc.is_null(own), "null_record", "unknown_feed"))]
            else:
                pieces = feeds[name].pieces(own)
            for at, values, reasons in pieces:
                these = where.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([ids.take(these), names.take(these), values, reasons], names=["record_id", "feed", "fields", "reason"])


def parse_records(records: DataFrame, record_id: str = "record_id", feed: str = "feed", line: str = "raw_line") -> DataFrame:
    """One row per record: record_id, feed, fields (the values as text, null if it failed), reason (null if it is valid).

    One narrow pass, no shuffle; a block never leaves its Arrow batch.
    """
    kind = records.schema[record_id].dataType.simpleString()
    narrow = records.select(F.col(record_id).alias("record_id"), F.col(feed).cast("string").alias("feed"), F.col(line).cast("string").alias("raw_line"))
    return narrow.mapInArrow(_parse_batches, f"record_id {kind}, feed string, fields array<string>, reason string")


def rejected(parsed: DataFrame) -> DataFrame:
    """The records that broke their contract, with the reason."""
    return parsed.filter(F.col("reason").isNotNull()).select("record_id", "feed", "reason")


def typed(parsed: DataFrame, feed: str) -> DataFrame:
    """The valid records of one feed with the columns and types of its table; an empty or untypable free value is null."""
    out = [F.col("record_id")]
    for i, (name, kind) in enumerate(FEEDS[feed]):
        text = F.nullif(F.get("fields", F.lit(i)), F.lit(""))
        out.append((text if kind == "string" else text.try_cast(kind)).alias(name))
    return parsed.filter((F.col("feed") == feed) & F.col("reason").isNull()).select(*out)
