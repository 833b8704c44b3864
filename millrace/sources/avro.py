"""Avro object container files, read and written without an extra module.

Files are split at block boundaries: a task opens its file, looks for the first sync marker at or after its start and reads
blocks until one begins past its end, so large files are read by many tasks. Any file system that pyarrow knows can be used.
Codecs null and deflate. Records, arrays, maps and unions of several types come out as JSON text, bytes and fixed as base64
text, enums as text; date and timestamp logical types are kept. Columns are in order of name, as for JSON lines.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.sources.options import AvroOptions

MAGIC = b"Obj\x01"
_EPOCH = datetime.datetime(1970, 1, 1)
_WIDE = decimal.Context(prec=80)
_DAY = datetime.date(1970, 1, 1)


# ---- binary values


def _long(f) -> int:
    shift = value = 0
    while True:
        b = f.read(1)
        if not b:
            raise EOFError
        value |= (b[0] & 0x7F) << shift
        if b[0] < 0x80:
            return (value >> 1) ^ -(value & 1)
        shift += 7


def _put_long(out: bytearray, value: int) -> None:
    value = (value << 1) ^ (value >> 63)
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)


def _bytes(f) -> bytes:
    return f.read(_long(f))


def _blocks(f) -> Iterator[int]:
    while n := _long(f):
        if n < 0:
            _long(f)  # size in bytes
            n = -n
        yield from range(n)


def decode(schema, f, named: dict):
    """One value as a Python object."""
    if isinstance(schema, list):
        return decode(schema[_long(f)], f, named)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return decode(kind, f, named)
    if kind in named and not (isinstance(schema, dict) and kind in ("record", "enum", "fixed")):
        return decode(named[kind], f, named)
    if kind == "null":
        return None
    if kind == "boolean":
        return f.read(1) == b"\x01"
    if kind in ("int", "long"):
        value, logical = _long(f), isinstance(schema, dict) and schema.get("logicalType")
        if logical == "date":
            return _DAY + datetime.timedelta(value)
        if logical in ("timestamp-millis", "local-timestamp-millis"):
            return _EPOCH + datetime.timedelta(milliseconds=value)
        if logical in ("timestamp-micros", "local-timestamp-micros"):
            return _EPOCH + datetime.timedelta(microseconds=value)
        return value
    if kind == "float":
        return struct.unpack("<f", f.read(4))[0]
    if kind == "double":
        return struct.unpack("<d", f.read(8))[0]
    if kind == "bytes":
        return _number(_bytes(f), schema)
    if kind == "string":
        return _bytes(f).decode()
    if kind == "record":
        return {x["name"]: decode(x["type"], f, named) for x in schema["fields"]}
    if kind == "enum":
        return schema["symbols"][_long(f)]
    if kind == "fixed":
        return _number(f.read(schema["size"]), schema)
    if kind == "array":
        return [decode(schema["items"], f, named) for _ in _blocks(f)]
    if kind == "map":
        return {_bytes(f).decode(): decode(schema["values"], f, named) for _ in _blocks(f)}
    raise ValueError(f"unknown type {kind}")


def _number(raw: bytes, schema):
    """The decimal that bytes stand for, if the schema says so."""
    if isinstance(schema, dict) and schema.get("logicalType") == "decimal":
        return decimal.Decimal(int.from_bytes(raw, "big", signed=True)).scaleb(-schema.get("scale", 0), _WIDE)
    return raw


def _names(schema, named: dict) -> dict:
    if isinstance(schema, list):
        for s in schema:
            _names(s, named)
    elif isinstance(schema, dict):
        if schema.get("name") and schema["type"] in ("record", "enum", "fixed"):
            named[schema["name"]] = schema
        for s in [f["type"] for f in schema.get("fields", [])] + [schema[k] for k in ("items", "values") if k in schema]:
            _names(s, named)
    return named


def header(f) -> tuple[dict, str, bytes]:
    """(schema, codec, sync marker) of an open file."""
    if f.read(4) != MAGIC:
        raise ValueError("not an Avro container file")
    meta = {}
    for _ in _blocks(f):
        key = _bytes(f).decode()
        meta[key] = _bytes(f)
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), f.read(16)


# ---- Spark types


def _plain_type(schema) -> T.DataType:
    if isinstance(schema, list):
        real = [s for s in schema if s != "null"]
        return _plain_type(real[0]) if len(real) == 1 else T.StringType()
    kind = schema["type"] if isinstance(schema, dict) else schema
    logical = schema.get("logicalType") if isinstance(schema, dict) else None
    if kind in ("int", "long") and logical == "date":
        return T.DateType()
    if kind == "long" and logical and "timestamp" in logical:
        return T.TimestampType()
    if kind in ("bytes", "fixed") and logical == "decimal" and schema["precision"] <= 38:
        return T.DecimalType(schema["precision"], schema.get("scale", 0))
    if isinstance(kind, (dict, list)):
        return _plain_type(kind)
    return {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType()}.get(kind, T.StringType())


def spark_schema(schema: dict) -> T.StructType:
    return T.StructType([T.StructField(f["name"], _plain_type(f["type"])) for f in sorted(schema["fields"], key=lambda f: f["name"])])


def _cell(value, kind: T.DataType):
    if value is None or not isinstance(kind, T.StringType):
        return value.replace(tzinfo=datetime.timezone.utc) if isinstance(value, datetime.datetime) else value
    if isinstance(value, bytes):
        return base64.b64encode(value).decode()
    return value if isinstance(value, str) else json.dumps(value, default=lambda x: base64.b64encode(x).decode() if isinstance(x, bytes) else str(x), ensure_ascii=False)


_ARROW = {"boolean": pa.bool_(), "integer": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "date": pa.date32(), "timestamp": pa.timestamp("us", "UTC"), "string": pa.string()}


def _arrow(kind: T.DataType) -> pa.DataType:
    return pa.decimal128(kind.precision, kind.scale) if isinstance(kind, T.DecimalType) else _ARROW[kind.typeName()]


# ---- reading


def _open(uri: str):
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _files(uri: str) -> list[tuple[str, int]]:
    system, path = _open(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    found = [x for x in system.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and x.path.lower().endswith(".avro")]
    prefix = uri.split("://")[0] + "://" if "://" in uri else ""
    return [(prefix + x.path, x.size) for x in sorted(found, key=lambda x: x.path)]


def _seek_block(f, sync: bytes, start: int, head: int, size: int) -> int:
    """Where the first block after a sync marker at or behind ``start`` begins."""
    if start <= head:
        return head
    at, step = start - 16, 1 << 16
    while at < size:
        f.seek(at)
        piece = f.read(step + 16)
        if (i := piece.find(sync)) >= 0:
            return at + i + 16
        at += step
    return size


def rows_of(uri: str, start: int, end: int) -> Iterator[dict]:
    """The records of the blocks that begin in [start, end)."""
    system, path = _open(uri)
    with system.open_input_file(path) as f:
        schema, codec, sync = header(f)
        size, head, named = f.size(), f.tell(), _names(schema, {})
        at = _seek_block(f, sync, start, head, size)
        f.seek(at)
        while at < min(end, size):
            n = _long(f)
            data = _bytes(f)
            if f.read(16) != sync:
                raise ValueError(f"broken block at {at} in {uri}")
            at = f.tell()
            block = BytesIO(zlib.decompress(data, -15) if codec == "deflate" else data)
            if codec not in ("null", "deflate"):
                raise ValueError(f"codec {codec} is not supported")
            for _ in range(n):
                yield decode(schema, block, named)


def _read_splits(kinds: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([pa.field(k.name, _arrow(k.dataType)) for k in kinds])

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([_cell(r.get(k.name), k.dataType) for r in rows], t.type) for k, t in zip(kinds, target)], schema=target)

        for splits in batches:
            for uri, start, end in zip(*(c.to_pylist() for c in splits.columns)):
                rows = []
                for row in rows_of(uri, start, end):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return run


def read_avro(spark: SparkSession, path: str, options: AvroOptions | None = None) -> DataFrame:
    """A container file or a directory of them; the first file by name gives the schema."""
    options = options or AvroOptions()
    found = _files(path)
    if not found:
        raise FileNotFoundError(f"no .avro file in {path}")
    system, first = _open(found[0][0])
    with system.open_input_file(first) as f:
        kinds = spark_schema(header(f)[0])
    splits = [(uri, a, min(a + options.split_bytes, size)) for uri, size in found for a in range(0, max(size, 1), options.split_bytes)]
    tasks = spark.createDataFrame(splits, "uri string, start bigint, end bigint").repartition(len(splits), "uri", "start")
    return tasks.mapInArrow(_read_splits(kinds), kinds)


# ---- writing


def _avro_type(kind: T.DataType):
    if isinstance(kind, T.DateType):
        return {"type": "int", "logicalType": "date"}
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return {"type": "long", "logicalType": "timestamp-micros"}
    if isinstance(kind, T.DecimalType):
        return {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
    names = {T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.BinaryType: "bytes"}
    return names.get(type(kind), "string")


def encode(kind, value, out: bytearray) -> None:
    """One value of a nullable field."""
    if value is None:
        out.append(0)
        return
    out.append(2)
    if isinstance(kind, dict):
        if kind["logicalType"] == "date":
            _put_long(out, (value - _DAY).days)
        elif kind["logicalType"] == "decimal":
            whole = int(value.scaleb(kind["scale"], _WIDE))
            raw = whole.to_bytes(whole.bit_length() // 8 + 1, "big", signed=True)
            _put_long(out, len(raw))
            out += raw
        else:
            _put_long(out, (value.replace(tzinfo=None) - _EPOCH) // datetime.timedelta(microseconds=1))
    elif kind == "boolean":
        out.append(value)
    elif kind in ("int", "long"):
        _put_long(out, value)
    elif kind in ("float", "double"):
        out += struct.pack("<f" if kind == "float" else "<d", value)
    else:
        data = value if isinstance(value, bytes) else (value if isinstance(value, str) else json.dumps(value, default=str)).encode()
        _put_long(out, len(data))
        out += data


def _write_part(columns: list[tuple[str, object]], uri: str, codec: str):
    schema = json.dumps({"type": "record", "name": "row", "fields": [{"name": n, "type": ["null", k]} for n, k in columns]}).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sync = f"part-{uuid.uuid4().hex}.avro", uuid.uuid4().bytes
        system, folder = _open(uri)
        wrote = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if wrote is None:
                wrote = system.open_output_stream(f"{folder}/{name}")
                head = bytearray(MAGIC)
                _put_long(head, 2)
                for k, v in (("avro.schema", schema), ("avro.codec", codec.encode())):
                    for x in (k.encode(), v):
                        _put_long(head, len(x))
                        head += x
                head.append(0)
                wrote.write(bytes(head) + sync)
            data = bytearray()
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for (_, kind), value in zip(columns, row):
                    encode(kind, value, data)
            body = zlib.compress(bytes(data), 6)[2:-4] if codec == "deflate" else bytes(data)
            block = bytearray()
            _put_long(block, batch.num_rows)
            _put_long(block, len(body))
            wrote.write(bytes(block) + body + sync)
        if wrote is not None:
            wrote.close()
            yield pa.RecordBatch.from_pydict({"name": [name]})

    return run


def write_avro(df: DataFrame, path: str, codec: str = "deflate", *, mode: str = "error") -> None:
    """One file per partition with rows. Files are written aside and moved when their task has succeeded, so a task that is
    run again leaves nothing behind; only the files' names come to the driver. ``mode`` (error, append, overwrite, ignore)
    says what happens where the folder exists; what is overwritten goes when the new files are there."""
    if mode not in ("error", "append", "overwrite", "ignore"):
        raise ValueError(f"mode {mode!r} is not one of error, append, overwrite, ignore")
    system, folder = _open(path)
    there = system.get_file_info(folder).type != fs.FileType.NotFound
    if there and mode == "ignore":
        return
    if there and mode == "error":
        raise FileExistsError(f"{path} exists")
    old = [x.path for x in system.get_file_info(fs.FileSelector(folder)) if x.path.lower().endswith(".avro")] if there and mode == "overwrite" else []
    aside = f"{folder}/_temporary-{uuid.uuid4().hex}"
    system.create_dir(aside, recursive=True)
    columns = [(f.name, _avro_type(f.dataType)) for f in df.schema]
    uri = path if "://" in path or path.startswith("file:") else folder
    written = [name for (name,) in df.mapInArrow(_write_part(columns, f"{uri}/{aside.rsplit('/', 1)[1]}", codec), "name string").collect()]
    for x in old:
        system.delete_file(x)
    for name in written:
        system.move(f"{aside}/{name}", f"{folder}/{name}")
    system.delete_dir(aside)
