"""Problem 8: encoding texts with a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern and every word into tokens. A short word is held as a contiguous array
of part boundaries with the rank of each adjacent pair; the least rank is searched by scanning, its boundary is deleted and
the two neighbouring ranks are refreshed, until no pair is in the vocabulary. A long word (a text without spaces may be one
word) would make the scans quadratic, so it goes through a heap over linked parts, with the same result. Words repeat, so
their ids are kept in a bounded table per worker.

The vocabulary is a file of fixed size that is broadcast as it is; its path is a parameter.

Defined results: null and empty texts have no tokens, an empty list; special-token strings are ordinary text; white space is
kept; no text is too long; repeated rows come out as often as they came in; an empty table gives no rows. Only the two named
columns are read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the published word pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words of more bytes than this use the heap.
SHORT = 200
#: Words kept per worker; the table is emptied when it is full.
KEPT = 300_000

_NONE = 1 << 60


class Encoder:
    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        self.words = regex.compile(pattern)
        self.kept: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        kept = self.kept
        for word in self.words.findall(text):
            ids = kept.get(word)
            if ids is None:
                ids = self.word(word.encode("utf-8", "replace"))
                if len(kept) >= KEPT:
                    kept.clear()
                if len(word) <= SHORT:
                    kept[word] = ids
            out += ids
        return out

    def word(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self._scan(data) if len(data) <= SHORT else self._heap(data)

    def _scan(self, data: bytes) -> list[int]:
        get = self.ranks.get
        at = list(range(len(data) + 1))
        pair = [get(data[i : i + 2], _NONE) for i in range(len(data) - 1)]
        while pair:
            least = min(pair)
            if least == _NONE:
                break
            i = pair.index(least)
            del at[i + 1]
            del pair[i]
            # pair[i] joined part i with the one that is now its own; refresh what touches the new part
            if i < len(pair):
                pair[i] = get(data[at[i] : at[i + 2]], _NONE)
            if i:
                pair[i - 1] = get(data[at[i - 1] : at[i + 1]], _NONE)
        return [self.ranks[data[a:b]] for a, b in zip(at, at[1:])]

    def _heap(self, data: bytes) -> list[int]:
        get, n = self.ranks.get, len(data)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        todo = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(todo)
        alive = bytearray(b"\1") * n
        while todo:
            _, i, j, stop = heapq.heappop(todo)
            if not (alive[i] and after[i] == j and j < n and alive[j] and end[j] == stop):
                continue  # one of the two has grown since
            alive[j] = 0
            end[i], after[i] = stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get(data[i : end[after[i]]])) is not None:
                    heapq.heappush(todo, (r, i, after[i], end[after[i]]))
            if before[i] >= 0:
                h = before[i]
                if (r := get(data[h:stop])) is not None:
                    heapq.heappush(todo, (r, h, i, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = after[i]
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: bytes) -> Encoder:
    """One encoder a worker and vocabulary."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoded(vocabulary, only_count: bool):
    """Works through the batches in steps of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary.value).encode
        for batch in batches:
            done, ids, held = 0, [], 0
            texts = batch.column(1)
            for i in range(batch.num_rows):
                got = encode(texts[i].as_py())
                ids.append(len(got) if only_count else got)
                held += 1 if only_count else len(got) + 1
                if held >= 500_000:
                    yield _out(batch, done, i + 1, ids, only_count)
                    done, ids, held = i + 1, [], 0
            if ids:
                yield _out(batch, done, batch.num_rows, ids, only_count)

    return run


def _out(batch: pa.RecordBatch, a: int, b: int, ids: list, only_count: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.int64() if only_count else pa.list_(pa.int32()))], names=["id", "out"])


def _apply(df: DataFrame, key: str, text: str, path: str, only_count: bool, kind: str) -> DataFrame:
    narrow = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    id_type = df.schema[key].dataType.simpleString()
    return narrow.mapInArrow(_encoded(_vocabulary(df.sparkSession, path), only_count), f"id {id_type}, out {kind}")


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """key, ids: the token ids of every row's text. One narrow pass."""
    return _apply(df, key, text, path, False, "array<int>").toDF(key, "ids")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """key, n_tokens."""
    return _apply(df, key, text, path, True, "bigint").toDF(key, "n_tokens")
