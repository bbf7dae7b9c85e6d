"""What the operators of this subpackage share: Arrow text access, hashing of words and windows in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import cut, release  # noqa: F401

#: Bytes of text that a task turns into numpy arrays at once (a longer document is a piece of its own).
PIECE = 2 << 20


def columns(docs: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; columns that docs hasn't are null. Extra columns can't clash with the operators' own."""
    have = {c.lower(): c for c in docs.columns}
    return docs.select(*((docs[f"`{have[c]}`"] if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """row (all columns of docs in one, so that none can clash with what is joined), id and node (what stands for the text; a null one is empty)."""
    have = {c.lower(): c for c in docs.columns}
    part = lambda name, kind: (F.col("row").getField(have[name]) if name in have else F.lit(None)).cast(kind)
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    return whole.select("row", part("doc_id", "long").alias("id"), F.xxhash64(F.coalesce(part("text", "string"), F.lit(""))).alias("node"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column one after another, and the offsets of the texts in them. Null is empty."""
    a = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.fill_null(b"")
    a = a.cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, off


def pieces(off: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs of bytes that are inside), and each text's first word in them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    m = inside[data]
    before, after = np.empty_like(m), np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    after[-1], after[:-1] = False, m[1:]
    edge = off[(off > 0) & (off < len(data))]
    before[edge], after[edge - 1] = False, False
    starts, ends = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


#: An odd multiplier for polynomial hashes modulo 2**64 and its inverse; a random value for each byte.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, 1 << 16), base, np.uint64)
        a[0] = 1
        _powers[base] = have = np.multiply.accumulate(a)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sums_of(values: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_of`` hashes any part of values."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
    return sums


def span_of(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each start and end."""
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64))


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_of(sums_of(values), starts, ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans(BYTES[data], starts, ends)


def batch(schema: pa.Schema, *arrays: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def rows_by_text(docs: DataFrame, stays: Callable[[pa.RecordBatch], object]) -> DataFrame:
    """The rows of docs that stay by what their own text says: stays gets rows of text and gives a truth value for each. Nothing is joined by an id."""
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    text = next((c for c in docs.columns if c.lower() == "text"), None)
    whole = whole.withColumn("text", (F.col("row").getField(text) if text else F.lit(None)).cast("string"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            good = rows.filter(pa.array(stays(rows.select(["text"])), pa.bool_()))
            if len(good):
                yield good.select(["row"])

    return whole.mapInArrow(kept, whole.select("row").schema).select("row.*")
