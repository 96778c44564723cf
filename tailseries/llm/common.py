"""What the operators share: reading Arrow text columns as bytes, hashing words, scratch tables.

Texts are processed in pieces of about ``PIECE`` bytes, cut between rows, straight from the
Arrow buffers; a longer text is a piece of its own. All hashes are 64 bits, computed with numpy
from the bytes, and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tailseries.packaging import ship  # noqa: F401 - for the operators
from tailseries.sources.tables import staged

PIECE = 1 << 20
U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators for words of letters and digits only; all bytes beyond ASCII count as letters.
_PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Rolling:
    """Hashes of ranges of a sequence of 64-bit values, from prefix sums of powers of an odd base."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << n.bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, U64(base), U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers(len(prefix))
        return mix((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(U64))


_PLACE = U64(0x9E3779B97F4A7C15)
_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


@dataclass
class Piece:
    """Words of the rows ``lo`` to ``hi`` of a column. Row r has words first[r - lo] to first[r - lo + 1]."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), offsets


def row_groups(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive rows of together at most ``size`` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ascending byte spans, computed in pieces so that memory stays in proportion to PIECE.

    A byte's value is scrambled with its place in the span before values are added up. (A polynomial
    with an odd base modulo 2**64 has long words of two letters that hash alike by construction.)
    """
    out = np.empty(len(starts), U64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PIECE, "right")))
        base = starts[lo]
        first, last = starts[lo:hi] - base, ends[lo:hi] - base
        part = data[base : ends[hi - 1]]
        place = np.arange(len(part), dtype=U64)
        place -= np.repeat(first, np.diff(np.append(first, len(part)))).astype(U64)
        place *= _PLACE
        place += _BYTE_VALUES[part]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(mix(place), out=sums[1:])
        out[lo:hi] = mix((sums[last] - sums[first]) + (last - first).astype(U64))
        lo = hi
    return out


def pieces(
    column: pa.Array, *, lower: bool = False, size: int = PIECE, hashed: bool = True, bare: bool = False
) -> Iterator[Piece]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column, with their hashes if asked for.

    lower folds A to Z; bare ends words at ASCII punctuation too.
    """
    data, offsets = text_buffers(column)
    for lo, hi in row_groups(offsets, size):
        part = data[offsets[lo] : offsets[hi]]
        rows = offsets[lo : hi + 1] - offsets[lo]
        word = ~(_PUNCTUATION if bare else _SPACE)[part]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        cuts = rows[1:-1][rows[1:-1] < len(part)]
        begins[cuts] = word[cuts]
        starts = np.flatnonzero(begins)
        closes = word.copy()
        closes[:-1] &= ~word[1:]
        cuts = rows[1:-1][rows[1:-1] > 0] - 1
        closes[cuts] = word[cuts]
        ends = np.flatnonzero(closes) + 1
        hashes = hash_spans(_LOWER[part] if lower else part, starts, ends) if hashed else starts[:0].astype(U64)
        yield Piece(lo, hi, part, rows, starts, ends, np.searchsorted(starts, rows), hashes)


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive parts of an array, so many values each, as one binary value each."""
    width = values.dtype.itemsize
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(np.asarray(counts, np.int64) * width, out=offsets[1:])
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(
        pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data.view(np.uint8).reshape(-1))]
    )


def unpacked(column: pa.Array | pa.ChunkedArray, kind) -> np.ndarray:
    """All binary values of a column, one after the other, as one array."""
    if isinstance(column, pa.ChunkedArray):
        chunks = column.chunks
    else:
        chunks = [column]
    parts = []
    for c in chunks:
        if len(c):
            offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            if offsets[-1] > offsets[0]:
                parts.append(np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
    if not parts:
        return np.zeros(0, kind)
    return np.concatenate(parts).view(kind)


def grouped(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by small whole-number keys, and how many there are of each."""
    kind = np.uint16 if n <= 1 << 16 else np.uint32
    return np.argsort(keys.astype(kind), kind="stable"), np.bincount(keys, minlength=n)


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two longs that tell rows apart, except rows equal in id and text; null ids are allowed.

    The first is a whole-number id itself, which keeps its order, or a hash of any other id.
    """
    key, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    whole = F.typeof(key).isin("tinyint", "smallint", "int", "bigint")
    name = F.when(whole, key.try_cast("long")).otherwise(F.xxhash64(key.cast("string")))
    return (
        F.when(key.isNull(), F.lit(-(1 << 63))).otherwise(name).alias("_k1"),
        F.xxhash64(text, key.isNull()).alias("_k2"),
    )


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts: sizes of sketches and numbers of buckets follow from it."""
    return docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Written below spark.checkpoint.dir and read again, so that it is computed once."""
    return staged(df, name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
