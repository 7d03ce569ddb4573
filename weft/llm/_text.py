"""Token and hash kernels over Arrow text columns.

Everything works on the UTF-8 bytes of a whole slice of rows at once: there
is no Python loop over rows or characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {}

#: Bytes up to the space end a word; words() takes this by default.
SPACES = np.arange(256) <= 32
#: Only ASCII letters, digits and bytes of longer characters are in a word.
NOT_ALNUM = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` has about ``most`` bytes in each, a row at least, and 1 << 18 rows at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = offsets(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + most, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows, at + (1 << 18))
            yield batch.slice(at, to - at)
            at = to


def offsets(col: pa.Array) -> np.ndarray:
    """Byte offsets of the rows, one more than rows."""
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    buf = col.buffers()[1]
    if buf is None or buf.size == 0:
        return np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(buf, kind, len(col) + 1, col.offset * kind().itemsize).astype(np.int64)


def content(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and offsets into them that begin at 0; nulls are empty."""
    off = offsets(col)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8, int(off[-1] - off[0]), int(off[0])) if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_MULT**i and its inverse, for i up to n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n + 1:
        for name, base in (("up", _MULT), ("down", _INV)):
            a = np.full(n + 1, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["up"][: n + 1], _POWERS["down"][: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit hash."""
    h = h ^ (h >> np.uint64(32))
    h = h * _STEP
    h ^= h >> np.uint64(32)
    h *= _STEP
    h ^= h >> np.uint64(32)
    return h


def words(data: np.ndarray, off: np.ndarray, ends: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, first): byte spans of words, and the first word of each row (rows + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~ends[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < n]
    begin[heads] = inside[heads]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    tails = off[1:][off[1:] > 0] - 1
    stop[tails] = inside[tails]
    b = np.flatnonzero(begin)
    return b, np.flatnonzero(stop) + 1, np.searchsorted(b, off)


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, the same wherever a span lies."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive hashes; len(h) - n + 1 of them, over row borders too."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out *= _MULT
        out += h[k : k + m]
    return mix(out)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each word, from words()' first."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def within(first: np.ndarray, n: int) -> np.ndarray:
    """For each of grams(n): does it lie in one row?"""
    row = rows_of(first)
    return row[: max(0, len(row) - n + 1)] == row[n - 1 :] if len(row) >= n else np.zeros(0, bool)


def trim() -> None:
    """Give memory that is free again back to the system; a worker that waits for its next task shouldn't hold it."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
    pa.default_memory_pool().release_unused()


def col(name: str) -> Column:
    """The column of this very name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own, like those given, that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, names: list[str]) -> tuple[list[Column], str]:
    """Columns under the names c0, c1, ..., and their schema: mapInArrow() takes no names with dots. toDF() names them again."""
    return [col(c).alias(f"c{k}") for k, c in enumerate(names)], ", ".join(f"c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(names))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that names of our own can't clash with theirs; unpack() takes it apart."""
    return F.struct(*[col(c) for c in df.columns])


def unpack(row: str, columns: list[str]) -> list[Column]:
    return [F.col(row).getField(c).alias(c) for c in columns]


def row_hash(df: DataFrame) -> Column:
    """A hash of a whole row; maps, which can't be hashed, count by their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(col(f.name))) if "map<" in f.dataType.simpleString() else col(f.name) for f in df.schema])


def pair_search(first: np.ndarray, second: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the pairs (first, second), which are in order, come before or equal each (a, b)."""
    lo, hi = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
    out = hi.astype(np.int64)
    tied = np.flatnonzero(lo < hi)
    for x in np.unique(lo[tied]):
        own = tied[lo[tied] == x]
        out[own] = x + np.searchsorted(second[x : hi[own[0]]], b[own], "right")
    return out
