"""Exact and near-duplicate removal."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import md5, sha1

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import codeblocks, squeeze
from weft.plans.graph import components
from weft.plans.scratch import cut

PRIME = (1 << 61) - 1
_PARTS = re.compile("[^A-Za-z_0-9]")
REASONS = ("seeds", "problems", "solutions")


def greedy_dedup(df: DataFrame, order: str, keys: list[str], reasons: tuple[str, ...] = REASONS) -> DataFrame:
    """Keep a row if each of its keys is new among the rows kept before it, in ``order``.

    What a dropped row has doesn't count as seen, so this isn't the first row
    of each key. In rounds: rows that come first among the undecided in all
    their groups are kept, undecided rows that share a key with them go. A group is
    reduced to its first row before the shuffle, so a key may be any size.
    Adds ``keep`` and ``reason``: the first key, in order, that a kept row
    before it has. Null keys equal each other; order must be unique.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    todo = cut(df.select(F.col(order).alias("_o"), *[F.md5(F.coalesce(F.concat(F.lit("v"), F.col(k).cast("string")), F.lit("n"))).alias(n) for k, n in zip(keys, ks)]))
    every, kept = todo, None
    while not todo.isEmpty():
        first = todo
        for k in ks:
            first = first.join(todo.groupBy(k).agg(F.min("_o").alias("_o")), [k, "_o"], "left_semi")
        win = cut(first.select("_o", *ks))
        kept = win if kept is None else kept.unionByName(win)
        for k in ks:
            todo = todo.join(win.select(k).distinct(), k, "left_anti")
        todo = cut(todo)
    if kept is None:
        return df.withColumns({"keep": F.lit(True), "reason": F.lit(None).cast("string")})
    said = every.join(kept.select("_o", F.lit(True).alias("keep")), "_o", "left")
    why = None
    for k, r in zip(ks, reasons):
        said = said.join(kept.select(k, F.col("_o").alias(f"_by{k}")), k, "left")
        hit = F.col(f"_by{k}") < F.col("_o")
        why = F.when(hit, f"duplicate {r}") if why is None else why.when(hit, f"duplicate {r}")
    keep = F.coalesce("keep", F.lit(False))
    return df.join(said.select("_o", keep.alias("keep"), F.when(~keep, why).alias("reason")), F.col(order) == F.col("_o")).drop("_o")


def clean_three_keys(df: DataFrame, order: str, seed: str = "seed", problem: str = "problem", solution: str = "solution") -> DataFrame:
    """greedy_dedup() over seed, problem and solution without white space."""
    named = df.withColumns({f"_s{i}": squeeze(c) for i, c in enumerate((seed, problem, solution))})
    return greedy_dedup(named, order, ["_s0", "_s1", "_s2"]).drop("_s0", "_s1", "_s2")


def copies_problem(problem: Column | str, solution: Column | str) -> Column:
    """Does a code block of the solution equal one of the problem, white space aside?"""
    blocks = lambda c: F.transform(codeblocks(c), squeeze)
    return F.coalesce(F.arrays_overlap(blocks(problem), blocks(solution)), F.lit(False))


def band_shape(threshold: float, permutations: int, fp: float = 0.5, fn: float = 0.5) -> tuple[int, int]:
    """(bands, rows): the least weighed area of false positives and negatives, by Simpson's rule."""
    best, found = np.inf, (1, 1)

    def area(f, a: float, b: float) -> float:
        x = np.linspace(a, b, 2001)
        y = f(x)
        return float((b - a) / 6000 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()))

    for bands in range(1, permutations + 1):
        for rows in range(1, permutations // bands + 1):
            miss = lambda s: (1 - s**rows) ** bands  # noqa: B023, E731
            cost = fp * area(lambda s: 1 - miss(s), 0.0, threshold) + fn * area(miss, threshold, 1.0)  # noqa: B023
            if cost < best:
                best, found = cost, (bands, rows)
    return found


def permutations(n: int, seed: int = 42) -> list[tuple[int, int]]:
    rng = np.random.RandomState(seed)
    return [(int(rng.randint(1, PRIME, dtype=np.uint64)), int(rng.randint(0, PRIME, dtype=np.uint64))) for _ in range(n)]


#: Bytes of a text that are no part of a word become spaces; a character beyond ASCII is one such byte.
_SPACED = bytes(c if _PARTS.fullmatch(chr(c)) is None and c < 128 else 32 for c in range(256))
#: Texts signed at a time, shingles hashed at a time, and hashes permuted at a time.
_TEXTS, _HASHED, _PERMUTED = 128, 32768, 128
_SHA1_ROUNDS = ((20, 0x5A827999), (40, 0x6ED9EBA1), (60, 0x8F1BBCDC), (80, 0xCA62C1D6))


def _sha1_first(w: np.ndarray) -> np.ndarray:
    """The first word of the SHA-1 of messages of one block each, whose 16 words are the rows of w; w is overwritten."""
    n = w.shape[1]
    a, b, c, d, e = (np.full(n, h, np.uint32) for h in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0))
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    one, two, five, by27, by30, by31 = (np.uint32(k) for k in (1, 2, 5, 27, 30, 31))
    i = 0
    for end, k in _SHA1_ROUNDS:
        k = np.uint32(k)
        for i in range(end - 20, end):
            x = w[i & 15]
            if i >= 16:
                x ^= w[(i - 3) & 15]
                x ^= w[(i - 8) & 15]
                x ^= w[(i - 14) & 15]
                np.right_shift(x, by31, out=t)
                x <<= one
                x |= t
            if end == 20:
                np.bitwise_xor(c, d, out=t)
                t &= b
                t ^= d
            elif end == 60:
                np.bitwise_or(b, c, out=t)
                t &= d
                np.bitwise_and(b, c, out=u)
                t |= u
            else:
                np.bitwise_xor(b, c, out=t)
                t ^= d
            t += e
            t += x
            t += k
            np.left_shift(a, five, out=u)
            t += u
            np.right_shift(a, by27, out=u)
            t += u
            np.left_shift(b, by30, out=u)
            b >>= two
            b |= u
            a, b, c, d, e, t = t, a, b, c, d, e
    return a + np.uint32(0x67452301)


def _hashes(text: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The first four bytes, as little-endian numbers, of the SHA-1 of each text[start:stop]."""
    out = np.empty(len(start), np.uint32)
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text + bytes(64), np.uint8), 64)
    byte = np.arange(64, dtype=np.int64)
    for at in range(0, len(start), _HASHED):
        s = start[at : at + _HASHED]
        size = stop[at : at + _HASHED] - s
        block = rows[s]
        block *= byte < size[:, None]
        fits = np.flatnonzero(size < 56)
        block[fits, size[fits]] = 0x80
        block[:, 62], block[:, 63] = size >> 5, size << 3 & 255
        out[at : at + len(s)] = _sha1_first(np.ascontiguousarray(block.view(">u4").astype(np.uint32).T)).byteswap()
        for k in np.flatnonzero(size >= 56):  # more than one block
            out[at + k] = int.from_bytes(sha1(text[s[k] : s[k] + size[k]]).digest()[:4], "little")
    return out


def _signer(n_perm: int) -> Callable[[np.ndarray], np.ndarray]:
    """Least (hash * a + b) mod 2^64 mod PRIME mod 2^32 of an array of hashes under each permutation; all ones of none."""
    ab = np.array(permutations(n_perm), dtype=np.uint64)
    a, b, low32, prime, top, one = ab[:, 0].copy(), ab[:, 1].copy(), np.uint64((1 << 32) - 1), np.uint64(PRIME), np.uint64(61), np.uint32(1)
    wide, high = np.empty((2, _PERMUTED, n_perm), np.uint64)

    def exact(v: np.ndarray) -> np.ndarray:
        low = np.full(n_perm, low32, np.uint64)
        for at in range(0, len(v), _PERMUTED):
            low = np.minimum(low, ((v[at : at + _PERMUTED, None] * a + b) % prime & low32).min(0))
        return low

    def sign(v: np.ndarray) -> np.ndarray:
        # x mod PRIME is the low 61 bits plus the high 3, less PRIME where that isn't below it. One more than that sum is kept
        # in 32 bits: up to 7 it may be a sum that PRIME has to be taken from, or one that wrapped, and any other is right.
        v = v.astype(np.uint64)
        low = np.full(n_perm, low32, np.uint32)
        for at in range(0, len(v), _PERMUTED):
            part = v[at : at + _PERMUTED, None]
            x, y = wide[: len(part)], high[: len(part)]
            np.multiply(part, a, out=x)
            x += b
            np.right_shift(x, top, out=y)
            x += y
            halves = x.view("<u4")
            halves += one
            np.minimum(low, np.minimum.reduce(halves, axis=0)[::2], out=low)
        return exact(v) if len(v) == 0 or low.min() <= 7 else (low - one).astype(np.uint64)

    return sign


def minhash(df: DataFrame, id_col: str, text_col: str, *, n_perm: int = 256, ngram: int = 5, least: int = 10) -> DataFrame:
    """(id, signature): the least hash of the shingles under each permutation; all ones for short texts.

    Products wrap at 64 bits before the remainder, as unsigned machine words
    do. Shingles are hashed abreast, and signatures leave a few texts at a
    time, so a task's memory is that of one Arrow batch of texts.
    """

    def hashed(texts: list[str]) -> Iterator[np.ndarray]:
        spaced = [t.encode("ascii", "replace").translate(_SPACED) for t in texts]
        starts, stops, counts, base = [], [], [], 0
        for b in spaced:
            gap = np.flatnonzero(np.frombuffer(b, np.uint8) == 32)
            n = len(gap) + 2 - ngram if len(gap) + 1 >= least else 0
            counts.append(max(0, n))
            if n > 0:
                starts.append(base + np.concatenate([[0], gap + 1])[:n])
                stops.append(base + np.concatenate([gap, [len(b)]])[-n:])
            base += len(b)
        v = _hashes(b"".join(spaced), np.concatenate(starts), np.concatenate(stops)) if starts else np.zeros(0, np.uint32)
        yield from np.split(v, np.cumsum(counts)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = _signer(n_perm)
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                some = batch.slice(at, _TEXTS)
                flat = np.concatenate([sign(v) for v in hashed(some.column("t").to_pylist())]).astype(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, n_perm, dtype=np.int32), pa.array(flat))
                yield pa.record_batch([some.column("id"), lists], names=["id", "signature"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(run, f"id {kind}, signature array<bigint>")


def _banded(signed: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, k, v): the MD5 of each band of each signature."""
    wide = 8 * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = np.arange(bands, dtype=np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                each = [np.asarray(x.values, "<i8").tobytes() for x in some.column("signature")]
                prints = [md5(x[k * wide : (k + 1) * wide]).digest() for x in each for k in range(bands)]
                ids = some.column("id").take(pa.array(np.repeat(np.arange(len(each)), bands)))
                yield pa.record_batch([ids, pa.array(np.tile(which, len(each))), pa.array(prints, pa.binary())], names=["id", "k", "v"])

    kind = signed.schema["id"].dataType.simpleString()
    return signed.mapInArrow(run, f"id {kind}, k int, v binary")


def minhash_edges(signed: DataFrame, bands: int, rows: int) -> DataFrame:
    """(a, b): every id that shares a band with others, and the least id there.

    Texts are signed once: their bands, 16 bytes each, are kept in the shared
    folder. A band's ids are reduced to the least one before the shuffle.
    """
    banded = cut(_banded(signed, bands, rows))
    low = banded.groupBy("k", "v").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1")
    return banded.join(low, ["k", "v"]).where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def minhash_clusters(df: DataFrame, id_col: str, text_col: str, *, n_perm: int = 256, threshold: float = 0.7, ngram: int = 5, least: int = 10, shape: tuple[int, int] | None = None) -> DataFrame:
    """(id, cluster): the least id among all that bands connect, directly or not."""
    bands, rows = shape or band_shape(threshold, n_perm)
    label = components(cut(minhash_edges(minhash(df, id_col, text_col, n_perm=n_perm, ngram=ngram, least=least), bands, rows)))  # read more than once
    ids = df.select(F.col(id_col).alias("id"))
    return ids.join(label, "id", "left").select("id", F.coalesce("label", "id").alias("cluster"))
