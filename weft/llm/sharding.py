"""Shuffled shards by a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._text import col, pair_search, row_hash, unpack, whole_row

SEED, ROUNDS, ROWS = 29, 6, 8192
#: Ranges of ids at most, and rows of the sample that their borders come from.
PARTS, SAMPLE = 20_000, 1_000_000
_PRIME = (1 << 31) - 1


def keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Multiplier and two offsets of each round, from splitmix64."""
    state, out = seed & ((1 << 64) - 1), []
    for _ in range(rounds):
        row = []
        for _ in range(3):
            state = (state + 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
            z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & ((1 << 64) - 1)
            row.append(int((z ^ (z >> 31)) >> 37))
        out.append((row[0] | (1 << 26) | 1, row[1], row[2]))
    return out


def half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def permute(x: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """The image of row numbers below n under a permutation of range(n).

    A Feistel network permutes the numbers of twice half_bits(n) bits; what
    falls at n or beyond goes through it again until it doesn't (cycle
    walking), which keeps the map one to one. n up to 2**50.
    """
    h = half_bits(n)
    mask = (1 << h) - 1
    out = np.array(x, np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> h, out[todo] & mask
        for a, b, c in keys(seed, rounds):
            f = (((right * a + b) % _PRIME) * (right + c) >> 9) & mask
            left, right = right, left ^ f
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n]
    return out


def unpermute(y: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """The row number that permute() sends to each position."""
    h = half_bits(n)
    mask = (1 << h) - 1
    out = np.array(y, np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> h, out[todo] & mask
        for a, b, c in reversed(keys(seed, rounds)):
            left, right = right ^ ((((left * a + b) % _PRIME) * (left + c) >> 9) & mask), left
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n]
    return out


def locate(row: int, n: int, rows_per_shard: int = ROWS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of a row number, with no look at the data."""
    at = int(permute(np.array([row]), n, seed)[0])
    return at // rows_per_shard, at % rows_per_shard


def row_numbers(df: DataFrame, *, id_col: str = "doc_id", name: str = "row_number", rows_per_part: int = 20000) -> tuple[DataFrame, int]:
    """Global row numbers from 0 in the order of ids, with no single-task sort; and the number of rows.

    Splitters, quantiles of a sample of at most SAMPLE (id, hash of the row),
    cut the table into up to PARTS ranges; rows are numbered in their range,
    after the counts of the ranges before it. Nulls come first; rows with
    one id are ordered by a hash of the row, by which they are cut into
    ranges too, and one that repeats takes as many numbers. Ids are numbers,
    strings, dates or timestamps. Any column names will do; ``name``
    replaces a column that is called so.
    """
    spark = df.sparkSession
    base = df.select(*[col(c) for c in df.columns if c.lower() != name.lower()])
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double", "string", "date", "timestamp"):
        raise TypeError(f"ids of type {kind}")
    key = {"date": F.unix_date, "timestamp": F.unix_micros}.get(kind, lambda c: c)(col(id_col))
    own = base.select(whole_row(base).alias("row"), key.alias("key"), row_hash(base).alias("other"))
    key_kind = own.schema["key"].dataType.simpleString()
    total = own.count()
    parts = min(PARTS, max(1, -(-total // rows_per_part)))
    sample = own.select("key", "other").sample(min(1.0, min(200 * parts, SAMPLE) / total), 3).toArrow() if parts > 1 else None
    none, ids, others = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if sample is not None and sample.num_rows:
        given = sample["key"].combine_chunks()
        known, other = np.array(given.is_valid()), sample["other"].to_numpy()
        step = max(1, sample.num_rows // parts)
        none = np.sort(other[~known])[step::step]
        value, other = np.array(given.drop_null().to_pylist()) if known.any() else ids, other[known]
        order = np.lexsort((other, value))[step::step]
        ids, others = value[order], other[order]
    sent = spark.sparkContext.broadcast((none, ids, others))

    @F.pandas_udf("int")
    def bucket(i: pd.Series, missing: pd.Series, h: pd.Series) -> pd.Series:
        null, first, second = sent.value
        out, no, other = np.zeros(len(i), np.int64), missing.to_numpy(), h.to_numpy()
        out[no] = np.searchsorted(null, other[no], "right")
        if not no.all():
            out[~no] = len(null) + 1 + pair_search(first, second, np.array(i[~no].tolist()), other[~no])
        return pd.Series(out)

    filler = F.lit("") if kind == "string" else F.lit(0).cast(key_kind)  # an integer column with nulls would reach the function as floats
    placed = own.withColumn("part", bucket(F.coalesce("key", filler), F.col("key").isNull(), "other"))
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each range
    before, at = [], 0
    for p, n in counts:
        before.append((p, at))
        at += n
    ahead = spark.createDataFrame(before, "part int, ahead long")
    order = Window.partitionBy("part").orderBy(F.col("key").asc_nulls_first(), "other")
    numbered = placed.withColumn("local", F.row_number().over(order)).join(F.broadcast(ahead), "part")  # PARTS rows at most
    return numbered.select(*unpack("row", base.columns), (F.col("ahead") + F.col("local") - 1).alias(name)), total


def shard_rows(df: DataFrame, *, id_col: str = "doc_id", rows_per_shard: int = ROWS, seed: int = SEED) -> DataFrame:
    """Shuffle a table into shards, the same at every run and on every cluster.

    Result: the columns of df, whatever they are called, then row_number
    (order of ids), position (its image under permute()), shard and slot:
    position divided by rows_per_shard, and what is left over. Rows are
    clustered by shard and sorted by slot. Columns of df that are called so
    are replaced. Null ids come first; rows that tie in the id are ordered
    by a hash of all columns; rows that repeat get places of their own; the
    longest texts don't matter; an empty table gives an empty one; all
    shards but the last are full.
    """
    base = df.select(*[col(c) for c in df.columns if c.lower() not in ("row_number", "position", "shard", "slot")])
    numbered, total = row_numbers(base, id_col=id_col)

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), total, seed))

    placed = numbered.withColumn("position", place("row_number"))
    return placed.withColumns({"shard": F.expr(f"position div {rows_per_shard}"), "slot": F.col("position") % rows_per_shard}).repartition("shard").sortWithinPartitions("shard", "slot")


def _round_sql(inner: str, a: int, b: int, c: int) -> str:
    return f"SELECT start, n, m, r AS l, xor(l, (((r * {a} + {b}) % {_PRIME}) * (r + {c}) >> 9) % m) AS r FROM ({inner})"


def sql() -> str:
    step = "SELECT start, n, m, y // m AS l, y % m AS r FROM walk WHERE step = 0 OR y >= n"
    for a, b, c in keys(SEED):
        step = _round_sql(step, a, b, c)
    return f"""
WITH RECURSIVE size AS (
  SELECT n, (1::BIGINT << greatest(1, ceil(ceil(log2(greatest(n, 2))) / 2)::INTEGER))::BIGINT AS m FROM (SELECT count(*) AS n FROM documents)
), walk(start, n, m, y, step) AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1, n, m, row_number() OVER (ORDER BY doc_id) - 1, 0 FROM documents, size
  UNION ALL
  SELECT start, n, m, l * m + r, 1 FROM ({step})
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.rn AS row_number, y AS position, y // {ROWS} AS shard, y % {ROWS} AS slot
FROM walk JOIN (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents) d ON d.rn = walk.start
WHERE step = 1 AND y < n
"""
