"""Shuffles, samples, splits and seed snippets, all from hashes of ids: the same at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import let, lines


def shuffle_key(id_col: Column | str, seed: int) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def shuffled(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    return df.withColumn("_k", shuffle_key(id_col, seed)).orderBy("_k", id_col).drop("_k")


def row_index(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """Row numbers from 0 in a global order, without sorting in one task.

    A range sort numbers rows in each range, and the ranges' counts, a row
    for each, give what comes before. The order must be unique.
    """
    from weft.plans.scratch import cut

    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_local", local).join(ahead, "_part").withColumn(name, F.col("_ahead") + F.col("_local") - 1).drop("_part", "_local", "_ahead")


def head(df: DataFrame, order: str, n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(order).limit(n)


def sample(df: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement; an error where there are fewer."""
    if df.limit(k).count() < k:
        raise ValueError(f"there are fewer than {k} rows")
    return shuffled(df, id_col, seed).limit(k)


def top_up(kept: DataFrame, filler: DataFrame, id_col: str, total: int, seed: int) -> DataFrame:
    """All of one set, filled up to ``total`` from another, shuffled."""
    n = kept.count()
    if n > total:
        raise ValueError(f"{n} rows are more than {total}")
    return shuffled(kept.unionByName(sample(filler, id_col, total - n, seed)), id_col, seed)


def train_test(df: DataFrame, id_col: str, test: float, seed: int) -> DataFrame:
    """df with ``split``: train or test, by a share below 1 (rounded up) or a number of rows."""
    n = df.count()
    k = -int(-n * test // 1) if 0 < test < 1 else int(test)
    if not 0 < k < n:
        raise ValueError("either part would be empty")
    own = shuffled(df, id_col, seed).limit(k).select(F.col(id_col).alias("_test"))
    return df.join(own, F.col(id_col) == F.col("_test"), "left").withColumn("split", F.when(F.col("_test").isNotNull(), "test").otherwise("train")).drop("_test")


def _draw(id_col: str, seed: int, what: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{what}:"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("bigint")


def seed_snippets(df: DataFrame, id_col: str, text_col: str, *, least: int = 1, most: int = 15, seed: int = 976) -> DataFrame:
    """(id, seed): a run of lines of each text, from a drawn line, of a drawn length, cut at the end. Empty texts have none."""
    start, size = _draw(id_col, seed, "start"), (_draw(id_col, seed, "size") % (most - least + 1) + least).cast("int")
    run = lambda ls: F.array_join(F.slice(ls, (start % F.size(ls) + 1).cast("int"), size), "")
    return df.where(F.length(text_col) > 0).select(F.col(id_col).alias("raw_index"), let(lines(text_col), run).alias("seed"))
