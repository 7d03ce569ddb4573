"""Reports: rejections, histograms, weighted scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import fixed


def rejections(df: DataFrame, by: str | None = None) -> DataFrame:
    """total, chosen, rejected and their ratio (two decimals, half to even) over rows with ``keep``; the ratio of no rows is null."""
    group = df.groupBy(by) if by else df.groupBy()
    counted = group.agg(F.count("*").alias("total"), F.count_if("keep").alias("chosen"))
    return counted.withColumn("rejected", F.col("total") - F.col("chosen")).withColumn("chosen_ratio", F.when(F.col("total") > 0, fixed(F.col("chosen") / F.col("total"), 2)))


def reasons(df: DataFrame, by: str) -> DataFrame:
    return df.where(~F.col("keep")).groupBy(by, "reason").agg(F.count("*").alias("n"))


def first_examples(df: DataFrame, by: list[str], order: str, n: int = 5) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("example_no", F.row_number().over(w)).where(F.col("example_no") <= n)


def histogram(df: DataFrame, value: str, width: int) -> DataFrame:
    return df.groupBy((F.floor(F.col(value) / width) * width).cast("bigint").alias("bin")).agg((F.count("*") / 1000).alias("thousands")).orderBy("bin")


def score_histogram(df: DataFrame, value: str) -> DataFrame:
    n = df.agg(F.count("*").alias("_n"))
    return df.groupBy(F.bround(value, 2).alias("score")).agg(F.count("*").alias("_c")).crossJoin(n).select("score", (F.col("_c") / F.col("_n")).alias("share"))


def weighted_rate(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Sum of rate times n over sum of n; keys that the dimension lacks are an error."""
    got = df.join(dim, key, "left")
    n = F.coalesce("n", F.raise_error(F.concat(F.lit("no count for "), F.col(key))).cast("bigint"))
    return got.agg((F.sum(F.col("rate") * n) / F.sum(n)).alias("weighted_rate"))
