"""Readers and writers for corpus files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = ("python", "cpp", "csharp", "java", "php", "rust", "swift", "typescript", "shell")
REMAP = {"csharp": "c-sharp"}
#: Languages that come from a corpus of their own.
ELSEWHERE = frozenset({"swift"})


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str | None = None, strict: bool = True) -> DataFrame:
    """JSON lines; a line that isn't JSON is an error, or with strict off a row of nulls."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(paths)


def texts_of(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns of JSON rows, by name; a null or a key that no row has is an empty text."""
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def read_json(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(paths)


def read_texts(spark: SparkSession, glob: str) -> DataFrame:
    """(path, value): a row for each whole file."""
    return spark.read.option("wholetext", True).text(glob).select(F.col("_metadata.file_path").alias("path"), "value")


def read_language(spark: SparkSession, root: str, lang: str) -> DataFrame:
    """A corpus laid out by language: only that language's folder is read."""
    return spark.read.parquet(root).where(F.col("lang") == REMAP.get(lang, lang))


def read_seed_language(spark: SparkSession, root: str, other_root: str, lang: str) -> DataFrame:
    """read_language() from the corpus that has the language."""
    return read_language(spark, other_root if lang in ELSEWHERE else root, lang)


def lang_of_metric(path: Column) -> Column:
    """The language in the name of a metric file: what follows the first hyphen, up to an underscore."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.substring_index(F.get(F.split(name, "-"), F.lit(1)), "_", 1)


def lang_of_path(path: Column) -> Column:
    """The second part of a file name between hyphens, which must be a known language."""
    name = F.get(F.split(F.element_at(F.split(path, "/"), -1), "-"), F.lit(1))
    return F.when(name.isin(*LANGUAGES), name).otherwise(F.raise_error(F.concat(F.lit("no known language in "), path)))


def read_tagged(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON lines with a ``lang`` column from the file names; an input that has one is an error."""
    df = read_jsonl(spark, paths, schema)
    if "lang" in df.columns:
        raise ValueError("the input has a lang column already")
    return df.withColumn("lang", lang_of_path(F.col("_metadata.file_path")))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_document(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small table as one JSON document (a report; its rows pass through one task)."""
    df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value")).coalesce(1).write.mode(mode).text(path)


def write_shards(df: DataFrame, path: str, order: str, shard_bytes: int, total_bytes: int) -> None:
    """Parquet in contiguous ranges of ``order``, in number with the bytes."""
    df.repartitionByRange(total_bytes // shard_bytes + 1, order).sortWithinPartitions(order).write.mode("errorifexists").parquet(path)


def write_by_language(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").partitionBy("lang").parquet(path)


def write_scores(df: DataFrame, path: str, id_col: str, score_col: str, nearest_col: str) -> None:
    """Scores and indices of the nearest rows, a JSON object for each row."""
    df.select(F.col(id_col).alias("id"), F.col(score_col).alias("score"), F.col(nearest_col).alias("nearest")).write.mode("overwrite").json(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Has a writer completed this folder? Asks the file system that the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
