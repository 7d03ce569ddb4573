"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import audio, jaccard, langid, lines, mixing, pieces, quality, sharding, suffixes, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.decode_telephony(audio.documents_as_calls(_table(spark, sf_dir, "documents")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train_quality(docs, _table(spark, sf_dir, "labels")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify_language(docs, langid.train_language(docs))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(_table(spark, sf_dir, "documents"), pieces.build())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.find_toxic(docs, toxicity.train_toxicity(docs, _table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_telephony_audio, op2_quality_rules, op3_suffix_dedup, op4_language_id, op5_sentencepiece, op6_mixing, op7_jaccard_join, op8_sharding, op9_line_dedup, op10_toxicity)}
SQL: dict[str, str] = {"op3_suffix_dedup": suffixes.SQL, "op6_mixing": mixing.SQL, "op7_jaccard_join": jaccard.SQL, "op8_sharding": sharding.sql(), "op9_line_dedup": lines.SQL}
