"""The corpus pipeline: five stages from documents to token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import jaccard, langid, lines, mixing, pieces
from weft.plans.scratch import drop_table, table_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the kernels know; the rest go.

    The model is trained on this stage's own rows, at most 300 a language. A
    null or empty text is no language and goes, as does one whose best score
    is low or hardly leads. Rows with a null language or source take part as
    any other; a null id only in training doesn't. Ties between languages are
    no lead, so such a text goes. Rows that repeat are judged each, the
    longest texts whole. Without any labelled text all rows go; an empty
    table gives an empty one. Columns other than those of documents go.
    """
    found = langid.identify_language(docs.select(*COLUMNS), langid.train_language(docs), keep_columns=True)
    return found.where("accepted").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that too many documents share, n_chars anew; documents that lose every line go.

    The document with the least id keeps such a line. A null text stays, a
    row with a null id keeps its lines, an empty text that lost nothing
    stays. Rows that repeat count as one document and are cut alike; ties
    don't arise. Texts are taken whole; an empty table gives an empty one.
    Columns other than those of documents go.
    """
    left = lines.dedup_lines(docs.select(*COLUMNS)).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near or exact copies, the one with the least id.

    Rows with a null id, null texts and texts without words have no copies
    and stay; rows that share an id stay or go together; of equal texts the
    least id stays. Texts are compared whole; an empty table gives an empty
    one. Columns other than those of documents go.
    """
    return jaccard.drop_near_copies(docs.select(*COLUMNS)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order; those of sources that are short of their weight come round again.

    Every row is used at least once. A null source is a source of its own, a
    null or blank text is placed with the document that follows it, and rows
    that repeat have places each. Ties in the position go by the hash and
    the id. An empty table gives an empty one. Columns other than those of
    documents go.
    """
    return mixing.mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, in place of its text.

    A null text has null ids and an empty one none; texts are encoded whole,
    rows that repeat each. Among segmentations of equal score pieces that
    begin first win. An empty table gives an empty one. Columns other than
    those of documents and of the encoding go.
    """
    return pieces.encode_pieces(docs.select(*COLUMNS), pieces.build(), keep_columns=True).drop("text")


STAGES = [("language_id", identify), ("line_dedup", dedup_lines), ("jaccard_join", drop_near), ("mixing", mix), ("sentencepiece", encode)]
#: SQL can't express the kernels of the first stage or the Viterbi search of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next; the last one's input stays there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = table_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                drop_table(spark, before)
            before = path
    return docs
