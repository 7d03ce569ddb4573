"""TF-IDF and embedding neighbours, clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.text import cosine
from weft.plans.scratch import cut
from weft.sources.io import finished

#: Java looks the usual letters up in one table; the classes of others are asked beyond ASCII only.
_LETTER = "[abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_[[^\\x00-\\x7f]&&[\\p{L}\\p{N}]]]"
TERM = f"{_LETTER}{_LETTER}++"


def tfidf(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, weight): raw counts times ln((1 + n) / (1 + df)) + 1, rows of length 1."""
    n = df.agg(F.count("*").alias("_n"))
    tf = _frequencies(df, F.col(id_col), text_col)
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(n).select("term", (F.log((1.0 + F.col("_n")) / (1.0 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "term", (F.col("w") / norm).alias("weight"))


def _frequencies(df: DataFrame, id_: Column, text_col: str) -> DataFrame:
    """(id, term, tf), kept in the shared folder. Texts are brought together by id, and their terms are counted where they are cut."""
    own = df.select(id_.alias("id"), F.col(text_col).alias("_t")).repartition("id")
    return cut(own.select("id", F.explode(F.regexp_extract_all(F.lower("_t"), F.lit(TERM), F.lit(0))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf")))


#: Weights of query terms that go to every task.
QUERY_TERMS = 5_000_000


def nearest_text(df: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_col: str) -> DataFrame:
    """(id, nearest, score): the query text of the highest TF-IDF cosine, the least id among equals; 0 and null where no term is shared.

    Weights are fitted on both tables together. Frequencies are counted in
    one pass; of the terms, those that queries have go to every task as a
    sparse matrix, whose size is checked (QUERY_TERMS weights at most), and
    documents are scored against it in Arrow batches.
    """
    docs, asked = (_frequencies(d, F.col(i).cast("bigint"), text_col) for d, i in ((df, id_col), (queries, query_col)))
    n = df.count() + queries.count()
    freq = cut(docs.select("term").union(asked.select("term")).groupBy("term").agg((F.log((1.0 + n) / (1.0 + F.count("*"))) + 1).alias("idf")))
    w = docs.join(freq, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    q = asked.join(freq, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    if (size := asked.count()) > QUERY_TERMS:
        raise ValueError(f"{size} query weights are more than {QUERY_TERMS}; ask in parts")
    got = q.toArrow()
    qid, which = np.unique(got["id"].to_numpy(), return_inverse=True)
    term, col = np.unique(np.array(got["term"].to_pylist(), dtype=str), return_inverse=True)
    weight = got["w"].to_numpy()
    weight = weight / np.sqrt(np.bincount(which, weight**2))[which] if len(weight) else weight
    order = np.argsort(col, kind="stable")
    which, weight, at = which[order], weight[order], np.searchsorted(col[order], np.arange(len(term) + 1))
    spark = df.sparkSession
    place = spark.createDataFrame(pd.DataFrame({"term": term, "c": np.arange(len(term))}), "term string, c int")
    sent = spark.sparkContext.broadcast((qid, which, weight, at))
    rows = w.join(F.broadcast(place), "term", "left").groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c", "w")))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, query, value, start = sent.value
        for batch in batches:
            x = batch.column("x")
            row = np.repeat(np.arange(batch.num_rows), np.diff(x.offsets.to_numpy()))
            c, v = (x.flatten().field(k).to_numpy() for k in range(2))
            v = v / batch.column("norm").to_numpy()[row]
            size = start[c + 1] - start[c]
            end = np.cumsum(size)
            entry = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start[c] - (end - size), size)
            pair = np.repeat(row, size) * np.int64(max(1, len(ids))) + query[entry]
            each, inverse = np.unique(pair, return_inverse=True)
            score = np.round(np.bincount(inverse, np.repeat(v, size) * value[entry], len(each)), 6)
            own = each // max(1, len(ids))
            by = np.lexsort((each, -score, own))
            head = by[np.flatnonzero(np.concatenate([[True], own[by][1:] != own[by][:-1]]))] if len(by) else by
            yield pa.record_batch([batch.column("id").take(pa.array(own[head])), pa.array(ids[each[head] % max(1, len(ids))] if len(head) else np.zeros(0, np.int64)), pa.array(score[head])], names=["id", "nearest", "score"])

    best = rows.mapInArrow(run, "id bigint, nearest bigint, score double")
    return df.select(F.col(id_col).alias("id")).join(best, "id", "left").select("id", "nearest", F.coalesce("score", F.lit(0.0)).alias("score"))


def nearest_vector(df: DataFrame, queries: DataFrame, id_col: str, vec_col: str, query_col: str, most: int = 10000) -> DataFrame:
    """(id, nearest, score): the query vector of the highest cosine, the least id among equals. At most ``most`` queries fit a task."""
    if queries.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} query vectors; cluster them first")
    q = queries.select(F.col(query_col).alias("q"), F.col(vec_col).alias("_qv"))
    pair = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v")).crossJoin(F.broadcast(q)).select("id", "q", F.round(cosine("_v", "_qv"), 6).alias("score"))
    return pair.groupBy("id").agg(F.max_by("q", F.struct("score", -F.col("q"))).alias("nearest"), F.max("score").alias("score"))


def lloyd_step(df: DataFrame, centers: DataFrame, id_col: str, vec_col: str, center_col: str, most: int = 10000) -> DataFrame:
    """(id, center): the nearest center by squared distance, the least id among equals. At most ``most`` centers fit a task."""
    if centers.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} centers")
    c = centers.select(F.col(center_col).alias("center"), F.col(vec_col).alias("_c"))
    far = F.aggregate(F.zip_with("_v", "_c", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    pair = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v")).crossJoin(F.broadcast(c)).select("id", "center", F.round(far, 6).alias("far"))
    return pair.groupBy("id").agg(F.min_by("center", F.struct("far", "center")).alias("center"))


def kmeans(df: DataFrame, id_col: str, vec_col: str, k: int, seed: int = 42) -> DataFrame:
    """(id, label) by k-means; labels run below k."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = df.select(F.col(id_col).alias("id"), array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=k, seed=seed).fit(own).transform(own).select("id", F.col("prediction").alias("label"))


#: Names of the two texts in rows of each kind of source.
FIELDS = {"oss": ("problem", "solution"), "evol": ("instruction", "output"), "codealpaca": ("instruction", "response")}


def text_of(df: DataFrame, kind: str) -> Column:
    """Both texts of a row with a space between; a missing one is empty."""
    if kind not in FIELDS:
        raise ValueError(f"unknown kind of source: {kind}")
    a, b = (F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("") for c in FIELDS[kind])
    return F.concat(a, F.lit(" "), b)


def embed(df: DataFrame, text: Column, load: Callable[[], Callable[[list[str]], list[list[float]]]], instruction: str = "", batch: int = 64) -> DataFrame:
    """df with ``embedding``: a model of the caller's, loaded once a task, on instruction and text."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            given = [instruction + x for x in part.fillna("")]
            yield pd.Series([v for k in range(0, len(given), batch) for v in model(given[k : k + batch])], index=part.index)

    return df.withColumn("embedding", run(text))


def memoised(spark: SparkSession, root: str, parts: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
    """A table by what it was made from: read where it was written before, else made and written."""
    path = f"{root.rstrip('/')}/{sha256(chr(0).join(parts).encode()).hexdigest()[:16]}"
    if not finished(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def classify(df: DataFrame, queries: DataFrame, id_col: str, vec_col: str, query_col: str) -> DataFrame:
    """nearest_vector() that raises where a query is no row's nearest."""
    found = cut(nearest_vector(df, queries, id_col, vec_col, query_col))
    never = [r[0] for r in queries.select(query_col).join(found, F.col(query_col) == F.col("nearest"), "left_anti").limit(10).collect()]
    if never:
        raise ValueError(f"labels that no row has: {never}")
    return found


def shares(df: DataFrame, label: str) -> DataFrame:
    n = F.count("*")
    return df.groupBy(label).agg(n.alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
