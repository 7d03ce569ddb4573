"""Resumable generation and streaming variants of the corpus jobs."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.functions.text import sections


def retry(call: Callable[[], object], errors: tuple[type[Exception], ...], *, delay: float = 30.0, factor: float = 2.0, most: int = 5, sleep: Callable[[float], None] = time.sleep) -> object:
    """call(), again after listed errors, each wait a random one to two times ``factor`` longer; the last error is raised."""
    for attempt in range(most + 1):
        try:
            return call()
        except errors:
            if attempt == most:
                raise
            sleep(delay)
            delay *= factor * (1 + random.random())
    raise AssertionError


def pending(prompts: DataFrame, done: DataFrame, key: str = "index") -> DataFrame:
    """Prompts without an answer yet."""
    return prompts.join(done.select(key).distinct(), key, "left_anti")


def resume_at(name: str, fingerprint: str, first: int, last: int, done: DataFrame, key: str = "index") -> int:
    """The index from which a job goes on: after the last answer in ``done``.

    The file's name has to hold the fingerprint of the data and the range of
    indices, and there has to be an answer.
    """
    if fingerprint not in name:
        raise ValueError("the file is of other data")
    if f"{first}_{last}" not in name:
        raise ValueError("the file is of another range")
    top = done.agg(F.max(key)).first()[0]
    if top is None:
        raise ValueError("the file has no answers")
    return int(top) + 1


def generate(prompts: DataFrame, client: Callable[[str, int], tuple[str, str]], *, seed: int = 976) -> DataFrame:
    """Call a client for each (index, prompt): adds finish_reason and content. It gets the prompt and seed + index."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [client(x, seed + int(i)) for i, x in zip(p["index"], p["prompt"])]
            yield p.assign(finish_reason=[g[0] for g in got], content=[g[1] for g in got])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(run, f"{kinds}, finish_reason string, content string")


def parse_answers(answers: DataFrame, first: str, second: str) -> DataFrame:
    """problem and solution of the answers that came to an end and have both, neither empty."""
    x = answers.where("finish_reason = 'stop'").withColumn("_x", sections("content", first, second))
    return x.where("_x is not null and _x.problem <> '' and _x.solution <> ''").select(*answers.columns, "_x.problem", "_x.solution")


def append_once(stream: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Run ``step`` on each micro-batch and append it to ``path``; a batch that is tried again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").json(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str, time_col: str, late: str) -> DataFrame:
    """Rows with a key that no row within the watermark had before."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time_col: str, width: str, late: str, by: str) -> DataFrame:
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width), by).agg(F.count("*").alias("n"))
