"""Benchmark decontamination by substring, with provenance and a cache."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.text import joined_lower

#: Characters of patterns in one automaton; more of them are searched for in parts.
PART_CHARS = 64_000_000
#: Texts searched at a time, which is what a task has in memory besides an Arrow batch and the automaton.
TEXTS = 128


def pattern_table(*sources: tuple[str, DataFrame], ignored: set[str] = frozenset()) -> DataFrame:
    """(bench_ord, benchmark, item_ord, pattern) of named sources with columns (item_ord, pattern); ignored ones aren't read."""
    out = None
    for k, (name, df) in enumerate(s for s in sources if s[0] not in ignored):
        own = df.select(F.lit(k).alias("bench_ord"), F.lit(name).alias("benchmark"), F.col("item_ord").cast("bigint").alias("item_ord"), "pattern")
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("every source is ignored")
    return out


def _parts(patterns: DataFrame) -> Iterator[list[tuple[str, int, int]]]:
    """The patterns in lower case with their order, of PART_CHARS characters at most each time, and once if there are none."""
    low = patterns.select(F.lower("pattern").alias("_p"), "bench_ord", "item_ord")
    parts = max(1, -(-low.agg(F.coalesce(F.sum(F.length("_p")), F.lit(0))).first()[0] // PART_CHARS))
    for k in range(parts):
        yield [(r["_p"], r["bench_ord"], r["item_ord"]) for r in low.where(F.pmod(F.xxhash64("_p"), F.lit(parts)) == k).toLocalIterator()]


def matches(docs: DataFrame, patterns: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(id, benchmark, matched_substring): for each row that has a pattern in it, in any case, the first in (bench_ord, item_ord).

    The columns are searched as one text with blank lines between, by an
    Aho-Corasick automaton. An empty pattern is in every text.
    """
    text = docs.select(F.col(id_col).alias("_id"), joined_lower(*text_cols).alias("_t"))
    hit = None
    for rows in _parts(patterns):
        own = _automaton(text, ["_id"], rows).where("bench_ord is not null")
        hit = own if hit is None else hit.unionByName(own)
    first = F.min_by(F.struct("benchmark", "pattern"), F.struct("bench_ord", "item_ord"))
    found = hit.join(patterns, ["bench_ord", "item_ord"]).groupBy("_id").agg(first.alias("m"))
    return found.select(F.col("_id").alias(id_col), F.col("m.benchmark").alias("benchmark"), F.col("m.pattern").alias("matched_substring"))


def _automaton(text: DataFrame, keep: list[str], rows: list[tuple[str, int, int]]) -> DataFrame:
    """The columns to keep of every row, with the order of the first pattern in its _t or nulls; map-only."""
    least: dict[str, tuple[int, int]] = {}
    for p, a, b in rows:
        least[p] = min(least.get(p, (a, b)), (a, b))
    always = least.pop("", None)
    sent = text.sparkSession.sparkContext.broadcast((list(least.items()), always))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        items, empty = sent.value
        tree = ahocorasick.Automaton()
        for p, order in items:
            tree.add_word(p, order)
        if items:
            tree.make_automaton()
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            best = []
            for t in batch.column("_t").to_pylist():
                seen = {order for _, order in tree.iter(t)} if items else set()
                best.append(min([*seen, *([empty] if empty else [])], default=(None, None)))
            yield pa.record_batch([*(batch.column(c) for c in keep), *(pa.array([x[k] for x in best], kind) for k, kind in ((0, pa.int32()), (1, pa.int64())))], names=[*keep, "bench_ord", "item_ord"])

    kinds = ", ".join(f"`{c}` {text.schema[c].dataType.simpleString()}" for c in keep)
    return text.mapInArrow(run, f"{kinds}, bench_ord int, item_ord bigint")


def decontaminate(docs: DataFrame, patterns: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """docs with filter_reason and matched_substring; both are null for rows to keep.

    While one automaton holds all patterns, rows pass through it with all
    their columns and none is shuffled.
    """
    if {"filter_reason", "matched_substring"} & set(docs.columns):
        raise ValueError("the input has filter_reason or matched_substring already")
    every = list(_parts(patterns)) if patterns.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0] <= PART_CHARS // 2 else None  # lower case may be longer
    if every is not None and len(every) == 1 and not {"bench_ord", "item_ord", "_t"} & {c.lower() for c in docs.columns}:
        tagged = _automaton(docs.withColumn("_t", joined_lower(*text_cols)), docs.columns, every[0])
        named = patterns.groupBy("bench_ord", "item_ord").agg(F.min(F.struct(F.concat("benchmark", F.lit("_match")).alias("filter_reason"), F.col("pattern").alias("matched_substring"))).alias("_m"))
        return tagged.join(F.broadcast(named), ["bench_ord", "item_ord"], "left").select(*[F.col(f"`{c}`") for c in docs.columns], "_m.filter_reason", "_m.matched_substring")
    found = matches(docs, patterns, id_col, text_cols)
    return docs.join(found.select(F.col(id_col).alias("_hit"), F.concat("benchmark", F.lit("_match")).alias("filter_reason"), "matched_substring"), F.col(id_col) == F.col("_hit"), "left").drop("_hit")


def excluded(tagged: DataFrame, columns: list[str]) -> DataFrame:
    return tagged.where("filter_reason is not null").select(F.struct(*columns).alias("data"), "filter_reason", "matched_substring")


def meta(tagged: DataFrame, lang_col: str | None = "lang") -> DataFrame:
    """Counts of excluded rows by language and reason; without a language column all are ``unknown``."""
    lang = F.col(lang_col) if lang_col in tagged.columns else F.lit("unknown")
    return tagged.where("filter_reason is not null").groupBy(lang.alias("lang"), "filter_reason").agg(F.count("*").alias("n"))


def split_cache(patterns: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns that the cache hasn't searched for, those that it has)."""
    keys = cached.select("benchmark", "pattern").distinct()
    return patterns.join(keys, ["benchmark", "pattern"], "left_anti"), patterns.join(keys, ["benchmark", "pattern"], "left_semi")


def cached_exclusions(old: DataFrame, known: DataFrame) -> DataFrame:
    """Cached exclusions (filter_reason, matched_substring, ...) whose patterns are still in use."""
    keys = known.select(F.concat("benchmark", F.lit("_match")).alias("filter_reason"), F.col("pattern").alias("matched_substring")).distinct()
    return old.join(keys, ["filter_reason", "matched_substring"])


def incremental(docs: DataFrame, patterns: DataFrame, cached_patterns: DataFrame, old: DataFrame, key: str, text_cols: list[str]) -> DataFrame:
    """decontaminate() where the cache's verdict goes first and only new patterns are searched for."""
    fresh, known = split_cache(patterns, cached_patterns)
    verdict = cached_exclusions(old, known)
    twice = verdict.groupBy(key).count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError(f"{key} isn't unique among the cached exclusions")
    own = decontaminate(docs, fresh, key, text_cols)
    v = verdict.select(F.col(key).alias("_key"), F.col("filter_reason").alias("_r"), F.col("matched_substring").alias("_m"))
    return own.join(v, F.col(key) == F.col("_key"), "left").withColumns({"filter_reason": F.coalesce("_r", "filter_reason"), "matched_substring": F.when(F.col("_r").isNotNull(), F.col("_m")).otherwise(F.col("matched_substring"))}).drop("_key", "_r", "_m")
