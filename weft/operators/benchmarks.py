"""Extraction rules for benchmark tables: what of each problem a corpus is searched for."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import let, strip

#: Solutions so short and common that any corpus has them.
GENERIC = ("return x + y", "return len(string)", "return n**2", "return .join(strings)")
LANGUAGES = "cpp cs d go java jl js lua php pl py r rb rkt rs scala sh swift ts".split()
MARKS = ("SOLUTION START", "BEGIN SOLUTION")


def _fail(why: str) -> Column:
    return F.raise_error(F.lit(why)).cast("string")


def before_mark(prompt: Column) -> Column:
    """The prompt up to its solution mark; an error where neither mark is there or the first that is stands there twice."""
    out = None
    for mark in MARKS:
        has, parts = F.contains(prompt, F.lit(mark)), F.size(F.split(prompt, mark, -1))
        own = F.when(parts == 2, F.substring_index(prompt, mark, 1)).otherwise(_fail("a prompt has its solution mark twice"))
        out = F.when(has, own) if out is None else out.when(has, own)
    return out.otherwise(_fail("a prompt has no solution mark"))


def quoted_docstring(prompt: Column) -> Column:
    """What the last docstring of a prompt says: of two or four triple double quotes, or else of two triple single ones.

    Where more than three quotes stand at the end of a docstring, the last three close it and the others are its own.
    """
    a, b = '"""', "'''"

    def last(q: str, most: int, why: str) -> Column:
        own = f"(?s){q}(.*?){q}(?!{q[0]})"
        good = lambda ds: (F.size(ds) > 0) & (F.size(ds) <= most) & ~F.contains(F.regexp_replace(prompt, own, " "), F.lit(q))
        return let(F.regexp_extract_all(prompt, F.lit(own), F.lit(1)), lambda ds: F.when(good(ds), F.element_at(ds, -1)).otherwise(_fail(why)))

    double, single = last(a, 2, "a prompt has an odd number of docstring quotes"), last(b, 1, "a prompt has no docstring")
    return strip(F.when(F.contains(prompt, F.lit(a)), double).otherwise(single))


def task_range(df: DataFrame, id_col: str, first: int = 11, last: int = 510, expect: int | None = 500) -> DataFrame:
    """The test tasks of a table with all splits; an error unless they are ``expect``."""
    own = df.where(F.col(id_col).between(first, last))
    if expect is not None and (n := own.count()) != expect:
        raise ValueError(f"{n} tasks between {first} and {last} instead of {expect}")
    return own


def texts(df: DataFrame, column: str, *, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the column stripped, less rows where that is empty, null or one of ``drop``."""
    own = df.withColumn(column, strip(column)).where(F.length(column) > 0)
    return own.where(~F.col(column).isin(*drop)) if drop else own


def json_solutions(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, item, solution): every string of a column of JSON lists; empty texts have none, what isn't a list is an error."""
    given = df.where(F.length(column) > 0).select(F.col(id_col).alias("id"), F.col(column).alias("_raw"), F.from_json(column, "array<string>").alias("_all"))
    checked = F.when(F.col("_all").isNull(), F.raise_error(F.concat(F.lit("not a JSON list: "), F.col("_raw"))).cast("array<string>")).otherwise(F.col("_all"))
    return given.select("id", F.posexplode(checked).alias("item", "solution"))


def translated_sets(languages: list[str] = LANGUAGES) -> list[str]:
    """Names of the sets of a benchmark that was translated: sources by languages by variations, where a source has the variation."""
    return [f"{source}-{lang}{kind}" for lang in languages for source, kinds in (("humaneval", ("", "-remove")), ("mbpp", ("",))) for kind in kinds]


def translated_docstrings(spark: SparkSession, read: Callable[[str], DataFrame], languages: list[str] = LANGUAGES) -> DataFrame:
    """(name, prompt) of all translated sets, stripped; ``read`` gives a set's table by its name."""
    out = None
    for name in translated_sets(languages):
        own = read(name).select(F.lit(name).alias("name"), strip("prompt").alias("prompt"))
        out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], "name string, prompt string")


def ignored(variable: str = "IGNORED") -> set[str]:
    """Sources that an environment variable lists, with colons between, for pattern_table()."""
    return {x for x in os.environ.get(variable, "").split(":") if x}
