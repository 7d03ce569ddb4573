"""Functions and comments: islands, nearest comment above, ranges, and a parser for Python sources."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from weft.functions.text import WS, doc_summary, let, lines, python_docstring, strip, strip_comment, strip_header
from weft.plans.scratch import cut


def locate_lines(content: Column, seed: Column) -> Column:
    """struct(first, last): where the seed's lines stand in the content, counted from 1; an error where they don't."""
    def find(c: Column, s: Column) -> Column:
        n = F.size(s)
        at = F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1))), lambda i: F.slice(c, i, n) == s), F.lit(0))
        at = F.coalesce(at, F.raise_error(F.lit("a seed isn't in its text")).cast("int"))
        return F.struct(at.alias("first"), (at + n - 1).alias("last"))

    return let(lines(content), lambda c: let(lines(seed), lambda s: find(c, s)))


def comment_islands(comments: DataFrame, sources: DataFrame, doc: str, code: str) -> DataFrame:
    """Comments (doc, begin, stop: characters from 0; first, last: lines; content) with those merged that nothing but one line end parts.

    sources has the text (doc, code). It meets a document's comments in one
    row, where the gaps are judged; the rows of comments don't carry it.
    """
    own = comments.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("last", "begin", "stop", "first", "content"))).alias("_c")).join(sources.select(doc, F.col(code).alias("_code")), doc)

    def joins(c: Column, i: Column) -> Column:
        before = F.get("_c", i - 1)["stop"].cast("int")
        gap = F.substring(F.col("_code"), before + 1, c["begin"].cast("int") - before)
        return (i > 0) & (F.regexp_replace(gap, "[ \t\r\n]", "") == "") & (F.length(gap) - F.length(F.replace(gap, F.lit("\n"), F.lit(""))) == 1)

    judged = F.transform("_c", lambda c, i: F.struct(c.alias("c"), F.when(joins(c, i), 0).otherwise(1).alias("new")))
    rows = own.select(doc, F.posexplode(judged).alias("_k", "x")).select(doc, "_k", "x.c.*", "x.new")
    island = F.sum("new").over(Window.partitionBy(doc).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_k", "content"))), lambda x: x["content"])
    return rows.withColumn("_island", island).groupBy(doc, "_island").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"), F.min("first").alias("first"), F.max("last").alias("last"), F.array_join(parts, "\n").alias("content")).drop("_island")


def nearest_above(methods: DataFrame, comments: DataFrame, key: list[str], at: str, last: str, carry: list[str]) -> DataFrame:
    """Each method with the last comment that ends on an earlier line (as-of join), by one sort of both together."""
    m = methods.withColumns({"_m": F.struct(*methods.columns), "_t": F.col(at), "_kind": F.lit(0), "_c": F.lit(None)}).select(*key, "_t", "_kind", "_m", "_c")
    c = comments.select(*key, F.col(last).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).alias("_m"), F.struct(*carry).alias("_c"))
    w = Window.partitionBy(*key).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = m.withColumn("_c", F.lit(None).cast(c.schema["_c"].dataType)).unionByName(c.withColumn("_m", F.lit(None).cast(m.schema["_m"].dataType)))
    return both.withColumn("_near", F.last("_c", ignorenulls=True).over(w)).where("_kind = 0").select("_m.*", *[F.col(f"_near.{x}").alias(x) for x in carry])


def overlapping(methods: DataFrame, seeds: DataFrame, on: str, cover: bool) -> DataFrame:
    """Methods whose lines (first, last) meet a seed's (seed_first, seed_last), or those that meet none."""
    cond = (methods[on] == seeds[on]) & (seeds["seed_first"] <= methods["last"]) & (methods["first"] <= seeds["seed_last"])
    return methods.join(seeds, cond, "left_semi" if cover else "left_anti")


_SPAN = StructType([*(StructField(c, StringType()) for c in ("kind", "name", "content", "docstring")), *(StructField(c, IntegerType()) for c in ("start_line", "end_line", "begin", "stop"))])
#: Strings, comments, brackets and words of languages with braces; a string or comment that isn't closed ends with the line or text.
_BRACED = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`[^`]*`?|[(){};]|[A-Za-z_$][\w$]*|[^\s\w]""", re.S)
_SHELL = re.compile(r"""(?<![^\s;])\#[^\n]*|"(?:\\.|[^"\\])*"?|'[^']*'?|\$\{[^}]*\}|[(){};]|[A-Za-z_][\w-]*|[^\s\w]""", re.S)
_HASHED = re.compile(r"\#(?!\[)[^\n]*|" + _BRACED.pattern, re.S)
_NOT_NAMES = frozenset("if for while switch catch return else do foreach match with using lock synchronized fixed guard elif until case new throw sizeof".split())
LANGUAGES = ("python", "cpp", "csharp", "java", "php", "rust", "swift", "typescript", "shell")


@udtf(returnType=_SPAN)
class PythonFunctions:
    """The functions of a Python source, also inner ones, with what their first string statement says; nothing of a source that doesn't parse."""

    def eval(self, code: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(code or "")
        except (SyntaxError, ValueError, RecursionError):
            return
        rows = re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", code or "")  # lines as the parser counts them
        at = [0]
        for r in rows:
            at.append(at[-1] + len(r))
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                said = next((n.value.value for n in node.body if isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str)), None)
                yield "function", node.name, "".join(rows[node.lineno - 1 : node.end_lineno]), said, node.lineno, node.end_lineno, at[node.lineno - 1], at[node.end_lineno]


def braced_spans(code: str, lang: str) -> Iterator[tuple[str, str | None, int, int]]:
    """(kind, name, begin, stop) of the comments and of the named functions with a body in braces, inner ones too.

    A function is a word with parentheses, or one after ``function``, whose
    next brace opens before any ``;``. It begins with its line's first word.
    """
    pattern = {"shell": _SHELL, "php": _HASHED}.get(lang, _BRACED)
    open_, depth, name, word, word_before = [], 0, None, None, None
    for m in pattern.finditer(code):
        x = m.group()
        if x.startswith(("//", "/*")) and lang != "shell" or x.startswith("#") and lang in ("shell", "php") and len(x) > 1:
            yield "comment", None, m.start(), m.end()
        elif x == "(":
            if depth == 0 and word and word[0] not in _NOT_NAMES:
                name = name or word
            depth += 1
        elif x == ")":
            depth = max(0, depth - 1)
        elif x == "{" and depth == 0:
            own = name if name and name[0] not in _NOT_NAMES else word if word_before and word_before[0] == "function" else None
            open_.append(own)
            name = word = word_before = None
        elif x == "}" and depth == 0:
            own = open_.pop() if open_ else None
            if own:
                line = code.rfind("\n", 0, own[1]) + 1
                while line < own[1] and code[line] in " \t":
                    line += 1
                yield "function", own[0], line, m.end()
            name = word = word_before = None
        elif x == ";" and depth == 0:
            name = word = word_before = None
        elif x[0].isalpha() or x[0] in "_$":
            if depth == 0:
                if x in _NOT_NAMES:
                    name = (x, m.start())
                word_before, word = word, (x, m.start())
        elif depth == 0 and x not in ("<", ">", ",", "&", "*", ":", "[", "]", "?", "-", "~"):
            word_before = word = None


@udtf(returnType=_SPAN)
class BracedSpans:
    """The functions and comments of a source in a language with braces, or in shell."""

    def eval(self, code: str, lang: str) -> Iterator[tuple]:
        code = code or ""
        for kind, name, a, b in braced_spans(code, lang):
            first = code.count("\n", 0, a) + 1
            yield kind, name, code[a:b], None, first, first + code.count("\n", a, b), a, b


def function_pairs(docs: DataFrame, *, id_col: str = "doc_id", cover: bool = True) -> DataFrame:
    """Functions with what their docstring or the comment above says, of every document's seed or of all else in it.

    docs have id_col, lang (one of LANGUAGES), content and seed. A first
    line of the seed that is a repository or file tag goes; the seed has to
    stand in the content. With cover the functions whose lines meet the
    seed's are returned, without it the others. Python functions take their
    first string statement. Others take the nearest comment that ends on an
    earlier line, neighbouring comments merged, if nothing but blanks
    parts it from the function, and an empty docstring otherwise.

    Result: (id_col, name, function, docstring, start_line, end_line).
    """
    spark = docs.sparkSession
    spark.udtf.register("weft_python_functions", PythonFunctions)
    spark.udtf.register("weft_braced_spans", BracedSpans)
    own = docs.select(F.col(id_col).alias("id"), F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise(F.raise_error(F.lit("an unknown language"))).alias("lang"), "content", strip_header("seed").alias("seed"))
    located = own.select("id", locate_lines(F.col("content"), F.col("seed")).alias("x"))
    placed = cut(located.select("id", F.col("x.first").alias("seed_first"), F.col("x.last").alias("seed_last")))  # else a pushed filter could search rows that are no part of docs
    own.createOrReplaceTempView("weft_mined")
    python = spark.sql("SELECT id, f.name, f.content, f.docstring, f.start_line, f.end_line FROM weft_mined, LATERAL weft_python_functions(content) f WHERE lang = 'python'")
    python = python.withColumn("docstring", F.coalesce(python_docstring("docstring"), F.lit("")))
    spans = cut(spark.sql("SELECT id, f.* FROM weft_mined, LATERAL weft_braced_spans(content, lang) f WHERE lang <> 'python'"))
    comments = spans.where("kind = 'comment'").select("id", "begin", "stop", F.col("start_line").alias("first"), F.col("end_line").alias("last"), F.col("content").alias("said"))
    merged = comment_islands(comments.withColumnRenamed("said", "content"), own.select("id", F.col("content").alias("code")), "id", "code")
    methods = spans.where("kind = 'function'").select("id", "name", "content", "start_line", "end_line", "begin")
    near = nearest_above(methods, merged.select("id", "last", F.col("stop").alias("c_stop"), F.col("content").alias("said")), ["id"], "start_line", "last", ["c_stop", "said"])
    gap = F.call_function("substring", F.col("code"), F.col("c_stop") + 1, F.col("begin") - F.col("c_stop"))
    said = F.when(F.col("said").isNotNull() & only_blank(gap), strip(doc_summary(strip_comment("said")))).otherwise(F.lit(""))
    other = near.join(own.select("id", F.col("content").alias("code")), "id").select("id", "name", "content", said.alias("docstring"), "start_line", "end_line")
    every = python.unionByName(other).withColumns({"first": F.col("start_line"), "last": F.col("end_line")})
    found = overlapping(every, placed.withColumnRenamed("id", "sid").withColumn("id", F.col("sid")).select("id", "seed_first", "seed_last"), "id", cover)
    return found.select(F.col("id").alias(id_col), "name", F.col("content").alias("function"), "docstring", "start_line", "end_line")


def only_blank(c: Column) -> Column:
    return F.regexp_replace(c, WS, "") == ""
