"""Text functions as Column builders, with Unicode white space and line breaks handled as Python handles them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and line breaks as Unicode has them; Java's \\s knows the ASCII part alone.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
BREAKS = "\n\x0b\f\r\x1c\x1d\x1e\x85\u2028\u2029"
#: Java looks single Latin characters up in one table, but asks each range of a class in turn: the usual ones go first, the rare ones are behind a test.
WS = "[\\t\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\x1f\\x20\\x85\\xa0[[^\\x00-\\xff]&&[\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]]]"
_BREAKS = "\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\x85\\u2028\\u2029"
_IN_LINE = f"[\\x20-\\x7e[^{_BREAKS}]]"
LINES = f"{_IN_LINE}*+(?:\\r\\n|[{_BREAKS}])|{_IN_LINE}++\\z"
FENCE = "```"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, also where lambdas inside use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column | str) -> Column:
    """The text without any white space."""
    return F.regexp_replace(_col(c), WS, "")


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(BLANKS))


def lines(c: Column | str) -> Column:
    """The lines with their ends; an empty text has none."""
    return F.regexp_extract_all(_col(c), F.lit(LINES), F.lit(0))


def bare_lines(c: Column | str) -> Column:
    """The lines without their ends."""
    return F.transform(lines(c), lambda x: F.rtrim(x, F.lit(BREAKS)))


def codeblocks(c: Column | str) -> Column:
    """What stands between fence lines, block by block; a fence that isn't closed opens nothing."""
    def cut(ls: Column, at: Column) -> Column:
        ks = F.filter(F.sequence(F.lit(0), F.floor(F.size(at) / 2).cast("int")), lambda k: k < F.floor(F.size(at) / 2))
        spot = lambda k: F.get(at, k.cast("int"))
        return F.transform(ks, lambda k: F.array_join(F.slice(ls, spot(2 * k) + 2, spot(2 * k + 1) - spot(2 * k) - 1), ""))

    fences = lambda ls: F.filter(F.transform(ls, lambda x, i: F.when(F.startswith(strip(x), F.lit(FENCE)), i)), lambda i: i.isNotNull())
    return let(lines(c), lambda ls: let(fences(ls), lambda at: cut(ls, at)))


def sections(c: Column | str, first: str, second: str) -> Column:
    """struct(problem, solution): what follows a line with ``first`` and one with ``second``; null unless both are there, in this order.

    Markers are found in any case, anywhere in a line; each one's first line counts.
    """
    def parse(ls: Column) -> Column:
        where = lambda mark: F.array_position(F.transform(ls, lambda x: F.contains(F.lower(x), F.lit(mark.lower()))), F.lit(True))
        a, b = where(first), where(second)
        problem = strip(F.array_join(F.slice(ls, (a + 1).cast("int"), F.greatest(b - a - 1, F.lit(0)).cast("int")), ""))
        solution = strip(F.array_join(F.slice(ls, (b + 1).cast("int"), F.size(ls)), ""))
        return F.when((a > 0) & (a < b), F.struct(problem.alias("problem"), solution.alias("solution")))

    return let(lines(c), parse)


def joined_lower(*cols: Column | str) -> Column:
    """The columns in lower case, blank lines between; a null column is an error, as a missing text would be."""
    return F.concat_ws("\n\n", *[F.lower(F.coalesce(_col(c), F.raise_error(F.lit("a text to search is null")))) for c in cols])


def shingles(c: Column | str, n: int, least: int) -> Column:
    """Distinct word n-grams, words being parted by single characters that no word has; none for fewer than ``least`` words."""
    def cut(words: Column) -> Column:
        m = F.size(words)
        grams = F.transform(F.sequence(F.lit(1), F.greatest(m - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(m < max(least, n, 1), F.array().cast("array<string>")).otherwise(F.array_distinct(grams))

    return let(F.split(_col(c), "[^A-Za-z_0-9]", -1), cut)


def fingerprint(*cols: Column | str, size: int = 5) -> Column:
    return F.substring(F.sha2(F.concat(*[_col(c).cast("string") for c in cols]), 256), 1, size)


def fixed(c: Column | str, digits: int) -> Column:
    """Decimals with half to even, as printf does on the binary value."""
    return F.format_string(f"%.{digits}f", F.bround(_col(c).cast("double"), digits))


def strip_comment(c: Column | str) -> Column:
    """A comment without its delimiters, line by line: the end mark, then one leading mark."""

    def bare(x: Column) -> Column:
        lead = F.when(F.startswith(x, F.lit("/**")), 3).when(F.startswith(x, F.lit("///")), 3).when(F.startswith(x, F.lit("/*")) | F.startswith(x, F.lit("//")), 2).when(F.startswith(x, F.lit("*")), 1).otherwise(0)
        return strip(F.substring(x, lead + 1, F.length(x)))

    unended = lambda x: F.when(F.endswith(x, F.lit("*/")), F.substring(x, F.lit(1), F.length(x) - 2)).otherwise(x)
    return strip(F.array_join(F.transform(F.transform(F.transform(F.split(_col(c), "\n", -1), strip), unended), bare), "\n"))


def doc_summary(c: Column | str) -> Column:
    """A docstring up to its first blank line, else up to its first at sign, else all of it."""
    x = _col(c)
    return F.when(F.contains(x, F.lit("\n\n")), F.substring_index(x, "\n\n", 1)).when(F.contains(x, F.lit("@")), F.substring_index(x, "@", 1)).otherwise(x)


def python_docstring(c: Column | str) -> Column:
    x = strip(c)
    for q in ('"', "'"):
        x = F.regexp_replace(x, f"\\A{q}+|{q}+\\z", "")
    return strip(doc_summary(strip_comment(x)))


def strip_header(c: Column | str) -> Column:
    """A corpus text without its first line, where that is a repository or file tag."""
    x = _col(c)
    rest = F.when(F.contains(x, F.lit("\n")), F.substring(x, F.instr(x, "\n") + 1, F.length(x))).otherwise(F.raise_error(F.lit("a header line has no end")))
    return F.when(x.rlike("\\A<(reponame|filename)>"), rest).otherwise(x)


def chart_label(c: Column | str) -> Column:
    """A label without the word that has ``Problems``, and with ``and`` as an escaped ampersand."""
    kept = F.array_join(F.filter(F.split(_col(c), " "), lambda w: ~F.contains(w, F.lit("Problems"))), " ")
    return F.replace(kept, F.lit("and"), F.lit("\\&"))


def until_fence(c: Column | str) -> Column:
    return F.substring_index(_col(c), FENCE, 1)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two arrays, in doubles; 0 where either has no length."""
    a, b = F.transform(_col(a), lambda x: x.cast("double")), F.transform(_col(b), lambda x: x.cast("double"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)
