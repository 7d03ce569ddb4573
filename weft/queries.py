"""Queries of the core library with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import analysis, benchmarks, cleaning, decontam, dedup, formatting, mining, sampling, sft, similarity
from weft.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The white space class of weft.functions.text, and line breaks, for RE2.
WS = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_B = "\\n\\x0b\\f\\r\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}"
LINES = f"[^{_B}]*(?:\\r\\n|[{_B}])|[^{_B}]+\\z"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+\\z', '', 'g')"


def _lines(x: str) -> str:
    return f"regexp_extract_all({x}, '{LINES}')"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- sources -----------------------------------------------------------------


@query("SELECT doc_id, source FROM documents WHERE lang = 'de'")
def scan_lang_partition(t: Tables) -> DataFrame:
    return t.documents.where(F.col("lang") == "de").select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def head_slice(t: Tables) -> DataFrame:
    return sampling.head(t.documents.select("doc_id", "lang"), "doc_id", 100)


@query("SELECT doc_id, split_part('data-' || lang || '-' || doc_id || '.jsonl', '-', 2) AS file_lang FROM documents")
def lang_from_path(t: Tables) -> DataFrame:
    name = F.concat(F.lit("data-"), "lang", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".jsonl"))
    return t.documents.select("doc_id", F.get(F.split(name, "-"), F.lit(1)).alias("file_lang"))


def _patterns(t: Tables) -> DataFrame:
    own = [(f"b{k}", t.benchmark.where(F.col("item_id") % 4 == k).select(F.col("item_id").alias("item_ord"), F.col("text").alias("pattern"))) for k in range(4)]
    return decontam.pattern_table(*own)


PATTERNS = "(SELECT (item_id % 4)::INTEGER AS bench_ord, 'b' || (item_id % 4) AS benchmark, item_id AS item_ord, text AS pattern FROM benchmark)"


@query(f"SELECT benchmark, count(*) AS n FROM {PATTERNS} GROUP BY benchmark")
def benchmark_catalog(t: Tables) -> DataFrame:
    return _patterns(t).groupBy("benchmark").agg(F.count("*").alias("n"))


@query(f"SELECT benchmark, item_ord FROM {PATTERNS} WHERE benchmark <> 'b2' AND length({_strip('pattern')}) > 0")
def benchmark_lib_filter(t: Tables) -> DataFrame:
    return _patterns(t).where((F.col("benchmark") != "b2") & (F.length(T.strip("pattern")) > 0)).select("benchmark", "item_ord")


@query(f"SELECT doc_id, {_strip('text')} AS pattern FROM documents WHERE doc_id BETWEEN 11 AND 110")
def bench_task_range(t: Tables) -> DataFrame:
    return benchmarks.texts(benchmarks.task_range(t.documents.select("doc_id", F.col("text").alias("pattern")), "doc_id", 11, 110, 100), "pattern")


@query(f"SELECT doc_id, {_strip('text')} AS pattern FROM documents")
def bench_docstrings(t: Tables) -> DataFrame:
    q, m = F.lit('"""'), F.col("doc_id") % 3
    prompt = F.when(m == 0, F.concat(F.lit("def f():\n    "), q, "text", q)).when(m == 1, F.concat(F.lit("def g():\n "), q, F.lit("helper"), q, F.lit("\ndef f():\n "), q, "text", q, F.lit("\n"))).otherwise(F.concat(F.lit("def f():\n  '''"), "text", F.lit("'''\n")))
    return t.documents.select("doc_id", benchmarks.quoted_docstring(prompt).alias("pattern"))


@query(f"SELECT doc_id, {_strip('text')} AS pattern FROM documents WHERE doc_id % 4 <> 0 AND {_strip('text')} <> ''")
def bench_solutions(t: Tables) -> DataFrame:
    """Every fourth solution is a generic one, with blanks around."""
    own = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, benchmarks.GENERIC)), (F.col("doc_id") / 4 % 4 + 1).cast("int")), F.lit("\n"))).otherwise(F.col("text"))
    return benchmarks.texts(t.documents.select("doc_id", own.alias("pattern")), "pattern", drop=benchmarks.GENERIC)


@query(f"SELECT item_id, {_strip('text')} AS question FROM benchmark WHERE {_strip('text')} <> ''")
def bench_questions(t: Tables) -> DataFrame:
    return benchmarks.texts(t.benchmark.select("item_id", F.concat(F.lit(" \n"), "text", F.lit("\t")).alias("question")), "question")


@query("SELECT id, (unnest(range(len(s))))::INTEGER AS item, unnest(s) AS solution FROM (SELECT doc_id AS id, string_split(text, chr(10)) AS s FROM documents WHERE doc_id % 3 <> 0)")
def bench_json_solutions(t: Tables) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.to_json(F.split("text", "\n")))
    return benchmarks.json_solutions(t.documents.select("doc_id", raw.alias("solutions")), "doc_id", "solutions")


@query("SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '# ' ELSE chr(10) END AS pattern FROM documents")
def bench_before_mark(t: Tables) -> DataFrame:
    mark = F.when(F.col("doc_id") % 2 == 0, F.lit("\n# SOLUTION START\n")).otherwise(F.lit("\nBEGIN SOLUTION\n<code>"))
    return t.documents.select("doc_id", benchmarks.before_mark(F.concat("text", mark, F.lit("after"))).alias("pattern"))


@query(f"SELECT s || '-' || l || v AS name, count(*) AS n, sum(length({_strip('text')}))::BIGINT AS chars FROM benchmark, (SELECT unnest(['humaneval', 'humaneval', 'mbpp']) AS s, unnest(['', '-remove', '']) AS v), (SELECT unnest({benchmarks.LANGUAGES}) AS l) GROUP BY ALL")
def bench_translated(t: Tables) -> DataFrame:
    own = t.benchmark.select(F.col("text").alias("prompt"))
    return benchmarks.translated_docstrings(t.spark, lambda name: own).groupBy("name").agg(F.count("*").alias("n"), F.sum(F.length("prompt")).alias("chars"))


@query(f"SELECT benchmark, bench_ord, count(*) AS n FROM (SELECT CASE bench_ord WHEN 0 THEN 0 ELSE bench_ord - 1 END AS bench_ord, benchmark FROM {PATTERNS} WHERE benchmark <> 'b1') GROUP BY ALL")
def bench_ignored(t: Tables) -> DataFrame:
    own = [(f"b{k}", t.benchmark.where(F.col("item_id") % 4 == k).select(F.col("item_id").alias("item_ord"), F.col("text").alias("pattern"))) for k in range(4)]
    return decontam.pattern_table(*own, ignored={"b1"}).groupBy("benchmark", "bench_ord").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang AS metric_lang FROM documents")
def lang_of_metric(t: Tables) -> DataFrame:
    name = F.concat(F.lit("out/run.d/multiple-"), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit("-0.2.json"))
    return t.documents.select("doc_id", io.lang_of_metric(name).alias("metric_lang"))


@query("SELECT doc_id, 'All ' || source || ' \\& ' || lang AS label FROM documents")
def chart_label(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.chart_label(F.concat(F.lit("All "), "source", F.lit(" HardProblems: and "), "lang")).alias("label"))


# --- formatting --------------------------------------------------------------


def _part(k: int, n: int) -> Column:
    """The k-th of n parts of the text, which hold all of it; the first are the longer ones."""
    at = lambda i: F.ceil(F.length("text") * i / n).cast("int")
    return F.substring(F.col("text"), at(k) + 1, at(k + 1) - at(k))


def _instr() -> Column:
    return _part(0, 2)


def _resp() -> Column:
    return _part(1, 2)


def _part_sql(k: int, n: int) -> str:
    at = lambda i: f"ceil(length(text) * {i} / {n})::BIGINT"
    return f"substr(text, {at(k)} + 1, {at(k + 1)} - {at(k)})"


SI, SR = _part_sql(0, 2), _part_sql(1, 2)


@query(f"SELECT doc_id, {SI} AS instruction, {SR} AS response FROM documents")
def fmt_evol(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", _instr().alias("instruction"), _resp().alias("output"))
    return d.withColumnRenamed("output", "response")


@query(f"SELECT doc_id, CASE WHEN {_strip('x')} = '' THEN i ELSE i || chr(10) || 'Input: ' || x END AS instruction FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE {SI} END AS i, CASE WHEN doc_id % 3 = 0 THEN ' ' || chr(160) ELSE {SR} END AS x FROM documents)")
def fmt_with_input(t: Tables) -> DataFrame:
    extra = F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(_resp())
    return t.documents.select("doc_id", formatting.with_input(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(_instr()), extra).alias("instruction"))


@query(f"SELECT doc_id, source, '{formatting.ASK}' || {SI} AS instruction, {SR} AS response FROM documents".replace("\n'", "' || chr(10)"))
def fmt_instruct(t: Tables) -> DataFrame:
    return formatting.instruct(t.documents.select("doc_id", "source", _instr().alias("problem"), _resp().alias("solution")), "src")


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query(f"SELECT doc_id, {_sql_text(formatting.SYSTEM + chr(10) * 2 + '### Instruction:' + chr(10))} || {SI} || {_sql_text(chr(10) * 2 + '### Response:' + chr(10))} || {SR} AS prompt FROM documents")
def fmt_chat_prompt(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", formatting.chat(_instr(), _resp()).alias("prompt"))


@query(f"SELECT doc_id, {_sql_text('# Problem' + chr(10))} || {SI} || {_sql_text(chr(10) * 2 + '# Solution' + chr(10))} || {SR} AS text FROM documents")
def embed_text_mode(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", formatting.illustration(_instr(), _resp(), "both").alias("text"))


TURNS = """(SELECT u.conv_id, u.turn, u.text AS instruction, a.text AS response FROM conversations u
JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""


def _turns(t: Tables) -> DataFrame:
    u = t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    a = t.conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return u.join(a, ["conv_id", "turn"])


@query(f"SELECT instruction, response FROM {TURNS} UNION ALL SELECT {SI}, {SR} FROM documents")
def combine_union(t: Tables) -> DataFrame:
    return formatting.combine(_turns(t), t.documents.select(_instr().alias("instruction"), _resp().alias("response")))


MARKED = f"CASE doc_id % 4 WHEN 0 THEN 'Intro' || chr(10) || '[Problem description]' || chr(10) || {SI} || chr(10) || 'the [SOLUTION] is' || chr(10) || {SR} WHEN 1 THEN '[solution]' || chr(10) || text || chr(10) || '[problem description]' WHEN 2 THEN text || chr(10) || '[Problem description]' || chr(10) || '[Solution]' || chr(10) ELSE text END"


def _marked() -> Column:
    nl, m = F.lit("\n"), F.col("doc_id") % 4
    return F.when(m == 0, F.concat(F.lit("Intro\n[Problem description]\n"), _part(0, 2), F.lit("\nthe [SOLUTION] is\n"), _part(1, 2))).when(m == 1, F.concat(F.lit("[solution]\n"), "text", nl, F.lit("[problem description]"))).when(m == 2, F.concat("text", F.lit("\n[Problem description]\n[Solution]\n"))).otherwise(F.col("text"))


SECTIONS = f"""(SELECT doc_id, ls, list_position(list_transform(ls, lambda x: contains(lower(x), '[problem description]')), true) AS a,
list_position(list_transform(ls, lambda x: contains(lower(x), '[solution]')), true) AS b FROM (SELECT doc_id, {_lines(MARKED)} AS ls FROM documents))"""
_P = _strip("array_to_string(ls[a + 1 : b - 1], '')")
_S = _strip("array_to_string(ls[b + 1 :], '')")


@query(f"SELECT doc_id, CASE WHEN a > 0 AND a < b THEN {_P} END AS problem, CASE WHEN a > 0 AND a < b THEN {_S} END AS solution FROM {SECTIONS}")
def parse_sections(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.sections(_marked(), "[problem description]", "[solution]").alias("x")).select("doc_id", "x.problem", "x.solution")


@query(f"SELECT doc_id FROM (SELECT doc_id, {_P} AS p, {_S} AS s FROM {SECTIONS} WHERE a > 0 AND a < b) WHERE p <> '' AND s <> ''")
def parse_valid(t: Tables) -> DataFrame:
    x = t.documents.select("doc_id", T.sections(_marked(), "[problem description]", "[solution]").alias("x"))
    return x.where("x is not null and x.problem <> '' and x.solution <> ''").select("doc_id")


FENCED = f"{_part_sql(0, 3)} || chr(10) || '  ```python' || chr(10) || {_part_sql(1, 3)} || chr(10) || '```' || chr(10) || 'mid' || chr(10) || '```' || chr(10) || {_part_sql(2, 3)} || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '```' ELSE '' END"


def _fenced() -> Column:
    tail = F.when(F.col("doc_id") % 2 == 0, F.lit("\n```")).otherwise(F.lit(""))
    return F.concat(_part(0, 3), F.lit("\n  ```python\n"), _part(1, 3), F.lit("\n```\nmid\n```\n"), _part(2, 3), tail)


BLOCKS = f"""list_transform(range(len(fences) // 2), lambda k: array_to_string(ls[fences[2 * k + 1] + 1 : fences[2 * k + 2] - 1], ''))"""


def _fences_sql(y: str) -> str:
    return f"(SELECT *, list_filter(range(1, len(ls) + 1), lambda i: starts_with({_strip('ls[i]')}, '```')) AS fences FROM (SELECT doc_id, {_lines('y')} AS ls FROM (SELECT doc_id, {y} AS y FROM documents)))"


@query(f"SELECT doc_id, array_to_string({BLOCKS}, '|') AS blocks, (len(fences) // 2)::INTEGER AS n FROM {_fences_sql(FENCED)}")
def codeblocks(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.codeblocks(_fenced()).alias("b")).select("doc_id", F.array_join("b", "|").alias("blocks"), F.size("b").alias("n"))


_OWN = "'code ' || doc_id || chr(10) || text"
_SEE = "'See' || chr(10) || '```' || chr(10) || {} || chr(10) || '```' || chr(10)"
_BARE_BLOCKS = f"list_transform({BLOCKS}, lambda b: regexp_replace(b, '{WS}', '', 'g'))"


@query(f"""SELECT doc_id, list_has_any(p.b, s.b) AS copied FROM (SELECT doc_id, {_BARE_BLOCKS} AS b FROM {_fences_sql(_SEE.format(_OWN))}) p
JOIN (SELECT doc_id, {_BARE_BLOCKS} AS b FROM {_fences_sql(_SEE.format(f"CASE WHEN doc_id % 5 = 0 THEN '  ' || {_OWN} || chr(10) ELSE {_OWN} || 'x' END"))}) s USING (doc_id)""")
def codeblock_copy(t: Tables) -> DataFrame:
    block = lambda x: F.concat(F.lit("See\n```\n"), x, F.lit("\n```\n"))
    own = F.concat(F.lit("code "), F.col("doc_id").cast("string"), F.lit("\n"), "text")
    other = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("  "), own, F.lit("\n"))).otherwise(F.concat(own, F.lit("x")))
    return t.documents.select("doc_id", dedup.copies_problem(block(own), block(other)).alias("copied"))


@query("SELECT doc_id, CASE WHEN lang = 'en' AND contains(lower(text), 'the') THEN 'python' WHEN lang <> 'en' AND NOT contains(lower(text), 'the') THEN 'other' END AS side FROM documents WHERE (lang = 'en') = contains(lower(text), 'the')")
def lang_split_conservative(t: Tables) -> DataFrame:
    has, is_ = F.contains(F.lower("text"), F.lit("the")), F.col("lang") == "en"
    return t.documents.where(is_ == has).select("doc_id", F.when(is_, "python").otherwise("other").alias("side"))


@query("SELECT doc_id, CASE WHEN contains(y, '```python') THEN 'python' ELSE 'other' END AS side FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE '```python' || chr(10) || text END AS y FROM documents)")
def lang_split_fence(t: Tables) -> DataFrame:
    y = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("```python\n"), "text"))
    return t.documents.select("doc_id", F.when(F.contains(y, F.lit("```python")), "python").otherwise("other").alias("side"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {_strip('y')} AS x FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN repeat(substr(text, 1, 1), length(text)) WHEN 1 THEN regexp_replace(text, '[^\\n]', ' ', 'g') ELSE text END AS y FROM documents)) WHERE length(x) > 0 AND length(replace(x, substr(x, 1, 1), '')) > 0")
def doc_repeat_char(t: Tables) -> DataFrame:
    m = F.col("doc_id") % 3
    y = F.when(m == 0, F.repeat(F.substring("text", 1, 1), F.length("text"))).when(m == 1, F.regexp_replace("text", "[^\n]", " ")).otherwise(F.col("text"))
    return t.documents.where(formatting.docstring_useful(y)).select("doc_id")


PY = "CASE doc_id % 3 WHEN 0 THEN 'def f():' || chr(10) || '    \"\"\"' || text || '\"\"\"' || chr(10) || '    return 1' WHEN 1 THEN 'def g():' || chr(10) || '  ' || repeat(chr(39), 3) || text || repeat(chr(39), 3) || chr(10) || '  pass' ELSE 'def h(): pass' || chr(10) || text END"


@query(f"""SELECT doc_id, substr(y, 1, e) AS prompt, substr(y, e + 1) AS completion FROM (SELECT doc_id, y, CASE WHEN p > 0 THEN p + 2 + instr(substr(y, p + 3), q) + 2 END AS e FROM (
SELECT doc_id, y, CASE WHEN contains(y, '\"\"\"') THEN '\"\"\"' ELSE repeat(chr(39), 3) END AS q, instr(y, CASE WHEN contains(y, '\"\"\"') THEN '\"\"\"' ELSE repeat(chr(39), 3) END) AS p FROM (SELECT doc_id, {PY} AS y FROM documents))) WHERE e IS NOT NULL""")
def pair_python(t: Tables) -> DataFrame:
    m = F.col("doc_id") % 3
    y = F.when(m == 0, F.concat(F.lit('def f():\n    """'), "text", F.lit('"""\n    return 1'))).when(m == 1, F.concat(F.lit("def g():\n  '''"), "text", F.lit("'''\n  pass"))).otherwise(F.concat(F.lit("def h(): pass\n"), "text"))
    return t.documents.select("doc_id", y.alias("y")).select("doc_id", formatting.pair_python(F.col("y")).alias("x")).where("x is not null").select("doc_id", "x.prompt", "x.completion")


def _bare(x: str) -> str:
    return f"list_transform({x}, lambda x: regexp_replace(x, '(\\r\\n|[{_B}])\\z', ''))"



@query(f"""SELECT doc_id, array_to_string(list_transform(d, lambda x: '/// ' || x), chr(10)) || chr(10) || 'fn f() {{' AS prompt, array_to_string(c[2:], chr(10)) AS completion
FROM (SELECT doc_id, {_bare(_lines('text'))} AS d, {_bare(_lines("'fn f() {' || chr(10) || text"))} AS c FROM documents)""")
def pair_generic(t: Tables) -> DataFrame:
    x = formatting.pair_generic(F.concat(F.lit("fn f() {\n"), "text"), F.col("text"))
    return t.documents.select("doc_id", x.alias("x")).select("doc_id", "x.prompt", "x.completion")


@query("SELECT doc_id, CASE WHEN regexp_matches(y, '^<(reponame|filename)>') THEN substr(y, instr(y, chr(10)) + 1) ELSE y END AS content FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<reponame>some/place' || chr(10) ELSE '' END || text AS y FROM documents)")
def strip_header(t: Tables) -> DataFrame:
    y = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<reponame>some/place\n"), "text")).otherwise(F.col("text"))
    return t.documents.select("doc_id", T.strip_header(y).alias("content"))


@query(f"SELECT doc_id, split_part(y, '```', 1) AS completion FROM (SELECT doc_id, {FENCED} AS y FROM documents)")
def truncate_fence(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.until_fence(_fenced()).alias("completion"))


@query(f"SELECT doc_id, {_sql_text(formatting.ASK + formatting.OPEN)} || p || {_sql_text(formatting.CLOSE)} AS instruction, {_sql_text(formatting.OPEN)} || p AS response_prefix FROM (SELECT doc_id, {_strip('text')} AS p FROM documents)")
def map_codegen_prompt(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", formatting.codegen_prompt(F.col("text")).alias("x")).select("doc_id", "x.*")


@query(f"""SELECT doc_id, CASE WHEN ends_with(s, '.') THEN s ELSE s || '.' END || {_sql_text(' It must pass this test:' + chr(10) + formatting.OPEN)} || {_strip("substr(i, instr(i, 'assert'))")} || {_sql_text(formatting.CLOSE)} AS instruction
FROM (SELECT doc_id, i, {_strip("substr(i, 1, instr(i, 'assert') - 1)")} AS s FROM (SELECT doc_id, replace(text, 'assert', '') || chr(10) || 'assert f(1) == ' || doc_id || chr(10) AS i FROM documents))""")
def map_assert_prompt(t: Tables) -> DataFrame:
    y = F.concat(F.lit('x """'), F.replace("text", F.lit("assert"), F.lit("")), F.lit("\nassert f(1) == "), F.col("doc_id").cast("string"), F.lit('\n"""\n'))
    return t.documents.select("doc_id", formatting.assert_prompt(y).alias("instruction"))


_TOLD = _strip("replace(text, 'A:', 'A ')")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_sql_text(formatting.ASK + formatting.OPEN)} || p || {_sql_text(formatting.CLOSE)} ELSE p END AS instruction,
CASE doc_id % 3 WHEN 0 THEN {_sql_text(formatting.OPEN)} || p WHEN 1 THEN {_sql_text(formatting.OPEN)} || 'x = 1' ELSE {_sql_text(formatting.OPEN)} || 'x = 1' || chr(10) || '# put it in y' END || {_sql_text(chr(10) + '# Solution' + chr(10))} AS response FROM (SELECT doc_id, {_TOLD} AS p FROM documents)""")
def map_completion_prompt(t: Tables) -> DataFrame:
    m = F.col("doc_id") % 3
    body = F.replace(F.col("text"), F.lit("A:"), F.lit("A "))
    y = F.when(m == 0, F.concat(body, F.lit("\n# SOLUTION START"))).when(m == 1, F.concat(F.lit("Problem:\n"), body, F.lit("\nA:\n<code>\nx = 1\n# return x\n# use x\n### BEGIN SOLUTION"))).otherwise(F.concat(F.lit("Problem:\n"), body, F.lit("\nA:\n<code>\nx = 1\n</code>\nput it in y\nBEGIN SOLUTION\n<code>")))
    return t.documents.select("doc_id", formatting.completion_prompt(y).alias("x")).select("doc_id", "x.*")


@query(f"SELECT doc_id, {_strip('text')} || chr(10) || '[insert]' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'print(y)' || chr(10) || '```' ELSE '' END AS prompt FROM documents")
def map_insert_prompt(t: Tables) -> DataFrame:
    y = F.concat("text", F.lit("\n" + formatting.INSERT), F.when(F.col("doc_id") % 2 == 0, F.lit("\n<code>\nprint(y)\n</code>")).otherwise(F.lit("\ntail")))
    return t.documents.select("doc_id", formatting.insert_prompt(y).alias("prompt"))


@query(f"SELECT doc_id, '<fim_prefix>' || {SI} || '<fim_suffix>' || {SR} || '<fim_middle>' AS star, '▁<PRE>' || {SI} || '▁<SUF>' || {SR} || '▁<MID>' AS llama, '<b>' || {SI} || '<h>' || {SR} || '<e>' AS hole FROM documents")
def fim_prompt(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", formatting.fim_prompt("star", _instr(), _resp()).alias("star"), formatting.fim_prompt("llama", _instr(), _resp()).alias("llama"), formatting.fim_prompt("deepseek", _instr(), _resp(), ("<b>", "<h>", "<e>")).alias("hole"))


# --- decontamination ---------------------------------------------------------

MATCH = f"(SELECT d.doc_id, arg_min(p.benchmark, p.bench_ord * 1000000 + p.item_ord) AS benchmark, arg_min(p.pattern, p.bench_ord * 1000000 + p.item_ord) AS matched_substring FROM documents d JOIN {PATTERNS} p ON contains(lower(d.text), lower(p.pattern)) GROUP BY d.doc_id)"
KNOWN = f"(SELECT * FROM {PATTERNS} WHERE item_ord % 3 = 0)"
OLD = "(SELECT doc_id, 'b' || (doc_id % 4) || '_match' AS filter_reason, b.text AS matched_substring FROM documents d JOIN benchmark b ON b.item_id = (d.doc_id % 4) + 4 * (d.doc_id % 6) WHERE d.doc_id % 7 = 0)"


@query(f"SELECT * FROM {MATCH}")
def decontam_match(t: Tables) -> DataFrame:
    return decontam.matches(t.documents, _patterns(t), "doc_id", ["text"])


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(lower(d.text), lower(b.text)))")
def decontam_keep(t: Tables) -> DataFrame:
    return decontam.decontaminate(t.documents, _patterns(t), "doc_id", ["text"]).where("filter_reason is null").select("doc_id", "source")


@query(f"SELECT d.lang, m.benchmark || '_match' AS filter_reason, count(*) AS n FROM {MATCH} m JOIN documents d ON d.doc_id = m.doc_id GROUP BY 1, 2")
def decontam_meta(t: Tables) -> DataFrame:
    return decontam.meta(decontam.decontaminate(t.documents, _patterns(t), "doc_id", ["text"]))


def _old(t: Tables) -> DataFrame:
    d = t.documents.where("doc_id % 7 = 0").select("doc_id", (F.col("doc_id") % 4 + 4 * (F.col("doc_id") % 6)).alias("item_id"))
    return d.join(t.benchmark, "item_id").select("doc_id", F.concat(F.lit("b"), (F.col("doc_id") % 4).cast("string"), F.lit("_match")).alias("filter_reason"), F.col("text").alias("matched_substring"))


@query(f"SELECT benchmark, item_ord FROM {PATTERNS} WHERE item_ord % 3 <> 0")
def decontam_cache_patterns(t: Tables) -> DataFrame:
    p = _patterns(t)
    return decontam.split_cache(p, p.where("item_ord % 3 = 0"))[0].select("benchmark", "item_ord")


@query(f"SELECT o.doc_id, o.filter_reason, o.matched_substring FROM {OLD} o JOIN {KNOWN} k ON k.benchmark || '_match' = o.filter_reason AND k.pattern = o.matched_substring")
def decontam_cache_excluded(t: Tables) -> DataFrame:
    return decontam.cached_exclusions(_old(t), _patterns(t).where("item_ord % 3 = 0")).select("doc_id", "filter_reason", "matched_substring")


@query(f"""WITH v AS (SELECT o.* FROM {OLD} o JOIN {KNOWN} k ON k.benchmark || '_match' = o.filter_reason AND k.pattern = o.matched_substring),
m AS (SELECT d.doc_id, arg_min(p.benchmark, p.bench_ord * 1000000 + p.item_ord) AS b, arg_min(p.pattern, p.bench_ord * 1000000 + p.item_ord) AS s FROM documents d JOIN {PATTERNS} p ON p.item_ord % 3 <> 0 AND contains(lower(d.text), lower(p.pattern)) GROUP BY 1)
SELECT d.doc_id, coalesce(v.filter_reason, m.b || '_match') AS filter_reason, coalesce(v.matched_substring, m.s) AS matched_substring FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id""")
def decontam_incremental(t: Tables) -> DataFrame:
    p = _patterns(t)
    return decontam.incremental(t.documents, p, p.where("item_ord % 3 = 0"), _old(t), "doc_id", ["text"]).select("doc_id", "filter_reason", "matched_substring")


# --- joins -------------------------------------------------------------------


#: Lines and two numbers of each document, that give its seed.
SEEDS = f"""(SELECT doc_id AS raw_index, array_to_string(ls[a % len(ls) + 1 : a % len(ls) + n % 15 + 1], '') AS seed FROM (SELECT doc_id, {_lines('text')} AS ls,
('0x' || substr(md5('976:start:' || doc_id), 1, 8))::BIGINT AS a, ('0x' || substr(md5('976:size:' || doc_id), 1, 8))::BIGINT AS n FROM documents) WHERE len(ls) > 0)"""


@query(f"SELECT d.doc_id, d.source, d.lang FROM documents d LEFT JOIN {SEEDS} s ON s.raw_index = d.doc_id WHERE contains(d.text, coalesce(s.seed, ''))")
def seed_lookup(t: Tables) -> DataFrame:
    """Looks a seed of every document up in its text."""
    drawn = sampling.seed_snippets(t.documents, "doc_id", "text")
    seeds = t.documents.select("lang", F.col("doc_id").alias("raw_index")).join(drawn, "raw_index", "left").withColumn("seed", F.coalesce("seed", F.lit("")))
    docs = t.documents.select("lang", F.col("doc_id").alias("raw_index"), "text", "source")
    got = seeds.join(docs, ["lang", "raw_index"])
    ok = F.when(F.contains("text", F.col("seed")), F.col("source")).otherwise(F.raise_error(F.lit("a seed isn't in its text")))
    return got.select(F.col("raw_index").alias("doc_id"), ok.alias("source"), "lang")


RANGES = "(SELECT event_id, user_id, (event_id * 7 % 1000)::BIGINT AS first, (event_id * 7 % 1000 + event_id % 9)::BIGINT AS last FROM events)"


@query(f"SELECT event_id FROM {RANGES} m WHERE EXISTS (SELECT 1 FROM {RANGES} s WHERE s.event_id % 50 = 0 AND s.user_id = m.user_id AND s.first <= m.last AND m.first <= s.last)")
def range_overlap_cover(t: Tables) -> DataFrame:
    m = t.events.select("event_id", "user_id", (F.col("event_id") * 7 % 1000).alias("first"), (F.col("event_id") * 7 % 1000 + F.col("event_id") % 9).alias("last"))
    s = m.where("event_id % 50 = 0").select("user_id", F.col("first").alias("seed_first"), F.col("last").alias("seed_last"))
    return mining.overlapping(m, s, "user_id", cover=True).select("event_id")


@query("SELECT m.event_id, c.cid AS nearest FROM (SELECT * FROM events WHERE event_type = 'purchase') m ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS cid FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2) c ON c.user_id = m.user_id AND c.ts < m.ts")
def asof_nearest_comment(t: Tables) -> DataFrame:
    m = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    c = t.events.where("event_type <> 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("nearest"))
    return mining.nearest_above(m, c, ["user_id"], "ts", "ts", ["nearest"]).select("event_id", "nearest")


@query("SELECT round(sum(r * n) / sum(n), 9) AS weighted_rate FROM (SELECT lang, avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END)::DOUBLE AS r FROM documents GROUP BY lang) JOIN (SELECT lang, count(DISTINCT source) AS n FROM documents GROUP BY lang) USING (lang)")
def weighted_pass_rate(t: Tables) -> DataFrame:
    rate = t.documents.groupBy("lang").agg(F.avg(F.when(F.col("n_chars") > 1000, 1.0).otherwise(0.0)).alias("rate"))
    dim = t.documents.groupBy("lang").agg(F.countDistinct("source").alias("n"))
    return analysis.weighted_rate(rate, dim, "lang").select(F.round("weighted_rate", 9).alias("weighted_rate"))


@query("SELECT item_id, unnest(range(5))::INTEGER AS sample_no, item_id * 5 + unnest(range(5)) AS output_no FROM benchmark")
def sample_fanout(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("sample_no")).withColumn("output_no", F.col("item_id") * 5 + F.col("sample_no"))


# --- similarity --------------------------------------------------------------

TFIDF = """WITH src AS ({src}), tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM src) GROUP BY 1, 2),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM src)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
raw AS (SELECT id, term, tf * idf AS w FROM tf JOIN idf USING (term)), nrm AS (SELECT id, sqrt(sum(w * w)) AS s FROM raw GROUP BY 1), wt AS (SELECT id, term, w / s AS weight FROM raw JOIN nrm USING (id)) """


@query(TFIDF.format(src="SELECT doc_id AS id, text FROM documents") + "SELECT id, count(*) AS terms, round(max(weight), 6) AS top, round(sum(weight), 5) AS total FROM wt GROUP BY id")
def tfidf_weights(t: Tables) -> DataFrame:
    return similarity.tfidf(t.documents, "doc_id", "text").groupBy("id").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("top"), F.round(F.sum("weight"), 5).alias("total"))


@query(TFIDF.format(src="SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'q' || item_id, text FROM benchmark") + """, sc AS (SELECT substr(d.id, 2)::BIGINT AS id, substr(q.id, 2)::BIGINT AS q, round(sum(d.weight * q.weight), 6) AS score FROM wt d JOIN wt q ON d.term = q.term WHERE d.id[1] = 'd' AND q.id[1] = 'q' GROUP BY 1, 2)
SELECT doc_id AS id, arg_max(q, score * 1000000 - q / 1000000.0) AS nearest, coalesce(max(score), 0.0) AS score FROM documents LEFT JOIN sc ON sc.id = doc_id GROUP BY doc_id""")
def tfidf_nearest(t: Tables) -> DataFrame:
    return similarity.nearest_text(t.documents, t.benchmark, "doc_id", "text", "item_id")


QV = "(SELECT arg_min(embedding, vec_id) AS qv, label FROM embeddings GROUP BY label)"


def _label_queries(t: Tables) -> DataFrame:
    return t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))


_COS = "round(list_dot_product(e.embedding::DOUBLE[], q.qv::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) / sqrt(list_dot_product(q.qv::DOUBLE[], q.qv::DOUBLE[])), 6)"


@query(f"SELECT e.vec_id AS id, arg_max(q.label, {_COS} * 1000000 - q.label / 1000.0) AS nearest, max({_COS}) AS score FROM embeddings e, {QV} q GROUP BY 1")
def embed_nearest_query(t: Tables) -> DataFrame:
    return similarity.nearest_vector(t.embeddings, _label_queries(t), "vec_id", "embedding", "label")


_L2 = "round(list_sum(list_transform(list_zip(e.embedding, q.qv), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 6)"


@query(f"SELECT e.vec_id AS id, arg_min(q.label, {_L2} * 1000000 + q.label / 1000.0) AS center FROM embeddings e, {QV} q GROUP BY 1")
def kmeans_step(t: Tables) -> DataFrame:
    return similarity.lloyd_step(t.embeddings, _label_queries(t), "vec_id", "embedding", "label")


@query()
def kmeans_assign(t: Tables) -> DataFrame:
    return similarity.kmeans(t.embeddings, "vec_id", "embedding", 10)


@query("SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM embeddings GROUP BY label")
def label_share(t: Tables) -> DataFrame:
    return similarity.shares(t.embeddings, "label").withColumn("share", F.round("share", 9))


@query("SELECT label, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS members FROM embeddings GROUP BY label")
def cluster_members(t: Tables) -> DataFrame:
    return t.embeddings.groupBy("label").agg(F.array_join(F.transform(F.sort_array(F.collect_list("vec_id")), lambda x: x.cast("string")), ",").alias("members"))


@query("SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS x, round(avg(embedding[2]::DOUBLE), 6) AS y FROM embeddings GROUP BY GROUPING SETS ((), (label))")
def centroid_mean(t: Tables) -> DataFrame:
    xy = [F.round(F.avg(F.get("embedding", F.lit(k)).cast("double")), 6).alias(n) for k, n in ((0, "x"), (1, "y"))]
    return t.embeddings.rollup("label").agg(*xy)


@query("SELECT conv_id, turn, coalesce(instruction, '') || ' ' || coalesce(response, '') AS text FROM " + TURNS)
def similarity_text(t: Tables) -> DataFrame:
    d = _turns(t)
    return d.select("conv_id", "turn", similarity.text_of(d, "codealpaca").alias("text"))


@query(SQL["embed_nearest_query"])
def embed_classify(t: Tables) -> DataFrame:
    """The nearest of the labels' first vectors; every label has to be some row's."""
    return similarity.classify(t.embeddings, _label_queries(t), "vec_id", "embedding", "label")


# --- reports -----------------------------------------------------------------

LABELLED = "(SELECT d.doc_id, d.lang, coalesce(l.quality, 1) = 1 AS keep, CASE WHEN l.quality = 0 THEN CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'poor' END END AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def _labelled(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return d.select("doc_id", "lang", (F.coalesce("quality", F.lit(1)) == 1).alias("keep"), F.when(F.col("quality") == 0, F.when(F.col("toxic") == 1, "toxic").otherwise("poor")).alias("reason"))


_RATIO = "printf('%.2f', count(*) FILTER (WHERE keep) / count(*))"


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE keep) AS chosen, count(*) FILTER (WHERE NOT keep) AS rejected, {_RATIO} AS chosen_ratio FROM {LABELLED}")
def clean_analysis_overall(t: Tables) -> DataFrame:
    return analysis.rejections(_labelled(t))


@query(f"SELECT lang, count(*) AS total, count(*) FILTER (WHERE keep) AS chosen, count(*) FILTER (WHERE NOT keep) AS rejected, {_RATIO} AS chosen_ratio FROM {LABELLED} GROUP BY lang")
def clean_analysis_lang(t: Tables) -> DataFrame:
    return analysis.rejections(_labelled(t), "lang")


@query(f"SELECT lang, reason, count(*) AS n FROM {LABELLED} WHERE NOT keep GROUP BY 1, 2")
def clean_analysis_reason(t: Tables) -> DataFrame:
    return analysis.reasons(_labelled(t), "lang")


@query(f"SELECT lang, reason, doc_id, n::INTEGER AS example_no FROM (SELECT *, row_number() OVER (PARTITION BY lang, reason ORDER BY doc_id) AS n FROM {LABELLED} WHERE NOT keep) WHERE n <= 5")
def examples_topn(t: Tables) -> DataFrame:
    return analysis.first_examples(_labelled(t).where("not keep"), ["lang", "reason"], "doc_id").select("lang", "reason", "doc_id", "example_no")


@query("SELECT round_even(value, 2) AS score, round(count(*) / (SELECT count(*) FROM events), 9) AS share FROM events GROUP BY 1")
def score_histogram(t: Tables) -> DataFrame:
    return analysis.score_histogram(t.events, "value").withColumn("share", F.round("share", 9))


@query("SELECT n_chars // 20 * 20 AS bin, count(*) / 1000 AS thousands FROM documents GROUP BY 1")
def length_histogram(t: Tables) -> DataFrame:
    return analysis.histogram(t.documents, "n_chars", 20)


# --- exact dedup -------------------------------------------------------------


def _three_keys(t: Tables, *more: str) -> DataFrame:
    """The whole text, and its two halves; a blank half would equal any other, so the text stands for it."""
    x = F.col("text")
    whole = lambda half: F.when(T.strip(half) == "", x).otherwise(half)
    return t.documents.select("doc_id", *more, F.concat(F.md5(F.concat(F.lit("666:"), F.col("doc_id").cast("string"))), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("ord"), x.alias("seed"), whole(_instr()).alias("problem"), whole(_resp()).alias("solution"))


@query(f"""WITH RECURSIVE k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5('666:' || doc_id)) AS rn, doc_id, md5(regexp_replace(text, '{WS}', '', 'g')) AS s, md5(regexp_replace(CASE WHEN {_strip(SI)} = '' THEN text ELSE {SI} END, '{WS}', '', 'g')) AS p, md5(regexp_replace(CASE WHEN {_strip(SR)} = '' THEN text ELSE {SR} END, '{WS}', '', 'g')) AS q FROM documents),
r AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS doc_id, false AS keep, NULL::VARCHAR AS reason, []::VARCHAR[] AS s, []::VARCHAR[] AS p, []::VARCHAR[] AS q
UNION ALL SELECT k.rn, k.doc_id, x.why IS NULL, x.why, CASE WHEN x.why IS NULL THEN list_append(r.s, k.s) ELSE r.s END, CASE WHEN x.why IS NULL THEN list_append(r.p, k.p) ELSE r.p END, CASE WHEN x.why IS NULL THEN list_append(r.q, k.q) ELSE r.q END
FROM r JOIN k ON k.rn = r.rn + 1, LATERAL (SELECT CASE WHEN list_contains(r.s, k.s) THEN 'duplicate seeds' WHEN list_contains(r.p, k.p) THEN 'duplicate problems' WHEN list_contains(r.q, k.q) THEN 'duplicate solutions' END AS why) x)
SELECT doc_id, keep, reason FROM r WHERE rn > 0""")
def clean_greedy3(t: Tables) -> DataFrame:
    return dedup.clean_three_keys(_three_keys(t), "ord").select("doc_id", "keep", "reason")


#: Rows of the cleaning job: the keys of clean_greedy3, in the order that the job shuffles to.
CLEANED = SQL["clean_greedy3"].removesuffix("SELECT doc_id, keep, reason FROM r WHERE rn > 0")


def _job(t: Tables) -> cleaning.Cleaned:
    return cleaning.clean(_three_keys(t, "lang").drop("ord"), id_col="doc_id")


@query(CLEANED + "SELECT lang, reason, count(*) AS n FROM (SELECT * FROM r WHERE rn > 0) r JOIN documents USING (doc_id) WHERE NOT keep GROUP BY ALL")
def clean_job_reasons(t: Tables) -> DataFrame:
    return _job(t).by_reason


@query(CLEANED + f", l AS (SELECT r.*, d.lang FROM (SELECT * FROM r WHERE rn > 0) r JOIN documents d USING (doc_id)) SELECT lang, count(*) AS total, count(*) FILTER (WHERE keep) AS chosen, count(*) FILTER (WHERE NOT keep) AS rejected, {_RATIO} AS chosen_ratio FROM l GROUP BY lang")
def clean_job_report(t: Tables) -> DataFrame:
    return _job(t).by_lang


@query(CLEANED + f"""SELECT d.lang || '-' || replace(reason, ' ', '_') || '-' || (row_number() OVER (PARTITION BY d.lang, reason ORDER BY r.rn) - 1) AS file, '[Seed]' || chr(10) || d.text || chr(10) || chr(10) || '[Problem]' || chr(10) || CASE WHEN {_strip(SI)} = '' THEN text ELSE {SI} END || chr(10) || chr(10) || '[Solution]' || chr(10) || CASE WHEN {_strip(SR)} = '' THEN text ELSE {SR} END AS text
FROM (SELECT * FROM r WHERE rn > 0) r JOIN documents d USING (doc_id) WHERE NOT keep QUALIFY row_number() OVER (PARTITION BY d.lang, reason ORDER BY r.rn) <= 5""")
def clean_job_examples(t: Tables) -> DataFrame:
    return _job(t).examples


# --- near dedup --------------------------------------------------------------

#: The operator's own setting, and the reference's.
PERMS, SHAPE = 256, dedup.band_shape(0.7, 256)
#: SQL of 256 permutations is too slow; tests/test_whole.py has the MinHash queries in plain Python.
SHINGLE = """w AS (SELECT doc_id, string_split_regex(text, '[^A-Za-z_0-9]') AS w FROM documents), g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 10))"""


def _signed(t: Tables) -> DataFrame:
    return dedup.minhash(t.documents, "doc_id", "text", n_perm=PERMS)


@query(f"WITH {SHINGLE} SELECT w.doc_id, count(g.g) AS n FROM w LEFT JOIN g ON g.doc_id = w.doc_id GROUP BY 1")
def shingle_distinct(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(T.shingles("text", 5, 10)).cast("bigint").alias("n"))


@query()
def minhash_signature(t: Tables) -> DataFrame:
    return _signed(t).select("id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


@query()
def minhash_edges(t: Tables) -> DataFrame:
    return dedup.minhash_edges(_signed(t), *SHAPE)


def _clusters(t: Tables) -> DataFrame:
    return dedup.minhash_clusters(t.documents, "doc_id", "text", n_perm=PERMS, shape=SHAPE)


@query()
def minhash_clusters(t: Tables) -> DataFrame:
    return _clusters(t)


@query()
def minhash_keep(t: Tables) -> DataFrame:
    return _clusters(t).where("id = cluster").select(F.col("id").alias("doc_id"))


@query()
def dedup_report(t: Tables) -> DataFrame:
    c = _clusters(t).agg(F.count("*").alias("before"), F.count_if(F.col("id") == F.col("cluster")).alias("after"))
    return c.select("before", "after", (F.col("before") - F.col("after")).alias("dropped"), F.round(F.col("after") / F.col("before"), 9).alias("kept"))


# --- positions, samples ------------------------------------------------------


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents")
def row_index(t: Tables) -> DataFrame:
    return sampling.row_index(t.documents.select("doc_id"), ["doc_id"])


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS chunk FROM documents")
def chunk_ids(t: Tables) -> DataFrame:
    return sampling.row_index(t.documents.select("doc_id"), ["doc_id"]).select("doc_id", F.expr("index div 100").alias("chunk"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i >= 50 AND i < 150")
def range_select(t: Tables) -> DataFrame:
    return sampling.row_index(t.documents.select("doc_id"), ["doc_id"]).where("index >= 50 and index < 150").select("doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('666:' || doc_id), doc_id) - 1 AS index FROM documents")
def seeded_shuffle(t: Tables) -> DataFrame:
    return sampling.row_index(t.documents.select("doc_id", sampling.shuffle_key("doc_id", 666).alias("_k")), ["_k", "doc_id"]).select("doc_id", "index")


@query("SELECT doc_id FROM documents ORDER BY md5('1:' || doc_id), doc_id LIMIT 50")
def sample_k(t: Tables) -> DataFrame:
    return sampling.sample(t.documents.select("doc_id"), "doc_id", 50, 1)


@query("SELECT doc_id, lang FROM documents WHERE lang = 'es' UNION ALL (SELECT doc_id, lang FROM documents WHERE lang = 'en' ORDER BY md5('1:' || doc_id), doc_id LIMIT (SELECT count(*) // 4 FROM documents WHERE lang = 'en'))")
def sample_topup(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang")
    es, en = d.where("lang = 'es'"), d.where("lang = 'en'")
    return sampling.top_up(es, en, "doc_id", es.count() + en.count() // 4, 1)


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= ceil(0.1 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM documents")
def train_test_split(t: Tables) -> DataFrame:
    return sampling.train_test(t.documents.select("doc_id"), "doc_id", 0.1, 42)


@query(f"SELECT * FROM {SEEDS}")
def seed_snippet(t: Tables) -> DataFrame:
    return sampling.seed_snippets(t.documents, "doc_id", "text")


@query(f"SELECT doc_id, least(3, len(ls))::INTEGER AS first, least(4, len(ls))::INTEGER AS last FROM (SELECT doc_id, {_lines('y')} AS ls FROM (SELECT doc_id, 'a' || doc_id || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' || chr(10) || text AS y FROM documents))")
def locate_seed(t: Tables) -> DataFrame:
    y = F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit("\nb\nc\nd\n"), "text")
    return t.documents.select("doc_id", mining.locate_lines(y, F.lit("c\nd\n")).alias("x")).select("doc_id", "x.*")


@query("SELECT lang, kind FROM (SELECT lang, 'both' AS kind FROM (SELECT DISTINCT lang FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT DISTINCT lang FROM documents WHERE n_chars > 5000) UNION ALL SELECT lang, 'any' FROM (SELECT lang FROM documents WHERE doc_id % 2 = 0 UNION SELECT lang FROM documents) UNION ALL SELECT lang, 'minus' FROM (SELECT lang FROM documents EXCEPT SELECT lang FROM documents WHERE lang = 'en'))")
def set_ops_lang(t: Tables) -> DataFrame:
    d = t.documents
    a, b, every = d.where("doc_id % 2 = 0").select("lang"), d.where("n_chars > 5000").select("lang"), d.select("lang")
    tag = lambda x, k: x.select("lang", F.lit(k).alias("kind"))
    return tag(a.intersect(b), "both").unionByName(tag(a.union(every).distinct(), "any")).unionByName(tag(every.subtract(d.where("lang = 'en'").select("lang")), "minus"))


@query("SELECT doc_id, substr(sha256(doc_id || lang || source), 1, 5) AS print FROM documents")
def fingerprint(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.fingerprint("doc_id", "lang", "source").alias("print"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def ts_format(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"))


# --- mining ------------------------------------------------------------------

COMMENT = "'/** ' || text || chr(10) || ' * second */' || chr(10) || '// third ' || chr(10) || '///fourth*/'"


@query(f"""SELECT doc_id, {_strip("array_to_string(list_transform(string_split(y, chr(10)), lambda l: " + _strip("regexp_replace(regexp_replace(" + _strip("l") + ", '[*]/\\z', ''), '^([*]|/[*][*]|/[*]|///|//)', '')") + "), chr(10))")} AS comment FROM (SELECT doc_id, {COMMENT} AS y FROM documents)""")
def strip_comment(t: Tables) -> DataFrame:
    y = F.concat(F.lit("/** "), "text", F.lit("\n * second */\n// third \n///fourth*/"))
    return t.documents.select("doc_id", T.strip_comment(y).alias("comment"))


@query("SELECT doc_id, CASE WHEN contains(y, chr(10) || chr(10)) THEN split_part(y, chr(10) || chr(10), 1) WHEN contains(y, '@') THEN split_part(y, '@', 1) ELSE y END AS summary FROM (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN chr(10) || chr(10) || 'more' WHEN 1 THEN '@param x' ELSE '' END AS y FROM documents)")
def doc_summary(t: Tables) -> DataFrame:
    m = F.col("doc_id") % 3
    y = F.concat("text", F.when(m == 0, F.lit("\n\nmore")).when(m == 1, F.lit("@param x")).otherwise(F.lit("")))
    return t.documents.select("doc_id", T.doc_summary(y).alias("summary"))


LINE_SPANS = f"(SELECT doc_id, text, k AS line, ls[k] AS content, coalesce(list_sum(list_transform(ls[1 : k - 1], lambda x: length(x))), 0)::BIGINT AS begin FROM (SELECT doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, text, {_lines('text')} AS ls FROM documents)))"


@query(f"""WITH c AS (SELECT doc_id, text, line, regexp_replace(content, '[\\n\\r]', '', 'g') AS content, begin, begin + length(regexp_replace(content, '[\\n\\r]', '', 'g')) AS stop FROM {LINE_SPANS} WHERE line % 3 <> 0),
f AS (SELECT *, substr(text, lag(stop) OVER w + 1, begin - lag(stop) OVER w) AS gap FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
i AS (SELECT *, sum(CASE WHEN regexp_replace(gap, '[ \\t\\r\\n]', '', 'g') = '' AND length(gap) - length(replace(gap, chr(10), '')) = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS isl FROM f)
SELECT doc_id, min(begin) AS begin, max(stop) AS stop, min(line) AS first, max(line) AS last, md5(string_agg(content, chr(10) ORDER BY line)) AS content FROM i GROUP BY doc_id, isl""")
def comment_islands(t: Tables) -> DataFrame:
    spans = t.documents.select("doc_id", F.posexplode(T.lines("text")).alias("k", "content"))
    w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    own = spans.withColumns({"line": F.col("k").cast("bigint") + 1, "begin": F.coalesce(F.sum(F.length("content")).over(w), F.lit(0))}).withColumn("content", F.regexp_replace("content", "[\n\r]", ""))
    c = own.where("line % 3 <> 0").select("doc_id", "begin", (F.col("begin") + F.length("content")).alias("stop"), F.col("line").alias("first"), F.col("line").alias("last"), "content")
    return mining.comment_islands(c, t.documents, "doc_id", "text").withColumn("content", F.md5("content"))


@query("SELECT doc_id, 'f_' || doc_id AS name, 'def f_' || doc_id || '():' || chr(10) || '    ' || to_json(lang) || chr(10) || '    return {\"text\":' || to_json(text) || '}' || chr(10) AS content, lang AS docstring, 1::INTEGER AS start_line, 3::INTEGER AS end_line FROM documents")
def python_functions(t: Tables) -> DataFrame:
    said = F.regexp_extract(F.to_json(F.struct("lang")), r'^\{"lang":(.*)\}$', 1)
    code = F.concat(F.lit("def f_"), F.col("doc_id").cast("string"), F.lit("():\n    "), said, F.lit("\n    return "), F.to_json(F.struct("text")), F.lit("\n"))
    src = t.documents.select("doc_id", code.alias("code"))
    src.createOrReplaceTempView("weft_sources")
    t.spark.udtf.register("weft_python_functions", mining.PythonFunctions)
    return t.spark.sql("SELECT doc_id, f.name, f.content, f.docstring, f.start_line, f.end_line FROM weft_sources, LATERAL weft_python_functions(code) f")


@query(f"""SELECT doc_id, 'f' || doc_id AS name, 'int f' || doc_id || '(int a, char *b) {{' || chr(10) || '  // inner' || chr(10) || '  if (a) {{ return g(b); }}' || chr(10) || '  return ' || n_chars || ';' || chr(10) || '}}' AS "function", 'about ' || lang || chr(10) || 'it' AS docstring, 3::INTEGER AS start_line, 7::INTEGER AS end_line FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'h', 'void h() {{ }}', '', 11::INTEGER, 11::INTEGER FROM documents WHERE doc_id % 2 = 1""")
def function_pairs(t: Tables) -> DataFrame:
    """The seed is a line of the first function, or the second function."""
    parts = [F.lit("/* about "), "lang", F.lit("\n * it */\nint f"), F.col("doc_id").cast("string"), F.lit("(int a, char *b) {\n  // inner\n  if (a) { return g(b); }\n  return "), F.col("n_chars").cast("string"), F.lit(";\n}\n\n// far\nint y;\nvoid h() { }\n")]
    seed = F.when(F.col("doc_id") % 2 == 0, F.lit("<filename>a/b.c\n  // inner\n")).otherwise(F.lit("int y;\nvoid h() { }\n"))
    return mining.function_pairs(t.documents.select("doc_id", F.lit("cpp").alias("lang"), F.concat(*parts).alias("content"), seed.alias("seed")))


# --- token arrays ------------------------------------------------------------

IDS = "list_transform(list_filter(string_split({}, ''), lambda c: c <> ''), lambda c: unicode(c))"


@query(f"SELECT conv_id, turn, array_to_string(list_concat([1], {IDS.format('text')}, [2]), ',') AS ids FROM conversations")
def encode_bos_eos(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.array_join(sft.marked(sft.code_points(F.col("text")), 1, 2), ",").alias("ids"))


@query("SELECT conv_id, turn, text FROM conversations")
def decode_skip_special(t: Tables) -> DataFrame:
    """Texts encoded with marks at both ends, decoded again without them."""
    ids = sft.marked(sft.code_points(F.col("text")), 1, 2)
    return t.conversations.select("conv_id", "turn", sft.text_of_code_points(ids).alias("text"))


@query("SELECT doc_id, least(16384 - n_chars, 512, 12000 - n_chars) AS room FROM documents WHERE n_chars < 16384")
def generation_room(t: Tables) -> DataFrame:
    g = sft.Generation(most_new=512, temperature=0.0, most_length=12000)
    return t.documents.where("n_chars < 16384").select("doc_id", g.room(F.col("n_chars"), sft.context_of("codellama/CodeLlama-7b-Python-hf")).alias("room"))


#: The reference's length.
MOST = 1216


def _examples(t: Tables) -> DataFrame:
    return sft.examples(_turns(t), sft.marked(sft.code_points(F.col("instruction")), bos=1), sft.marked(sft.code_points(F.col("response")), eos=2), MOST)


EX = f"(SELECT conv_id, turn, list_concat(p, c)[1 : {MOST}] AS ids, list_concat(list_transform(p, lambda x: -100), c)[1 : {MOST}] AS labels, len(p) + len(c) > {MOST} AS over FROM (SELECT conv_id, turn, list_concat([1], {IDS.format('instruction')}) AS p, list_concat({IDS.format('response')}, [2]) AS c FROM {TURNS}))"


@query(f"SELECT conv_id, turn, array_to_string(ids, ',') AS input_ids, array_to_string(labels, ',') AS labels, over AS exceeding_length FROM {EX}")
def sft_examples(t: Tables) -> DataFrame:
    return _examples(t).select("conv_id", "turn", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("labels", ",").alias("labels"), "exceeding_length")


@query(f"SELECT count(*) FILTER (WHERE over) AS truncated, count(*) AS total FROM {EX}")
def truncation_rate(t: Tables) -> DataFrame:
    return _examples(t).agg(F.count_if("exceeding_length").alias("truncated"), F.count("*").alias("total"))


_PAD = "list_concat({0}, list_resize([]::INTEGER[], m - len({0}), {1}))"


@query(f"SELECT conv_id, turn, array_to_string({_PAD.format('ids', 0)}, ',') AS input_ids FROM (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS m FROM {EX})")
def pad_batch(t: Tables) -> DataFrame:
    return sft.collate(_examples(t), "conv_id", 0).select("conv_id", "turn", F.array_join("input_ids", ",").alias("input_ids"))


@query(f"SELECT conv_id, turn, array_to_string({_PAD.format('labels', -100)}, ',') AS labels, array_to_string(list_transform({_PAD.format('ids', 32)}, lambda x: (x <> 32)::INTEGER), ',') AS attention_mask FROM (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS m FROM {EX})")
def collate_mask(t: Tables) -> DataFrame:
    """Spaces equal the padding here, and are masked as it is."""
    return sft.collate(_examples(t), "conv_id", 32).select("conv_id", "turn", F.array_join("labels", ",").alias("labels"), F.array_join("attention_mask", ",").alias("attention_mask"))


@query("SELECT doc_id, least(512, 16384 - n_chars - 10) AS budget FROM documents WHERE least(512, 16384 - n_chars - 10) > 0")
def token_budget(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", sft.budget(F.col("n_chars"), 16384, 512).alias("budget")).where("budget > 0")


# --- the relational surface --------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(t: Tables) -> DataFrame:
    d = t.lineitem.where("l_shipdate <= timestamp '1998-09-02'")
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def orders_by_nation(t: Tables) -> DataFrame:
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
