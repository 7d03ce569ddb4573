"""Readers, writers, extraction rules, the cleaning job and function pairs, on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from weft.operators import benchmarks, cleaning, decontam, formatting, mining, sft, similarity
from weft.sources import io
from weft.streaming import jobs


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def fails(spark, value, f):
    with pytest.raises(Exception, match="USER_RAISED|raised|prompt|list|language"):
        one(spark, value, f)


def test_extraction_rules(spark):
    assert one(spark, 'def f():\n  """ says """\n', benchmarks.quoted_docstring) == "says"
    assert one(spark, 'x """a""" y """ b\n"""', benchmarks.quoted_docstring) == "b"
    assert one(spark, "f '''c'''", benchmarks.quoted_docstring) == "c"
    for bad in ('"""a', "none", '"""a""" """', "'''a"):
        fails(spark, bad, benchmarks.quoted_docstring)
    assert one(spark, "a\n# SOLUTION START\nb", benchmarks.before_mark) == "a\n# "
    assert one(spark, "a\nBEGIN SOLUTION\nb", benchmarks.before_mark) == "a\n"
    for bad in ("a", "SOLUTION START SOLUTION START", "BEGIN SOLUTION BEGIN SOLUTION"):
        fails(spark, bad, benchmarks.before_mark)
    tasks = spark.range(600).withColumnRenamed("id", "task_id")
    assert benchmarks.task_range(tasks, "task_id").count() == 500
    with pytest.raises(ValueError):
        benchmarks.task_range(tasks.where("task_id < 400"), "task_id")
    said = spark.createDataFrame([(" return x + y ",), (" ",), (None,), ("return 2",)], "s string")
    assert [r.s for r in benchmarks.texts(said, "s", drop=benchmarks.GENERIC).collect()] == ["return 2"]
    lists = spark.createDataFrame([(1, '["a", "b\\n"]'), (2, ""), (3, "[]"), (4, None)], "id int, s string")
    assert [tuple(r) for r in benchmarks.json_solutions(lists, "id", "s").collect()] == [(1, 0, "a"), (1, 1, "b\n")]
    with pytest.raises(Exception):
        benchmarks.json_solutions(spark.createDataFrame([(1, "{")], "id int, s string"), "id", "s").collect()
    assert len(benchmarks.translated_sets()) == 57 and "mbpp-py-remove" not in benchmarks.translated_sets()


def test_ignored(monkeypatch):
    monkeypatch.setenv("IGNORED", "a::b")
    assert benchmarks.ignored() == {"a", "b"}
    monkeypatch.delenv("IGNORED")
    assert benchmarks.ignored() == set()


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "data-python-1.jsonl").write_text('{"problem": "p", "n": 1}\n\n{"n": 2}\n')
    (tmp_path / "data-cobol-1.jsonl").write_text('{"problem": "p", "n": 1}\n')
    rows = io.read_jsonl(spark, str(tmp_path / "data-python-1.jsonl"), "problem string, n int")
    assert sorted(tuple(r) for r in io.texts_of(rows, "problem", "solution").collect()) == [("", ""), ("p", "")]
    tagged = io.read_tagged(spark, [str(tmp_path / "data-python-1.jsonl")], "problem string, n int")
    assert {r.lang for r in tagged.collect()} == {"python"}
    with pytest.raises(Exception, match="no known language"):
        io.read_tagged(spark, [str(tmp_path / "data-cobol-1.jsonl")], "problem string, n int").collect()
    with pytest.raises(ValueError):
        io.read_tagged(spark, [str(tmp_path / "data-python-1.jsonl")], "problem string, lang string")
    (tmp_path / "bad.jsonl").write_text("{\n")
    with pytest.raises(Exception):
        io.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "n int").collect()
    (tmp_path / "whole.json").write_text('[\n{"n": 1},\n {"n": 2}]')
    assert io.read_json(spark, str(tmp_path / "whole.json"), "n int").count() == 2
    assert io.read_texts(spark, str(tmp_path / "whole.js*")).first().value.startswith("[")
    out = str(tmp_path / "out")
    assert not io.finished(spark, out)
    io.write_jsonl(rows, out)
    assert io.finished(spark, out) and io.read_jsonl(spark, out, "problem string, n int").count() == 2
    with pytest.raises(Exception):
        io.write_jsonl(rows, out)
    io.write_jsonl(rows, out, "append")
    assert io.read_jsonl(spark, out, "n int").count() == 4
    io.write_document(rows.select("n"), str(tmp_path / "doc"))
    assert sorted(r["n"] for r in json.loads(spark.read.text(str(tmp_path / "doc")).first()[0])) == [1, 2]
    many = spark.range(1000)
    io.write_shards(many, str(tmp_path / "shards"), "id", 100, 450)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 1000 and len(list((tmp_path / "shards").glob("*.parquet"))) == 5
    corpus = spark.createDataFrame([("c-sharp", 1), ("java", 2), ("swift", 3)], "lang string, n int")
    io.write_by_language(corpus, str(tmp_path / "corpus"))
    io.write_by_language(corpus.withColumn("n", F.col("n") * 10), str(tmp_path / "other"))
    read = lambda lang: [r.n for r in io.read_seed_language(spark, str(tmp_path / "corpus"), str(tmp_path / "other"), lang).collect()]
    assert (read("csharp"), read("java"), read("swift")) == ([1], [2], [30])
    io.write_scores(spark.createDataFrame([(1, 0.5, 7)], "i int, s double, q int"), str(tmp_path / "scores"), "i", "s", "q")
    assert spark.read.json(str(tmp_path / "scores")).first().asDict() == {"id": 1, "score": 0.5, "nearest": 7}
    assert one(spark, "a/b-c/multiple-rs_x-0.2.json", io.lang_of_metric) == "rs"


def test_cleaning_job(spark, tmp_path):
    rows = [(0, "en", "s1", "p1", "x1"), (1, "en", "s1 ", "p2", "x2"), (2, "de", "s2", "p2", "x3"), (3, "de", "s3", "p3", "see\n```\nk\n```\n"), (4, "de", "s4", "```\nk\n```\n", " ```\n k\n```")]
    df = spark.createDataFrame(rows, "index long, lang string, seed string, problem string, solution string")
    got = cleaning.clean(df, copies=True)
    order = [r["index"] for r in df.withColumn("k", F.md5(F.concat(F.lit("666:"), F.col("index").cast("string")))).orderBy("k").collect()]
    seen, kept, gone = [set(), set(), set()], [], {}
    for i in order:
        keys = ["".join(x.split()) for x in rows[i][2:]]
        why = next((f"duplicate {n}" for k, s, n in zip(keys, seen, ("seeds", "problems", "solutions")) if k in s), None)
        if why is None:
            for k, s in zip(keys, seen):
                s.add(k)
            why = "copied code block" if i == 4 else None
        if why:
            gone[i] = why
        else:
            kept.append(i)
    assert [r["index"] for r in got.kept.collect()] == kept and {r["index"]: r.reason for r in got.rejected.collect()} == gone and 4 in gone
    assert tuple(got.overall.first())[:3] == (5, len(kept), len(gone))
    assert {(r.lang, r.reason): r.n for r in got.by_reason.collect()} == {(rows[i][1], w): sum(rows[j][1] == rows[i][1] and v == w for j, v in gone.items()) for i, w in gone.items()}
    cleaning.write_examples(got.examples, str(tmp_path / "examples"))
    folders = {p.name.removeprefix("file=") for p in (tmp_path / "examples").iterdir() if p.is_dir()}
    assert folders == {r.file for r in got.examples.collect()} and "de-copied_code_block-0" in folders
    text = next((tmp_path / "examples" / "file=de-copied_code_block-0").glob("*.txt")).read_text()
    assert text.startswith("[Seed]\ns4\n\n[Problem]\n```\nk\n```\n\n\n[Solution]\n")


SOURCES = {
    "java": "class A {\n  /** Adds.\n   * @return sum */\n  public int add(int a, int b) throws E {\n    if (a > 0) { return a + b; }\n    String s = \"} /* no */\";\n    return b;\n  }\n\n  // far away\n  int x;\n  void other() { for (;;) { } }\n}\n",
    "rust": "/// Doubles.\n/// Twice.\nfn two(x: &str) -> Vec<u8> {\n    let y = || { 1 };\n    y()\n}\n",
    "shell": "# Says hello\nhello() {\n  echo \"} $1\" # inner\n}\nfunction bye {\n  echo x\n}\n",
    "php": "<?php\n# Old style\nfunction f($a) { return \"{$a}\"; }\n",
    "cpp": "int g();\n/* Gets\n   it */\n\nint h(std::vector<int> &v) const { return v[0]; }\n",
    "typescript": "// One\nexport function one(a: number): number { return a }\n",
    "python": "import os\n\ndef f(a):\n    x = 1\n    '''Adds one.\n\n    More.'''\n    return a\n\nclass B:\n    def g(self):\n        return 2\n",
}
WANT = {
    "java": [("add", "Adds.\n", 4, 8), ("other", "", 12, 12)],
    "rust": [("two", "Doubles.\nTwice.", 3, 6)],
    "shell": [("hello", "Says hello", 2, 4), ("bye", "", 5, 7)],
    "php": [("f", "Old style", 3, 3)],
    "cpp": [("h", "Gets\nit", 5, 5)],
    "typescript": [("one", "One", 2, 2)],
    "python": [("f", "Adds one.", 3, 8), ("g", "", 11, 12)],
}


def test_function_pairs(spark):
    rows = [(k, lang, src, "<filename>x\n" + src) for k, (lang, src) in enumerate(SOURCES.items())]
    df = spark.createDataFrame(rows, "doc_id int, lang string, content string, seed string")
    got = mining.function_pairs(df).collect()
    for k, lang in enumerate(SOURCES):
        mine = sorted(((r.name, r.docstring, r.start_line, r.end_line) for r in got if r.doc_id == k), key=lambda x: x[2])
        want = [(n, d.strip(), a, b) for n, d, a, b in WANT[lang]]
        if lang in ("shell", "php"):  # a hash isn't one of the marks that are stripped
            mine = [(n, d.lstrip("# "), a, b) for n, d, a, b in mine]
        assert mine == want, lang
        for r in got:
            if r.doc_id == k:
                lines = SOURCES[lang].splitlines(keepends=True)
                assert r.function.strip() in "".join(lines[r.start_line - 1 : r.end_line])
    part = df.where("lang = 'java'").withColumn("seed", F.lit("    return b;\n"))
    assert [r.name for r in mining.function_pairs(part).collect()] == ["add"]
    assert [r.name for r in mining.function_pairs(part, cover=False).collect()] == ["other"]
    with pytest.raises(Exception, match="unknown language"):
        mining.function_pairs(df.withColumn("lang", F.lit("cobol"))).collect()
    assert mining.function_pairs(df.limit(0)).count() == 0


def test_completion_prompts(spark):
    f = lambda x: formatting.completion_prompt(x)
    tail = "\nA:\n<code>\ny = 2\n"
    got = one(spark, "Problem:\nAsk <b>" + tail + "# return y\n# use y\n### BEGIN SOLUTION", f)
    assert tuple(got) == ("Ask <b>", "```python\ny = 2\n# Solution\n")
    got = one(spark, "Ask" + tail + "</code>\none\ntwo\n  three\nBEGIN SOLUTION\n<code>", f)
    assert tuple(got) == ("Ask", "```python\ny = 2\n# one\n# two\n# three\n# Solution\n")
    assert tuple(one(spark, "Ask" + tail + "</code>\nBEGIN SOLUTION\n<code>", f)) == ("Ask", "```python\ny = 2\n# Solution\n")
    head = "import a\n"
    assert tuple(one(spark, head + "# SOLUTION START\n", f)) == (f"{formatting.ASK}{formatting.OPEN}import a{formatting.CLOSE}", f"{formatting.OPEN}import a\n# Solution\n")
    for bad in ("x # SOLUTION START\nmore", "<code> # SOLUTION START", "no answer", "A: none", "Q" + tail + "# return y\n### BEGIN SOLUTION", "Q" + tail + "</code>\none\ntwo\nBEGIN SOLUTION\n<code>", "Q\nA:\n### BEGIN SOLUTION", "Q\nA:\nBEGIN SOLUTION"):
        fails(spark, bad, f)


def test_tokens_and_models(spark):
    text = "a é 😀 \n\t日本"
    ids = lambda x: sft.marked(sft.code_points(x), 1, 2)
    assert one(spark, text, lambda x: sft.text_of_code_points(ids(x))) == text
    count = sft.tokenizer_udf(lambda t: [len(w) for w in t.split()])
    assert one(spark, "ab c", count) == [2, 1] and one(spark, None, count) is None
    decode = sft.decoder_udf(lambda xs: "-".join(map(str, xs)), {1, 2})
    assert one(spark, [1, 5, 7, 2], decode, "array<int>") == "5-7"
    assert one(spark, [5, 6], lambda x: sft.pad(x, 4, 0, "left"), "array<int>") == [0, 0, 5, 6]
    assert len(sft.MODELS) == 11 and sft.context_of("bigcode/starcoder") == 8192
    with pytest.raises(ValueError):
        sft.context_of("other")
    g = sft.Generation(100, 1.0, 0.0, 300)
    assert not g.sampled and "temperature" not in g.options(2, 0) and sft.Generation().options(2, 0)["temperature"] == 1.0
    assert g.for_new(7).most_length is None
    assert [one(spark, n, lambda x: g.room(x, 1000), "int") for n in (50, 250)] == [100, 50]
    with pytest.raises(Exception):
        one(spark, 1000, lambda x: g.room(x, 1000), "int")
    with pytest.raises(ValueError):
        formatting.fim_prompt_of("codellama/CodeLlama-7b-Python-hf", F.lit("a"), F.lit("b"))
    assert one(spark, "p", lambda x: formatting.fim_prompt_of("bigcode/starcoder", x, F.lit("s"))) == "<fim_prefix>p<fim_suffix>s<fim_middle>"


def test_embeddings(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id int, t string")
    got = similarity.embed(df, F.col("t"), lambda: lambda xs: [[float(len(x)), 1.0] for x in xs], "do:").orderBy("id").collect()
    assert [r.embedding for r in got] == [[5.0, 1.0], [3.0, 1.0]]
    made = []

    def make():
        made.append(1)
        return df

    for parts in (("a", "b"), ("a", "b"), ("a", "c")):
        assert similarity.memoised(spark, str(tmp_path), parts, make).count() == 2
    assert len(made) == 2
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1])], "id int, v array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "label int, v array<double>")
    with pytest.raises(ValueError):
        similarity.classify(v, q, "id", "v", "label")
    assert {r.nearest for r in similarity.classify(v.union(spark.createDataFrame([(3, [0.0, 2.0])], v.schema)), q, "id", "v", "label").collect()} == {0, 1}


def test_resume(spark):
    done = spark.createDataFrame([(100,), (104,)], "index long")
    assert jobs.resume_at("data-ab12c-100_200-x.jsonl", "ab12c", 100, 200, done) == 105
    for name, rows in (("data-zz-100_200.jsonl", done), ("data-ab12c-1_2.jsonl", done), ("data-ab12c-100_200.jsonl", done.limit(0))):
        with pytest.raises(ValueError):
            jobs.resume_at(name, "ab12c", 100, 200, rows)


def test_decontaminate_keeps_rows_and_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "An Apple pie", "x"), (2, "none", "y"), (3, "pear and apple", "z")], "id int, t string, `a.b` string")
    p = decontam.pattern_table(("b0", spark.createDataFrame([(1, "pear"), (2, "APPLE")], "item_ord int, pattern string")), ("b1", spark.createDataFrame([(1, "apple")], "item_ord int, pattern string")))
    want = {1: ("b0_match", "APPLE"), 2: (None, None), 3: ("b0_match", "pear")}
    for most in (64_000_000, 5):
        monkeypatch.setattr(decontam, "PART_CHARS", most)
        plain = docs.withColumnRenamed("a.b", "c")
        assert {r.id: (r.filter_reason, r.matched_substring) for r in decontam.decontaminate(plain, p, "id", ["t"]).collect()} == want
        assert {r.id: r.matched_substring for r in decontam.matches(plain, p, "id", ["t"]).collect()} == {1: "APPLE", 3: "pear"}
    tagged = decontam.decontaminate(docs.withColumnRenamed("a.b", "c"), p, "id", ["t"])
    out = decontam.excluded(tagged, ["id", "c"]).orderBy("data.id").collect()
    assert [(r.data.id, r.data.c, r.filter_reason) for r in out] == [(1, "x", "b0_match"), (3, "z", "b0_match")]


def test_seen_keys_and_windows_of_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    stamp = lambda m: f"2024-01-01T00:{m:02d}:00.000Z"
    for k, rows in enumerate(([("a", 0), ("b", 1), ("a", 2)], [("a", 3), ("c", 4)], [("d", 50)])):
        (src / f"{k}.json").write_text("".join(json.dumps({"k": x, "ts": stamp(m)}) + "\n" for x, m in rows))
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(src))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r.k for r in run(jobs.first_seen(stream, "k", "ts", "10 minutes"), "seen")) == ["a", "b", "c", "d"]
    got = run(jobs.windowed_counts(stream, "ts", "10 minutes", "5 minutes", "k"), "counted")
    assert {(r.k, r.n) for r in got} == {("a", 3), ("b", 1), ("c", 1)}  # the last window is still open
