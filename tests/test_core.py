"""Core operators against plain Python on hand-made rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft import queries as Q
from weft.functions import text as T
from weft.operators import benchmarks, decontam, dedup, formatting, mining, sampling, sft, similarity
from weft.plans.graph import components
from weft.streaming import jobs

WEIRD = ["", "\n", "a", "a\n\n", "\r\n", "\r\r\n", "x y", "f\x0cg", "  b　", "\x1c\x85c\t", "plain text"]


def one(spark, rows, kind="string"):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")


def test_white_space_and_lines(spark):
    got = one(spark, WEIRD).select("x", T.squeeze("x").alias("s"), T.strip("x").alias("t"), T.lines("x").alias("l"), T.bare_lines("x").alias("b")).collect()
    for r in got:
        assert r.s == "".join(r.x.split()) and r.t == r.x.strip()
        assert r.l == r.x.splitlines(keepends=True) and r.b == r.x.splitlines()


def test_codeblocks_and_sections(spark):
    rows = ["none", "```\na\n```", "```py\na\nb\n  ```\n```\n```", "```\nopen", "x\n```\none\n```\ny\n```\ntwo"]
    want = [[], ["a\n"], ["a\nb\n", ""], [], ["one\n"]]
    assert [r.b for r in one(spark, rows).orderBy("i").select(T.codeblocks("x").alias("b")).collect()] == want
    text = ["[problem]\np\n[solution]\ns", "[solution]\n[problem]", "[problem] [solution]", "a [PROBLEM]\n\n[Solution]", "no"]
    got = [r.s and tuple(r.s) for r in one(spark, text).orderBy("i").select(T.sections("x", "[Problem]", "[Solution]").alias("s")).collect()]
    assert got == [("p", "s"), None, None, ("", ""), None]
    same = one(spark, ["```\n```"]).select(dedup.copies_problem("x", "x").alias("c")).first().c
    assert same


def test_docstrings(spark):
    rows = ["/** a\n * b */", "// x\n/// y", "**", "plain"]
    assert [r.c for r in one(spark, rows).orderBy("i").select(T.strip_comment("x").alias("c")).collect()] == ["a\nb", "x\ny", "*", "plain"]
    assert [r.c for r in one(spark, ["a\n\nb", "a@b", "a"]).orderBy("i").select(T.doc_summary("x").alias("c")).collect()] == ["a", "a", "a"]
    pairs = [r.p and tuple(r.p) for r in one(spark, ['f"""d"""r', "f'''d'''r", "none", '"""open']).orderBy("i").select(formatting.pair_python(F.col("x")).alias("p")).collect()]
    assert pairs == [('f"""d"""', "r"), ("f'''d'''", "r"), None, None]
    assert one(spark, [0.125], "double").select(T.fixed("x", 2).alias("f")).first().f == "0.12"


def greedy(rows):
    seen, out = [set(), set(), set()], {}
    for o, *keys in sorted(rows):
        why = next((r for k, s, r in zip(keys, seen, dedup.REASONS) if k in s), None)
        out[o] = why and f"duplicate {why}"
        if not why:
            for k, s in zip(keys, seen):
                s.add(k)
    return out


def test_greedy_dedup(spark):
    rng = random.Random(4)
    rows = [(i, f"s{rng.randint(0, 40)}", f"p{rng.randint(0, 60)}", f"x{rng.randint(0, 60)}") for i in range(150)]
    rows += [(900, "A", "B", "C"), (901, "A", "D", "E"), (902, "F", "D", "G")]
    df = spark.createDataFrame(rows, "o int, seed string, problem string, solution string")
    got = {r.o: r.reason for r in dedup.clean_three_keys(df, "o").collect()}
    assert got == greedy(rows)
    assert got[900] is None and got[901] and got[902] is None
    assert dedup.clean_three_keys(df.limit(0), "o").count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 7)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    root = {x: x for e in edges if None not in e for x in e}
    for _ in range(70):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_band_shape():
    assert [dedup.band_shape(t, n) for t, n in ((0.7, 256), (0.5, 256), (0.7, 128), (0.85, 256))] == [(25, 10), (42, 6), (14, 9), (13, 19)]
    assert dedup.permutations(2) == [(2297359619001564596, 1396682528897996046), (1973689801170867272, 1819927849474927636)]


def test_decontamination(spark, sf, monkeypatch):
    t = Q.Tables(spark, sf)
    pats = [(r.bench_ord, r.item_ord, r.benchmark, r.pattern) for r in Q._patterns(t).collect()]
    want = {}
    for r in t.documents.collect():
        hit = min((p for p in pats if p[3].lower() in r.text.lower()), default=None)
        if hit:
            want[r.doc_id] = hit[2:]
    for most in (64_000_000, 2000):
        monkeypatch.setattr(decontam, "PART_CHARS", most)
        assert {r[0]: (r[1], r[2]) for r in decontam.matches(t.documents, Q._patterns(t), "doc_id", ["text"]).collect()} == want and len(want) == 3
    df = spark.createDataFrame([(1, "AbC", "x"), (2, "zzz", "b")], "i int, a string, b string")
    p = spark.createDataFrame([(1, "q", 0, "bc"), (0, "r", 0, "B"), (2, "s", 0, "c\n\nX")], "bench_ord int, benchmark string, item_ord long, pattern string")
    assert {tuple(r) for r in decontam.matches(df, p, "i", ["a", "b"]).collect()} == {(1, "r", "B"), (2, "r", "B")}


def test_samples(spark):
    df = spark.range(20).withColumnRenamed("id", "i")
    assert sampling.sample(df, "i", 20, 1).count() == 20
    with pytest.raises(ValueError):
        sampling.sample(df, "i", 21, 1)
    assert [r["index"] for r in sampling.row_index(df, ["i"]).orderBy("i").collect()] == list(range(20))
    docs = one(spark, ["", "a\nb\nc\n", "x"])
    got = {r.raw_index: r.seed for r in sampling.seed_snippets(docs, "i", "x").collect()}
    assert set(got) == {1, 2} and got[1] in "a\nb\nc\n" and got[2] == "x"


def test_token_arrays(spark):
    df = spark.createDataFrame([(1, "ab", "cd"), (1, "abcdef", "g")], "k int, p string, c string")
    ex = sft.examples(df, sft.marked(sft.code_points(F.col("p")), bos=1), sft.marked(sft.code_points(F.col("c")), eos=2), 6)
    a, b = ex.orderBy("p").collect()
    assert a.input_ids == [1, 97, 98, 99, 100, 2] and a.labels == [-100] * 3 + [99, 100, 2] and not a.exceeding_length
    assert b.labels == [-100] * 6 and b.exceeding_length
    c = sft.collate(ex, "k", 2, to=8).orderBy("p").first()
    assert c.attention_mask == [1, 1, 1, 1, 1, 0, 0, 0]
    with pytest.raises(Exception):
        sft.collate(ex, "k", 0, to=3).collect()


def test_mining(spark):
    assert tuple(one(spark, ["a\nb\nc\n"]).select(mining.locate_lines(F.col("x"), F.lit("b\nc\n")).alias("l")).first().l) == (2, 3)
    spark.udtf.register("fns", mining.PythonFunctions)
    rows = spark.sql("SELECT * FROM fns('def f():\n    \"doc\"\n    return 1\n')").collect()
    assert [(r.name, r.docstring, r.start_line, r.end_line) for r in rows] == [("f", "doc", 1, 3)]


def test_generation(spark, tmp_path):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "index long, prompt string")
    client = lambda p, s: ("stop" if s % 2 == 0 else "length", f"[Problem]\n{p}\n[Solution]\nx")
    answers = jobs.parse_answers(jobs.generate(prompts, client), "[problem]", "[solution]")
    assert sorted(r.problem for r in answers.collect()) == ["p0", "p2", "p4"]
    assert jobs.pending(prompts, answers.select("index")).count() == 3
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert jobs.retry(flaky, (OSError,), sleep=waits.append) == "ok" and len(waits) == 2 and waits[1] >= 2 * waits[0]
    prompts.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("index long, prompt string").json(str(tmp_path / "in"))
    jobs.append_once(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 6


def test_catalog():
    assert len(Q.QUERIES) >= 80 and set(Q.SQL) <= set(Q.QUERIES)
    assert not [k for k, s in Q.SQL.items() if re.search(r"\bTABLESAMPLE\b", s)]


def test_scratch_tables(spark):
    from weft.plans import scratch

    path = scratch.table_path(spark, "t")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    scratch.drop_table(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_kmeans_ends_at_a_fixed_point(spark):
    from weft.operators import similarity

    rng = random.Random(3)
    rows = [(i, [rng.gauss(10 * (i % 3), 1.0), rng.gauss(-10 * (i % 3), 1.0)]) for i in range(90)]
    got = {r.id: r.label for r in similarity.kmeans(spark.createDataFrame(rows, "i int, v array<double>"), "i", "v", 3).collect()}
    assert len(got) == 90 and set(got.values()) == {0, 1, 2}
    mean = {c: [sum(v[d] for i, v in rows if got[i] == c) / sum(x == c for x in got.values()) for d in (0, 1)] for c in (0, 1, 2)}
    for i, v in rows:
        assert got[i] == min(mean, key=lambda c: sum((a - b) ** 2 for a, b in zip(v, mean[c])))


def test_nearest_text(spark):
    import math
    from collections import Counter

    from weft.operators import similarity

    docs = [(1, "red green blue"), (2, "Red red fish"), (3, "nothing shared"), (4, None), (5, ""), (6, "green fish")]
    asked = [(7, "red fish"), (8, "green"), (9, "fish red")]
    words = lambda t: re.findall(r"\w\w+", (t or "").lower())
    df = Counter(w for _, t in docs + asked for w in set(words(t)))
    n = len(docs) + len(asked)

    def weigh(t):
        w = {x: c * (math.log((1 + n) / (1 + df[x])) + 1) for x, c in Counter(words(t)).items()}
        size = math.sqrt(sum(v * v for v in w.values())) or 1.0
        return {x: v / size for x, v in w.items()}

    want = {}
    for i, t in docs:
        scores = [(round(sum(v * weigh(q).get(x, 0) for x, v in weigh(t).items()), 6), -k) for k, q in asked]
        top = max(scores)
        want[i] = (-top[1], top[0]) if top[0] > 0 else (None, 0.0)
    a = spark.createDataFrame(docs, "i long, t string")
    b = spark.createDataFrame([(k, q) for k, q in asked], "k long, t string")
    assert {r.id: (r.nearest, r.score) for r in similarity.nearest_text(a, b, "i", "t", "k").collect()} == want
    assert {(r.nearest, r.score) for r in similarity.nearest_text(a, b.limit(0), "i", "t", "k").collect()} == {(None, 0.0)}


def test_docstring_that_ends_in_a_quote(spark):
    said = ["plain", "he said \"so\"", "it's 'so'", "\"", "", "\"both\""]
    prompts = [f'def f():\n    """{x}"""' for x in said] + [f"def f():\n  '''{x}'''\n" for x in said] + [f'def g():\n """{x}"""\ndef f():\n """{x}"""\n' for x in said]
    got = [r.d for r in one(spark, prompts).orderBy("i").select(benchmarks.quoted_docstring(F.col("x")).alias("d")).collect()]
    assert got == said * 3
    for bad in ('"""a"""b"""', '"""open', "none", "'''a''' '''b'''", '"""a""" """b""" """c"""'):
        with pytest.raises(Exception, match="docstring"):
            one(spark, [bad]).select(benchmarks.quoted_docstring(F.col("x"))).collect()


def calls(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(f"{name}(")


def test_code_blocks_need_no_search_for_blanks_at_ends(spark, sf):
    """A regular expression for blanks at either end looks at every character of every line."""
    assert calls(Q.QUERIES["codeblock_copy"](spark, sf), "regexp_replace") == 2
    odd = ["\u2003\u3000a \u00a0b\x85", "\u0085", "\u200b x \u200b", "\x1f\x1cé\u2028", "tail\u2029\r\n", "\u180e\U0001f600 \n"]
    for r in one(spark, odd).select("x", T.squeeze("x").alias("s"), T.strip("x").alias("t"), T.lines("x").alias("l"), T.bare_lines("x").alias("b")).collect():
        assert (r.s, r.t, r.l, r.b) == ("".join(r.x.split()), r.x.strip(), r.x.splitlines(keepends=True), r.x.splitlines())


def test_pairs_cut_each_text_into_lines_once(spark, sf):
    assert calls(Q.QUERIES["pair_generic"](spark, sf), "regexp_extract_all") == 2
    assert calls(Q.QUERIES["pair_generic"](spark, sf), "regexp_replace") == 0


def test_comments_need_no_regular_expression(spark, sf):
    assert calls(Q.QUERIES["strip_comment"](spark, sf), "regexp_replace") == 0
    rows = ["*/", "/*/", "/** */", "a */ ", "a*/*/", "///", "* * x", "", "\u3000/* x\u3000*/"]
    assert [r.c for r in one(spark, rows).orderBy("i").select(T.strip_comment("x").alias("c")).collect()] == ["", "/", "", "a", "a*/", "", "* x", "", "x"]


def test_seed_snippets_cut_lines_once(spark, sf):
    assert calls(Q.QUERIES["seed_snippet"](spark, sf), "regexp_extract_all") == 1
    got = sampling.seed_snippets(one(spark, ["", None, "\n", "a"]), "i", "x").collect()
    assert {tuple(r) for r in got} == {(2, "\n"), (3, "a")}


def test_sha1_and_permutations_abreast():
    rng = random.Random(2)
    parts = [bytes(rng.choices(range(33, 127), k=n)) for n in [0, 1, 30, 54, 55, 56, 57, 63, 64, 65, 119, 120, 300, *range(2, 50)]]
    stop = np.cumsum([len(x) for x in parts])
    got = dedup._hashes(b"".join(parts), stop - [len(x) for x in parts], stop)
    assert got.tolist() == [int.from_bytes(hashlib.sha1(x).digest()[:4], "little") for x in parts]
    ab = dedup.permutations(16)
    sign = dedup._signer(16)
    # hashes whose products end just below, at and above a multiple of the prime, and at the ends of 32 bits
    edge = [(r + k * dedup.PRIME - b) * pow(a, -1, 2**64) % 2**64 for a, b in ab if a % 2 for r in (-9, -8, -2, -1, 0, 1, 6, 7, 8, 2**32 - 2, 2**32 - 1) for k in (1, 5)]
    for v in [[], [0], [2**32 - 1], *([x] for x in edge), *(rng.choices(edge, k=3) for _ in range(50)), [rng.getrandbits(32) for _ in range(700)]]:
        want = [min([(x * a + b) % 2**64 % dedup.PRIME % 2**32 for x in v], default=2**32 - 1) for a, b in ab]
        assert sign(np.array(v, np.uint64)).tolist() == want


def test_signatures_of_odd_texts(spark):
    """Characters beyond ASCII, shingles over one block, missing and short texts; a batch over one slice."""
    signed = dedup.minhash(one(spark, ["a b c d e f g h i j k"] * 1000).coalesce(1), "i", "x", n_perm=2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert signed.count() == 1000 and dedup._TEXTS <= 128
    words = dedup.minhash(one(spark, ["é" * 9 + "a", "x" * 70 + " b c d e f g h i j", None, "a b"]), "i", "x", n_perm=2).orderBy("id").collect()
    ab = dedup.permutations(2)
    for r, x in zip(words, ["é" * 9 + "a", "x" * 70 + " b c d e f g h i j", "", "a b"]):
        w = re.split("[^A-Za-z_0-9]", x)
        h = [int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "little") for g in {" ".join(w[k : k + 5]) for k in range(len(w) - 4)}] if len(w) >= 10 else []
        assert r.signature == [min([(v * a + b) % 2**64 % dedup.PRIME % 2**32 for v in h], default=2**32 - 1) for a, b in ab]


def test_tfidf_counts_terms_once(spark):
    docs = one(spark, ["Ab ab a É é_1 ÉÉ Ⅷx ٣٤ 中文 x", "ab cd", None, ""])
    own = similarity.tfidf(docs, "i", "x")
    assert calls(own, "regexp_extract_all") == 0  # texts are cut into terms before, and their counts kept
    assert {r.term for r in own.where("id = 0").collect()} == {"ab", "é_1", "éé", "ⅷx", "٣٤", "中文"}
    assert all(abs(r.n - 1) < 1e-9 for r in own.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect())
