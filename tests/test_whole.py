"""Queries over the whole of their input, against plain Python on fixtures of their own."""

import hashlib
import random
import re

import pytest

from weft import queries as Q
from weft.operators import dedup


@pytest.fixture
def run(spark, tmp_path):
    """Runs a query over tables of the given rows."""

    def go(name, **tables):
        for k, (rows, kinds) in tables.items():
            spark.createDataFrame(rows, kinds).write.mode("overwrite").parquet(f"{tmp_path}/{k}.parquet")
        return Q.QUERIES[name](spark, str(tmp_path)).collect()

    return go


def signature(text, ab):
    words = re.split("[^A-Za-z_0-9]", text)
    own = {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 10 else ()
    h = [int.from_bytes(hashlib.sha1(x.encode()).digest()[:4], "little") for x in own]
    return [min([(x * a + b) % 2**64 % (2**61 - 1) % 2**32 for x in h], default=2**32 - 1) for a, b in ab]


def test_minhash_queries(run):
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    texts = []
    for _ in range(14):  # pairs that share about 3 in 10 shingles
        a = [word() for _ in range(60)]
        texts += [a, a[:31] + [word() for _ in range(29)]]
    for _ in range(4):  # near copies
        a = [word() for _ in range(80)]
        texts += [a, [*a, word()]]
    texts = [" ".join(x) for x in texts] + ["short", "too"]
    docs = ([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    ab = dedup.permutations(256)
    signed = [signature(x, ab) for x in texts]
    assert {r.id: r.signature for r in run("minhash_signature", documents=docs)} == {i: ",".join(map(str, s)) for i, s in enumerate(signed)}
    least, edges, label = {}, set(), {i: i for i in range(len(texts))}
    for i, s in enumerate(signed):
        for k in range(25):
            b = least.setdefault((k, *s[10 * k : 10 * k + 10]), i)
            edges |= {(i, b)} if b != i else set()
    for _ in texts:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {tuple(r) for r in run("minhash_edges", documents=docs)} == edges
    assert {r.id: r.cluster for r in run("minhash_clusters", documents=docs)} == label
    keep = {i for i, c in label.items() if i == c}
    assert {r.doc_id for r in run("minhash_keep", documents=docs)} == keep and keep >= set(range(28))
    assert {29, 31, 33, 35, 37}.isdisjoint(keep)
    assert [tuple(r)[:3] for r in run("dedup_report", documents=docs)] == [(len(texts), len(keep), len(texts) - len(keep))]


def test_greedy_takes_whole_texts(run):
    head, tail = "h" * 50, "t" * 50
    rows = [(1, head + "a" * 60 + tail), (2, head + "b" * 90 + "c" * 80 + tail), (3, "one\nx y z"), (4, "one\nother words here"), (5, "p"), (6, "q"), (7, "one\nx  y z"), (8, "same half" + "other one"), (9, "same half" + "third one")]
    got = {r.doc_id: r.reason for r in run("clean_greedy3", documents=(rows, "doc_id long, text string"))}
    seen, want = [set(), set(), set()], {}
    for i, x in sorted(rows, key=lambda r: hashlib.md5(f"666:{r[0]}".encode()).hexdigest()):
        n = (len(x) + 1) // 2
        keys = ["".join(k.split()) or "".join(x.split()) for k in (x, x[:n], x[n:])]
        want[i] = next((f"duplicate {r}" for k, s, r in zip(keys, seen, dedup.REASONS) if k in s), None)
        if not want[i]:
            for k, s in zip(keys, seen):
                s.add(k)
    assert got == want and sum(map(bool, got.values())) == 2


def test_formats_hold_whole_texts(run):
    rows = [(i, "".join(random.Random(i).choices("abc \né", k=n)), "s") for i, n in enumerate([0, 1, 2, 501, 500, 3000])]
    docs = (rows, "doc_id long, text string, source string")
    turns = ([(1, 0, "user", "u"), (1, 1, "assistant", "a")], "conv_id long, turn int, role string, text string")
    cut = {i: (x[: (len(x) + 1) // 2], x[(len(x) + 1) // 2 :]) for i, x, _ in rows}
    assert {r.doc_id: (r.instruction, r.response) for r in run("fmt_evol", documents=docs)} == cut
    assert {(r.instruction, r.response) for r in run("combine_union", documents=docs, conversations=turns)} == {*cut.values(), ("u", "a")}
    for r in run("fmt_instruct", documents=docs):
        assert r.instruction.endswith(cut[r.doc_id][0]) and r.response == cut[r.doc_id][1]
    for name, col in (("fmt_chat_prompt", "prompt"), ("embed_text_mode", "text"), ("fim_prompt", "star"), ("fim_prompt", "llama"), ("fim_prompt", "hole")):
        for r in run(name, documents=docs):
            a, b = cut[r.doc_id]
            assert a in r[col] and b in r[col][r[col].index(a) + len(a) :]
    for r in run("fmt_with_input", documents=docs):
        a, b = cut[r.doc_id]
        assert r.instruction == (a + b if r.doc_id % 3 == 0 or not b.strip() else f"{a}\nInput: {b}")


def test_examples_of_the_reference_length(run):
    rows = [(c, k, role, x) for c, n in enumerate([5, 800, 1213, 1214, 4000]) for k, (role, x) in enumerate([("user", "u"), ("assistant", "v" * n)])]
    turns = (rows, "conv_id long, turn int, role string, text string")
    want = {c: ([1, 117] + [118] * n + [2])[:1216] for c, n in enumerate([5, 800, 1213, 1214, 4000])}
    got = run("sft_examples", conversations=turns)
    assert {r.conv_id: r.input_ids for r in got} == {c: ",".join(map(str, x)) for c, x in want.items()}
    assert {r.conv_id for r in got if r.exceeding_length} == {3, 4}
    assert [tuple(r) for r in run("truncation_rate", conversations=turns)] == [(2, 5)]
    assert {r.conv_id: r.input_ids.count(",") + 1 for r in run("pad_batch", conversations=turns)} == {c: len(x) for c, x in want.items()}
    assert {r.conv_id: r.attention_mask.count("1") for r in run("collate_mask", conversations=turns)} == {c: len(x) for c, x in want.items()}


def test_every_document_is_a_seed(run):
    rows = [(i, x, "en", f"s{i}") for i, x in enumerate(["a\nb\nc", "", "no line break", "x\n" * 40, "tiny"])]
    got = run("seed_lookup", documents=(rows, "doc_id long, text string, lang string, source string"))
    assert {tuple(r) for r in got} == {(i, s, lang) for i, _, lang, s in rows} and len(got) == 5


def test_markers_hold_whole_texts(run):
    base = ["w%d " % i * (40 * i + 1) + "end%d" % i for i in range(12)]
    docs = ([(i, x) for i, x in enumerate(base)], "doc_id long, text string")
    half = lambda x: (x[: -(-len(x) // 2)].strip(), x[-(-len(x) // 2) :].strip())
    third = lambda x: [x[-(-len(x) * k // 3) : -(-len(x) * (k + 1) // 3)] for k in range(3)]
    want = {i: half(x) if i % 4 == 0 else ("", "") if i % 4 == 2 else (None, None) for i, x in enumerate(base)}
    assert {r.doc_id: (r.problem, r.solution) for r in run("parse_sections", documents=docs)} == want
    assert {r.doc_id for r in run("parse_valid", documents=docs)} == {0, 4, 8}
    tail = {i: [third(x)[2] + "\n"] if i % 2 == 0 else [] for i, x in enumerate(base)}
    assert {r.doc_id: (r.blocks, r.n) for r in run("codeblocks", documents=docs)} == {i: ("|".join([third(x)[1] + "\n", *tail[i]]), 1 + len(tail[i])) for i, x in enumerate(base)}
    assert {r.doc_id: r.completion for r in run("truncate_fence", documents=docs)} == {i: third(x)[0] + "\n  " for i, x in enumerate(base)}
    assert {r.doc_id: r.comment for r in run("strip_comment", documents=docs)} == {i: f"{x}\nsecond\nthird\nfourth" for i, x in enumerate(base)}
    assert {r.doc_id: r.summary for r in run("doc_summary", documents=docs)} == dict(enumerate(base))
    got = {r.doc_id: r.prompt for r in run("pair_python", documents=docs)}
    assert set(got) == {i for i in range(12) if i % 3 < 2} and all(base[i] in p for i, p in got.items())
    fenced = ([(i, "x\n```\nshared\n```\n") for i in range(1, 3)] + [(5, "y"), (6, "y")], "doc_id long, text string")
    assert {r.doc_id: r.copied for r in run("codeblock_copy", documents=fenced)} == {1: True, 2: True, 5: True, 6: False}
