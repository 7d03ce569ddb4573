"""n-gram Jaccard self-join by vertical partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._text import NOT_ALNUM, col, content, fresh, grams, hashes, mix, rows_of, slices, trim, within, words
from weft.plans.graph import components
from weft.plans.scratch import cut, drop_table, table_path

N, THRESHOLD = 3, 0.6
BITS = 56
#: Fragments of the n-gram order in which overlaps are counted.
PARTS = 3
#: Bytes of text for a fragment of the first passes, n-grams that a flush packs, n-grams and documents in a block of a component.
CHARS, FLUSH, SEGMENT, BLOCK = 10_000_000, 1 << 20, 1 << 21, 20000


def document_grams(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct word n-grams of each row, sorted by row.

    Words are runs of ASCII letters and digits and of longer characters,
    ASCII in lower case. A text of fewer than n words has one n-gram, all of
    it; a text without words has none.
    """
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    begin, end, first = words(low, off, NOT_ALNUM)
    h = hashes(low, begin, end)
    ok = within(first, n)
    row, g = rows_of(first)[: len(ok)][ok], grams(h, n)[ok]
    count = np.diff(first)
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            row = np.concatenate([row, short])
            g = np.concatenate([g, grams(h, k)[first[short]] + np.uint64(k)])
    g >>= np.uint64(64 - BITS)
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
    return row[new], g[new]


def _zip(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).view(np.uint8), codec="zstd", asbytes=True) if a.nbytes else b""


def _unzip(raw: bytes, kind: type, n: int) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(raw, size, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def _pack40(sorted_values: np.ndarray) -> tuple[bytes, int]:
    """Steps between sorted numbers in 5 bytes each, or 8 where one is larger; and that width."""
    step = np.diff(sorted_values, prepend=np.uint64(0))
    first, step[0] = step[0], 0
    width = 5 if not len(step) or int(step.max()) < 1 << 40 else 8
    return np.uint64(first).tobytes() + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), width


def _unpack40(raw: bytes, width: int) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8, offset=8).reshape(-1, width)
    wide = np.zeros((len(part), 8), np.uint8)
    wide[:, :width] = part
    out = wide.view(np.uint64).ravel()
    out[0] = np.frombuffer(raw, np.uint64, 1)[0]
    return np.cumsum(out, dtype=np.uint64)


def _cut_up(docs: DataFrame, n: int, fragments: int) -> DataFrame:
    """First pass: every document's n-grams, packed by fragment of the global order."""

    def flush(ids: list, rows: list, values: list) -> pa.RecordBatch:
        i, r, g = np.concatenate(ids), np.concatenate(rows), np.concatenate(values)
        size = np.bincount(r, minlength=len(i)).astype(np.int32)
        order = np.argsort(g, kind="stable")
        r, g = r[order], g[order]
        edge = [(f << BITS) // fragments for f in range(fragments)]
        at = [*np.searchsorted(g, np.array(edge, np.uint64)), len(g)]
        out: list[list] = [[] for _ in range(7)]
        for f in range(fragments):
            lo, hi = int(at[f]), int(at[f + 1])
            if lo == hi:
                continue
            own, local = np.unique(r[lo:hi], return_inverse=True)
            raw, width = _pack40(g[lo:hi])
            for c, x in zip(out, (f, len(own), _zip(np.diff(i[own], prepend=np.int64(0))), _zip(size[own]), raw, width, local.astype(np.uint16).tobytes())):
                c.append(x)
        return pa.record_batch([pa.array(c, pa.int32() if k in (0, 1, 5) else pa.binary()) for k, c in enumerate(out)], names=["frag", "z", "ids", "sizes", "grams", "width", "local"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        values: list[np.ndarray] = []
        held = have = 0
        for part in slices(batches, "t", 1 << 21):
            for lo in range(0, part.num_rows, 16384):
                some = part.slice(lo, 16384)
                r, g = document_grams(*content(some.column("t")), n)
                if have + some.num_rows > 60000:
                    if held:
                        yield flush(ids, rows, values)
                    ids, rows, values, held, have = [], [], [], 0, 0
                ids.append(some.column("i").to_numpy())
                rows.append(r + have)
                values.append(g)
                held, have = held + len(g), have + some.num_rows
                if held >= FLUSH:
                    yield flush(ids, rows, values)
                    ids, rows, values, held, have = [], [], [], 0, 0
        if held:
            yield flush(ids, rows, values)
        trim()

    return docs.mapInArrow(run, "frag int, z int, ids binary, sizes binary, grams binary, width int, local binary")


def _frequencies(table: pa.Table) -> pa.Table:
    """Second pass, a fragment at a time: document frequencies. n-grams of one document go; a row for each other (document, n-gram)."""
    ids, sizes, vals, docs, base = [], [], [], [], 0
    for z, a, b, g, w, x in zip(*(table[c].to_pylist() for c in ("z", "ids", "sizes", "grams", "width", "local"))):
        ids.append(np.cumsum(_unzip(a, np.int64, z)))
        sizes.append(_unzip(b, np.int32, z))
        vals.append(_unpack40(g, w))
        docs.append(np.frombuffer(x, np.uint16).astype(np.int32) + base)
        base += z
    del table
    each, which = np.unique(np.concatenate(ids), return_inverse=True)
    size = np.zeros(len(each), np.int32)
    np.maximum.at(size, which, np.concatenate(sizes))
    g, d = np.concatenate(vals), which[np.concatenate(docs)].astype(np.int32)
    del vals, docs
    order = np.argsort(g, kind="stable")
    g, d = g[order], d[order]
    if len(each) < base:  # rows that share an id
        order = np.lexsort((d, g))
        g, d = g[order], d[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        g, d = g[new], d[new]
    head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    df = np.repeat(np.diff(np.append(head, len(g))), np.diff(np.append(head, len(g)))).astype(np.int32)
    keep = np.flatnonzero(df > 1)
    keep = keep[np.argsort(d[keep], kind="stable")]  # a document's rows stand together, which packs well
    d = d[keep]
    out = pa.table([pa.array(each[d]), pa.array(size[d]), pa.array(g[keep].view(np.int64)), pa.array(df[keep])], names=["id", "n", "k", "df"])
    trim()
    return out


def _need(n: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t * n - 1e-9).astype(np.int64)


def _select(t: float):
    """Third pass, all rows of some documents at a time: those that can have a partner, their prefix, and their shared n-grams by fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        del got
        each, first, d = np.unique(table["id"].to_numpy(), return_index=True, return_inverse=True)
        size = table["n"].to_numpy()[first].astype(np.int64)
        key, df = table["k"].to_numpy().view(np.uint64), table["df"].to_numpy()
        del table
        shared = np.bincount(d, minlength=len(each))
        can = shared >= _need(size, t)  # an overlap of t times the size is the least for any partner
        ok = can[d]
        d, key, df = d[ok], key[ok], df[ok]
        by = np.lexsort((key, df, d))  # rarest first
        rare = key[by]
        order = np.lexsort((key, d))
        key = key[order]
        at = np.searchsorted(d[order], np.arange(len(each) + 1))
        spread = mix(key + np.uint64(1))
        edge = np.array([(p << BITS) // PARTS for p in range(1, PARTS)], np.uint64)
        schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("m", pa.list_(pa.int32())), ("same", pa.int64()), ("prefix", pa.list_(pa.int64())), ("grams", pa.list_(pa.binary()))])
        rows: list[list] = [[] for _ in range(6)]
        for x in np.flatnonzero(can):
            lo, hi = at[x], at[x + 1]
            whole = shared[x] == size[x]  # no n-gram of its own: may equal another document
            parts = np.split(key[lo:hi], np.searchsorted(key[lo:hi], edge))
            prefix = rare[lo : lo + shared[x] - _need(size[x : x + 1], t)[0] + 1]
            for c, v in zip(rows, (each[x], size[x], [len(p) for p in parts], int(spread[lo:hi].sum().view(np.int64)) if whole else None, prefix.view(np.int64), [_zip(np.diff(p, prepend=np.uint64(0))) for p in parts])):
                c.append(v)
            if len(rows[0]) >= 2000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
                rows = [[] for _ in range(6)]
        if rows[0]:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
        trim()

    return run


def _spread(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the ranges start[i]..stop[i], end to end."""
    size = stop - start
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - size), size)


def _count(t: float):
    """Fourth pass, one fragment of one block: partial overlaps of the pairs that share a prefix n-gram.

    A pair goes on where the rest of its n-grams, all of them in common,
    would bring it to the threshold.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, size, side = table["id"].to_numpy(), table["n"].to_numpy().astype(np.int64), table["side"].to_numpy()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        here, rest = table["m"].to_numpy().astype(np.int64), table["rest"].to_numpy().astype(np.int64)
        at = np.concatenate([[0], np.cumsum(here)])
        _, gram = np.unique(np.concatenate([np.cumsum(_unzip(g, np.uint64, m), dtype=np.uint64) for g, m in zip(table["grams"].to_pylist(), here.tolist())]), return_inverse=True)
        gram = gram.astype(np.int32)
        first = table["prefix"].combine_chunks()
        first = first if isinstance(first, pa.Array) else first.chunk(0)
        of = np.repeat(np.arange(len(ids)), np.diff(first.offsets.to_numpy()))
        key = first.flatten().to_numpy()
        del table, first
        order = np.argsort(key, kind="stable")  # postings by row
        post, key = of[order], key[order]
        stop = np.searchsorted(key, key, "right")
        by_row = np.argsort(post, kind="stable")
        row_at = np.searchsorted(post[by_row], np.arange(len(ids) + 1))
        mark, seen = np.zeros(int(gram.max()) + 1 if len(gram) else 1, bool), np.zeros(len(ids), bool)
        out: list[list] = [[] for _ in range(3)]
        for r in range(len(ids)):
            if not here[r]:
                continue
            where = by_row[row_at[r] : row_at[r + 1]]
            for some in np.array_split(where, max(1, int((stop[where] - where).sum()) >> 20)):
                seen[post[_spread(some + 1, stop[some])]] = True
            c = np.flatnonzero(seen[r + 1 :]) + r + 1
            if not len(c):
                continue
            seen[c] = False
            c = c[(np.minimum(size[c], size[r]) >= t * np.maximum(size[c], size[r]) - 1e-9) & ((i == j) | (side[c] != side[r]))]
            if not len(c):
                continue
            mark[gram[at[r] : at[r + 1]]] = True
            for some in np.array_split(c, max(1, int(here[c].sum()) >> 20)):
                hit = np.concatenate([[0], np.cumsum(mark[gram[_spread(at[some], at[some + 1])]])])
                end = np.cumsum(here[some])
                o = hit[end] - hit[end - here[some]]
                best = o + np.minimum(rest[some], rest[r])
                good = (o > 0) & (best >= t * (size[some] + size[r] - best) - 1e-9)
                for x, v in zip(out, (np.full(int(good.sum()), r), some[good], o[good])):
                    x.append(v)
            mark[gram[at[r] : at[r + 1]]] = False
        p, q, o = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out)
        trim()
        return pa.table([pa.array(c, pa.int64()) for c in (ids[p], ids[q], size[p], size[q], o)], names=["a", "b", "na", "nb", "o"])

    return run


def jaccard_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Pairs of different texts whose sets of word n-grams have a Jaccard similarity of ``threshold`` at least, and membership.

    1. The global order of n-gram hashes is cut into fragments, in number
       with the corpus; each fragment counts document frequencies, and
       n-grams of one document alone go no further.
    2. A document can have a partner only if it shares ``threshold`` of its
       n-grams with any others; the rest are dropped. Documents with equal
       sets are a class, and the least id stands for it from here on.
    3. Two documents that reach the threshold have an n-gram in common among
       the rarest ones of both (prefix filter over the order by frequency),
       so they fall into one connected component of shared prefix n-grams. A
       component is one task's work, of over BLOCK documents or SEGMENT
       n-grams it is dealt into blocks, every two blocks together.
    4. The order is cut into PARTS fragments. In each fragment of each block
       the partial overlaps of pairs that share a prefix n-gram are counted
       on their own; a pair goes on where it could reach the threshold if
       all its other n-grams were in common. The partial overlaps are summed
       a pair.
    Up to collisions of 56-bit hashes the result is exact.

    Returns (pairs, members): pairs (a, b, overlap, n_a, n_b, jaccard) of
    class representatives, a < b; members (id, rep, n_copies) of every
    document in a class of at least two. Rows with a null id, and texts that
    are null or without words, are in neither. Ids are integers.
    """
    spark = docs.sparkSession
    own = docs.where(col(id_col).isNotNull() & col(text_col).isNotNull()).select(col(id_col).cast("bigint").alias("i"), col(text_col).cast("string").alias("t"))
    chars = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    fragments = max(12, -(-chars // CHARS))
    packed = _cut_up(own, n, fragments).repartition(fragments, "frag")
    shared = packed.groupBy("frag").applyInArrow(_frequencies, "id bigint, n int, k bigint, df int")
    chosen = shared.repartition(fragments, "id").mapInArrow(_select(threshold), "id bigint, n int, m array<int>, same bigint, prefix array<bigint>, grams array<binary>")
    path = table_path(spark, "jaccard")
    chosen.write.parquet(path)
    chosen = spark.read.parquet(path)
    classes = cut(chosen.where("same is not null").groupBy("n", "same").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies")).where("n_copies > 1"))
    members = cut(chosen.where("same is not null").select("id", "n", "same").join(classes, ["n", "same"]).select("id", "rep", "n_copies"))
    prefix = chosen.select("id", "prefix").join(members.where("id <> rep").select("id"), "id", "left_anti").select("id", F.explode("prefix").alias("k"))
    low = prefix.groupBy("k").agg(F.min("id").alias("low"), F.count("*").alias("c")).where("c > 1").drop("c")
    edges = prefix.join(low, "k").where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
    label = cut(components(edges))
    weight = F.aggregate("m", F.lit(0), lambda x, y: x + y)
    sized = label.join(label.join(chosen.select("id", weight.alias("w")), "id").groupBy("label").agg(F.count("*").alias("s"), F.sum("w").alias("w")), "label")
    blocks = F.greatest(F.ceil(F.col("s") / BLOCK), F.ceil(F.col("w") / SEGMENT)).cast("int")
    placed = chosen.select("id", "n", "m", "prefix", "grams").join(sized, "id").withColumn("d", blocks).withColumn("side", F.pmod(F.xxhash64("id"), F.col("d")).cast("int"))
    dealt = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("d") - 1))).withColumns({"i": F.least("side", "k"), "j": F.greatest("side", "k"), "large": F.col("d") > 1})
    units = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).withColumn("g", F.when(F.col("large"), F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(fragments))))
    here = F.element_at("m", F.col("part") + 1)
    partial = units.select("large", "g", "i", "j", "part", "id", "n", here.alias("m"), (weight - here).alias("rest"), "side", "prefix", F.element_at("grams", F.col("part") + 1).alias("grams")).groupBy("large", "g", "i", "j", "part").applyInArrow(_count(threshold), "a bigint, b bigint, na bigint, nb bigint, o bigint")
    pairs = partial.groupBy("a", "b").agg(F.max("na").alias("n_a"), F.max("nb").alias("n_b"), F.sum("o").alias("overlap")).withColumn("jaccard", F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap"))).where(F.col("jaccard") >= threshold - 1e-12)
    pairs = cut(pairs.select("a", "b", "overlap", "n_a", "n_b", "jaccard"))
    drop_table(spark, path)
    return pairs, members


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Similarity self-join, a row for each document that has a partner.

    Result: (id_col, class_id, copy_of, n_copies, n_texts, n_links, nearest):
    class_id is the least id of all documents that links connect with this
    one, copy_of the least id with an equal set of n-grams (its own where
    there is none less), n_copies how many documents have that set, n_texts
    how many different sets reach the threshold with it, n_links how many
    other documents do, copies counted each, and nearest the highest Jaccard
    similarity to a different set, null where there is none. Links between
    different texts one by one are those of jaccard_pairs().

    A document without a partner has no row, nor has one with a null id, a
    null text or a text without words. A text of fewer than n words is one
    n-gram; the longest texts are taken whole. Rows that repeat an id are
    taken for repeats of one row. Ties don't arise: ids are integers, and
    the least one stands for equal texts. An empty table gives an empty one.
    Other columns don't matter, whatever they are called.
    """
    pairs, members = jaccard_pairs(docs, id_col=id_col, text_col=text_col, n=n, threshold=threshold)
    classes = members.where("id = rep").select("rep", "n_copies")
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other"), "jaccard").union(pairs.select("b", "a", "jaccard"))
    linked = both.join(classes.select(F.col("rep").alias("other"), F.col("n_copies").alias("c")), "other", "left").groupBy("rep").agg(F.count("*").alias("n_texts"), F.sum(F.coalesce("c", F.lit(1))).alias("links"), F.max("jaccard").alias("nearest"))
    label = components(pairs.select("a", "b")).select(F.col("id").alias("rep"), "label")
    texts = classes.join(linked, "rep", "full").join(label, "rep", "left")
    texts = cut(texts.select("rep", F.coalesce("label", "rep").alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("links", F.lit(0)).alias("links"), "nearest"))
    row = lambda i: [i.alias(id_col), F.col("class_id"), F.col("rep").alias("copy_of"), F.col("n_copies"), F.col("n_texts"), (F.col("links") + F.col("n_copies") - 1).alias("n_links"), F.col("nearest")]
    alone = texts.where("n_copies = 1").select(*row(F.col("rep")))
    return alone.unionByName(members.select("id", "rep").join(texts.where("n_copies > 1"), "rep").select(*row(F.col("id"))))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document, the one with the least id, of each class that jaccard_join() connects.

    Rows that have no partner stay, null ids and empty texts among them; of
    rows that repeat an id all stay or all go. All columns stay as they are.
    """
    found = jaccard_join(docs, id_col=id_col, text_col=text_col, n=n, threshold=threshold)
    (name,) = fresh(docs, "_weft_gone")
    gone = found.where(col(id_col) != F.col("class_id")).select(col(id_col).alias(name))
    return docs.join(gone, col(id_col) == col(name), "left_anti")


#: Word n-grams as DuckDB has them; links, classes by the least label that links carry, and a row for each linked document.
SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM documents WHERE text IS NOT NULL
), g AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {N - 2}), lambda k: array_to_string(w[k:k + {N - 1}], ' ')) END) AS g
  FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS MATERIALIZED (
  SELECT a, b, o / (x.n + y.n - o) AS j FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE o / (x.n + y.n - o) >= {THRESHOLD} - 1e-12
), walk(id, label) AS (
  SELECT DISTINCT a, a FROM p
  UNION
  SELECT p.b, walk.label FROM walk JOIN p ON p.a = walk.id
), class AS (SELECT id, min(label) AS class_id FROM walk GROUP BY id),
eq AS (SELECT a AS id, least(a, min(b)) AS copy_of, count(*) + 1 AS n_copies FROM p WHERE j = 1 GROUP BY a),
rep AS (SELECT id, coalesce(copy_of, id) AS copy_of, coalesce(n_copies, 1) AS n_copies, class_id FROM class LEFT JOIN eq USING (id))
SELECT r.id AS doc_id, r.class_id, r.copy_of, r.n_copies, count(DISTINCT s.copy_of) FILTER (WHERE p.j < 1) AS n_texts, count(*) AS n_links, max(p.j) FILTER (WHERE p.j < 1) AS nearest
FROM rep r JOIN p ON p.a = r.id JOIN rep s ON s.id = p.b GROUP BY ALL
"""
