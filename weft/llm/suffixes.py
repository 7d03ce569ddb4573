"""Repeated passages by distributed suffix sorting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._text import col, content, grams, hashes, mix, pair_search, rows_of, slices, trim, words
from weft.plans.scratch import cut

#: Words of the shortest passage, words of a lead, and suffixes for a bucket.
LENGTH, LEAD, PER_BUCKET = 50, 8, 50_000
#: Rows of the sample that splitters come from.
SAMPLE = 1_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _least(g: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost least of g[i:i + w], for each i up to len(g) - w."""
    val, idx, have = g, np.arange(len(g)), 1
    while have < w:
        step = min(have, w - have)
        n = len(val) - step
        right = val[step:] < val[:n]
        val, idx = np.where(right, val[step:], val[:n]), np.where(right, idx[step:], idx[:n])
        have += step
    return idx


def anchors(data: np.ndarray, off: np.ndarray, length: int, lead: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first, last window, lead hash, token, first token of each row).

    Every window of ``length`` words has an anchor, the place in it of its
    lead (a run of ``lead`` words) with the least hash; windows with the same
    words have it at the same place. The windows first..last are those of
    one anchor. Positions count words of the whole slice.
    """
    begin, end, start = words(data, off)
    h = hashes(data, begin, end)
    token = (h >> np.uint64(32)).astype(np.uint32)
    g = grams(h, lead)
    none = np.zeros(0, np.int64)
    if len(h) < length:
        return none, none, none, none, np.zeros(0, np.uint64), token, start
    at = _least(g, length - lead + 1)
    row = rows_of(start)
    p = np.flatnonzero(row[: len(at)] == row[length - 1 :][: len(at)])
    a, r = at[p], row[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(p)) - 1
    return r[head], a[head], p[head], p[tail], g[a[head]], token, start


def multikey_quicksort(keys: np.ndarray) -> np.ndarray:
    """An order that sorts the rows of a matrix, by three-way partition on one column after another.

    Bentley and Sedgewick's sort, with all open segments partitioned
    together in each round; a segment equal to its pivot goes on to the next
    column.
    """
    n, deep = keys.shape
    order = np.arange(n)
    begin, end, depth = np.array([0]), np.array([n]), np.array([0])
    while True:
        open_ = (end - begin > 1) & (depth < deep)
        begin, end, depth = begin[open_], end[open_], depth[open_]
        if not len(begin):
            return order
        size = end - begin
        shift = np.cumsum(size) - size
        seg = np.repeat(np.arange(len(size)), size)
        pos = np.arange(len(seg)) - shift[seg] + begin[seg]
        own = order[pos]
        char = keys[own, depth[seg]]
        a, b, c = (keys[order[x], depth] for x in (begin, (begin + end) // 2, end - 1))
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[seg]
        less, same = char < pivot, char == pivot
        more = ~(less | same)
        n_less, n_same = np.add.reduceat(less, shift, dtype=np.int64), np.add.reduceat(same, shift, dtype=np.int64)
        dest = np.empty(len(pos), np.int64)
        for mask, base in ((less, begin), (same, begin + n_less), (more, begin + n_less + n_same)):
            rank = np.cumsum(mask)
            rank -= (rank[shift] - mask[shift])[seg]
            dest[mask] = (base[seg] + rank - 1)[mask]
        order[dest] = own
        begin, end, depth = np.concatenate([begin, begin + n_less, begin + n_less + n_same]), np.concatenate([begin + n_less, begin + n_less + n_same, end]), np.concatenate([depth, depth + 1, depth])


def _lead_key(token: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The first four words of suffixes as one number, 16 bits of each word."""
    top = (token >> np.uint32(16)).astype(np.uint64)
    return (top[a] << np.uint64(48)) | (top[a + 1] << np.uint64(32)) | (top[a + 2] << np.uint64(16)) | top[a + 3]


def splitters(sample: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of (lead, doc) pairs, which part them into so many buckets."""
    lead, doc = sample["lead"].to_numpy().view(np.uint64), sample["doc"].to_numpy()
    order = np.lexsort((doc, lead))
    at = order[len(order) * np.arange(1, buckets) // buckets] if len(order) else order
    return lead[at], doc[at]


def _sorted_bucket(length: int, lead: int, alone: bool):
    """Sort one bucket's suffixes and compare neighbours; windows next to a border are left for the comparison across."""

    def run(table: pa.Table) -> pa.Table:
        doc, pos = table["doc"].to_numpy(), table["pos"].to_numpy().astype(np.int64)
        low, high = table["low"].to_numpy().astype(np.int64), table["high"].to_numpy().astype(np.int64)
        key = table["lead"].to_numpy().view(np.uint64)
        n = len(doc)
        flat, at = content(table["words"].combine_chunks() if table["words"].num_chunks != 1 else table["words"].chunk(0))
        flat, at = flat.view(np.uint32), at // 4
        reach = length - lead
        right, left = np.zeros((n, length), np.uint32), np.zeros((n, reach), np.uint32)
        size = length - low
        for k in range(length):
            has = size > k
            right[has, k] = flat[at[:-1][has] + high[has] + k]
        for k in range(reach):
            has = high > k
            left[has, k] = flat[at[:-1][has] + high[has] - 1 - k]
        pair = (right[:, 0::2].astype(np.uint64) << np.uint64(32)) | (right[:, 1::2] if length % 2 == 0 else np.pad(right, ((0, 0), (0, 1)))[:, 1::2])
        order = multikey_quicksort(np.concatenate([key[:, None], pair], axis=1))
        doc, pos, low, high, key, size = (x[order] for x in (doc, pos, low, high, key, size))
        right, left = right[order], left[order]
        differ = right[1:] != right[:-1]
        common = np.minimum(np.where(differ.any(1), differ.argmax(1), length), np.minimum(size[1:], size[:-1])) if n > 1 else np.zeros(0, np.int64)
        common[key[1:] != key[:-1]] = 0
        edge = np.zeros(n, bool) if alone else (key == key[0]) | (key == key[-1])
        forward = np.zeros((length + 1, n), np.uint64)
        for k in range(length):
            forward[k + 1] = forward[k] * _MULT + right[:, k] + np.uint64(1)
        back = np.zeros(n, np.uint64)
        out_doc, out_p, out_first, w_hash, w_doc, w_p = [], [], [], [], [], []
        for o in range(reach + 1):  # windows that begin o words before their anchor
            if o:
                back = back * _MULT + left[:, o - 1] + np.uint64(1)
            own = np.flatnonzero((low <= o) & (o <= high))
            if not len(own):
                continue
            run_of = np.concatenate([[0], np.cumsum(common < length - o)])  # equal to the depth that the window needs
            same = mix(run_of[own].astype(np.uint64) * _MULT + mix(back[own]))
            by = np.argsort(same, kind="stable")
            group = np.flatnonzero(np.concatenate([[True], same[by][1:] != same[by][:-1]]))
            d = doc[own][by]
            least, most = np.minimum.reduceat(d, group), np.maximum.reduceat(d, group)
            times = np.diff(np.append(group, len(by)))
            hit, first = np.empty(len(own), bool), np.empty(len(own), bool)
            hit[by], first[by] = np.repeat(least != most, times), d == np.repeat(least, times)
            e = edge[own]
            good = own[hit & ~e]
            out_doc.append(doc[good])
            out_p.append(pos[good] - o)
            out_first.append(first[hit & ~e])
            far = own[e]
            w_hash.append(mix(mix(back[far]) + forward[length - o][far] + np.uint64(o)))
            w_doc.append(doc[far])
            w_p.append(pos[far] - o)
        d, p, f = np.concatenate(out_doc), np.concatenate(out_p), np.concatenate(out_first)
        by = np.lexsort((p, d))
        d, p, f = d[by], p[by], f[by]
        head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1) | (f[1:] != f[:-1])])) if len(d) else np.zeros(0, np.int64)
        tail = np.append(head[1:], len(d)) - 1 if len(d) else head
        wh, wd, wp = np.concatenate(w_hash), np.concatenate(w_doc), np.concatenate(w_p)
        m = len(head)
        trim()
        return pa.table([
            pa.array(np.concatenate([np.zeros(m, np.int64), wh.view(np.int64)]), mask=np.arange(m + len(wh)) < m),
            pa.array(np.concatenate([d[head], wd])),
            pa.array(np.concatenate([p[head], wp]), pa.int64()),
            pa.array(np.concatenate([p[tail], wp]) + length, pa.int64()),
            pa.array(np.concatenate([f[head], np.zeros(len(wh), bool)])),
        ], names=["w", "doc", "begin", "stop", "first"])

    return run


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, lead: int = LEAD, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Every passage of at least ``length`` words that stands in another document too.

    Each window of ``length`` words is sorted under its anchor (see
    anchors()), the same place in all windows with the same words; so one
    suffix stands for the windows, about (length - lead) / 2 of them, that
    share an anchor, and no repeat is lost.

    1. Suffixes whose first ``lead`` words are those of no other document
       can't repeat and go.
    2. Splitters, quantiles of a sample of leads (ties by document; SAMPLE
       or four a bucket at most), cut the rest into buckets in number with
       them. A suffix takes along the words of its windows.
    3. A bucket sorts by multikey quicksort, and the common prefixes of
       neighbours with equal words before the anchor tell the repeats. What
       has the lead of a bucket's first or last suffix may go on in another
       bucket; those windows are compared across all borders by hash.
    4. Repeated windows of a document that touch or overlap are one passage.
    Words are what blanks part, compared by 32-bit hashes, case and
    punctuation included; a passage of 50 hashes is alike only by its words.

    Result: (doc_id, first_word, last_word, n_words, original): positions
    count from 0; original where no document with a smaller id has any part
    of it (deduplication keeps these and cuts the others). Passages repeated
    in one document alone have no row, neither have null or short texts and
    rows with a null id. Ids are integers; rows that share an id are one
    document, so a row that repeats is no other document. The longest texts
    are sorted whole; of documents that tie in a passage the least id is the
    original; an empty table gives an empty one. Other columns don't matter,
    whatever they are called.
    """
    spark = docs.sparkSession
    own = docs.where(col(id_col).isNotNull() & col(text_col).isNotNull()).select(col(id_col).cast("bigint").alias("doc"), col(text_col).cast("string").alias("text"))

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 21):
            row, a, _, _, g, token, start = anchors(*content(part.column("text")), length, lead)
            if len(a):
                yield pa.record_batch([pa.array(g.view(np.int64)), pa.array(_lead_key(token, a).view(np.int64)), part.column("doc").take(pa.array(row)), pa.array((a - start[row]).astype(np.int32))], names=["g", "lead", "doc", "pos"])
        trim()

    found = cut(own.mapInArrow(leads, "g bigint, lead bigint, doc bigint, pos int"))
    shared = found.groupBy("g").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("g")
    tied = cut(found.join(shared, "g", "left_semi").select("doc", "pos", "lead"))
    total = tied.count()
    buckets = max(1, -(-total // per_bucket))
    borders = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if buckets > 1:
        most = max(min(60 * buckets, SAMPLE), 4 * buckets)
        borders = splitters(tied.select("lead", "doc").sample(min(1.0, most / total), 5).toArrow(), buckets)
    sent = spark.sparkContext.broadcast(borders)
    places = tied.groupBy("doc").agg(F.collect_set("pos").alias("places")).withColumnRenamed("doc", "_doc")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 21):
            row, a, first, last, _, token, start = anchors(*content(part.column("text")), length, lead)
            wanted = part.column("places")
            which = np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
            code = np.sort((which << 32) | wanted.flatten().to_numpy().astype(np.int64))
            mine = (row << 32) | (a - start[row])
            at = np.minimum(np.searchsorted(code, mine), max(0, len(code) - 1))
            ok = code[at] == mine if len(code) else np.zeros(len(mine), bool)
            row, a, first, last = row[ok], a[ok], first[ok], last[ok]
            if not len(a):
                continue
            key, doc = _lead_key(token, a), part.column("doc").to_numpy()[row]
            bucket = pair_search(*sent.value, key, doc).astype(np.int32)
            size = last + length - first
            end = np.cumsum(size)
            flat = token[np.arange(int(end[-1])) + np.repeat(first - (end - size), size)]
            off = np.concatenate([[0], end * 4]).astype(np.int32)
            text = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(off), pa.py_buffer(flat)])
            yield pa.record_batch([pa.array(bucket, pa.int32()), pa.array(key.view(np.int64)), pa.array(doc), pa.array((a - start[row]).astype(np.int32)), pa.array((a - last).astype(np.int16)), pa.array((a - first).astype(np.int16)), text], names=["bucket", "lead", "doc", "pos", "low", "high", "words"])
        trim()

    carried = own.join(places, F.col("doc") == F.col("_doc")).select("doc", "text", "places").mapInArrow(suffixes, "bucket int, lead bigint, doc bigint, pos int, low smallint, high smallint, words binary")
    found = cut(carried.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_sorted_bucket(length, lead, not len(borders[0])), "w bigint, doc bigint, begin bigint, stop bigint, first boolean"))
    far = found.where("w is not null")
    ends = far.groupBy("w").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi")
    edge = far.join(ends, "w").select("doc", "begin", "stop", (F.col("doc") == F.col("lo")).alias("first"))
    every = found.where("w is null").select("doc", "begin", "stop", "first").unionByName(edge)
    order = Window.partitionBy("doc").orderBy("begin", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("begin") <= F.col("_reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    joined = every.withColumn("_reach", reach).withColumn("_island", island).groupBy("doc", "_island").agg(F.min("begin").alias("first_word"), (F.max("stop") - 1).alias("last_word"), F.bool_and("first").alias("original"))
    return joined.select(F.col("doc").alias(id_col), "first_word", "last_word", (F.col("last_word") - F.col("first_word") + 1).alias("n_words"), "original")


#: Every window of LENGTH words by its words; those of two documents or more, joined where they touch.
SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x00-\\x20]+') AS w FROM documents WHERE text IS NOT NULL),
g AS MATERIALIZED (
  SELECT doc_id, unnest(range(len(l))) AS b, unnest(l) AS h
  FROM (SELECT doc_id, list_transform(range(1, len(w) - {LENGTH - 2}), lambda i: md5(array_to_string(w[i:i + {LENGTH - 1}], ' '))) AS l FROM w WHERE len(w) >= {LENGTH})
), h AS (SELECT h, min(doc_id) AS lo FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)),
r AS (SELECT doc_id, b, doc_id = lo AS first, lag(b) OVER (PARTITION BY doc_id ORDER BY b) AS before FROM g JOIN h USING (h)),
i AS (SELECT *, sum(CASE WHEN b <= before + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY b) AS k FROM r)
SELECT doc_id, min(b) AS first_word, max(b) + {LENGTH - 1} AS last_word, max(b) - min(b) + {LENGTH} AS n_words, bool_and(first) AS original FROM i GROUP BY doc_id, k
"""
