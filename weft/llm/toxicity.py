"""Toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._text import NOT_ALNUM, col, content, grams, hashes, mix, rows_of, slices, within, words
from weft.plans.scratch import cut

#: A passage is significant up to this expected count of such passages in a clean document of the length.
E_VALUE = 0.003
#: Signed root of the likelihood ratio from which a word's lean to toxic documents is no chance.
LEAST_ROOT = 3.0
#: Word n-gram whose least hashes tell near copies among the training rows.
SKETCH, SKETCHES = 5, 3


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, end, first) of words of ASCII letters, digits and longer characters; ASCII in lower case."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    begin, end, first = words(low, off, NOT_ALNUM)
    return hashes(low, begin, end), begin, end, first


def sketches(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SKETCHES least hashes of each row's word n-grams; a row of fewer words has the hash of them all."""
    n = len(first) - 1
    out = np.full((n, SKETCHES), np.iinfo(np.uint64).max, np.uint64)
    ok = within(first, SKETCH)
    g, row = grams(h, SKETCH)[ok], rows_of(first)[: len(ok)][ok]
    for k in range(1, SKETCH):
        short = np.flatnonzero(np.diff(first) == k)
        g, row = np.concatenate([g, grams(h, k)[first[short]]]), np.concatenate([row, short])
    for k in range(SKETCHES):
        np.minimum.at(out[:, k], row, mix(g + np.uint64(k + 1)))
    return out


def lean(y1: np.ndarray, y0: np.ndarray, d1: int, d0: int) -> np.ndarray:
    """Signed root of the likelihood ratio of counts in d1 toxic and d0 other documents against one common rate."""
    e1 = (y1 + y0) * (d1 / (d1 + d0))
    e0 = (y1 + y0) - e1
    part = lambda y, e: np.where(y > 0, y * np.log(np.maximum(y, 1) / np.maximum(e, 1e-300)), 0.0)
    return np.sqrt(np.maximum(2 * (part(y1, e1) + part(y0, e0)), 0)) * np.sign(y1 - e1)


def segments(at: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence (Ruzzo and Tompa), in linear time.

    The sequence has ``score`` > 0 at the increasing positions ``at`` and
    ``drift`` < 0 everywhere else. Returns (first, last position, score).
    """
    out: list[list] = []  # left sum, right sum, first, last
    total, before = 0.0, -1
    for p, s in zip(at.tolist(), score.tolist()):
        total += drift * (p - before - 1)
        left, total, before = total, total + s, p
        new = [left, total, p, p]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= new[0]:
                j -= out[j][4] if len(out[j]) > 4 else 1
            if j < 0 or out[j][1] >= new[1]:
                new.append(len(out) - j)  # how far back the next smaller left sum lies
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
    return [(x[2], x[3], x[1] - x[0]) for x in out]


@dataclass(frozen=True)
class ToxicModel:
    token: np.ndarray
    score: np.ndarray
    drift: float
    lam: float
    k: float

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the tokens that speak for toxicity."""
        table = np.zeros(1 << 16, bool)
        table[(self.token >> np.uint64(48)).astype(np.int64)] = True
        at = np.flatnonzero(table[(h >> np.uint64(48)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.token, h[at]), max(0, len(self.token) - 1))
        ok = self.token[where] == h[at] if len(self.token) else np.zeros(0, bool)
        return at[ok], self.score[where[ok]]

    def e_value(self, s: float | np.ndarray, length: int | np.ndarray) -> float | np.ndarray:
        return self.k * length * np.exp(-self.lam * s)


def _karlin_lambda(score: np.ndarray, prob: np.ndarray, drift: float) -> float:
    """The positive root of E[exp(x * score)] = 1 under the background."""
    f = lambda x: (prob * np.exp(np.minimum(x * score, 700))).sum() + (1 - prob.sum()) * np.exp(x * drift) - 1
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def word_scores(y1: np.ndarray, y0: np.ndarray, t1: int, t0: int, size: int, d1: int, d0: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(chosen, scores, background rates of the chosen, drift) from counts of words in toxic and other documents.

    A class's Dirichlet prior has its share of one occurrence for each of
    ``size`` words, so a word that was never seen leans to neither.
    """
    a1, a0 = t1 / (t1 + t0), t0 / (t1 + t0)
    up = np.flatnonzero(lean(y1, y0, d1, d0) >= LEAST_ROOT)
    q, p = (y1[up] + a1) / (t1 + a1 * size), (y0[up] + a0) / (t0 + a0 * size)
    return up, np.log(q / p), p, float(np.log((1 - q.sum()) / (1 - p.sum())))


def train_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 6000) -> ToxicModel | None:
    """Word log-odds of toxic against other labelled documents, with Dirichlet priors.

    At most ``max_rows`` rows of either label are used, the first by a hash of
    the id. Of near copies in a label (rows that share one of SKETCHES least
    hashes of word n-grams) one is used, else the ordinary words of a text
    that was copied often would count as toxic. A word counts once a document.
    Every word whose lean to toxic documents is significant (LEAST_ROOT)
    scores its log-odds; the others share the log-odds of all that is left,
    the drift, which is negative. Karlin and Altschul's lambda follows from
    the scores, K from the segments of a third of the clean rows, which takes
    no part in the counts. Ties in the hash go by id. Rows without id, text
    or label, and empty texts, take no part; a row that repeats is a near
    copy of itself. None where a label has no rows or no word stands out.
    """
    given = labels.where(col(label_col).isin(0, 1) & col(id_col).isNotNull()).groupBy(col(id_col).alias("_id")).agg(F.max(col(label_col)).cast("int").alias("_y")).withColumn("_h", F.xxhash64("_id", F.lit(13)))
    ids = given.where("_y = 0").orderBy("_h", "_id").limit(max_rows).unionByName(given.where("_y = 1").orderBy("_h", "_id").limit(max_rows))
    text = docs.where(col(text_col).isNotNull() & col(id_col).isNotNull()).select(col(id_col).alias("_id"), col(text_col).cast("string").alias("_t"))
    sample = cut(text.join(F.broadcast(ids), "_id").select("_h", "_y", "_t").distinct())  # bounded by max_rows

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_t", 1 << 22):
            h, _, _, first = tokens(*content(part.column("_t")))
            s = sketches(h, first)
            some = pa.array(np.diff(first) > 0)
            yield pa.record_batch([part.column("_h"), part.column("_y"), *(pa.array(s[:, k].view(np.int64)) for k in range(SKETCHES))], names=["h", "y", *(f"s{k}" for k in range(SKETCHES))]).filter(some)

    seen = sample.mapInArrow(sketched, "h bigint, y int, " + ", ".join(f"s{k} bigint" for k in range(SKETCHES))).toArrow()
    h, y = seen["h"].to_numpy(), seen["y"].to_numpy()
    order = np.argsort(h, kind="stable")
    alone = np.ones(len(h), bool)
    for k in range(SKETCHES):
        s = seen[f"s{k}"].to_numpy()
        for label in (0, 1):
            own = order[y[order] == label]
            _, head = np.unique(s[own], return_index=True)
            later = np.ones(len(own), bool)
            later[head] = False
            alone[own[later]] = False
    used = np.unique(np.stack([h[alone], y[alone]]), axis=1)
    aside = (used[1] == 0) & (used[0] % 3 == 0)
    if (used[1] == 1).sum() == 0 or ((used[1] == 0) & ~aside).sum() == 0:
        return None
    d1, d0 = int((used[1] == 1).sum()), int(((used[1] == 0) & ~aside).sum())
    role = docs.sparkSession.createDataFrame([(int(a), bool(b)) for a, b in zip(used[0], aside)], "_h bigint, _aside boolean")
    chosen = sample.join(F.broadcast(role), "_h")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_t", 1 << 22):
            w, _, _, first = tokens(*content(part.column("_t")))
            key = np.unique(np.stack([w, rows_of(first).astype(np.uint64)]), axis=1)
            label = part.column("_y").to_numpy()[key[1].astype(np.int64)]
            each, inverse = np.unique(key[0], return_inverse=True)
            yield pa.record_batch([pa.array(each.view(np.int64)), *(pa.array(np.bincount(inverse[label == v], minlength=len(each))) for v in (1, 0))], names=["w", "y1", "y0"])

    counted = cut(chosen.where("not _aside").select("_y", "_t").mapInArrow(count, "w bigint, y1 bigint, y0 bigint").groupBy("w").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")))
    total = counted.agg(F.coalesce(F.sum("y1"), F.lit(0)).alias("t1"), F.coalesce(F.sum("y0"), F.lit(0)).alias("t0"), F.count("*").alias("size")).first()
    if not total["t1"] or not total["t0"]:
        return None
    often = counted.where("y1 > 1").toArrow().sort_by("w")
    w, y1, y0 = (often[k].to_numpy() for k in ("w", "y1", "y0"))
    up, score, p, drift = word_scores(y1, y0, total["t1"], total["t0"], total["size"], d1, d0)
    if not len(up):
        return None
    token = w[up].view(np.uint64)
    by = np.argsort(token)
    lam = _karlin_lambda(score, p, drift)
    model = ToxicModel(token[by], score[by], drift, lam, 1.0)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_t", 1 << 22):
            found, length = _scan(part.column("_t"), model)
            yield pa.record_batch([pa.array([int(length.sum())]), pa.array([[s for *_, s in found]], pa.list_(pa.float64()))], names=["n", "s"])

    got = chosen.where("_aside").select("_t").mapInArrow(clean, "n bigint, s array<double>").collect()
    return ToxicModel(model.token, model.score, drift, lam, _tail(np.array([s for r in got for s in r["s"]]), lam, sum(r["n"] for r in got)))


def _tail(scores: np.ndarray, lam: float, n: int) -> float:
    """K of the extreme-value law: segments of n clean words that reach the median score, carried back to score 0."""
    least = float(np.median(scores)) if len(scores) else 0.0
    return float(((scores >= least).sum() + 1) * np.exp(lam * least) / max(1, n))


def _scan(texts: pa.Array, m: ToxicModel) -> tuple[list[tuple[int, int, int, int, int, float]], np.ndarray]:
    """(row, first, last token, begin, end byte in the row, score) of each maximal segment; tokens of each row."""
    data, off = content(texts)
    h, begin, end, first = tokens(data, off)
    at, score = m.hits(h)
    row = np.searchsorted(first, at, "right") - 1
    out = []
    cut = np.flatnonzero(np.diff(row)) + 1
    for lo, hi in zip([0, *cut], [*cut, len(row)]):
        if lo < hi:
            r = int(row[lo])
            out += [(r, a, b, int(begin[first[r] + a] - off[r]), int(end[first[r] + b] - off[r]), s) for a, b, s in segments(at[lo:hi] - first[r], score[lo:hi], m.drift)]
    return out, np.diff(first)


def find_toxic(docs: DataFrame, model: ToxicModel | None, *, id_col: str = "doc_id", text_col: str = "text", e_value: float = E_VALUE) -> DataFrame:
    """Every significant toxic passage of every row; map-only.

    Result, a row for each passage: (id_col, passage_no, first_word,
    last_word, score, e_value, doc_p_value, passage). Passages are the
    maximal scoring segments with an expected count in clean text of the
    document's length up to ``e_value``; doc_p_value is the extreme-value
    probability of the document's best one. Documents without any, null and
    empty texts, and all where there is no model, have no rows. Passages of
    one document are disjoint and in order; of segments that tie the first
    counts as the earlier passage. Rows that repeat are searched each, the
    longest texts whole. Other columns, also such as are called like those
    of the result, are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part in slices(batches, "text", 1 << 21) if m is not None else ():
            found, length = _scan(part.column("text"), m)
            best: dict[int, float] = {}
            good = []
            for r, a, b, i, j, s in found:
                e = float(m.e_value(s, int(length[r])))
                if e <= e_value:
                    best[r] = min(best.get(r, e), e)
                    good.append((r, a, b, i, j, s, e))
            if not good:
                continue
            texts = part.column("text")
            number, last, raw = [], -1, b""
            text = []
            for r, _, _, i, j, _, _ in good:
                number.append(number[-1] + 1 if r == last else 0)
                raw = raw if r == last else texts[r].as_py().encode()
                last = r
                text.append(raw[i:j].decode("utf-8", "replace"))
            rows = [g[0] for g in good]
            yield pa.record_batch(
                [part.column("id").take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), *(pa.array([g[k] for g in good], pa.int32()) for k in (1, 2)), *(pa.array([g[k] for g in good], pa.float64()) for k in (5, 6)), pa.array([float(-np.expm1(-best[r])) for r in rows]), pa.array(text)],
                names=["id", "passage_no", "first_word", "last_word", "score", "e_value", "doc_p_value", "passage"],
            )

    return own.mapInArrow(run, f"id {kind}, passage_no int, first_word int, last_word int, score double, e_value double, doc_p_value double, passage string").withColumnRenamed("id", id_col)
