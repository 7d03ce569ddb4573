"""Quality by hashed n-gram logistic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._text import col, content, grams, hashes, mix, rows_of, slices, trim, within, words

#: n-gram orders, each of them a family of features of its own.
WORD_ORDERS = (1, 2)
CHAR_ORDERS = (2, 3, 4)
BITS = 18
#: A row is kept from this calibrated probability on, and called high from the second.
KEEP, HIGH = 0.5, 0.9


def _families(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family: bucket of each n-gram, and first n-gram of each row (rows + 1)."""
    begin, end, first = words(data, off)
    h = hashes(data, begin, end)
    lead = np.flatnonzero((data & 192) != 128) if len(data) else np.zeros(0, np.int64)  # characters, not bytes
    char_first = np.searchsorted(lead, off)
    wide = np.concatenate([lead, [len(data)]])
    code = np.zeros(len(lead), np.uint64)
    for k in range(4):
        has = wide[:-1] + k < wide[1:]
        code[has] = (code[has] << np.uint64(8)) | data[lead[has] + k]
    code = mix(code + np.uint64(1))
    for tag, values, start, orders in ((1, h, first, WORD_ORDERS), (2, code, char_first, CHAR_ORDERS)):
        for n in orders:
            ok = within(start, n)
            g = grams(values, n)[ok] + np.uint64(tag * 1000003 + n)
            at = np.concatenate([[0], np.cumsum(ok)])
            yield (mix(g) >> np.uint64(64 - BITS)).astype(np.int64), at[np.minimum(start, len(ok))]


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of all rows; value: a bucket's share of the family's n-grams in the row."""
    rows, keys, vals = [], [], []
    for bucket, first in _families(data, off):
        row = rows_of(first)
        key, count = np.unique((row << BITS) | bucket, return_counts=True)
        r = key >> BITS
        rows.append(r)
        keys.append(key & ((1 << BITS) - 1))
        vals.append(count / np.diff(first)[r])
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(vals)


def logits(data: np.ndarray, off: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """bias plus, for each family, the mean weight of a row's n-grams. A row's sum has its own n-grams in order and no others."""
    out = np.full(len(off) - 1, bias)
    for bucket, first in _families(data, off):
        size = np.diff(first)
        some = np.flatnonzero(size)
        if len(some):
            out[some] += np.add.reduceat(weights[bucket], first[some]) / size[some]
    return out


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    held_out: dict

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -50, 50)))


def _fit_logistic(at: np.ndarray, keys: np.ndarray, vals: np.ndarray, y: np.ndarray, use: np.ndarray, epochs: int, l2: float) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Adam over small batches of the rows in ``use``; both classes weigh alike."""
    w, b, m, v, mb, vb, t = np.zeros(1 << BITS), 0.0, np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, 0
    weight = np.where(y == 1, 0.5 * len(use) / max(1, (y[use] == 1).sum()), 0.5 * len(use) / max(1, (y[use] == 0).sum()))
    rng = np.random.default_rng(7)
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(use), max(1, len(use) // 128)):
            t += 1
            size = at[rows + 1] - at[rows]
            end = np.cumsum(size)
            own = np.arange(int(end[-1])) + np.repeat(at[rows] - (end - size), size)
            k, x, r = keys[own], vals[own], np.repeat(np.arange(len(rows)), size)
            z = np.bincount(r, x * w[k], len(rows)) + b
            d = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[rows]) * weight[rows] / len(rows)
            g, gb = np.bincount(k, x * d[r], 1 << BITS) + l2 * w, d.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            rate = 0.3 / (1 + epoch / 3)
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, float(b)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-out scores, by Newton's method on smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -50, 50)))
        r, q = p - t, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * z).sum() + 1e-3 * (a - 1), r.sum()])
        h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, c = a - float(np.clip(step[0], -2, 2)), c - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), c


def train_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 4000, epochs: int = 10, l2: float = 1e-6) -> QualityModel | None:
    """Fit on at most ``max_rows`` labelled rows of each label, the first by a hash of the id.

    Half of them train the weights, a quarter the calibration, and the last
    quarter, which takes part in neither, gives the accuracy and Brier score
    in held_out. Rows without id, text or label are left out; ties in the
    hash go by id; ids that repeat are one row for each of their texts. None
    where a label has fewer than 8 rows.
    """
    given = labels.where(col(label_col).isin(0, 1) & col(id_col).isNotNull()).groupBy(col(id_col).alias("_id")).agg(F.max(col(label_col)).cast("int").alias("_y")).withColumn("_h", F.xxhash64("_id", F.lit(7)))
    ids = given.where("_y = 0").orderBy("_h", "_id").limit(max_rows).unionByName(given.where("_y = 1").orderBy("_h", "_id").limit(max_rows))
    text = docs.where(col(text_col).isNotNull() & col(id_col).isNotNull()).select(col(id_col).alias("_id"), col(text_col).cast("string").alias("_t"))
    sample = text.join(F.broadcast(ids), "_id").select("_h", "_y", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_t", 1 << 20):
            r, k, v = features(*content(part.column("_t")))
            order = np.argsort(r, kind="stable")
            at = np.searchsorted(r[order], np.arange(part.num_rows + 1)).astype(np.int64)
            pack = lambda x: [pa.compress(np.ascontiguousarray(x[i:j]).view(np.uint8), codec="zstd", asbytes=True) for i, j in zip(at[:-1], at[1:])]  # noqa: B023, E731
            yield pa.record_batch([part.column("_h"), part.column("_y"), pa.array(np.diff(at).astype(np.int32)), pa.array(pack(k[order].astype(np.int32)), pa.binary()), pa.array(pack(v[order].astype(np.float32)), pa.binary())], names=["h", "y", "n", "k", "v"])

    got = sample.mapInArrow(run, "h bigint, y int, n int, k binary, v binary").toArrow()
    y = got["y"].to_numpy().astype(np.float64)
    if min((y == 0).sum(), (y == 1).sum()) < 8:
        return None
    size = got["n"].to_numpy().astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    unpack = lambda name, kind: np.concatenate([np.frombuffer(pa.decompress(x, int(n) * 4, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind) for x, n in zip(got[name].to_pylist(), size)])
    keys, vals = unpack("k", np.int32), unpack("v", np.float32)
    order = np.lexsort((size, got["h"].to_numpy()))  # one order, however the rows arrive
    del got
    role = np.zeros(len(y), np.int64)  # 0 and 2: weights, 1: calibration, 3: held out
    for c in (0, 1):
        own = order[y[order] == c]
        role[own] = np.arange(len(own)) % 4
    w, b = _fit_logistic(at, keys, vals, y, order[role[order] % 2 == 0], epochs, l2)
    z = np.array([vals[i:j] @ w[keys[i:j]] for i, j in zip(at[:-1], at[1:])]) + b
    slope, shift = _platt(z[role == 1], y[role == 1])
    model = QualityModel(w, b, slope, shift, {})
    held = role == 3
    p = model.probability(z[held])
    model.held_out.update(rows=int(held.sum()), accuracy=float(((p >= KEEP) == y[held]).mean()), brier=float(((p - y[held]) ** 2).mean()))
    return model


def score_quality(docs: DataFrame, model: QualityModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Calibrated probability of good quality for every row; map-only.

    Result: (id_col, probability, grade, keep): grade is ``high``, ``medium``
    or ``low`` by the fixed thresholds HIGH and KEEP. A null text, or no
    model, has a null probability, grade ``unknown`` and isn't kept. An
    empty text is scored by the bias alone, the longest texts whole. Equal
    texts have equal scores, whatever is scored with them, and a probability
    at a threshold is in the better grade. Rows that repeat are scored each;
    other columns, also such as are called like those of the result, are
    left out. An empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, probability double, grade string, keep boolean"
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part in slices(batches, "text", 1 << 21):
            has = np.array(part.column("text").is_valid()) & (m is not None)
            z = logits(*content(part.column("text")), m.weights, m.bias) if m is not None else np.zeros(part.num_rows)
            p = m.probability(z) if m is not None else z
            grade = np.where(~has, "unknown", np.where(p >= HIGH, "high", np.where(p >= KEEP, "medium", "low")))
            yield pa.record_batch([part.column("id"), pa.array(p, mask=~has), pa.array(grade), pa.array(has & (p >= KEEP))], names=["id", "probability", "grade", "keep"])
        trim()

    return own.mapInArrow(run, schema).withColumnRenamed("id", id_col)
