"""Language identification with blended-spectrum presence kernels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._text import col, content, grams, mix, numbered, slices, trim, within

ORDERS = (2, 3, 4)
#: Bits of an n-gram's hash by which it is compared, and by which it is looked up.
SHORT, SLOTS = 44, 21
#: A text is accepted where the best one-versus-rest score reaches LEAST and leads the next by LEAD.
LEAST, LEAD = -0.25, 0.15


def codes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of every character n-gram of all orders, lower-case ASCII; with repeats."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    lead = np.flatnonzero((low & 192) != 128)
    wide = np.concatenate([lead, [len(low)]])
    char = np.zeros(len(lead), np.uint64)
    for k in range(4):
        has = wide[:-1] + k < wide[1:]
        char[has] = (char[has] << np.uint64(8)) | low[lead[has] + k]
    char = mix(char + np.uint64(1))
    first = np.searchsorted(lead, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    rows, out = [], []
    for n in ORDERS:
        ok = within(first, n)
        rows.append(row[: len(ok)][ok])
        out.append(grams(char, n)[ok] + np.uint64(n))
    return np.concatenate(rows), np.concatenate(out)


class Spectrum:
    """The n-grams of the landmarks, compared by SHORT-bit hashes, and a table of slots to look them up."""

    def __init__(self, vocabulary: np.ndarray) -> None:
        self.vocabulary = np.unique(vocabulary >> np.uint64(64 - SHORT))
        slot = (self.vocabulary >> np.uint64(SHORT - SLOTS)).astype(np.int64)
        self.start = np.searchsorted(slot, np.arange((1 << SLOTS) + 1)).astype(np.int32)
        self.some = np.diff(self.start) > 0
        self.most = int(np.diff(self.start).max())

    def presence(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sparse presence matrix of texts (rows, columns, sorted by row), and how many distinct n-grams each text has in all."""
        n = len(off) - 1
        row, code = codes(data, off)
        if n >= 1 << (64 - SHORT):
            raise ValueError("too many rows in a slice")
        key = np.sort((row.astype(np.uint64) << np.uint64(SHORT)) | (code >> np.uint64(64 - SHORT)))
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        row = (key >> np.uint64(SHORT)).astype(np.int64)
        size = np.bincount(row, minlength=n)
        key &= np.uint64((1 << SHORT) - 1)
        slot = (key >> np.uint64(SHORT - SLOTS)).astype(np.int64)
        own = np.flatnonzero(self.some[slot])
        at = np.full(len(own), -1)
        place, end = self.start[slot[own]].astype(np.int64), self.start[slot[own] + 1]
        for _ in range(self.most):
            hit = (place < end) & (self.vocabulary[np.minimum(place, len(self.vocabulary) - 1)] == key[own])
            at[hit] = place[hit]
            place += 1
        known = at >= 0
        return row[own[known]], at[known], size


def product(rows: np.ndarray, cols: np.ndarray, n: int, matrix: np.ndarray) -> np.ndarray:
    """A sparse presence matrix of n rows times a dense matrix."""
    out = np.zeros((n, matrix.shape[1]), matrix.dtype)
    if len(rows):
        head = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        out[rows[head]] = np.add.reduceat(matrix[cols], head, axis=0)
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    spectrum: Spectrum
    matrix: np.ndarray
    held_out: dict

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """One-versus-rest scores of a batch of texts by one matrix product; -1 throughout where no n-gram is known."""
        rows, cols, size = self.spectrum.presence(data, off)
        out = product(rows, cols, len(off) - 1, self.matrix) / np.sqrt(np.maximum(size, 1))[:, None]
        out[np.bincount(rows, minlength=len(off) - 1) == 0] = -1
        return out


def train_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, landmarks: int = 32, ridge: float = 1e-3) -> LanguageModel | None:
    """Fit on at most ``per_language`` labelled rows of each language, the first by a hash of the id.

    The kernel of two texts is the number of n-grams that both have, of all
    orders together, over the geometric mean of how many either has. The
    first ``landmarks`` rows of each language are Nyström landmarks, whose
    n-grams are all kept; kernel ridge regression, each language against
    the rest, is solved on them. As scores are linear in presence, kernels
    and coefficients fold into one weight a language for each n-gram. A
    fifth of the other rows is held out for the accuracy in held_out. Rows
    without id, text or language are left out; ties in the hash go by id and
    text. None where there is no labelled text.
    """
    labelled = docs.where(col(lang_col).isNotNull() & col(id_col).isNotNull() & (F.length(col(text_col)) > 0)).select(col(id_col).alias("_id"), col(lang_col).cast("string").alias("_l"), col(text_col).cast("string").alias("_t"))
    counts = {r["_l"]: r["n"] for r in labelled.groupBy("_l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, (2 * per_language + 200) / n)))])
    unit = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    drawn = labelled.withColumn("_u", unit).where(F.col("_u") < share[F.col("_l")])  # some 2 * per_language + 200 rows of each
    taken = drawn.withColumn("_n", F.row_number().over(Window.partitionBy("_l").orderBy("_u", "_id", "_t"))).where(F.col("_n") <= per_language)
    got = taken.select("_l", "_n", "_t").toArrow().sort_by([("_l", "ascending"), ("_n", "ascending")])
    names = sorted(counts)
    y = np.searchsorted(np.array(names), np.array(got["_l"].to_pylist()))
    rank = got["_n"].to_numpy() - 1
    mark, held = rank < landmarks, (rank >= landmarks) & (rank % 5 == 0)
    data, off = content(got["_t"].cast(pa.large_string()).combine_chunks())
    text = lambda i: (data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))
    spectrum = Spectrum(np.unique(np.concatenate([np.unique(codes(*text(i))[1]) for i in np.flatnonzero(mark)] or [np.zeros(0, np.uint64)])))
    if not len(spectrum.vocabulary):
        return None
    own = [spectrum.presence(*text(i)) for i in range(len(y))]
    at_mark = np.zeros((len(spectrum.vocabulary), int(mark.sum())), np.uint8)
    for j, i in enumerate(np.flatnonzero(mark)):
        at_mark[own[i][1], j] = 1
    size = np.array([max(1, x[2][0]) for x in own], np.float64)
    kernel = np.stack([at_mark[x[1]].sum(0, dtype=np.int64) for x in own]) / np.sqrt(size[:, None] * size[mark][None, :])
    fit = ~held
    target = np.where(y[fit][:, None] == np.arange(len(names)), 1.0, -1.0)
    weigh = 1 / np.sqrt(np.bincount(y[fit], minlength=len(names)))[y[fit]][:, None]
    k_nm, k_mm = kernel[fit] * weigh, kernel[mark]
    alpha = np.linalg.solve(k_nm.T @ k_nm + ridge * len(names) * k_mm + 1e-8 * np.eye(len(k_mm)), k_nm.T @ (target * weigh))
    model = LanguageModel(names, spectrum, at_mark @ (alpha / np.sqrt(size[mark])[:, None]), {})
    if held.any():
        model.held_out.update(rows=int(held.sum()), accuracy=float(((kernel[held] @ alpha).argmax(1) == y[held]).mean()))
    return model


def identify_language(docs: DataFrame, model: LanguageModel | None, *, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """The language of every row; map-only.

    Result: (id_col, language, score, margin, accepted), with keep_columns
    the columns of docs instead of id_col, less any that clash with the rest.
    language is the best of the one-versus-rest scores, margin its lead; accepted where the
    score reaches LEAST and the margin LEAD. A null or empty text, one that
    shares no n-gram with the landmarks, and any text where there is no
    model have language ``und``, score -1, margin 0 and aren't accepted.
    With one language alone the margin is the score plus 1. Ties go to the
    first language in order. Rows that repeat are scored each, the longest
    texts whole; an empty table gives an empty one.
    """
    added = ["language", "score", "margin", "accepted"]
    kept = [c for c in docs.columns if c.lower() not in added] if keep_columns else [id_col]
    columns, kinds = numbered(docs, kept)
    own = docs.select(*columns, col(text_col).cast("string").alias("text"))
    schema = f"{kinds}, language string, score double, margin double, accepted boolean"
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part in slices(batches, "text", 1 << 20):
            n = part.num_rows
            if m is None:
                best, top, lead = np.zeros(n, int), np.full(n, -1.0), np.zeros(n)
            else:
                s = m.scores(*content(part.column(len(kept))))
                best, top = s.argmax(1), s.max(1)
                lead = top - np.partition(s, -2, axis=1)[:, -2] if s.shape[1] > 1 else top + 1
            known = top > -1
            names = np.array([*(m.languages if m else []), "und"], dtype=object)[np.where(known, best, -1)]
            yes = known & (top >= LEAST) & (lead >= LEAD)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array(names, pa.string()), pa.array(top), pa.array(np.where(known, lead, 0.0)), pa.array(yes)], names=[*(f"c{i}" for i in range(len(kept))), *added])
        trim()

    return own.mapInArrow(run, schema).toDF(*kept, *added)
