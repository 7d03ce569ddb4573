"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from weft.llm._text import col, content, hashes, numbered, slices, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Chunks whose encodings a worker remembers.
REMEMBERED = 1 << 19
#: Bytes up to which spans are searched abreast, and positions of a longer one that walk the trie together.
LONG, BLOCK = 256, 1 << 17


def _fields(raw: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, kind, raw[at : at + n]
            at += n


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each id of a SentencePiece model file."""
    out = []
    with open(path, "rb") as f:
        raw = f.read()
    for number, _, value in _fields(raw):
        if number == 1:
            own = {n: v for n, _, v in _fields(value)}
            out.append((own.get(1, b"").decode(), float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]), own.get(3, NORMAL)))
    return out


@dataclass(frozen=True)
class Pieces:
    """Pieces as a double array. A state's transition on byte b is base + b + 1, valid where check is the state."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray
    deepest: int
    unknown: float
    byte_id: np.ndarray
    text: np.ndarray
    text_off: np.ndarray
    raw: np.ndarray = field(repr=False)


def zipf(pieces: list[tuple[str, float, int]]) -> list[float]:
    """Log scores by rank for a vocabulary ordered by merges: log of a Zipf law over its ordinary pieces."""
    ordinary = [i for i, p in enumerate(pieces) if p[2] == NORMAL]
    total = np.log((1 / np.arange(1, len(ordinary) + 1)).sum()) if ordinary else 0.0
    out = [0.0] * len(pieces)
    for rank, i in enumerate(ordinary, 1):
        out[i] = float(np.float32(-np.log(rank) - total))
    return out


def build(path: str = MODEL, scores: str = "zipf") -> Pieces:
    """The trie of a model file. scores: ``zipf``, for files whose scores are merge ranks, or ``file``."""
    pieces = read_pieces(path)
    score = np.array(zipf(pieces) if scores == "zipf" else [p[1] for p in pieces], np.float32)
    keys: dict[bytes, int] = {}
    for i, (s, _, kind) in enumerate(pieces):
        if kind == NORMAL and s:
            if MARK in s.lstrip(MARK):
                raise ValueError(f"piece {i} has the marker inside; texts couldn't be cut before markers")
            keys.setdefault(s.replace(MARK, " ").encode(), i)
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, i in keys.items():
        at = 0
        for b in key:
            if b not in children[at]:
                children[at][b] = len(children)
                children.append({})
                ends.append(-1)
            at = children[at][b]
        ends[at] = i
    size = 8 * len(children) + 4096
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    taken, free, wide, place = bytearray(size), 1, 0, [0] * len(children)
    taken[0] = 1
    for node in range(len(children)):  # parents come before their children
        state, own = place[node], sorted(children[node])
        value[state] = ends[node]
        if not own:
            continue
        if len(own) == 1:  # fills gaps
            while taken[free] or free <= own[0]:
                free += 1
            at = free - own[0] - 1
        else:
            at = wide
            while any(taken[at + b + 1] for b in own):
                at += 1
            wide = at
        base[state] = at
        for b in own:
            taken[at + b + 1] = 1
            check[at + b + 1] = state
            place[children[node][b]] = at + b + 1
    size = max(place) + 258
    byte_id = np.full(256, next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0), np.int64)
    texts, raw = [], np.zeros(len(pieces), bool)
    for i, (s, _, kind) in enumerate(pieces):
        if kind == BYTE:
            byte_id[int(s[3:5], 16)] = i
            texts.append(bytes([int(s[3:5], 16)]))
            raw[i] = True
        else:
            texts.append(b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else s.replace(MARK, " ").encode())
    ordinary = score[[p[2] == NORMAL for p in pieces]]
    return Pieces(base[:size], check[:size], value[:size], score, max(map(len, keys)), float(np.float32(ordinary.min()) - np.float32(UNKNOWN_PENALTY)), byte_id, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), raw)


def viterbi(p: Pieces, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentations of byte spans, all spans abreast: (ids, offsets of the spans in them).

    Among equal scores the piece that begins first wins. A character that no
    single-character piece covers may also be taken as unknown; it then
    gives the ids of its bytes.
    """
    length = end - begin
    order = np.argsort(-length, kind="stable")
    at, n = begin[order], length[order]
    slot = np.concatenate([[0], np.cumsum(n + 1)])[:-1]
    best = np.full(int((n + 1).sum()), -np.inf, np.float32)
    back = np.zeros(len(best), np.int32)
    pick = np.full(len(best), -1, np.int32)
    best[slot] = 0
    longest = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(longest), "left") if longest else []
    for pos in range(longest):
        own = np.flatnonzero(best[slot[: live[pos]] + pos] > -np.inf)  # spans that reach a piece's end here
        if not len(own):
            continue
        left = n[own] - pos
        first = data[at[own] + pos]
        char = np.minimum(np.where(first < 192, 1, np.where(first < 224, 2, np.where(first < 240, 3, 4))), left)
        score, single = best[slot[own] + pos], np.zeros(len(own), bool)
        state, row, deep = np.zeros(len(own), np.int64), np.arange(len(own)), 0
        while len(row):
            to = p.base[state] + data[at[own[row]] + pos + deep] + 1
            ok = p.check[to] == state
            row, state = row[ok], to[ok]
            deep += 1
            v = p.value[state]
            hit = v >= 0
            if hit.any():
                r, v = row[hit], v[hit]
                single[r[char[r] == deep]] = True
                cell, s = slot[own[r]] + pos + deep, score[r] + p.score[v]
                up = s > best[cell]
                best[cell[up]], back[cell[up]], pick[cell[up]] = s[up], pos, v[up]
            more = left[row] > deep
            row, state = row[more], state[more]
        rest = np.flatnonzero(~single)
        if len(rest):
            cell, s = slot[own[rest]] + pos + char[rest], score[rest] + np.float32(p.unknown)
            up = s > best[cell]
            best[cell[up]], back[cell[up]], pick[cell[up]] = s[up], pos, -1
    spans, ids, rank = [], [], []
    cur, row, step = n.copy(), np.flatnonzero(n > 0), 0
    while len(row):  # back from the ends, all spans at once
        cell = slot[row] + cur[row]
        prev, v = back[cell], pick[cell]
        size = np.where(v >= 0, 1, cur[row] - prev)
        for k in range(int(size.max())):
            has = size > k
            spans.append(row[has])
            ids.append(np.where(v[has] >= 0, v[has], p.byte_id[data[at[row[has]] + cur[row[has]] - 1 - k]]))
            rank.append(np.full(int(has.sum()), step))
            step += 1
        cur[row] = prev
        row = row[prev > 0]
    count = np.zeros(len(n), np.int64)
    if spans:
        span, tok, rank = order[np.concatenate(spans)], np.concatenate(ids), np.concatenate(rank)
        by = np.lexsort((-rank, span))
        count = np.bincount(span, minlength=len(n))
        return tok[by].astype(np.int32), np.concatenate([[0], np.cumsum(count)])
    return np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(count)])


def viterbi_long(p: Pieces, data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The best segmentation of one long span, in time that grows with its length.

    A block of positions walks the trie abreast; the pieces found there are
    then relaxed one after another, with sums in double precision. Ties go
    as in viterbi().
    """
    n = end - begin
    best, back, pick = array("d", [-np.inf]) * (n + 1), array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
    best[0] = 0.0
    text = data[begin:end]
    heads = np.flatnonzero((text & 192) != 128)
    width = np.diff(np.append(heads, n))
    for lo in range(0, len(heads), BLOCK):
        own, wide = heads[lo : lo + BLOCK], width[lo : lo + BLOCK]
        state, row, deep = np.zeros(len(own), np.int64), np.arange(len(own)), 0
        single = np.zeros(len(own), bool)
        found = []
        while len(row):
            to = p.base[state] + text[own[row] + deep] + 1
            ok = p.check[to] == state
            row, state = row[ok], to[ok]
            deep += 1
            hit = p.value[state] >= 0
            found.append((row[hit], np.full(int(hit.sum()), deep), p.value[state[hit]]))
            single[row[hit][wide[row[hit]] == deep]] = True
            more = own[row] + deep < n
            row, state = row[more], state[more]
        r, size, piece = (np.concatenate(x) for x in zip(*found))
        by = np.argsort(r, kind="stable")
        at = np.searchsorted(r[by], np.arange(len(own) + 1)).tolist()
        cell, gain, piece = (own[r] + size)[by].tolist(), p.score[piece[by]].astype(float).tolist(), piece[by].tolist()
        for k, (pos, alone, w) in enumerate(zip(own.tolist(), single.tolist(), wide.tolist())):
            s = best[pos]
            if s == -np.inf:
                continue
            for m in range(at[k], at[k + 1]):
                c = cell[m]
                if s + gain[m] > best[c]:
                    best[c], back[c], pick[c] = s + gain[m], pos, piece[m]
            if not alone and s + p.unknown > best[pos + w]:
                best[pos + w], back[pos + w], pick[pos + w] = s + p.unknown, pos, -1
    out, at = [], n
    while at:
        v, before = pick[at], back[at]
        out += [v] if v >= 0 else p.byte_id[text[before:at]][::-1].tolist()
        at = before
    return np.array(out[::-1], np.int32)


def segment(p: Pieces, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """viterbi() for spans of up to LONG bytes, all abreast, and viterbi_long() for each longer one."""
    long = np.flatnonzero(end - begin > LONG)
    if not len(long):
        return viterbi(p, data, begin, end)
    short = np.flatnonzero(end - begin <= LONG)
    ids, at = viterbi(p, data, begin[short], end[short])
    parts = [viterbi_long(p, data, int(begin[i]), int(end[i])) for i in long]
    start, size = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    start[short], size[short] = at[:-1], np.diff(at)
    size[long] = [len(x) for x in parts]
    start[long] = len(ids) + np.cumsum(size[long]) - size[long]
    return ragged(np.concatenate([ids, *parts]), start, size), np.concatenate([[0], np.cumsum(size)])


def ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start[i]:start[i] + size[i]] for all i, end to end."""
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return values[np.arange(total) + np.repeat(start - (end - size), size)]


class Encoder:
    """Encodes slices of texts, and remembers chunks: what lies between the beginnings of runs of spaces."""

    def __init__(self, pieces: Pieces) -> None:
        self.p = pieces
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store: np.ndarray = np.zeros(0, np.int32)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the rows in them). An empty text has no ids."""
        n = np.diff(off)
        heads = off[:-1][n > 0]
        marked = np.insert(data, heads, 32)  # each text begins with a marker
        new_off = np.concatenate([[0], np.cumsum(n + (n > 0))])
        if len(marked) > 2:
            m = np.flatnonzero((marked[:-2] == 0xE2) & (marked[1:-1] == 0x96) & (marked[2:] == 0x81))
            if len(m):  # a marker in a text is a space
                drop = np.concatenate([m + 1, m + 2])
                marked[m] = 32
                gone = np.zeros(len(marked) + 1, np.int64)
                gone[drop + 1] = 1
                new_off -= np.cumsum(gone)[new_off]
                marked = np.delete(marked, drop)
        if not len(marked):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        space = marked == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[new_off[:-1][n > 0]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(marked))
        first = np.searchsorted(begin, new_off)
        each, example, which = np.unique(hashes(marked, begin, end), return_index=True, return_inverse=True)
        where = np.searchsorted(self.known, each)
        where[where == len(self.known)] = 0
        old = self.known[where] == each if len(self.known) else np.zeros(len(each), bool)
        start, size = np.empty(len(each), np.int64), np.empty(len(each), np.int64)
        if len(self.known):
            start[old], size[old] = self.at[where[old]], self.size[where[old]]
        fresh = np.flatnonzero(~old)
        store = self.store
        if len(fresh):
            ids, at = segment(self.p, marked, begin[example[fresh]], end[example[fresh]])
            start[fresh], size[fresh] = at[:-1] + len(store), np.diff(at)
            store = np.concatenate([store, ids])
            if len(self.known) + len(fresh) <= REMEMBERED:
                self.store = store
                by = np.searchsorted(self.known, each[fresh])
                self.known = np.insert(self.known, by, each[fresh])
                self.at, self.size = np.insert(self.at, by, start[fresh]), np.insert(self.size, by, size[fresh])
        per = size[which]
        total = np.concatenate([[0], np.cumsum(per)])
        return ragged(store, start[which], per), total[first]


def decode(p: Pieces, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of rows of ids: markers become spaces and the first one goes."""
    start, size = p.text_off[ids], np.diff(p.text_off)[ids]
    data = ragged(p.text, start, size)
    total = np.concatenate([[0], np.cumsum(size)])
    out = total[off]
    lead = np.flatnonzero((np.diff(out) > 0) & ~p.raw[ids[np.minimum(off[:-1], max(0, len(ids) - 1))]]) if len(ids) else np.zeros(0, np.int64)
    lead = lead[data[out[lead]] == 32]
    shift = np.zeros(len(out), np.int64)
    shift[lead + 1] = 1
    return np.delete(data, out[lead]), out - np.cumsum(shift)


def encode_pieces(docs: DataFrame, pieces: Pieces, *, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """Unigram token ids of every text, decoded again as a check; map-only.

    Result: (id_col, ids, n_tokens, round_trip), with keep_columns the
    columns of docs instead of id_col, less any that clash. A null text has
    nulls; an empty one no ids. round_trip tells whether decoding gives the
    text's bytes; it doesn't where a text has the marker itself (U+2581),
    which stands for a space. Rows that repeat are encoded each. The longest
    texts are encoded whole, with blanks or without, in time that grows with
    their length. Among segmentations of equal score pieces that begin first
    win. An empty table gives an empty one.
    """
    added = ["ids", "n_tokens", "round_trip"]
    kept = [c for c in docs.columns if c.lower() not in added] if keep_columns else [id_col]
    columns, kinds = numbered(docs, kept)
    own = docs.select(*columns, col(text_col).cast("string").alias("text"))
    schema = f"{kinds}, ids array<int>, n_tokens int, round_trip boolean"
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for part in slices(batches, "text", 1 << 20):
            texts = part.column(len(kept))
            data, off = content(texts)
            ids, at = encoder.encode(data, off)
            back, back_off = decode(encoder.p, ids, at)
            same = np.diff(back_off) == np.diff(off)
            if same.all():
                differ = np.concatenate([[0], np.cumsum(back != data)])
                same = differ[off[1:]] == differ[off[:-1]]
            else:
                same = np.array([s and bool((back[a:b] == data[c:d]).all()) for s, a, b, c, d in zip(same, back_off[:-1], back_off[1:], off[:-1], off[1:])])
            null = ~np.array(texts.is_valid())
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=np.append(null, False)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), lists, pa.array(np.diff(at).astype(np.int32), mask=null), pa.array(same, mask=null)], names=[*(f"c{i}" for i in range(len(kept))), *added])
        trim()

    return own.mapInArrow(run, schema).toDF(*kept, *added)


def decode_pieces(df: DataFrame, pieces: Pieces, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) from token ids; map-only. Null ids give a null text, bytes that aren't UTF-8 U+FFFD."""
    kind = df.schema[id_col].dataType.simpleString()
    own = df.select(col(id_col).alias("id"), col(ids_col).cast("array<int>").alias("ids"))
    sent = df.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for part in batches:
            lists = part.column("ids")
            n = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            data, off = decode(p, ids, np.concatenate([[0], np.cumsum(n)]))
            raw, ok = data.tobytes(), lists.is_valid().to_pylist()
            yield pa.record_batch([part.column("id"), pa.array([raw[a:b].decode("utf-8", "replace") if v else None for a, b, v in zip(off[:-1], off[1:], ok)], pa.string())], names=["id", "text"])

    return own.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
