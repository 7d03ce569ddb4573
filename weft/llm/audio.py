"""Telephony audio columns: G.711 and IMA ADPCM to resampled 16-bit PCM."""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._text import col, content, slices, trim

#: Taps of the resampling filter at the lower of the two rates.
TAPS = 16


def _mulaw() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int64) & 255
    mag = (((u & 15) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -mag, mag).astype(np.int16)


def _alaw() -> np.ndarray:
    a = np.arange(256, dtype=np.int64) ^ 85
    exp, low = (a >> 4) & 7, (a & 15) << 4
    mag = np.where(exp == 0, low + 8, (low + 264) << np.maximum(exp - 1, 0))
    return np.where(a & 128, mag, -mag).astype(np.int16)


MULAW, ALAW = _mulaw(), _alaw()
#: The 89 step sizes of IMA ADPCM: each is about 1.1 times the one before it.
STEPS = np.array([int(x) for x in "7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767".split()], np.int32)
MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: What a code adds at a step index, and the index after it; row: index, column: code.
_c = np.arange(16)
_d = (STEPS[:, None] >> 3) + (STEPS[:, None] >> 2) * (_c & 1) + (STEPS[:, None] >> 1) * ((_c >> 1) & 1) + STEPS[:, None] * ((_c >> 2) & 1)
DELTA = np.where(_c & 8, -_d, _d).astype(np.int32).ravel()
NEXT = np.clip(np.arange(89)[:, None] + MOVE, 0, 88).astype(np.int32).ravel()


def adpcm(data: np.ndarray, off: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Decode rows of IMA ADPCM blocks (mono, WAV layout), all blocks at once.

    A block has its first sample (16 bits), a step index, a reserved byte,
    then two codes a byte, the low one first. A last block that is cut off
    gives the samples it has; under 4 bytes of one give none. A step index
    over 88 counts as 88.

    Returns the samples of all rows and the offsets of the rows in them.
    """
    size = np.diff(off)
    whole, rest = size // block, size % block
    count = whole + (rest >= 4)
    row = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = off[row] + k * block
    length = np.where(k < whole[row], block, rest[row])
    n = 1 + 2 * (length - 4)
    per = np.bincount(row, n, len(size)).astype(np.int64) if len(row) else np.zeros(len(size), np.int64)
    out_off = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(int(out_off[-1]), np.int16)
    if not len(row):
        return out, out_off
    put = np.cumsum(n) - n
    order = np.argsort(-length, kind="stable")
    at, put, length = at[order], put[order], length[order]
    pred = (data[at].astype(np.int32) | (data[at + 1].astype(np.int32) << 8)).astype(np.int16).astype(np.int32)
    idx = np.minimum(data[at + 2], 88).astype(np.int32)
    out[put] = pred
    live = np.searchsorted(-length, -np.arange(4, int(length.max())), "left")
    for j, m in zip(range(4, int(length.max())), live):  # the blocks that reach byte j come first
        byte = data[at[:m] + j]
        for half in (0, 1):
            code = idx[:m] * 16 + ((byte >> (4 * half)) & 15)
            p = np.clip(pred[:m] + DELTA[code], -32768, 32767)
            pred[:m] = p
            idx[:m] = NEXT[code]
            out[put[:m] + (2 * (j - 4) + half + 1)] = p
    return out, out_off


def bank(rate: int, to: int) -> tuple[int, int, np.ndarray]:
    """(up, down, filters): a Hann-windowed sinc for each of the up phases, each with sum 1.

    The window is TAPS samples of the lower rate wide, so a filter that goes
    down in rate is as many times longer as the rates differ, and what lies
    above half the new rate is taken out.
    """
    g = gcd(rate, to)
    up, down = to // g, rate // g
    cut = min(1.0, to / rate)
    half = -(-TAPS * max(rate, to) // (2 * to)) if rate > to else TAPS // 2
    x = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    h = cut * np.sinc(cut * x) * (0.5 + 0.5 * np.cos(np.pi * x / half))
    h[np.abs(x) >= half] = 0
    return up, down, (h / h.sum(1, keepdims=True)).astype(np.float32)


def resample(pcm: np.ndarray, off: np.ndarray, rate: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of PCM at another rate, ceil(n * to / rate) samples each; silence lies beyond the ends.

    Rows are laid out with gaps of silence between them, so that one strided
    multiply-add a tap serves all rows.
    """
    if rate == to:
        return pcm, off
    up, down, h = bank(rate, to)
    taps = h.shape[1]
    n = np.diff(off)
    slot = -(-(n + taps) // down) * down
    base = np.concatenate([[0], np.cumsum(slot)])
    lead = taps // 2 - 1
    x = np.zeros(int(base[-1]) + 2 * taps + down, np.float32)
    inside = np.arange(len(pcm)) + np.repeat(base[:-1] - off[:-1], n) + lead
    x[inside] = pcm
    full = int(base[-1]) * up // down
    y = np.empty(full, np.int16)
    for r in range(up):
        m = (full - r + up - 1) // up
        start, phase = r * down // up, r * down % up
        acc = np.zeros(m, np.float32)
        for k in range(taps):
            if h[phase, k]:
                acc += h[phase, k] * x[start + k : start + k + (m - 1) * down + 1 : down]
        np.rint(acc, out=acc)
        y[r::up] = np.clip(acc, -32768, 32767)
    want = -(-(n * up) // down)
    out_off = np.concatenate([[0], np.cumsum(want)])
    return y[np.arange(int(out_off[-1])) + np.repeat(base[:-1] * up // down - out_off[:-1], want)], out_off


def _chunk(batch: pa.RecordBatch, to: int, block: int) -> pa.RecordBatch:
    codec = np.array([c or "" for c in batch.column("codec").to_pylist()], dtype=object)
    rate = np.array([r or 0 for r in batch.column("rate").to_pylist()], np.int64)
    payload = batch.column("payload")
    given = np.array(payload.is_valid()) & (rate > 0) & np.isin(codec, ["mulaw", "alaw", "ima_adpcm"])
    n = batch.num_rows
    where: dict[int, tuple[np.ndarray, int, int]] = {}
    for c, r in sorted({(codec[i], int(rate[i])) for i in np.flatnonzero(given)}):
        own = np.flatnonzero(given & (codec == c) & (rate == r))
        data, off = content(payload.take(pa.array(own)))
        pcm, at = adpcm(data, off, block) if c == "ima_adpcm" else ((MULAW if c == "mulaw" else ALAW)[data], off)
        pcm, at = resample(pcm, at, r, to)
        where |= {int(i): (pcm, int(at[j]), int(at[j + 1])) for j, i in enumerate(own)}
    empty = np.zeros(0, np.int16)
    parts = [where.get(i, (empty, 0, 0)) for i in range(n)]
    count = np.array([b - a for _, a, b in parts], np.int64)
    values = np.concatenate([p[a:b] for p, a, b in parts]) if n else empty
    off = np.concatenate([[0], np.cumsum(2 * count)])
    if off[-1] >= 1 << 31:
        raise ValueError("a call has over 2 GB of PCM")
    off = off.astype(np.int32)
    mask = pa.array(given)
    bits = mask.buffers()[1]
    pcm = pa.Array.from_buffers(pa.binary(), n, [bits, pa.py_buffer(off), pa.py_buffer(values.astype("<i2", copy=False))])
    said = np.where(given, "ok", np.where(np.array(payload.is_valid()), "unsupported", "missing"))
    return pa.record_batch(
        [batch.column("id"), batch.column("codec"), pa.array(said), pa.array(np.full(n, to, np.int32)), pa.array(count, mask=~given), pcm],
        names=["id", "codec", "status", "sample_rate", "n_samples", "pcm"],
    )


def decode_telephony(df: DataFrame, *, id_col: str = "doc_id", codec_col: str = "codec", rate_col: str = "rate", payload_col: str = "payload", to_rate: int = 16000, block: int = 256) -> DataFrame:
    """Decode and resample a column of telephony audio; map-only.

    codec_col has ``mulaw``, ``alaw`` or ``ima_adpcm`` (mono WAV blocks of
    ``block`` bytes), rate_col the sampling rate, payload_col the bytes.

    Result: (id_col, codec, status, sample_rate, n_samples, pcm), a row for
    each row. status is ``ok``; ``missing`` where the payload is null; or
    ``unsupported`` where codec or rate is null, unknown or not positive; in
    the last two pcm and n_samples are null. An empty payload gives empty
    pcm. Repeated rows and null ids stay as they are, and an empty table
    gives an empty one; there are no ties. A call is decoded whole, up to the
    2 GB of PCM that a cell holds, beyond which it is an error. Other
    columns, also such as are called like those of the result, are left out.
    """
    if block < 5:
        raise ValueError("a block has 4 bytes of header and some of codes")
    kind = df.schema[id_col].dataType.simpleString()
    own = df.select(col(id_col).alias("id"), col(codec_col).cast("string").alias("codec"), col(rate_col).cast("int").alias("rate"), col(payload_col).cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "payload", 1 << 20):
            yield _chunk(part, to_rate, block)
        trim()

    return own.mapInArrow(run, f"id {kind}, codec string, status string, sample_rate int, n_samples bigint, pcm binary").withColumnRenamed("id", id_col)


def documents_as_calls(docs: DataFrame) -> DataFrame:
    """The media table of the query: each document's bytes as 8 kHz codes, the codec by doc_id in turn."""
    turn = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3))
    return docs.select("doc_id", F.when(turn == 0, "mulaw").when(turn == 1, "alaw").otherwise("ima_adpcm").alias("codec"), F.lit(8000).alias("rate"), F.encode("text", "UTF-8").alias("payload"))
