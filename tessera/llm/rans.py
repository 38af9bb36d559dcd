"""A static range asymmetric numeral system over shared frequencies, with interleaved lanes in numpy."""

from __future__ import annotations

import zlib

import numpy as np

#: Frequencies add up to 2**SCALE; states are 63 bits and give or take 32 at a time.
SCALE, LANES, EVERY = 20, 1024, 128
_M, _LEAST, _WORD = np.uint64(1 << SCALE), np.uint64(1 << 31), np.uint64(32)


class Table:
    """Frequencies of symbols 0 .. n-1; those that never occur have none and can't be encoded."""

    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq, np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)]).astype(np.uint64)[:-1]
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        if len(self.symbol) != 1 << SCALE:
            raise ValueError("frequencies don't add up")

    @classmethod
    def fit(cls, counts: np.ndarray) -> Table:
        counts = np.asarray(counts, np.float64)
        if not counts.sum():
            counts = np.append(np.zeros(max(0, len(counts) - 1)), 1.0)
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts / counts.sum() * (1 << SCALE))), 0).astype(np.int64)
        over = int(freq.sum()) - (1 << SCALE)
        for k in np.argsort(-freq, kind="stable"):  # the most frequent give way, or get what is left
            take = min(over, int(freq[k]) - 1) if over > 0 else over
            freq[k] -= take
            over -= take
            if not over:
                break
        if over:
            raise ValueError("more symbols than the scale has room for")
        return cls(freq)


def encode(ids: np.ndarray, table: Table) -> dict[str, bytes | int]:
    """n, states, words, checksum, and checkpoints (words read and states before every EVERY-th step)."""
    n = len(ids)
    steps = -(-n // LANES)
    pad = int(table.freq.argmax())
    grid = np.concatenate([np.asarray(ids, np.int64), np.full(steps * LANES - n, pad)]).reshape(steps, LANES)
    f, c = table.freq[grid], table.cum[grid]
    if n and not f.all():
        raise ValueError("a symbol that the table lacks")
    most = f << np.uint64(63 - SCALE)
    x = np.full(LANES, _LEAST, np.uint64)
    chunks, marks = [], []
    for t in range(steps - 1, -1, -1):
        if (t + 1) % EVERY == 0 and t + 1 < steps:
            marks.append((len(chunks), x.copy()))
        out = x >= most[t]
        chunks.append(x[out].astype(np.uint32))
        x = np.where(out, x >> _WORD, x)
        q = x // f[t]
        x = q * _M + (x - q * f[t]) + c[t]
    size = np.array([len(k) for k in chunks[::-1]], np.int64)
    read = np.concatenate([[0], np.cumsum(size)])
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    points = [np.concatenate([[np.uint64(read[steps - k])], s]) for k, s in marks[::-1]]
    return {"n": n, "states": x.tobytes(), "words": words.astype("<u4").tobytes(), "points": (np.concatenate(points) if points else np.zeros(0, np.uint64)).astype("<u8").tobytes(), "crc": checksum(ids)}


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids).astype("<u4").tobytes())


def decode(block: dict, table: Table, point: int = 0) -> np.ndarray:
    """All ids from a checkpoint on (0: the beginning); from the beginning the checksum is verified."""
    n, steps = block["n"], -(-block["n"] // LANES)
    words, at = np.frombuffer(block["words"], "<u4").astype(np.uint64), 0
    if point:
        mark = np.frombuffer(block["points"], "<u8").reshape(-1, LANES + 1)[point - 1]
        at, x = int(mark[0]), mark[1:].astype(np.uint64)
    else:
        x = np.frombuffer(block["states"], "<u8").astype(np.uint64)
    out = np.empty((steps - point * EVERY, LANES), np.uint32)
    for t in range(len(out)):
        slot = x & (_M - np.uint64(1))
        s = table.symbol[slot.astype(np.int64)]
        out[t] = s
        x = table.freq[s] * (x >> np.uint64(SCALE)) + slot - table.cum[s]
        low = np.flatnonzero(x < _LEAST)
        x[low] = (x[low] << _WORD) | words[at : at + len(low)]
        at += len(low)
    ids = out.reshape(-1)[: n - point * EVERY * LANES]
    if not point and checksum(ids) != block["crc"]:
        raise ValueError("a block's checksum doesn't hold")
    return ids
