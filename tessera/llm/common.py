"""What the corpus operators share: the shared folder, packed blobs, and text as numpy arrays.

Documents are keyed by (doc_id, hash of text), so a repeated row is the same document and rows
that reuse a doc_id for another text stay apart. A null doc_id orders before all others.
"""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import scratch

try:  # Large arrays go back to the system when they are freed, also in workers that live on for other stages.
    ctypes.CDLL(None).mallopt(-3, 4 << 20)
except (AttributeError, OSError):
    pass
pa.set_memory_pool(pa.system_memory_pool())

NO_ID = -(2**63)
#: Text bytes that are turned into arrays at once, so that these stay in a processor's cache; all take about 100 times as much.
CHUNK = 1 << 18
U = np.uint64


_held: dict[str, dict] = {}


def held(kind: str) -> dict:
    """What one operator keeps in this process between tasks. Whatever another one kept here is dropped first: workers
    live on from stage to stage."""
    if kind not in _held:
        if _held:
            _held.clear()
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass
        _held[kind] = {}
    return _held[kind]


def workspace(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return scratch(spark, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


#: A worker keeps its compressors: one for each blob would take a megabyte and more each time.
_packers: dict[int, zstandard.ZstdCompressor] = {}
_unpacker: list[zstandard.ZstdDecompressor] = []


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    if level not in _packers:
        _packers[level] = zstandard.ZstdCompressor(level=level)
    return _packers[level].compress(pickle.dumps(arrays, protocol=5))


def unpack(blob: bytes) -> tuple:
    if not _unpacker:
        _unpacker.append(zstandard.ZstdDecompressor())
    return pickle.loads(_unpacker[0].decompress(blob))


def slices(batch: pa.RecordBatch | pa.Table, text: str = "text", limit: int = CHUNK, most: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `limit` bytes of text and `most` rows; one long text is a piece of its own."""
    for b in batch.to_batches() if isinstance(batch, pa.Table) else [batch]:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(piece) + np.diff(np.arange(b.num_rows) // most)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and offsets; a null is empty."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_STATE = np.random.default_rng(20240229)
BYTE_1 = _STATE.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BYTE_2 = _STATE.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_2 = U(0xD6E8FEB86659FD93)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 2**64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(raw: np.ndarray, offsets: np.ndarray, second: bool = False):
    """Words [^\\x20\\x09-\\x0D]+ : start, end, document index, hash (and another hash).

    No word runs over a document's end."""
    if not len(raw):
        none, no = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return none, none, none, no, no
    is_word = ~SPACE[raw]
    begin = is_word.copy()
    begin[1:] &= ~is_word[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(raw)]
    begin[edge] = is_word[edge]
    start = np.flatnonzero(begin)
    if not len(start):
        none, no = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return none, none, none, no, no
    at = np.flatnonzero(is_word)
    word = np.cumsum(begin)[at] - 1
    count = np.bincount(word, minlength=len(start))
    end = start + count
    within = at - start[word]
    first = np.zeros(len(start), np.int64)
    np.cumsum(count[:-1], out=first[1:])
    chars = raw[at]
    n = int(count.max())
    h1 = mix(np.add.reduceat(BYTE_1[chars] * powers(BASE, n)[within], first) + count.astype(np.uint64))
    h2 = mix(np.add.reduceat(BYTE_2[chars] * powers(BASE_2, n)[within], first)) if second else h1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return start, end, doc, h1, h2


def windows(h: np.ndarray, n: int, base: np.uint64 = BASE) -> np.ndarray:
    """Polynomial hashes of all runs of n neighbours (len(h) - n + 1 of them)."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, step = None, 0, h, 1
    left = n
    while left:
        if left & 1:
            scaled = part[done : done + size]
            out = scaled.copy() if out is None else out + scaled * U(pow(int(base), done, 2**64))
            done += step
        left >>= 1
        if left:
            part = part[:-step] + part[step:] * U(pow(int(base), step, 2**64))
            step *= 2
    return mix(out)


def sliding_argmin(key: np.ndarray, w: int, most: int = 1 << 27) -> np.ndarray:
    """Position of the smallest of each w neighbours, the leftmost of equal ones; keys count to 37 bits."""
    if len(key) < w:
        return np.zeros(0, np.int64)
    if len(key) > most:  # in parts that share w - 1 keys
        return np.concatenate([lo + sliding_argmin(key[lo : lo + most], w, most) for lo in range(0, len(key) - w + 1, most - w + 1)])
    cur = ((key >> U(27)) << U(27)) | np.arange(len(key), dtype=np.uint64)
    step = 1
    while step * 2 <= w:
        cur = np.minimum(cur[:-step], cur[step:])
        step *= 2
    if step < w:
        cur = np.minimum(cur[: len(cur) - (w - step)], cur[w - step :])
    return (cur & U((1 << 27) - 1)).astype(np.int64)


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] of them, then those of start[1], and so on."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count - start, count)


def key_columns(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> list[Column]:
    """`doc` (the id, a null as NO_ID) and `tx` (hash of the text): together the key of a document."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID).cast("long")).alias("doc"), F.xxhash64(F.col(text)).alias("tx")]
