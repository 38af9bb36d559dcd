"""What the two operators on repeated windows share: cutting texts at minimisers, and packed exchanges.

A window is `length` consecutive units (words or bytes) of one document. Its minimiser is the k-mer of units
inside it that ranks first by a hash (the leftmost of equal ones), so equal windows have equal minimisers.
Consecutive windows with one minimiser form a run. K-mers of cells that hold more than HOT times the mean
count rank after all others, so what surrounds a frequent passage is not dealt by that passage.

Rows travel packed: each task sends one compressed blob to each bucket, and a group of documents gets one
blob of each bucket. Of equal runs a task sends the first only; what a document is not told about a run
of its own means that the run's windows all started earlier elsewhere.

A document is named by doc_id and a 64-bit hash of its text, and dealt to groups by both: repeated rows are one
document, rows that reuse a doc_id or have none stay apart. A null doc_id orders before all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BASE_2, BYTE_1, BYTE_2, NO_ID, U, expand, flat, held, inverse, mix, pack, partitions, powers, slices, sliding_argmin, unpack, windows, words

CELLS, HOT = 1 << 16, 16
#: Documents are dealt to groups by doc_id and hash modulo this prime, scrambled: the same in Spark and in numpy.
PRIME = 2_147_483_647
#: Bytes of text whose runs a task packs at once.
FLUSH = 12 << 20


@dataclass(frozen=True)
class Rule:
    unit: str
    length: int
    k: int


@dataclass
class Units:
    """Units of some texts: `buf` has them on end (words with a blank after each), `at` their bounds in it."""

    buf: np.ndarray
    at: np.ndarray
    doc: np.ndarray
    h1: np.ndarray
    h2: np.ndarray | None
    first: np.ndarray  # of each document, and the end


def units(raw: np.ndarray, offsets: np.ndarray, unit: str, second: bool) -> Units:
    n = len(offsets) - 1
    if unit == "byte":
        doc = np.repeat(np.arange(n), np.diff(offsets))
        return Units(raw, np.arange(len(raw) + 1), doc, BYTE_1[raw], BYTE_2[raw] if second else None, offsets)
    start, end, doc, h1, h2 = words(raw, offsets, second)
    size = end - start + 1
    at = np.concatenate([[0], np.cumsum(size)])
    buf = raw[np.minimum(expand(start, size), max(0, len(raw) - 1))]
    buf[at[1:] - 1] = 0x20
    return Units(buf, at, doc, h1, h2 if second else None, np.searchsorted(doc, np.arange(n + 1)))


@dataclass
class Runs:
    s: np.ndarray  # first window, by its first unit
    c: np.ndarray  # windows
    key: np.ndarray  # hash of the minimiser


def runs(u: Units, rule: Rule, hot: np.ndarray) -> Runs:
    n = len(u.doc) - rule.length + 1
    held("repeats")
    none = np.zeros(0, np.int64)
    if n <= 0:
        return Runs(none, none, none.astype(np.uint64))
    kmer = windows(u.h1, rule.k)
    rank = (mix(kmer) >> U(1)) | (hot[(kmer >> U(48)).astype(np.int64)].astype(np.uint64) << U(63))
    place = sliding_argmin(rank, rule.length - rule.k + 1)
    w = np.flatnonzero(u.doc[:n] == u.doc[rule.length - 1 :])
    if not len(w):
        return Runs(none, none, none.astype(np.uint64))
    place = place[w]
    begin = np.ones(len(w), bool)
    begin[1:] = place[1:] != place[:-1]
    at = np.flatnonzero(begin)
    return Runs(w[at], np.diff(np.append(at, len(w))), kmer[place[at]])


_tables: dict[int, tuple] = {}


def range_hashes(h: np.ndarray, a: np.ndarray, b: np.ndarray, base: np.uint64) -> np.ndarray:
    """A hash of h[a:b] for each a, b, by prefix sums."""
    have = _tables.get(int(base))
    if have is None or len(have[0]) <= len(h):
        size = max(1 << 19, len(h) + 1)
        _tables[int(base)] = have = (powers(base, size), powers(inverse(base), size))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * have[0][: len(h)])])
    return mix((total[b] - total[a]) * have[1][a] + (b - a).astype(np.uint64))


def hot_cells(docs: DataFrame, rule: Rule) -> np.ndarray:
    """Which cells of k-mer hashes are frequent, counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(CELLS, np.int64)
        for batch in batches:
            for b in slices(batch):
                raw, offsets = flat(b.column("text"))
                u = units(raw, offsets, rule.unit, False)
                kmer = windows(u.h1, rule.k)
                if len(kmer):
                    inside = u.doc[: len(kmer)] == u.doc[rule.k - 1 :]
                    count += np.bincount((kmer[inside] >> U(48)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(count[at])], names=["cell", "n"])

    found = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    hot = np.zeros(CELLS, bool)
    if len(found):
        hot[found.cell[found.n > HOT * found.n.sum() / CELLS].to_numpy(np.int64)] = True
    return hot


def n_buckets(df: DataFrame) -> int:
    return 2 * partitions(df.sparkSession)


def n_groups(df: DataFrame) -> int:
    return partitions(df.sparkSession)


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc, tag, grp (by which documents are dealt) and text, and further columns by number (c0, c1 ...)."""
    doc, tag = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")), F.xxhash64("text")
    grp = (F.pmod(doc, F.lit(PRIME)) * 48_271 + F.pmod(tag, F.lit(PRIME)) * 16_807) % PRIME % n_groups(docs)
    return docs.select(doc.alias("doc"), tag.alias("tag"), grp.cast("int").alias("grp"), "text", *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)])


def group_of(doc: np.ndarray, tag: np.ndarray, groups: int) -> np.ndarray:
    return (np.mod(doc, np.int64(PRIME)) * 48_271 + np.mod(tag, np.int64(PRIME)) * 16_807) % PRIME % groups


def order(doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.lexsort((at, tag, doc))


def dealt(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of key and where it is, in order."""
    o = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[o])) + 1
    for part in np.split(o, cut):
        if len(part):
            yield int(key[part[0]]), part


def delta(doc: np.ndarray) -> np.ndarray:
    return np.diff(doc, prepend=np.int64(0))


def blob_batch(name: str, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=[name, "blob"])


def packed_slices(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return buf[expand(lo, hi - lo)]


def joined(blobs: list[bytes]) -> list[np.ndarray]:
    """The arrays of all blobs on end, the first two of each being differences (of doc and tag)."""
    parts = [unpack(b) for b in blobs]
    out = [np.concatenate([np.cumsum(p[k]) for p in parts]) for k in (0, 1)]
    return out + [np.concatenate(x) for x in list(zip(*parts))[2:]]


def name_hash(doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(mix(mix(doc.astype(np.int64).view(np.uint64)) + tag.astype(np.int64).view(np.uint64)) + at.astype(np.uint64))


class Known:
    """What the documents of a group were told of their runs, by document and first window."""

    def __init__(self, blobs: list[bytes]):
        got = joined(blobs) if blobs else None
        if got is None:
            self.key, self.value = np.zeros(0, np.uint64), []
            return
        key = name_hash(*got[:3])
        o = np.argsort(key, kind="stable")
        self.key, self.value = key[o], [v[o] for v in got[3:]]

    def find(self, doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each run is known, and where."""
        key = name_hash(doc, tag, at)
        i = np.searchsorted(self.key, key)
        i = np.minimum(i, max(0, len(self.key) - 1))
        return (self.key[i] == key if len(self.key) else np.zeros(len(key), bool)), i


def first_of_equal(*keys: np.ndarray) -> np.ndarray:
    """Which rows are the first with their keys, in the order given."""
    o = np.lexsort((np.arange(len(keys[0])), *keys[::-1]))
    new = np.zeros(len(o), bool)
    if len(o):
        new[0] = True
        for k in keys:
            new[1:] |= k[o][1:] != k[o][:-1]
    out = np.zeros(len(o), bool)
    out[o[new]] = True
    return out


def grouped(df: DataFrame, by: str, work: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]], schema: str, empty: pa.Schema) -> DataFrame:
    """work(key, blobs) of each group of (by, blob)."""

    def run(t: pa.Table) -> pa.Table:
        out = list(work(t.column(by)[0].as_py(), t.column("blob").to_pylist()))
        return pa.Table.from_batches(out) if out else empty.empty_table()

    return df.groupBy(by).applyInArrow(run, schema)


def covered(dup: np.ndarray, length: int, n_units: int) -> np.ndarray:
    """Which units lie in a window that begins at one of `dup`."""
    step = np.bincount(dup, minlength=n_units + 1) - np.bincount(dup + length, minlength=n_units + 1)
    return np.cumsum(step[:-1]) > 0


def base_hashes(u: Units, r: Runs, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    end = r.s + r.c + rule.length - 1
    return range_hashes(u.h1, r.s, end, BASE), range_hashes(u.h2, r.s, end, BASE_2)
