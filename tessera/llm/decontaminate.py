"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters and digits, ASCII letters lower-cased (other characters as they are). A
mask selects some of its neighbours, so a seed still hits when an ignored token was substituted. The
two masks hit every stretch of SPAN tokens with at most ERRORS substitutions. Around each hit the
benchmark text is laid along the document and matches are counted: it overlaps where some SPAN
neighbours have no more than ERRORS differences (places beyond a document's end differ), or where a whole shorter text stands unchanged.
Benchmark texts under `least` tokens (LEAST unless told otherwise) are no evidence and never match; with a smaller
`least`, texts too short for a mask are looked up as a whole.

Result: a row for each document and benchmark text that overlap: the longest stretch without a gap that such
windows cover on one diagonal, [start, end) in tokens of the document, and the matches in it (of equally long
stretches the one with most matches, then the first). Null texts have no tokens. Documents with equal ids give a row
each, and so do benchmark texts with equal ids; repeated benchmark rows count once. Empty tables give no rows.

The benchmark's index is sent to all tasks only up to `most_bytes` of text; a larger benchmark is
searched in blocks of about that size, each against all documents. A single text above it is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, U, expand, flat, held, mix, slices, words

#: These two hit any 13 tokens with 2 substitutions; tests try all of them.
MASKS = ("11010111", "1011001011")
SPAN, ERRORS, LEAST = 13, 2, 8
BLOCK = 16 << 20
SCHEMA = "doc_id long, item_id long, matches long, start long, end long, item_tokens long"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in range(128):
    if chr(_c).isalnum():
        _FOLD[_c] = ord(chr(_c).lower())


def tokens(col: pa.Array):
    """Hash and document of each token, and token offsets by document."""
    raw, offsets = flat(col)
    _, _, doc, h, _ = words(_FOLD[raw], offsets)
    return h, doc, np.searchsorted(doc, np.arange(len(offsets)))


def seeds(h: np.ndarray, doc: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each place where the mask fits into one document."""
    n = len(mask)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
    out = np.full(len(at), salt, np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out = out * BASE + h[at + k]
    return at, mix(out)


def runs(item_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window and matches asked for, by an item's tokens."""
    w = np.minimum(SPAN, item_len)
    return w, np.where(w == SPAN, w - ERRORS, w)


class Index:
    """Seeds of a block of benchmark texts."""

    def __init__(self, ids: list[int | None], texts: pa.Array, least: int = LEAST):
        self.h, doc, self.offsets = tokens(texts)
        self.ids, self.size = ids, np.diff(self.offsets)
        short = sorted({n for n in self.size.tolist() if max(1, least) <= n < min(map(len, MASKS))})
        #: Masks, and of how many tokens the texts are that each one serves (None: of all that it fits).
        self.masks = [(m, None) for m in MASKS] + [("1" * n, n) for n in short]
        found = [seeds(self.h, doc, mask, k + 1) for k, (mask, _) in enumerate(self.masks)]
        at = np.concatenate([a for a, _ in found])
        key = np.concatenate([k for _, k in found])
        only = np.concatenate([np.full(len(a), n or 0) for (a, _), (_, n) in zip(found, self.masks)])
        ok = (self.size[doc[at]] >= least) & ((only == 0) | (only == self.size[doc[at]])) if len(at) else np.zeros(0, bool)
        order = np.argsort(key[ok], kind="stable")
        self.key, self.at = key[ok][order], at[ok][order]
        self.item = doc[self.at]
        bits = min(26, max(10, int(np.ceil(np.log2(len(self.key) + 1))) + 5))
        self.shift = U(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(self.key >> self.shift).astype(np.int64)] = True

    def search(self, texts: pa.Array):
        """Document, item, matches, start and end of each overlap; ends count in a document's tokens."""
        held("decontaminate")
        h, doc, offsets = tokens(texts)
        pairs = []
        for m, (mask, _) in enumerate(self.masks):
            at, key = seeds(h, doc, mask, m + 1)
            may = self.maybe[(key >> self.shift).astype(np.int64)]
            at, key = at[may], key[may]
            lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
            entry, place = expand(lo, hi - lo), np.repeat(at, hi - lo)
            pairs.append(np.stack([doc[place], self.item[entry], place - offsets[doc[place]] - (self.at[entry] - self.offsets[self.item[entry]])], 1))
        lines = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 3), np.int64)
        out = []
        cost = np.cumsum(self.size[lines[:, 1]]) // 1_000_000
        for part in np.split(lines, np.flatnonzero(np.diff(cost)) + 1):
            if len(part):
                out.append(self._verified(h, offsets, part))
        rows = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
        rows = rows[np.lexsort((rows[:, 3], -rows[:, 2], rows[:, 3] - rows[:, 4], rows[:, 1], rows[:, 0]))]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
        return rows[first]

    def _verified(self, h: np.ndarray, offsets: np.ndarray, lines: np.ndarray) -> np.ndarray:
        doc, item, diagonal = lines.T
        n = self.size[item]
        line = np.repeat(np.arange(len(lines)), n)
        j = expand(np.zeros(len(lines), np.int64), n)
        place = diagonal[line] + j
        inside = (place >= 0) & (place < np.diff(offsets)[doc[line]])
        match = np.zeros(len(line), bool)
        match[inside] = h[offsets[doc[line[inside]]] + place[inside]] == self.h[self.offsets[item[line[inside]]] + j[inside]]
        total = np.concatenate([[0], np.cumsum(match)])
        w, least = runs(n)
        begin = np.concatenate([[0], np.cumsum(n)])[:-1]
        fits = j + w[line] <= n[line]
        k = np.flatnonzero(fits)
        good = k[total[k + w[line[k]]] - total[k] >= least[line[k]]]
        if not len(good):
            return np.zeros((0, 5), np.int64)
        # A stretch ends where the next good window leaves a gap.
        new = np.ones(len(good), bool)
        new[1:] = (line[good[1:]] != line[good[:-1]]) | (j[good[1:]] > j[good[:-1]] + w[line[good[:-1]]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(good)) - 1
        hit = line[good[first]]
        start = place[good[first]]
        end = place[good[last]] + w[hit]
        matches = total[good[last] + w[hit]] - total[good[first]]
        return np.stack([doc[hit], item[hit], matches, np.maximum(0, start), np.minimum(end, np.diff(offsets)[doc[hit]])], 1)


def indexes(benchmark: DataFrame, most_bytes: int = BLOCK, least: int = LEAST) -> Iterator[Broadcast]:
    """Indexes of blocks of benchmark texts (item_id, text), each of about `most_bytes` at most, sent to all tasks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-2 * total // most_bytes) if total > most_bytes else 1
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        got = part.orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Index([r.item_id for r in got], pa.array([r.text for r in got], pa.string()), least))


def overlaps(docs: DataFrame, benchmark: DataFrame, most_bytes: int = BLOCK, least: int = LEAST) -> DataFrame:
    """Rows of SCHEMA for all documents (doc_id, text) against all benchmark texts (item_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in indexes(benchmark, most_bytes, least):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in slices(batch):
                    found = index.value.search(b.column("text"))
                    ids = [index.value.ids[i] for i in found[:, 1]]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(found[:, 0])), pa.array(ids, pa.int64()), *(pa.array(found[:, c]) for c in (2, 3, 4)), pa.array(index.value.size[found[:, 1]])],
                        names=["doc_id", "item_id", "matches", "start", "end", "item_tokens"],
                    )

        found = rows.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionAll(found)
    return out


def without(docs: DataFrame, benchmark: DataFrame, most_bytes: int = BLOCK, least: int = LEAST) -> DataFrame:
    """The documents, all columns, that overlap no benchmark text."""
    for index in indexes(benchmark, most_bytes, least):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in slices(batch):
                    keep = np.ones(b.num_rows, bool)
                    keep[index.value.search(b.column("text"))[:, 0]] = False
                    yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
