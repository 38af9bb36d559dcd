"""Substring dedup by super-k-mer partitioning.

Consecutive windows of LENGTH words that share a minimiser of K words travel as one packed string of words to
the minimiser's bucket; there all windows of all strings are sorted by a 128-bit hash, which finds each one's
first start exactly (see repeats). A word is removed if a window that covers it also starts earlier: in a
smaller doc_id, or in the same document before. Windows are judged on the input.

Result: doc_id, n_words, n_removed, kept (the other words, joined by one blank). Words are runs of other than
blanks, tabs and line ends, unchanged. Null and empty texts, and texts without words, have no words and keep ''.
Fewer words than LENGTH are kept. Rows with equal doc_id and text are one document. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from .common import NO_ID, U, expand, flat, mix, pack, slices, windows, words

LENGTH, K = 20, 4
RULE = R.Rule("word", LENGTH, K)
SCHEMA = "doc_id long, n_words long, n_removed long, kept string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
_BLOBS = pa.schema([("grp", pa.int32()), ("blob", pa.binary())])


def strings(rows: DataFrame, hot: np.ndarray, rule: R.Rule, buckets: int) -> DataFrame:
    """`bucket`, `blob`: packed strings of all runs of rows (doc, tag, text)."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, tag, at, c, key, t1, t2, size = (np.concatenate([h[i] for h in held]) for i in range(8))
        data = np.concatenate([h[8] for h in held])
        ends = np.cumsum(size)
        o = R.order(doc, tag, at)
        o = o[R.first_of_equal(t1[o], t2[o])]
        to = (mix(key[o]) % U(buckets)).astype(np.int64)
        out = []
        for bucket, part in R.dealt(to, buckets):
            p = o[part]
            out.append((bucket, pack(R.delta(doc[p]), R.delta(tag[p]), at[p].astype(np.uint32), c[p].astype(np.uint8), size[p].astype(np.uint32), R.packed_slices(data, ends[p] - size[p], ends[p]), level=3)))
        if out:
            yield R.blob_batch("bucket", out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for b in slices(batch):
                raw, offsets = flat(b.column("text"))
                u = R.units(raw, offsets, rule.unit, True)
                r = R.runs(u, rule, hot)
                d = u.doc[r.s]
                lo, hi = u.at[r.s], u.at[r.s + r.c + rule.length - 1]
                held.append((b.column("doc").to_numpy()[d], b.column("tag").to_numpy()[d], r.s - u.first[d], r.c, r.key, *R.base_hashes(u, r, rule), hi - lo, R.packed_slices(u.buf, lo, hi)))
                size += len(raw)
                if size >= R.FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return rows.select("doc", "tag", "text").mapInArrow(run, "bucket int, blob binary")


def first_windows(sent: DataFrame, rule: R.Rule, groups: int) -> DataFrame:
    """`grp`, `blob`: of each run with windows that start nowhere earlier, which ones those are."""

    def work(_: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        doc, tag, at, c, size, data = R.joined(blobs)
        o = R.order(doc, tag, at)
        ends = np.cumsum(size, dtype=np.int64)
        w1, w2 = [], []
        for part in np.split(o, np.flatnonzero(np.diff(np.cumsum(size[o], dtype=np.int64) >> 20)) + 1):
            raw = R.packed_slices(data, ends[part] - size[part], ends[part])
            _, _, mine, h1, h2 = words(raw, np.concatenate([[0], np.cumsum(size[part], dtype=np.int64)]), True)
            inside = mine[: len(mine) - rule.length + 1] == mine[rule.length - 1 :]
            w1.append(windows(h1, rule.length)[inside])
            w2.append(windows(h2, rule.length)[inside])
        first = R.first_of_equal(np.concatenate(w1), np.concatenate(w2))
        doc, tag, at, c = doc[o], tag[o], at[o], c[o].astype(np.int64)
        begin = np.cumsum(c) - c
        bit = first.astype(np.uint32) << (np.arange(len(first)) - np.repeat(begin, c)).astype(np.uint32)
        mask = np.bitwise_or.reduceat(bit, begin)
        keep = np.flatnonzero(mask)
        to = R.group_of(doc[keep], tag[keep], groups)
        out = []
        for grp, part in R.dealt(to, groups):
            p = keep[part]
            out.append((grp, pack(R.delta(doc[p]), R.delta(tag[p]), at[p], mask[p].astype(np.uint16 if rule.length - rule.k < 16 else np.uint32))))
        if out:
            yield R.blob_batch("grp", out)

    return R.grouped(sent, "bucket", work, "grp int, blob binary", _BLOBS)


def dedup(docs: DataFrame, rule: R.Rule = RULE) -> DataFrame:
    """SCHEMA for every row of documents (doc_id, text)."""
    groups, buckets = R.n_groups(docs), R.n_buckets(docs)
    hot = R.hot_cells(docs, rule)
    rows = R.keyed(docs)
    told = first_windows(strings(rows, hot, rule, buckets), rule, groups)

    def finish(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        known = R.Known(blobs.column("blob").to_pylist())
        out = []
        for b in slices(texts):
            raw, offsets = flat(b.column("text"))
            u = R.units(raw, offsets, rule.unit, False)
            r = R.runs(u, rule, hot)
            doc = b.column("doc").to_numpy()
            d = u.doc[r.s]
            yes, i = known.find(doc[d], b.column("tag").to_numpy()[d], r.s - u.first[d])
            mask = np.where(yes, known.value[0][i].astype(np.int64), 0) if len(known.key) else np.zeros(len(d), np.int64)
            start = expand(r.s, r.c)
            again = (np.repeat(mask, r.c) >> (start - np.repeat(r.s, r.c))) & 1 == 0
            gone = R.covered(start[again], rule.length, len(u.doc))
            n = np.diff(u.first)
            kept = np.bincount(u.doc[~gone], minlength=len(n))
            keep = np.repeat(~gone, np.diff(u.at))
            data = u.buf[keep].tobytes()
            size = np.bincount(u.doc[~gone], weights=np.diff(u.at)[~gone], minlength=len(n)).astype(np.int64)
            ends = np.cumsum(size)
            texts_out = [data[a:e].decode("utf-8", "replace") for a, e in zip((ends - size).tolist(), np.maximum(ends - 1, ends - size).tolist())]
            ids = pa.array(doc, pa.int64(), mask=doc == NO_ID)
            out.append(pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array((n - kept).astype(np.int64)), pa.array(texts_out, pa.string())], schema=_OUT))
        return pa.Table.from_batches(out, _OUT)

    return rows.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(finish, SCHEMA)


def digests(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
