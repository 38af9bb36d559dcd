"""Suffix-array dedup by distributed prefix doubling.

Every position of a text whose LENGTH-byte string might also start earlier is ranked by longer and longer
prefixes, until it is unique or past the threshold:

1. Positions are ranked by the K bytes at their window's minimiser (see repeats), a run of windows at a time.
   Runs equal in whole to an earlier one are settled: all their strings start earlier. Runs alone with their
   K bytes are settled too: none does. Spark deals (rank, hash of the run) pairs to buckets, which sort them.
2. The bytes of the runs that are left are dealt by the same ranks, so positions with equal strings meet in one bucket.
   There positions are ranked by LENGTH / 4 bytes; pairs (rank at p, rank at p + LENGTH / 4) are sorted and ranked
   again, which ranks LENGTH / 2 bytes, and pairs (rank at p, rank at p + LENGTH / 2) rank LENGTH. Positions leave as
   soon as they are unique. All but the first position of a last rank start earlier.

Ranks stand for 128 bits of hash at LENGTH / 4 bytes, and are exact from there on. A byte is removed if a string that
covers it also starts earlier: in a smaller doc_id, or in the same document before. Strings are judged on the input.

Result: doc_id, n_bytes, n_removed, spans (maximal removed runs [start, end) in order), kept (binary).
Texts are UTF-8 bytes, null is empty; matches never cross documents. Rows with equal doc_id and text are one
document. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import written
from . import repeats as R
from .common import BASE_2, BYTE_1, BYTE_2, NO_ID, U, expand, flat, mix, pack, slices, windows

LENGTH, K = 100, 24
RULE = R.Rule("byte", LENGTH, K)
SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(_SPAN)), ("kept", pa.binary())])
_BLOBS = pa.schema([("grp", pa.int32()), ("blob", pa.binary())])
_SENT = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
_LOW = U((1 << 40) - 1)


def runs_of(b: pa.RecordBatch, rule: R.Rule, hot: np.ndarray, second: bool):
    u = R.units(*flat(b.column("text")), rule.unit, second)
    r = R.runs(u, rule, hot)
    d = u.doc[r.s]
    return u, r, b.column("doc").to_numpy()[d], b.column("tag").to_numpy()[d], r.s - u.first[d]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key) % U(buckets)).astype(np.int64)


def ranks(rows: DataFrame, hot: np.ndarray, rule: R.Rule, buckets: int) -> DataFrame:
    """`bucket`, `blob`: 40 bits of the minimiser's rank and a hash of each run; of equal runs of a task the first."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, tag, at, key, t1, t2 = (np.concatenate(x) for x in zip(*held))
        o = R.order(doc, tag, at)
        o = o[R.first_of_equal(t1[o], t2[o])]
        out = []
        for bucket, part in R.dealt(bucket_of(key[o], buckets), buckets):
            p = o[part]
            low = key[p] & _LOW
            out.append((bucket, pack(R.delta(doc[p]), R.delta(tag[p]), at[p].astype(np.uint32), (low >> U(32)).astype(np.uint8), low.astype(np.uint32), t1[p])))
        if out:
            yield R.blob_batch("bucket", out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for b in slices(batch):
                u, r, doc, tag, at = runs_of(b, rule, hot, True)
                held.append((doc, tag, at, r.key, *R.base_hashes(u, r, rule)))
                size += len(u.buf)
                if size >= R.FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return rows.select("doc", "tag", "text").mapInArrow(run, "bucket int, blob binary")


def first_runs(sent: DataFrame, groups: int) -> DataFrame:
    """`grp`, `blob`: the runs that equal no earlier run, and whether another run has their K bytes."""

    def work(_: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        doc, tag, at, high, low, t1 = R.joined(blobs)
        o = R.order(doc, tag, at)
        key = (high[o].astype(np.uint64) << U(32)) | low[o]
        first = R.first_of_equal(key, t1[o])
        o, key = o[first], key[first]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        open_ = count[inverse] > 1
        out = []
        for grp, part in R.dealt(R.group_of(doc[o], tag[o], groups), groups):
            p = o[part]
            out.append((grp, pack(R.delta(doc[p]), R.delta(tag[p]), at[p], open_[part])))
        if out:
            yield R.blob_batch("grp", out)

    return R.grouped(sent, "bucket", work, "grp int, blob binary", _BLOBS)


def open_runs(rows: DataFrame, told: DataFrame, hot: np.ndarray, rule: R.Rule, buckets: int) -> DataFrame:
    """`bucket`, `blob`: the bytes of the runs that are left."""

    def send(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        known = R.Known(blobs.column("blob").to_pylist())
        held = []
        for b in slices(texts):
            u, r, doc, tag, at = runs_of(b, rule, hot, False)
            yes, i = known.find(doc, tag, at)
            p = np.flatnonzero(yes & known.value[0][i]) if len(known.key) else np.zeros(0, np.int64)
            end = r.s[p] + r.c[p] + rule.length - 1
            held.append((doc[p], tag[p], at[p], r.c[p], r.key[p], R.packed_slices(u.buf, r.s[p], end)))
        if not held:
            return _SENT.empty_table()
        doc, tag, at, c, key, data = (np.concatenate(x) for x in zip(*held))
        size = c + rule.length - 1
        ends = np.cumsum(size)
        o = R.order(doc, tag, at)
        new = np.ones(len(o), bool)
        new[1:] = (doc[o][1:] != doc[o][:-1]) | (tag[o][1:] != tag[o][:-1]) | (at[o][1:] != at[o][:-1])  # repeated rows
        o = o[new]
        out = []
        for bucket, part in R.dealt(bucket_of(key[o], buckets), buckets):
            p = o[part]
            out.append((bucket, pack(R.delta(doc[p]), R.delta(tag[p]), at[p].astype(np.uint32), c[p].astype(np.uint8), R.packed_slices(data, ends[p] - size[p], ends[p]))))
        return pa.Table.from_batches([R.blob_batch("bucket", out)], _SENT) if out else _SENT.empty_table()

    return rows.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(send, "bucket int, blob binary")


def rank(*keys: np.ndarray) -> np.ndarray:
    """A dense rank of each tuple of keys, by sorting them."""
    o = np.lexsort(keys[::-1])
    new = np.ones(len(o), bool)
    new[1:] = np.logical_or.reduce([k[o][1:] != k[o][:-1] for k in keys])
    out = np.empty(len(o), np.int64)
    out[o] = np.cumsum(new) - 1
    return out


def lengths(length: int) -> list[int]:
    """Prefixes that are ranked, each at most twice as long as the one before; two overlap where they are less."""
    out = [length]
    while len(out) < 3:
        out.append(-(-out[-1] // 2))
    return out[::-1]


def shared(places: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The places whose keys others may have too: a key alone in its cell of a table is unique."""
    if not len(places):
        return places
    bits = max(10, int(len(places)).bit_length() + 2)
    cell = (key[places] >> U(64 - bits)).astype(np.int64)
    return places[np.bincount(cell, minlength=1 << bits)[cell] > 1]


def later_strings(data: np.ndarray, c: np.ndarray, rule: R.Rule) -> np.ndarray:
    """Which windows of the runs (c windows each, bytes on end, in order of start) equal an earlier one.

    Prefix doubling: positions are ranked by their first lengths(...)[0] bytes, then by pairs of ranks at growing offsets. A
    position that is unique with its rank, or whose pair has a unique half, is finished and leaves."""
    size = c + rule.length - 1
    begin = np.cumsum(size) - size
    every = expand(begin, c)
    steps = lengths(rule.length)
    h1 = windows(BYTE_1[data], steps[0])
    parts = sorted({0, rule.length - steps[0], *(k * steps[0] for k in range(rule.length // steps[0]))})
    live = every
    for at in sorted(parts, key=lambda x: (x != 0, -x)):  # those that are unique at one part needn't be sorted
        live = shared(live + at, h1) - at
    h2 = windows(BYTE_2[data], steps[0], BASE_2)
    ranks = np.zeros(len(data), np.int64)
    # Where each step's ranks are asked for: at a start and, for every longer step, that much less its half later.
    offsets = [[0]]
    for long, short in zip(steps[:0:-1], steps[-2::-1]):
        offsets.append(sorted({x + d for x in offsets[-1] for d in (0, long - short)}))
    wanted = [np.unique(np.concatenate([live + d for d in x])) for x in offsets[::-1]]
    ranks[wanted[0]] = rank(h1[wanted[0]], h2[wanted[0]])
    for k in range(1, len(steps)):
        step = steps[k] - steps[k - 1]
        at = wanted[k] if k + 1 < len(steps) else live
        pair = rank(ranks[at], ranks[at + step])
        ranks[at] = pair
        if k + 1 < len(steps):  # unique among the starts, or among what follows them: finished
            for d in offsets[len(steps) - 1 - k]:
                here = ranks[live + d]
                live = live[np.bincount(here)[here] > 1] if len(live) else live
            wanted[k + 1] = live
    out = np.zeros(len(data), bool)
    out[live] = ~R.first_of_equal(ranks[live])
    return out[every]


def settled(sent: DataFrame, rule: R.Rule, groups: int) -> DataFrame:
    """`grp`, `blob`: for each run that was left, which of its strings start earlier."""

    def work(_: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        doc, tag, at, c, data = R.joined(blobs)
        c = c.astype(np.int64)
        size = c + rule.length - 1
        ends = np.cumsum(size)
        o = R.order(doc, tag, at)
        again = later_strings(R.packed_slices(data, ends[o] - size[o], ends[o]), c[o], rule)
        starts = np.cumsum(c[o]) - c[o]
        out = []
        for grp, part in R.dealt(R.group_of(doc[o], tag[o], groups), groups):
            p = o[part]
            bits = again[expand(starts[part], c[p])]
            wide = np.zeros((len(p), rule.length), bool)
            wide[np.repeat(np.arange(len(p)), c[p]), expand(np.zeros(len(p), np.int64), c[p])] = bits
            out.append((grp, pack(R.delta(doc[p]), R.delta(tag[p]), at[p], np.packbits(wide, 1))))
        if out:
            yield R.blob_batch("grp", out)

    return R.grouped(sent, "bucket", work, "grp int, blob binary", _BLOBS)


def spans_of(gone: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end (within the document) of each maximal run of removed bytes."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[offsets] = True
    a = gone & np.concatenate([[True], ~gone[:-1]])[: len(gone)] | (gone & edge[:-1])
    b = gone & (np.concatenate([~gone[1:], [True]])[: len(gone)] | edge[1:])
    start, end = np.flatnonzero(a), np.flatnonzero(b) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return doc, start - offsets[doc], end - offsets[doc]


def dedup(docs: DataFrame, rule: R.Rule = RULE, carry: tuple[str, ...] = (), text: bool = False) -> DataFrame:
    """SCHEMA for every row of documents (doc_id, text), and the columns `carry` as they are.

    With `text`, `kept` is a string: of a character that was cut in parts, nothing is left."""
    groups, buckets = R.n_groups(docs), R.n_buckets(docs)
    hot = R.hot_cells(docs, rule)
    rows = R.keyed(docs, carry)
    fixed = pa.schema([*list(_OUT)[:-1], pa.field("kept", pa.string())]) if text else _OUT
    own = T.StructType.fromDDL(SCHEMA.replace("kept binary", "kept string") if text else SCHEMA)
    schema = T.StructType([*own.fields, *(T.StructField(c, docs.schema[c].dataType) for c in carry)])
    told = written(first_runs(ranks(rows, hot, rule, buckets), groups), "runs")
    last = settled(open_runs(rows, told, hot, rule, buckets), rule, groups)
    answers = told.select("grp", F.lit(0).alias("kind"), "blob").unionAll(last.select("grp", F.lit(1).alias("kind"), "blob"))

    def finish(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        kind, blob = blobs.column("kind").to_pylist(), blobs.column("blob").to_pylist()
        firsts, bits = (R.Known([x for x, k in zip(blob, kind) if k == n]) for n in (0, 1))
        out = []
        for b in slices(texts):
            u, r, doc, tag, at = runs_of(b, rule, hot, False)
            yes, _ = firsts.find(doc, tag, at)
            start, run = expand(r.s, r.c), np.repeat(np.arange(len(r.s)), r.c)
            again = ~yes[run]
            left, i = bits.find(doc, tag, at)
            if len(bits.key):
                some = np.flatnonzero(left[run])
                flags = np.unpackbits(bits.value[0], axis=1)
                again[some] = flags[i[run[some]], start[some] - r.s[run[some]]]
            gone = R.covered(start[again], rule.length, len(u.buf))
            n = np.diff(u.first)
            kept = np.bincount(u.doc[~gone], minlength=len(n))
            sd, ss, se = spans_of(gone, u.first)
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(sd, np.arange(len(n) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(ss, pa.int64()), pa.array(se, pa.int64())], fields=list(_SPAN)))
            data = u.buf[~gone].tobytes()
            ends = np.cumsum(kept)
            rest = [data[a:e] for a, e in zip((ends - kept).tolist(), ends.tolist())]
            rest = pa.array([x.decode("utf-8", "ignore") for x in rest] if text else rest, fixed.field("kept").type)
            ids = b.column("doc").to_numpy()
            also = [b.column(f"c{k}") for k in range(len(carry))]
            wide = pa.schema([*fixed, *(pa.field(c, x.type) for c, x in zip(carry, also))])
            out.append(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(n.astype(np.int64)), pa.array((n - kept).astype(np.int64)), spans, rest, *also], schema=wide))
        if not out:
            return pa.schema([*fixed, *(pa.field(c, texts.schema.field(f"c{k}").type) for k, c in enumerate(carry))]).empty_table()
        return pa.Table.from_batches(out)

    return rows.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(finish, schema)


def digests(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
