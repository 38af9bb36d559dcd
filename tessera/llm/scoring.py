"""LM scoring by cross-entropy difference.

Two n-gram models, of the target's and of the background's documents, share one vocabulary (all words of both)
and one form: a bigram estimate mixed with a unigram estimate that adds one to every count,

    p(w | v) = MIX * c(v, w) / c(v) + (1 - MIX) * (r * c(w) + 1) / (r * N + V),

where v is the word before (an empty word begins each document), the first term is 0 if c(v) is 0, N counts
the model's tokens and V the words of either model. The models are matched in size: r brings the larger one's counts
down to the smaller one's tokens (r is 1 for the smaller one), so the added ones weigh the same in both. A token's loss is -log2 p; a document's score is the mean of target loss less background loss:
the lower, the closer to the target. A document's own occurrences are taken off the counts of its own model
first, so documents that trained a model are scored like others.

Counts cover all words and pairs of all documents; none is dropped. Documents are dealt to groups; a group
asks for the counts of its distinct words and pairs in packed blobs by range of their hashes, and gets the sums
over all groups back the same way, so a frequent word is one number in each group and no more.

Result: doc_id, n_tokens, target_loss, background_loss, score (bits a token; null without tokens). Words are
runs of other than blanks, tabs and line ends, ASCII lower-cased. Null and empty texts have no tokens. A null
target id names the documents without an id. Repeated rows count and score as often as they are there. Empty tables give no
rows. A target id without a document is ignored, and so are other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, NO_ID, U, flat, mix, pack, partitions, slices, unpack, words

MIX = 0.7
SCHEMA = "doc_id long, n_tokens long, target_loss double, background_loss double"
#: Bit 0 of a key says that the occurrence is the target's, bit 1 that it is a pair. The empty word is _START.
_START = U(0x5851F42D4C957F2C)
_PLAIN = U(2**64 - 4)
_SENT = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("blob", pa.binary())])
_TOLD = pa.schema([("grp", pa.int32()), ("blob", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64())])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PAIR = U(0x2545F4914F6CDD1D)


def tokens(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, word and pair of each token, and where documents with tokens begin."""
    raw, offsets = flat(b.column("text"))
    _, _, doc, h, _ = words(_LOWER[raw], offsets)
    h = h & _PLAIN
    before = np.concatenate([[_START], h[:-1]]) if len(h) else h
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    before[first] = _START
    return doc, h, (mix(before * BASE + h * _PAIR) & _PLAIN) | U(2), first


def flagged(t: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The documents of a group, and which are the target's."""
    mark = t.column("mark").combine_chunks()
    wanted = pc.unique(t.filter(mark).column("doc"))
    for b in slices(t.filter(pc.invert(mark))):
        yield b, pc.is_in(b.column("doc"), value_set=wanted).to_numpy(zero_copy_only=False)


def counted(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of a group's documents in order, and how often the target and the background have them."""
    found = [np.zeros(0, np.uint64)]
    for b, target in flagged(t):
        doc, h, pair, first = tokens(b)
        own = target[doc].astype(np.uint64)
        found += [h | own, pair | own, _START | own[first]]
    key = np.sort(np.concatenate(found))
    of = key >> U(1)
    at = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    both = np.diff(np.append(at, len(of)))
    on = np.add.reduceat(key & U(1), at).astype(np.int64) if len(at) else both
    return of[at] << U(1), on, both - on


def bounds(key: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of keys begins, and the end."""
    return np.searchsorted(key, np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)).tolist() + [len(key)]


def narrow(n: np.ndarray) -> np.ndarray:
    return n.astype(np.min_scalar_type(int(n.max()) if len(n) else 0))


def planes(key: np.ndarray) -> np.ndarray:
    """Sorted keys as bytes of their differences, all first bytes, then all second ones, and so on."""
    return np.diff(key, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.copy()


def requests(rows: DataFrame, buckets: int) -> DataFrame:
    """`bucket`, `grp`, `blob`: keys and counts of each group for each bucket, be they none."""

    def run(t: pa.Table) -> pa.Table:
        key, on, off = counted(t)
        cut = bounds(key, buckets)
        blobs = [pack(planes(key[a:b]), narrow(on[a:b]), narrow(off[a:b])) for a, b in zip(cut, cut[1:])]
        grp = t.column("grp")[0].as_py()
        return pa.table([pa.array(range(buckets), pa.int32()), pa.array([grp] * buckets, pa.int32()), pa.array(blobs, pa.binary())], schema=_SENT)

    return rows.groupBy("grp").applyInArrow(run, "bucket int, grp int, blob binary")


def replies(sent: DataFrame) -> DataFrame:
    """`grp`, `blob`: bucket, its words and tokens, and the counts over all groups of what the group asked for."""

    def run(t: pa.Table) -> pa.Table:
        asked = [unpack(x) for x in t.column("blob").to_pylist()]
        keys = [np.cumsum(np.ascontiguousarray(a[0].T).view(np.uint64).ravel()) for a in asked]
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        on, off = (np.bincount(inverse, np.concatenate([a[i] for a in asked]), len(key)).astype(np.int64) for i in (1, 2))
        word = (key & U(2) == 0) & (key != _START)
        sums = np.array([t.column("bucket")[0].as_py(), word.sum(), on[word].sum(), off[word].sum()])
        ends = np.cumsum([len(k) for k in keys])
        blobs = [pack(sums, narrow(on[inverse[e - len(k) : e]]), narrow(off[inverse[e - len(k) : e]])) for k, e in zip(keys, ends)]
        return pa.table([t.column("grp").combine_chunks(), pa.array(blobs, pa.binary())], schema=_TOLD)

    return sent.groupBy("bucket").applyInArrow(run, "grp int, blob binary")


def looked_up(keys: np.ndarray, wanted: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each wanted key, and how often its own document wants it (documents in order)."""
    o = np.argsort(wanted, kind="stable")
    w, d = wanted[o], doc[o]
    new = np.append(True, w[1:] != w[:-1])
    first = np.flatnonzero(new)
    mine = np.flatnonzero(new | np.append(True, d[1:] != d[:-1]))
    size = np.diff(np.append(mine, len(w)))
    place, own = np.empty(len(w), np.int64), np.empty(len(w), np.int64)
    place[o] = np.repeat(np.searchsorted(keys, w[first]), np.diff(np.append(first, len(w))))
    own[o] = np.repeat(size, size)
    return place, own


def score(docs: DataFrame, target: DataFrame, share: float = MIX) -> DataFrame:
    """SCHEMA and `score` for every row of documents (doc_id, text); `target` has the ids of the target's documents."""
    groups, buckets = 2 * partitions(docs.sparkSession), partitions(docs.sparkSession)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long"))
    # Documents without an id are dealt by their texts, and their mark goes to all groups.
    grp = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(doc)), F.lit(groups)).cast("int")
    to = F.when(F.col("doc_id").isNull(), F.sequence(F.lit(0), F.lit(groups - 1))).otherwise(F.array(F.pmod(F.xxhash64(doc), F.lit(groups)).cast("int")))
    marks = target.select("doc_id").distinct().select(doc.alias("doc"), F.explode(to).alias("grp"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("mark"))
    rows = docs.select(doc.alias("doc"), grp.alias("grp"), "text", F.lit(False).alias("mark")).unionAll(marks)

    def loss(c_pair, c_before, c_word, n, v, r):
        known = np.where(c_before > 0, c_pair / np.maximum(c_before, 1), 0.0)
        return -np.log2(share * known + (1 - share) * (r * c_word + 1) / (r * n + v))

    def shifted(of_word: np.ndarray, first: np.ndarray, start) -> np.ndarray:
        out = np.concatenate([of_word[:1], of_word[:-1]])
        out[first] = start
        return out

    def finish(t: pa.Table, told: pa.Table) -> pa.Table:
        got = sorted((unpack(x) for x in told.column("blob").to_pylist()), key=lambda g: g[0][0])
        key = counted(t)[0]
        v, n_on, n_off = sum((g[0][1:] for g in got), np.zeros(3, np.int64)).tolist()
        counts = [np.concatenate([g[i].astype(np.int64) for g in got]) for i in (1, 2)]
        out = []
        for b, target in flagged(t):
            d, h, pair, first = tokens(b)
            n_own = np.bincount(d, minlength=b.num_rows)
            mean = [np.zeros(b.num_rows)] * 2
            if len(d):
                (at_pair, own_pair), (at_word, own_word) = looked_up(key, pair, d), looked_up(key, h, d)
                at_before = shifted(at_word, first, np.searchsorted(key, _START))
                own_before = shifted(own_word, first, 1)
                for k, (c, n, mine) in enumerate(((counts[0], n_on, target), (counts[1], n_off, ~target))):
                    m = mine[d]
                    each = loss(c[at_pair] - own_pair * m, c[at_before] - own_before * m, c[at_word] - own_word * m, n - n_own[d] * m, v, min(n_on, n_off) / max(n, 1))
                    mean[k] = np.bincount(d, each, minlength=b.num_rows) / np.maximum(n_own, 1)
            ids = b.column("doc").to_numpy()
            out.append(pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), pa.array(n_own.astype(np.int64)), *(pa.array(m, mask=n_own == 0) for m in mean)], schema=_OUT))
        return pa.Table.from_batches(out, _OUT)

    done = rows.groupBy("grp").cogroup(replies(requests(rows, buckets)).groupBy("grp")).applyInArrow(finish, SCHEMA)
    return done.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def trained_on(labels: DataFrame, fold: int = 2) -> DataFrame:
    """doc_id of the documents labelled of high quality whose crc32(doc_id as text) mod 4 is not `fold` (held out)."""
    return labels.where("quality = 1").select("doc_id").where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) != fold)
