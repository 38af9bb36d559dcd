"""Token ids in files of independent, entropy-coded blocks.

Texts are encoded by the tokenizers library, piece by distinct piece: pieces are cut as the vocabulary's
pre-tokenizer does (letters, single digits, other marks, English endings), by character class over arrays, and named
by a 64-bit hash; the library's model encodes each new piece once. A text goes through the library whole if it has a special
token in it, characters that normalisation might compose, reorder or replace (combining marks, Hangul letters and
the like), or characters newer than Python's tables. An end id follows each document.

File format: Parquet in the shared folder. `tables` has the shared frequencies (id, freq; adding up to
2**20) of the static range asymmetric numeral system; `blocks` a row for each block: shard and block (order), ids
before it in its shard, doc_ids and sizes of its documents, n, and states, words, points (checkpoints) and crc of rans.encode. Shards
are ranges of doc_id in ascending order (null first; ties by hash of text), blocks hold whole documents, about
BLOCK ids; each decodes by itself, or from its checkpoints in parts.

Nulls are empty texts: the end id alone. Repeated rows are written as often as they are there. An empty
table gives files without blocks. Other columns are ignored.
"""

from __future__ import annotations

import array
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import dropped, written
from . import rans
from .common import BASE, NO_ID, expand, flat, held, partitions, slices, workspace
from .repeats import range_hashes

BLOCK, CACHE, STRETCH = 1 << 18, 2_000_000, 1 << 18
#: Slots by which known pieces are found, two for each; a piece whose slots others have taken since is encoded again.
SLOTS = 1 << 22
_BLOCKS = "shard int, block int, before long, doc_ids array<long>, sizes array<int>, n int, states binary, words binary, points binary, crc long"
_SPACE, _LETTER, _DIGIT, _OTHER, _NEW = range(5)
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Class of each code point."""
    if not _kinds:
        of = {"L": _LETTER, "N": _DIGIT}
        names = [unicodedata.category(chr(c)) for c in range(0x110000)]
        # What Python's tables don't know yet may be a letter to the library, and marks may compose or change places.
        k = np.fromiter((_NEW if n == "Cn" or n[0] == "M" else of.get(n[0], _OTHER) for n in names), np.uint8, 0x110000)
        k[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
        k[[c for c in range(0x110000) if unicodedata.decomposition(chr(c)) and unicodedata.normalize("NFC", chr(c)) != chr(c)]] = _NEW
        k[[*range(0x1100, 0x1200), *range(0xA960, 0xA980), *range(0xD7B0, 0xD800)]] = _NEW  # Hangul letters join to syllables
        k[0x130] = _NEW  # its lower case has a mark
        _kinds.append(k)
    return _kinds[0]


def lowered(text: str) -> str:
    """Lower case character by character."""
    return text.replace("Σ", "σ").lower()


_random: list[np.ndarray] = []


def random_of_point() -> np.ndarray:
    """64 random bits for each code point."""
    if not _random:
        _random.append(np.random.default_rng(49_408).integers(0, 2**64, 0x110000, dtype=np.uint64))
    return _random[0]


def cut(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each piece of code points (texts separated by blanks), and a hash of it."""
    kind = kinds()[p]
    begin = np.ones(len(p), bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    # An apostrophe alone, before one of the endings s t m d re ve ll, takes it along.
    mark = np.flatnonzero((p == 0x27) & begin)
    mark = mark[(mark + 1 < len(p))]
    mark = mark[begin[mark + 1]]
    one = p[mark + 1]
    two = p[np.minimum(mark + 2, len(p) - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    take = np.where(short, 1, np.where(long & (mark + 2 < len(p)), 2, 0))
    mark, take = mark[take > 0], take[take > 0]
    begin[mark + 1] = False
    rest = mark + 1 + take
    begin[rest[rest < len(p)]] = True
    start = np.flatnonzero(begin)
    if not len(start):
        return start, start, start.astype(np.uint64)
    end = np.append(start[1:], len(p))
    keep = np.flatnonzero(kind[start] != _SPACE)
    start, end = start[keep], end[keep]
    return start, end, range_hashes(random_of_point()[p], start, end, BASE)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # Pieces are normalised and cut already: the library's model alone encodes them, by its byte-level letters, from one
        # text with a line for each.
        spec = json.load(open(path, encoding="utf-8"))
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        letters = next(s for s in steps if s["type"] == "ByteLevel") | {"use_regex": False}
        lines = {"type": "Split", "pattern": {"String": "\n"}, "behavior": "Removed", "invert": False}
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [lines, letters]}}
        self.model = Tokenizer.from_str(json.dumps(spec))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size()
        self.forget()

    def forget(self) -> None:
        self.keys, self.places = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.starts, self.flat = array.array("q", [0]), array.array("i")

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces on end, and how many each has."""
        x = self.model.encode("\n".join(pieces), add_special_tokens=False)
        size = np.bincount(np.array(x.word_ids, np.int64), minlength=len(pieces)) if pieces else np.zeros(0, np.int64)
        return np.array(x.ids, np.int64), size

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and offsets of each text."""
        if len(self.starts) > CACHE:
            self.forget()
        whole = {k: self.whole(t) for k, t in enumerate(texts) if t and any(s in t for s in self.special)}
        parts, sizes, held, size, first = [], [], [], 0, 0
        # Texts are taken in stretches that fit into a processor's cache.
        for k, t in enumerate(texts):
            held.append(" " if t is None or k in whole else t + " ")
            size += len(held[-1])
            if size >= STRETCH or k == len(texts) - 1:
                if not "".join(held).isascii():
                    for j, part in enumerate(held):
                        if not part.isascii() and (kinds()[np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)] == _NEW).any():
                            held[j] = " "
                            whole[first + j] = self.whole(texts[first + j])
                held = [lowered(x) for x in held]
                ids, n = self._stretch(held)
                parts.append(ids)
                sizes.append(n)
                held, size, first = [], 0, k + 1
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        if whole:
            pieces = np.split(ids, np.cumsum(n)[:-1])
            for k, x in whole.items():
                pieces[k], n[k] = x, len(x)
            ids = np.concatenate(pieces)
        return ids, np.concatenate([[0], np.cumsum(n)])

    def _stretch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-cased texts that end in a blank each, and how many each has."""
        joined = "".join(texts)
        p = np.frombuffer(joined.encode("latin-1"), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        start, end, h = cut(p)
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        new = np.flatnonzero(self.keys[slot] != h)
        at = self.places[slot]
        if len(new):
            slot[new] = ((h[new] >> np.uint64(32)) & np.uint64(SLOTS - 1)).astype(np.int64)
            at[new] = self.places[slot[new]]
            new = new[self.keys[slot[new]] != h[new]]
        if len(new):
            _, one, of = np.unique(h[new], return_index=True, return_inverse=True)
            one = new[one]
            ids, size = self.encode_pieces([joined[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())])
            places = len(self.starts) - 1 + np.arange(len(one))
            self.starts.frombytes((self.starts[-1] + np.cumsum(size, dtype=np.int64)).tobytes())
            self.flat.frombytes(ids.astype(np.int32).tobytes())
            at[new] = places[of]
            to = (h[one] & np.uint64(SLOTS - 1)).astype(np.int64)
            to = np.where(self.keys[to] == 0, to, slot[one])
            # Of two that share a slot the last one written stays, with its own key: both writes go by the same order.
            self.places[to], self.keys[to] = places, h[one]
        starts = np.frombuffer(self.starts, np.int64)
        begin = starts[at]
        count = starts[at + 1] - begin
        ids = np.frombuffer(self.flat, np.int32)[expand(begin, count)] if len(self.flat) else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(ends[np.concatenate([[0], np.searchsorted(start, np.cumsum([len(x) for x in texts]))])])


def encoder(path: str) -> Encoder:
    kept = held("tokens")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def width(size: int) -> str:
    """The array type for ids of a vocabulary."""
    return "<u2" if size <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """`doc`, `tag`, `ids`: ids (of `width` bits) of each document with the end id."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, limit=1 << 21):
                ids, offsets = encoder(path).encode_all(b.column("text").to_pylist())
                every = np.insert(ids, offsets[1:], end_id).astype(width(encoder(path).size)).tobytes()
                bounds = (int(width(encoder(path).size)[2:]) * (offsets + np.arange(len(offsets)))).tolist()
                blobs = [every[lo:hi] for lo, hi in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("tag"), pa.array(blobs, pa.binary())], names=["doc", "tag", "ids"])

    return docs.select(doc.alias("doc"), F.xxhash64("text").alias("tag"), "text").mapInArrow(run, "doc long, tag long, ids binary")


def frequencies(packed: DataFrame, kind: str) -> DataFrame:
    """`id`, `n`: how often each id occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(0, np.int64)
        for b in batches:
            if b.num_rows:
                mine = np.bincount(flat(b.column("ids"))[0].view(kind))
                if len(mine) > len(count):
                    count = np.pad(count, (0, len(mine) - len(count)))
                count[: len(mine)] += mine
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(count[at])], names=["id", "n"])

    return packed.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, end_id: int = 1, at: str | None = None) -> str:
    """Writes the files of documents (doc_id, text) below `at`, which is returned."""
    spark = docs.sparkSession
    at = at or workspace(spark, "tokens")
    packed = written(tokenized(docs, path, end_id), "ids")
    kind = width(encoder(path).size)
    counted = frequencies(packed, kind).toPandas()  # at most the vocabulary
    counts = np.zeros(int(counted.id.max()) + 1 if len(counted) else end_id + 1, np.int64)
    counts[counted.id.to_numpy(np.int64)] = counted.n.to_numpy(np.int64)
    freq = rans.Table.fit(counts).freq.astype(np.int64)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id long, freq long").coalesce(1).write.parquet(f"{at}/tables")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("rans")  # drops what the encoder kept
        table, shard, block, before = rans.Table(freq), TaskContext.get().partitionId(), 0, 0
        names = [x.split(" ")[0] for x in _BLOCKS.split(", ")]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]

        def row(waiting):
            ids = np.concatenate([x for _, x in waiting])
            e = rans.encode(ids, table)
            values = [shard, block, before, [d for d, _ in waiting], [len(x) for _, x in waiting], e["n"], e["states"], e["words"], e["points"], e["crc"]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        waiting, size = [], 0
        for batch in batches:
            for b in slices(batch, "ids"):
                for doc, ids in zip(b.column("doc").to_pylist(), b.column("ids").to_pylist()):
                    waiting.append((doc, np.frombuffer(ids, kind)))
                    size += len(waiting[-1][1])
                    if size >= BLOCK:
                        yield row(waiting)
                        waiting, size, block, before = [], 0, block + 1, before + size
        if waiting:
            yield row(waiting)

    ordered = packed.repartitionByRange(partitions(spark), "doc", "tag").sortWithinPartitions("doc", "tag")
    ordered.select("doc", "ids").mapInArrow(run, _BLOCKS).write.parquet(f"{at}/blocks")
    dropped(packed)
    return at


def read(spark: SparkSession, at: str, binary: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids of each document in the files: array<int>, or 32-bit little-endian bytes."""
    table = spark.read.parquet(f"{at}/tables").toPandas()
    freq = np.zeros(int(table.id.max()) + 1, np.int64)
    freq[table.id.to_numpy()] = table.freq.to_numpy()
    blocks = spark.read.schema(_BLOCKS).parquet(f"{at}/blocks")
    sizes = blocks.groupBy("shard").agg(F.sum(F.col("n").cast("long")).alias("n")).orderBy("shard").collect()  # a row for each shard
    first = dict(zip([r.shard for r in sizes], np.cumsum([0, *(r.n for r in sizes)]).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("rans")
        t = rans.Table(freq)
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                ids = rans.decode(r, t)
                ends = np.cumsum(r["sizes"])
                begin = np.concatenate([[0], ends[:-1]])
                if binary:
                    raw = ids.astype("<u4").tobytes()
                    lists = pa.array([raw[4 * a : 4 * e] for a, e in zip(begin.tolist(), ends.tolist())], pa.binary())
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                doc = np.array(r["doc_ids"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == NO_ID), pa.array(first[r["shard"]] + r["before"] + begin, pa.int64()), pa.array(np.array(r["sizes"], np.int64)), lists], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, f"doc_id long, start long, n_tokens long, ids {'binary' if binary else 'array<int>'}")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what the files hold."""
    back = read(docs.sparkSession, write(docs, path), binary=True)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
