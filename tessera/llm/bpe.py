"""BPE encoding and decoding: a backtracking encoder over Aho-Corasick longest matches.

A token is taken greedily (the longest match) as long as its pair with the token before it is
compatible, that is, as long as merging by rank would leave a boundary there; else the next shorter
prefix token is tried, and a position without any is marked dead and left. Every position is left
once at most, so the time is linear (a match looks no further than the longest token). Decoding copies each token's bytes by an offset table.

Nulls encode as the empty text: no ids. Special tokens of the vocabulary found in a text become
their ids, as the tokenizers library does by default. Rows are independent: repeated rows give
equal results, and other columns pass through unless they are named `ids` or `decoded`, which are
replaced.
"""

from __future__ import annotations

import array
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import expand, held

#: Fixed: the published pattern that cuts texts into pieces before merging; `\s` is Unicode's White_Space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Distinct pieces that a worker keeps; the cache starts anew beyond it.
CACHE = 300_000


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        of = byte_chars()
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.data = {i: bytes(of[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(pairs):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merged[left, right] = whole
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = r, (left, right)
        self.automaton = ahocorasick.Automaton()
        by_text = {b.decode("latin-1"): i for i, b in self.data.items()}
        for text, i in by_text.items():
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.longest = max(map(len, by_text), default=1)
        self.shorter: dict[int, int | None] = {}
        for text, i in by_text.items():
            self.shorter[i] = next((by_text[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in by_text), None)
        self.compatible: dict[tuple[int, int], bool] = {}
        size = max([*self.data, *self.special.values()], default=-1) + 1
        every = [self.data.get(i, b"") for i in range(size)]
        for text, i in self.special.items():
            every[i] = text.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in every])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(every), np.uint8)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = _Known(self)
        self.starts, self.flat, self.texts = array.array("q", [0]), array.array("i"), []

    def fits(self, left: int, right: int) -> bool:
        """Would merging by rank keep the boundary between these two tokens?"""
        key = (left, right)
        if (said := self.compatible.get(key)) is not None:
            return said
        rank, parts, merged = self.rank, self.parts, self.merged
        # Undo merges from the latest: whatever could have merged over the boundary must rank after the undone ones.
        limit, ok = len(self.merged) + 1, True
        while True:
            whole = merged.get((left, right))
            if whole is not None and rank[whole] < limit:
                ok = False
                break
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                break
            if a > b:  # of equal ranks the left one was merged first, so the right one is undone
                limit, left = a, parts[left][1]
            else:
                limit, right = b + 1, parts[right][0]
        if len(self.compatible) > CACHE // 2:
            self.compatible.clear()
        self.compatible[key] = ok
        return ok

    def merge_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        text, n = piece.decode("latin-1"), len(piece)
        dead, out, at = bytearray(n + 1), [], 0
        # The automaton copies the text that it is given; beyond the longest token nothing can match.
        longest = lambda p: next(self.automaton.iter_long(text[p : p + self.longest]))[1]
        token = longest(0) if n else None
        while token is not None:
            last = out[-1] if out else None
            while token is not None:
                end = at + len(self.data[token])
                if not dead[end] and (last is None or self.fits(last, token)):
                    out.append(token)
                    at = end
                    break
                token = self.shorter[token]
            if token is None:
                dead[at] = 1
                out.pop()
                at -= len(self.data[last])
                token = last
            else:
                token = longest(at) if at < n else None
        return out

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and offsets of each text."""
        if len(self.known) > CACHE or len(self.flat) > 16 * CACHE:
            self.forget()
        found, counts = [], []
        get, pieces = self.known.__getitem__, self.pieces.findall
        for text in texts:
            text = text or ""
            if self.split is not None and any(s in text for s in self.special):
                mine = [k for part in self.split.split(text) if part for k in ([get(part)] if part in self.special else map(get, pieces(part)))]
            else:
                mine = [get(p) for p in pieces(text)]
            found.append(np.array(mine, np.int64))
            counts.append(len(mine))
        index = np.concatenate(found) if found else np.zeros(0, np.int64)
        starts, ids = np.frombuffer(self.starts, np.int64), np.frombuffer(self.flat, np.int32) if len(self.flat) else np.zeros(0, np.int32)
        size = starts[index + 1] - starts[index]
        tokens = ids[expand(starts[index], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        return tokens, ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]

    def decode_all(self, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts on end, and offsets of each text."""
        tokens = np.asarray(tokens, np.int64)
        size = self.offsets[tokens + 1] - self.offsets[tokens]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[expand(self.offsets[tokens], size)], ends[offsets]


class _Known(dict):
    """Piece to its place in the codec's flat list of ids."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> int:
        c = self.codec
        ids = [c.special[piece]] if piece in c.special else c.merge_piece(piece.encode())
        c.flat.extend(ids)
        c.starts.append(len(c.flat))
        self[piece] = place = len(self)
        return place


def codec(path: str) -> Codec:
    kept = held("bpe")
    if path not in kept:
        kept[path] = Codec(path)
    return kept[path]


def _wide(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values).cast(pa.list_(values.type))


def _texts(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.string())


def _mapped(df: DataFrame, add: dict[str, str], work) -> DataFrame:
    kept = df.drop(*add)
    names, schema = kept.columns, T.StructType(list(kept.schema.fields))
    for name, kind in add.items():
        schema = schema.add(name, T.ArrayType(T.IntegerType()) if kind == "array<int>" else T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                cols = [b.column(n) for n in names] + work(b)
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *add])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds `ids` (array<int>) of column `text`."""

    def work(b: pa.RecordBatch) -> list[pa.Array]:
        tokens, offsets = codec(path).encode_all(b.column(text).to_pylist())
        return [_wide(offsets, pa.array(tokens, pa.int32()))]

    return _mapped(df, {"ids": "array<int>"}, work)


def decode(df: DataFrame, path: str) -> DataFrame:
    """Adds `decoded` (string) of column `ids`; ids outside the vocabulary raise, null ids give ''."""

    def work(b: pa.RecordBatch) -> list[pa.Array]:
        lists = [x or [] for x in b.column("ids").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return [_texts(*codec(path).decode_all(np.array([i for x in lists for i in x], np.int64), offsets))]

    return _mapped(df, {"decoded": "string"}, work)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds `ids` of column `text` and what they decode to, in one pass."""

    def work(b: pa.RecordBatch) -> list[pa.Array]:
        c = codec(path)
        tokens, offsets = c.encode_all(b.column(text).to_pylist())
        return [_wide(offsets, pa.array(tokens, pa.int32())), _texts(*c.decode_all(tokens, offsets))]

    return _mapped(df, {"ids": "array<int>", "decoded": "string"}, work)


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    done = round_trip(df.select("doc_id", "text"), path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
