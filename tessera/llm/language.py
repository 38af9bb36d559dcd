"""Language ID by cross-parsing entropy.

A suffix automaton of labelled text stands for each language. A text is cut into phrases, each the
longest that occurs in that training text; phrases * log2(training length) / length estimates the
cross entropy in bits a character, and the language with the fewest wins (of equals, the first in
alphabetical order). Letters are lower-cased, runs of anything else become one blank. Texts are
parsed whole, in lanes of LANE characters where a new phrase starts.

The models are fitted on a bounded sample: of each language whole texts in order of a hash of the
text, up to `chars` characters (the last one is cut), from at most `most_docs` of them.

Result for each row: `lang_pred`, `und` for a text that is null or has no letter, or if nothing was
learned; `score` from 0 to 1, the share by which the winner needs fewer bits than the runner-up (with
one language: 1 less its bits as a share of the bits of one phrase per character). Equal texts get
equal results; other columns pass through, those named like the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, slices

CHARS, DOCS, LANGS, LANE = 40_000, 256, 256, 1024
SCHEMA = "lang_pred string, score double"


class Automaton:
    """Suffix automaton of one sequence of codes; every path from state 0 spells a factor of it."""

    def __init__(self, codes: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            cur = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur


def letters() -> np.ndarray:
    """Which code points are letters."""
    kept = held("language")
    if "letters" not in kept:
        kept["letters"] = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)
    return kept["letters"]


def points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts on end, each text ended by code point 0; and the ends."""
    joined = "".join(f"{(t or '').replace(chr(0), ' ')}\0" for t in texts).lower()
    p = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    return p, np.flatnonzero(p == 0)


class Models:
    """Suffix automata of several languages in one table: (state, code) to next state * 2 + whether a phrase begins."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        seen = points([texts[x] for x in self.langs])[0]
        known = np.unique(seen[letters()[seen]])
        self.code = np.where(letters(), 1, 0).astype(np.uint8 if len(known) < 250 else np.uint16)
        self.code[known] = np.arange(2, len(known) + 2)
        self.width = len(known) + 2
        tables, self.idle, base, bits = [], [], 0, []
        for x in self.langs:
            codes = self.squeezed([texts[x]])[0]
            auto = Automaton(codes.tolist())
            idle = base + len(auto.next)  # before a first phrase, and after a character that the language lacks
            root = np.full(self.width, idle * 2 + 1, np.int64)
            for c, t in auto.next[0].items():
                root[c] = (base + t) * 2 + 1
            table = np.tile(root, (len(auto.next) + 1, 1))
            for s, step in enumerate(auto.next):
                for c, t in step.items():
                    table[s, c] = (base + t) * 2
            tables.append(table)
            self.idle.append(idle)
            base += len(table)
            bits.append(np.log2(max(2, len(codes))))
        self.table = np.concatenate(tables).ravel().astype(np.int32 if base < 2**30 else np.int64) if tables else np.zeros(0, np.int32)
        self.bits = np.array(bits)

    def squeezed(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes without blanks after blanks or at an end, offsets by text, and which texts have a letter."""
        p, ends = points(texts)
        codes = self.code[p]
        blank = codes == 0
        after = np.concatenate([[True], blank[:-1]])
        keep = ~(blank & after) & (p != 0)
        kept = np.concatenate([[0], np.cumsum(keep)])
        some = np.concatenate([[0], np.cumsum(~blank)])
        starts = np.concatenate([[0], ends[:-1] + 1])
        return codes[keep], np.concatenate([[0], kept[ends]]), some[ends] > some[starts]

    def phrases(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text (row) by each language (column)."""
        size = np.diff(offsets)
        lanes = -(-size // LANE)
        owner = np.repeat(np.arange(len(size)), lanes)
        first = np.concatenate([[0], np.cumsum(lanes)])[:-1]
        begin = offsets[:-1][owner] + (np.arange(len(owner)) - first[owner]) * LANE
        length = np.minimum(LANE, offsets[1:][owner] - begin)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        n_at = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
        state = np.repeat(np.array(self.idle, self.table.dtype)[:, None], len(begin), 1)
        count = np.zeros(state.shape, np.int32)
        for t, n in enumerate(n_at):
            v = self.table[state[:, :n] * self.width + codes[begin[:n] + t]]
            count[:, :n] += v & 1
            state[:, :n] = v >> 1
        out = np.zeros((len(size), len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner[order], weights=count[k], minlength=len(size))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        codes, offsets, has = self.squeezed(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        size = np.maximum(1, np.diff(offsets))
        cost = self.phrases(codes, offsets) * self.bits / size[:, None]
        best = cost.argmin(1)
        low = cost[np.arange(len(cost)), best]
        second = np.partition(cost, 1, 1)[:, 1] if len(self.langs) > 1 else np.full(len(cost), self.bits[0])
        score = np.clip(1 - low / np.maximum(second, 1e-12), 0, 1) * has
        return [self.langs[b] if h else "und" for b, h in zip(best, has)], score


def sample(labelled: DataFrame, text: str = "text", lang: str = "lang", chars: int = CHARS, most_docs: int = DOCS) -> dict[str, str]:
    """Training text of each language, at most `chars` characters each; bounded whatever the input's size."""
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("t").isNotNull() & F.col("l").isNotNull())
    h = F.xxhash64("t")
    # Of distinct texts: copies pass or fail together.
    counts = {r.l: r.n for r in rows.select("l", h.alias("h")).distinct().groupBy("l").agg(F.count(F.lit(1)).alias("n")).limit(LANGS + 1).collect()}
    if len(counts) > LANGS:
        raise ValueError(f"more than {LANGS} languages")
    if not counts:
        return {}
    # A threshold on the hash lets about most_docs / 2 texts of each language through.
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, most_docs / 2 / n))])
    picked = rows.where(F.pmod(h, F.lit(1 << 30)) < share[F.col("l")] * (1 << 30)).withColumn("h", h)
    took: dict[str, list[str]] = {}
    bounded = picked.select("l", "h", F.substring("t", 1, chars).alias("t")).dropDuplicates(["l", "h"]).orderBy("h", "l").limit(len(counts) * most_docs)
    for r in sorted(bounded.collect(), key=lambda r: (r.l, r.h)):
        took.setdefault(r.l, []).append(r.t)
    return {k: " ".join(v)[:chars] for k, v in took.items()}


def models(texts: dict[str, str]) -> Models:
    kept, key = held("language"), hashlib.sha256(repr(sorted(texts.items())).encode()).hexdigest()
    if key not in kept:
        for old in set(kept) - {"letters"}:
            del kept[old]
        kept[key] = Models(texts)
    return kept[key]


def identify(df: DataFrame, texts: dict[str, str], text: str = "text") -> DataFrame:
    """Adds `lang_pred` and `score` by models of the given training texts."""
    kept = df.drop("lang_pred", "score")
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = models(texts)
        for batch in batches:
            for b in slices(batch, text, 1 << 22):
                lang, score = m.predict(b.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def held_out(col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))), F.lit(4)) == 2


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the labelled rows that aren't held out."""
    texts = sample(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), texts).drop("text")
