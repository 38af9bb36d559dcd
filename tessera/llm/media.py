"""Media columns as interleaved document sequences.

HTML is parsed into an ordered sequence of structs: text runs, and references to media with their captions (of
the figure around them, else their alternative text). References name a payload by its SHA-256 digest. Payloads
lie in a store of their own as 8-bit grey images (binary PGM, WIDTH samples a row), which holds every byte; a join
by digest resolves references to what was read back from the store, and positions and captions stay where
they were.

Payload: the UTF-8 bytes of a text (null is empty), with bytes 0 appended to a positive multiple of WIDTH. Equal
payloads have equal digests and may be stored more than once; any copy serves. HTML that is null or has
nothing gives an empty sequence; unclosed and stray tags are taken as browsers would roughly take them; script and
style are left out. A reference whose payload isn't in the store resolves to nulls. Repeated rows give
repeated results, an empty table none; other columns are ignored.

References to one payload may be a large share of all: the digests with more than `hot` references, of which there can be
no more than references / hot, are joined by a broadcast of their features, the others by a shuffle.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import written
from .common import workspace

WIDTH, SCHEME = 64, "sha256:"
PART = "struct<position:int,kind:string,text:string,ref:string,caption:string>"
_MEDIA = {"img", "video", "audio", "source", "embed"}
_SKIP = {"script", "style", "noscript", "template"}
_BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "table", "section", "article", "figure", "figcaption", "blockquote", "pre", "nav", "header", "footer", "title"}


class Sequence(HTMLParser):
    """Parts of one page in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.words: list[str] = []
        self.skipped, self.figures, self.caption = 0, [], None

    def end_text(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.words)).strip()
        self.words = []
        if text:
            self.parts.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skipped += 1
        elif tag in _BREAKS or tag in _MEDIA:
            self.end_caption() if tag == "figcaption" else None
            self.end_text()
        if tag == "figure":
            self.figures.append([])
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA and not self.skipped and (src := dict(attrs).get("src")):
            part = {"kind": "media", "text": None, "ref": src, "caption": dict(attrs).get("alt") or None}
            self.parts.append(part)
            if self.figures:
                self.figures[-1].append(part)

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag in _BREAKS:
            if tag == "figure":
                self.end_caption()
            self.end_text()
        if tag == "figure" and self.figures:
            mine = self.figures.pop()
            for part in mine:
                if isinstance(part, dict):
                    part["caption"] = next((c for c in mine if isinstance(c, str)), part["caption"])

    def end_caption(self) -> None:
        if self.caption is not None:
            text = re.sub(r"\s+", " ", "".join(self.caption)).strip()
            self.caption = None
            if text and self.figures:
                self.figures[-1].append(text)

    def handle_data(self, data):
        if self.skipped:
            return
        (self.caption if self.caption is not None else self.words).append(data)

    def close(self):
        super().close()
        while self.figures:
            self.handle_endtag("figure")
        self.end_caption()
        self.end_text()


def sequence(html: str | None) -> list[dict]:
    p = Sequence()
    p.feed(html or "")
    p.close()
    return [{"position": k} | x for k, x in enumerate(p.parts)]


def parsed(pages: DataFrame, id_col: str = "doc_id", html: str = "html") -> DataFrame:
    """The id and `sequence` (array of PART) of each page."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sequence(x) for x in b.column(1).to_pylist()], pa.list_(part))], names=[id_col, "sequence"])

    return pages.select(id_col, html).mapInArrow(run, f"{id_col} {kind}, sequence array<{PART}>")


def payload(text):
    """A text column's payload."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    size = F.octet_length(raw)
    more = F.when(size == 0, F.lit(WIDTH)).otherwise(F.pmod(-size, F.lit(WIDTH)))
    return F.concat(raw, F.repeat(F.lit("\0"), more).cast("binary"))


def image(data: bytes) -> bytes:
    return f"P5\n{WIDTH} {len(data) // WIDTH}\n255\n".encode() + data


def samples(stored: bytes) -> bytes:
    """The payload in a stored image; raises if it isn't one."""
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", stored)
    data = stored[head.end() :] if head else b""
    if not head or len(data) != int(head[1]) * int(head[2]):
        raise ValueError("not a whole 8-bit image")
    return data


def store(payloads: DataFrame, at: str) -> None:
    """Writes column `payload` (binary) as images named by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                data = batch.column("payload").slice(lo, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(x).hexdigest() for x in data]), pa.array([image(x) for x in data], pa.binary())], names=["digest", "media"])

    payloads.select("payload").mapInArrow(run, "digest string, media binary").write.option("compression", "zstd").parquet(at)


_FEATURES = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}


def feature(data: bytes) -> str:
    """Mean sample, mean absolute step to the next sample, and shares of 8 bins, to 6 digits."""
    v = np.frombuffer(data, np.uint8)
    step = np.abs(np.diff(v.astype(np.int16))).mean() if len(v) > 1 else 0.0
    bins = np.bincount(v >> 5, minlength=8) / len(v)
    return f"mean={v.mean():.6f};step={step:.6f};bins=" + ",".join(f"{b:.6f}" for b in bins)


def features(spark: SparkSession, at: str) -> DataFrame:
    """`digest` and the features of each payload in the store, once."""
    names = list(_FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                rows = []
                for x in b.column("media").to_pylist():
                    d = samples(x)
                    rows.append((len(d), hashlib.sha256(d).hexdigest(), zlib.crc32(d[-WIDTH:]), len(x), hashlib.sha256(x).hexdigest(), feature(d)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column("digest"), *(pa.array(c, pa.int64() if _FEATURES[n] == "long" else pa.string()) for c, n in zip(cols, names))], names=["digest", *names])

    read = spark.read.schema("digest string, media binary").parquet(at)
    return read.mapInArrow(run, "digest string, " + ", ".join(f"{n} {k}" for n, k in _FEATURES.items())).dropDuplicates(["digest"])


#: Digests that are joined by broadcast at most; so many of the most frequent ones are looked at.
MOST_HOT = 1000


def resolved(sequences: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each media reference: id, position, caption, ref, and what the store has of it."""
    refs = sequences.select(id_col, F.explode(F.filter("sequence", lambda x: x["kind"] == "media")).alias("m")).select(id_col, "m.position", "m.caption", "m.ref")
    refs = written(refs.withColumn("digest", F.when(F.col("ref").startswith(SCHEME), F.substring("ref", len(SCHEME) + 1, 64))), "refs")
    found = written(found, "features")
    # The digests that more than one in MOST_HOT references has: fewer than MOST_HOT.
    counts = refs.where("digest IS NOT NULL").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    total = refs.count()
    hot = [r.digest for r in counts.where(F.col("n") > max(100, total / MOST_HOT)).select("digest").collect()]
    apart = F.col("digest").isin(hot) if hot else F.lit(False)
    parts = [refs.where("digest IS NULL").join(found.where("false"), "digest", "left")]  # refers to no payload
    parts.append(refs.where(F.col("digest").isNotNull() & ~apart).join(found.where(~apart), "digest", "left"))
    if hot:
        parts.append(refs.where(apart).join(F.broadcast(found.where(apart)), "digest", "left"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.drop("digest")


def interleaved(sequences: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The id (of one page) and `sequence` with each reference resolved in its place: parts with `media`, null for text."""
    rows = resolved(sequences, found, id_col).select(F.col(id_col).alias("_id"), F.struct("position", F.struct(*_FEATURES).alias("media")).alias("m"))
    by_id = rows.groupBy("_id").agg(F.collect_set("m").alias("media"))
    joined = sequences.join(by_id, sequences[id_col] == by_id["_id"], "left").drop("_id")
    return joined.withColumn("sequence", F.transform("sequence", lambda p: p.withField("media", F.get(F.filter("media", lambda m: m["position"] == p["position"]), F.lit(0))["media"]))).drop("media")


def document_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the features of each document's text as a medium: stored, referred to by HTML, resolved."""
    spark = docs.sparkSession
    at = workspace(spark, "media")
    rows = docs.select("doc_id", payload("text").alias("payload"), F.coalesce(F.octet_length(F.col("text").cast("binary")), F.lit(0)).cast("string").alias("n"))
    store(rows, at)
    ref = F.concat(F.lit(SCHEME), F.sha2("payload", 256))
    pages = rows.select("doc_id", F.concat(F.lit('<figure><img src="'), ref, F.lit('"><figcaption>'), F.col("n"), F.lit("</figcaption></figure>")).alias("html"))
    done = resolved(parsed(pages), features(spark, at))
    return done.select("doc_id", F.col("caption").cast("long").alias("n_bytes"), *_FEATURES, "position")
