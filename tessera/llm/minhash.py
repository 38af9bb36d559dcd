"""MinHash near-dedup by DartMinHash.

A document is a weighted set of shingles of WORDS words (all its words, if fewer). Darts lie in the plane of
weight and rank above each shingle: every cell of unit area has a Poisson(1) number of them, at places
that only the shingle and the cell decide. Darts below the shingle's weight and before a rank that yields
about K ln K + 2 K of them per document are looked at; the earliest in each of K coordinates is the
signature (with a coordinate empty, the rank is doubled). Two signatures agree in a coordinate with the
probability of the weighted Jaccard similarity. BANDS bands of ROWS coordinates each (drawn from the K, so bands
share some) are joined.

Equal texts are one. In each band's group all texts are paired with two leaders, and what is still in different
classes with all others of its group; pairs that earlier links have joined already aren't compared. A compared pair is verified on the whole
sets of shingles (weights are 1 there; signatures also take counts as weights), a similarity of SIMILARITY or more links it, and classes are the connected components.
A pair at 0.8 shares no band with a probability of 5 in 10,000, at 0.85 of 7 in a million.

Result: doc_id, class_id (the least doc_id of the class). Texts without words, and null texts, are linked to
equal texts only. A doc_id names one document: of rows that reuse it for different texts each counts by itself, but
links lead to all of them. A null doc_id has the class null. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components, written
from .common import BASE, U, expand, flat, held, mix, slices, windows, words

WORDS, SIMILARITY, K, ROWS, BANDS = 5, 0.8, 160, 8, 64
#: The coordinates of each band: a fixed draw, so that K serves more bands than K / ROWS.
_DRAW = np.random.default_rng(20200423)
PLACES = np.stack([_DRAW.permutation(K)[:ROWS] for _ in range(BANDS)])
#: Longs of the bitmap by which pairs are bounded before their sets are compared.
MAP = 16
_GOLD = U(0x9E3779B97F4A7C15)
_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, n + 1, dtype=float))) for n in range(20)])


def uniform(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(np.float64) * 2.0**-53


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of each distinct shingle, by document."""
    _, _, doc, h, _ = words(raw, offsets)
    run = windows(h, n)
    inside = doc[: len(run)] == doc[n - 1 :] if len(run) else np.zeros(0, bool)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    few = np.flatnonzero((count > 0) & (count < n))
    first = np.concatenate([[0], np.cumsum(count)])
    short = np.array([windows(h[first[d] : first[d + 1]], int(count[d]))[0] for d in few], np.uint64)
    d = np.concatenate([doc[: len(run)][inside], few])
    e = np.concatenate([run[inside], short])
    order = np.lexsort((e, d))
    d, e = d[order], e[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (e[1:] != e[:-1])
    at = np.flatnonzero(new)
    return d[at], e[at], np.diff(np.append(at, len(d)))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Signature (n_docs x k) of weighted sets given by document in order, and which documents have one."""
    held("minhash")
    out = np.zeros((n_docs, k), np.uint64)
    norm = np.bincount(doc, weights=weight, minlength=n_docs)
    has = norm > 0
    theta = np.where(has, (k * np.log(k) + 2 * k) / np.maximum(norm, 1e-300), 0)
    left = has.copy()
    while left.any():
        mine = left[doc]
        d, e, w = doc[mine], element[mine], weight[mine].astype(float)
        # Weights are cut at 1, 2, 4 ...; a strip of width x has cells of height 1 / x.
        strips = np.where(w > 1, np.ceil(np.log2(np.maximum(w, 1))).astype(np.int64), 0) + 1
        at = np.repeat(np.arange(len(d)), strips)
        nu = expand(np.zeros(len(d), np.int64), strips)
        low = np.where(nu > 0, 2.0 ** (nu - 1), 0.0)
        width = np.where(nu > 0, 2.0 ** (nu - 1), 1.0)
        cells = np.ceil(theta[d[at]] * width).astype(np.int64)
        row = np.repeat(np.arange(len(at)), cells)
        rho = expand(np.zeros(len(at), np.int64), cells)
        seed = mix(e[at[row]] + mix((nu[row].astype(np.uint64) << U(48)) + rho.astype(np.uint64) + U(1)))
        darts = np.searchsorted(_POISSON, uniform(mix(seed ^ _GOLD)), "right")
        cell = np.repeat(np.arange(len(row)), darts)
        dart = mix(seed[cell] + _GOLD * (expand(np.zeros(len(row), np.int64), darts) + 1).astype(np.uint64))
        strip = row[cell]
        rank = (rho[cell] + uniform(dart)) / width[strip]
        height = low[strip] + width[strip] * uniform(mix(dart + U(1)))
        owner = d[at[strip]]
        keep = (rank < theta[owner]) & (height < w[at[strip]])
        value = mix(dart[keep] + U(2))
        place = owner[keep] * k + (value % U(k)).astype(np.int64)
        order = np.lexsort((rank[keep], place))
        place, value = place[order], value[order]
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        full = np.bincount(place[first] // k, minlength=n_docs) == k
        done = first & (full & left)[place // k]
        out.reshape(-1)[place[done]] = value[done]
        left &= ~full
        theta = np.where(left, theta * 2, theta)
    return out, has


def bands(sig: np.ndarray) -> np.ndarray:
    """A key for each band."""
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        key = key * BASE + sig[:, PLACES[:, r]]
    return mix(key).view(np.int64)


def band_rows(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """`doc`, `keys` (a key for each band) of rows (doc, text) that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, most=256):
                d, e, n = shingles(*flat(b.column("text")))
                sig, has = signatures(d, e, n if weighted else np.ones(len(n)), b.num_rows)
                key = bands(sig[has])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1) * BANDS, pa.int32()), pa.array(key.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc").filter(pa.array(has)), lists], names=["doc", "keys"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, keys array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """`doc`, `s`: hashes of the distinct shingles of rows (doc, text); `bits`: which of 64 * MAP cells they fall into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, most=1024):
                d, e, _ = shingles(*flat(b.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(b.num_rows + 1)), pa.int32()), pa.array(e.view(np.int64)))
                cells = np.zeros((b.num_rows, 64 * MAP), bool)
                cells[d, (e % U(64 * MAP)).astype(np.int64)] = True
                bits = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * MAP, pa.int32()), pa.array(np.packbits(cells, 1).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc"), lists, bits], names=["doc", "s", "bits"])

    return texts.select("doc", "text").mapInArrow(run, "doc long, s array<long>, bits array<long>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets (doc, s) have Jaccard similarity `threshold` or more.

    The joins are sort-merge joins at every size: sets are long, and a frequent leader's pairs can be split."""
    with_b = pairs.join(sets.select(F.col("doc").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
    both = with_b.join(sets.select(F.col("doc").alias("a"), F.col("s").alias("sa")).hint("merge"), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", common.alias("n"), F.size("sa").alias("na"), F.size("sb").alias("nb")).where(F.col("n") >= F.lit(threshold) * (F.col("na") + F.col("nb") - F.col("n")))


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that are in different classes so far."""
    a, b = (found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """`node`, `component` after further links between classes; what isn't there is a class of its own."""
    links = written(links.select("a", "b"), "links")
    if found is None:
        return written(connected_components(links, "a", "b"), "classes")
    if links.isEmpty():
        return found
    a, b = (found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    edges = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    more = written(connected_components(edges, "a", "b"), "classes")
    new = more.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = found.join(new, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return written(old.unionAll(more.join(found, "node", "left_anti")), "classes")


def lacking(x: str, y: str):
    """How many cells text x has and y lacks: as many of its shingles at least aren't y's."""
    at = lambda t, k: F.get(F.col(f"{t}.bits"), F.lit(k))
    return sum((F.bit_count(at(x, k).bitwiseAND(F.bitwise_not(at(y, k)))) for k in range(MAP)), F.lit(0))


def possible(left: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows (key, doc, c) that may still have a partner in their group, with n shingles and u that no other text left has.

    A partner has at least max(0.8 n, the group's least) shingles and shares n - u at most: an exact bound."""
    own = sets.join(left.select("doc").distinct(), "doc", "left_semi")
    each = own.select("doc", F.explode("s").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("k"), F.min("doc").alias("doc"))
    solo = each.where("k = 1").groupBy("doc").agg(F.count(F.lit(1)).alias("u"))
    sized = own.select("doc", "bits", F.size("s").alias("n")).join(solo, "doc", "left").select("doc", "bits", "n", F.coalesce("u", F.lit(0)).alias("u"))
    rows = written(left.join(sized, "doc"), "sized")
    least = rows.groupBy("key").agg(F.min("n").alias("lo"))
    at_least = F.greatest(F.col("lo"), F.lit(SIMILARITY) * F.col("n"))
    kept = rows.join(least, "key").where(F.col("n") - F.col("u") >= F.lit(SIMILARITY) * (at_least + F.col("u")) - 1e-9)
    return written(kept.select("key", "doc", "c", "n", "u", "bits"), "possible")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id of every row of documents (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    hashed = rows.select("doc", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).where("doc IS NOT NULL")
    same = written(hashed.groupBy("h1", "h2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n")), "texts")
    reps = same.select(F.col("rep").alias("doc"))
    texts = rows.where("doc IS NOT NULL")
    keyed = band_rows(texts).join(reps.distinct(), "doc", "left_semi").select("doc", F.explode("keys").alias("key"))
    keyed = written(keyed, "bands")
    groups = keyed.groupBy("key").agg(F.min("doc").alias("first"), F.min_by("doc", F.xxhash64("doc")).alias("other"), F.max("doc").alias("last")).where("first <> last")
    spread = keyed.join(groups.select("key", "first", "other"), "key")
    pairs = spread.select(F.explode(F.array(F.struct(F.col("first").alias("a"), F.col("doc").alias("b")), F.struct(F.least("other", "doc").alias("a"), F.greatest("other", "doc").alias("b")))).alias("p")).select("p.a", "p.b").where("a <> b")
    pairs = written(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "pairs")
    nodes = pairs.select(F.col("a").alias("doc")).unionAll(pairs.select("b")).distinct()
    sets = written(shingle_sets(texts.join(nodes.hint("merge"), "doc", "left_semi")), "sets")
    # First the leader with which a text shares most bands; then what that leaves apart of the other leaders' pairs,
    # and last what a group still holds in different classes, outright.
    best = pairs.groupBy("b").agg(F.max(F.struct("n", "a")).alias("m")).select("m.a", "b")
    found = joined(None, verified(best, sets))
    found = joined(found, verified(apart(pairs, found).join(best, ["a", "b"], "left_anti"), sets))
    of = spread.select("key", "doc").join(found.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("c"))
    mixed = of.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    left = written(of.join(mixed, "key"), "apart")
    left = possible(left, sets)
    inter = F.least(F.col("x.n") - F.greatest("x.u", lacking("x", "y")), F.col("y.n") - F.greatest("y.u", lacking("y", "x")))
    may = inter >= F.lit(SIMILARITY) * (F.col("x.n") + F.col("y.n") - inter) - 1e-9
    rest = left.alias("x").join(left.alias("y"), "key").where((F.col("x.doc") < F.col("y.doc")) & (F.col("x.c") != F.col("y.c")) & may)
    rest = rest.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()
    found = joined(found, verified(rest.join(pairs, ["a", "b"], "left_anti"), sets))
    # Rows to the first row of their text, and on to its class.
    by_text = same.where("n > 1").select("h1", "h2", "rep")
    own = hashed.join(by_text, ["h1", "h2"], "left").select("doc", F.coalesce("rep", "doc").alias("rep"))
    done = own.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc", F.coalesce("component", "rep").alias("class_id"))
    return done.select(F.col("doc").alias("doc_id"), "class_id").unionAll(rows.where("doc IS NULL").select("doc", F.lit(None).cast("long")))
