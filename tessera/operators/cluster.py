"""Density clustering of bounded samples, assignment to centres, and sequential samplers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spanning_tree(x: np.ndarray, core_k: int, distance: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Edges (a, b, weight) of the least spanning tree under mutual reachability; memory for a row at a time."""
    n = len(x)
    core = np.array([np.partition(distance(x[i], x), min(core_k, n) - 1)[min(core_k, n) - 1] for i in range(n)])
    best, came, inside, at = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), 0
    edges = np.zeros((max(0, n - 1), 3))
    for k in range(n - 1):
        inside[at] = True
        d = np.maximum(np.maximum(distance(x[at], x), core[at]), core)
        nearer = ~inside & (d < best)
        best[nearer], came[nearer] = d[nearer], at
        at = int(np.argmin(np.where(inside, np.inf, best)))
        edges[k] = came[at], at, best[at]
    return edges[np.argsort(edges[:, 2], kind="stable")]


def euclidean(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - p) ** 2).sum(1))


def mixed(places: int, share: float = 0.5) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """share * (1 - cosine) + (1 - share) * distance in space; the last `places` columns are coordinates, those before a unit vector."""

    def distance(p: np.ndarray, x: np.ndarray) -> np.ndarray:
        cut = len(p) - places
        return share * (1.0 - np.clip(x[:, :cut] @ p[:cut], -1.0, 1.0)) + (1.0 - share) * euclidean(p[cut:], x[:, cut:])

    return distance


def hdbscan(x: np.ndarray, least: int = 10, core_k: int | None = None, epsilon: float = 0.0, distance=euclidean) -> np.ndarray:
    """Cluster of each point by stability over the condensed tree, -1 for noise; clusters numbered by first point."""
    n = len(x)
    if n < max(2, least):
        return np.full(n, -1)
    # Single linkage: node n + k joins two earlier ones at a distance.
    root, node = np.arange(n), np.arange(n)
    find = lambda a: a if root[a] == a else find_up(a)

    def find_up(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    kids, size, height = [], np.ones(2 * n, int), np.zeros(2 * n)
    for k, (a, b, w) in enumerate(spanning_tree(x, core_k or least, distance)):
        a, b = find(int(a)), find(int(b))
        kids.append((node[a], node[b]))
        size[n + k], height[n + k] = size[node[a]] + size[node[b]], w
        root[b] = a
        node[a] = n + k

    def points(t: int) -> list[int]:
        out, todo = [], [t]
        while todo:
            t = todo.pop()
            if t < n:
                out.append(t)
            else:
                todo += kids[t - n]
        return out

    # Condensed tree: a cluster lives from the density of its birth until it splits into two large ones.
    inverse = lambda h: 1.0 / h if h > 0 else 1e12
    clusters: list[dict] = []
    todo = [(2 * n - 2, -1, 0.0)]
    while todo:
        top, parent, birth = todo.pop()
        c = {"parent": parent, "birth": birth, "stability": 0.0, "kids": [], "points": points(top), "height": height[top]}
        me = len(clusters)
        clusters.append(c)
        if parent >= 0:
            clusters[parent]["kids"].append(me)
        t = top
        while t >= n:
            a, b = kids[t - n]
            level = inverse(height[t])
            big = [s for s in (a, b) if size[s] >= least]
            if len(big) == 2:
                c["stability"] += size[t] * (level - birth)
                todo += [(s, me, level) for s in big]
                break
            if not big:
                c["stability"] += size[t] * (level - birth)
                break
            c["stability"] += (size[t] - size[big[0]]) * (level - birth)
            t = big[0]
    chosen: set[int] = set()
    value = [0.0] * len(clusters)
    for k in range(len(clusters) - 1, -1, -1):
        below = sum(value[j] for j in clusters[k]["kids"])
        if k and (not clusters[k]["kids"] or clusters[k]["stability"] >= below):
            value[k] = clusters[k]["stability"]
            chosen.add(k)
        else:
            value[k] = below
    top_chosen = [k for k in sorted(chosen) if not any(p in chosen for p in _above(clusters, k))]
    if epsilon > 0:
        lifted = set()
        for k in top_chosen:
            while clusters[k]["parent"] > 0 and clusters[k]["birth"] > 1.0 / epsilon:
                k = clusters[k]["parent"]
            lifted.add(k)
        top_chosen = [k for k in sorted(lifted) if not any(p in lifted for p in _above(clusters, k))]
    labels = np.full(n, -1)
    for number, k in enumerate(sorted(top_chosen, key=lambda k: min(clusters[k]["points"]))):
        labels[clusters[k]["points"]] = number
    return labels


def _above(clusters: list[dict], k: int):
    while (k := clusters[k]["parent"]) >= 0:
        yield k


def clusters_by(points: DataFrame, by: str, id_: str, vec: str, least: int = 3, core_k: int | None = None, most: int = 5000, seed: int = 0, cluster=hdbscan, scale: float = 10.0, threshold: float = 0.3, axes: list[str] | None = None, feature_share: float = 0.5, epsilon: float = 0.0) -> DataFrame:
    """by, id, cluster, core of every point, by the direction of its vector; `cluster` may be any function of the array and `least`.

    With `axes` the place counts too: the fit's distance is `mixed`, and a centre's similarity is feature_share * cosine + (1 - feature_share) *
    exp(-distance to its mean place). Points without a coordinate are like points without a vector.

    The fit sees at most `most` points of each group, picked by a hash of the id; `core` is its label, null of other points.
    Then every point of the group goes to a fitted cluster's centre as in `assigned`: -1 below the threshold, where
    the fit finds no cluster, and without a vector. A task in Python has about `most` points at once."""
    import pyarrow as pa
    from pyspark.sql import Window

    kind = points.schema
    type_of = lambda c: kind[c].dataType.simpleString()
    h = F.xxhash64(F.lit(seed), id_)
    axes = list(axes or [])
    whole = F.col(vec).cast("array<double>")
    if axes:
        here = [F.col(c).cast("double") for c in axes]
        known = here[0].isNotNull()
        for c in here[1:]:
            known &= c.isNotNull()
        whole = F.when(known, F.concat(whole, F.array(*here)))
    rows = points.select(by, id_, whole.alias("_v"))
    rows = rows.withColumn("_k", F.xxhash64(id_, "_v"))
    some = rows.where(F.col("_v").isNotNull())
    picked = some.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(h, id_, "_k"))).where(F.col("_r") <= most)

    def units(column) -> np.ndarray:
        x = np.stack(column).astype(float)
        cut = x.shape[1] - len(axes)
        n = np.sqrt((x[:, :cut] ** 2).sum(1, keepdims=True))
        return np.hstack([x[:, :cut] / np.where(n > 0, n, 1.0), x[:, cut:]])

    def similarity(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        cut = x.shape[1] - len(axes)
        cosines = x[:, :cut] @ c[:, :cut].T
        if not axes:
            return cosines
        gaps = np.stack([euclidean(p, x[:, cut:]) for p in c[:, cut:]], 1)
        return feature_share * np.clip(cosines, -1.0, 1.0) + (1.0 - feature_share) * np.exp(-gaps)

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([(id_, "ascending"), ("_k", "ascending")])
        x = units(table["_v"].to_numpy())
        labels = np.asarray(hdbscan(x, least, core_k, epsilon, mixed(len(axes), feature_share) if axes else euclidean) if cluster is hdbscan else cluster(x, least)).astype(np.int64)
        known = np.unique(labels[labels >= 0])
        c = units([x[labels == k].mean(0) for k in known]) if len(known) else np.zeros((0, x.shape[1]))
        n = [0]
        return pa.table({by: table[by].take(n), "_names": pa.array([known.tolist()], pa.list_(pa.int64())), "_c": pa.array([c.ravel().tolist()], pa.list_(pa.float64())), "_ids": pa.array([table["_k"].to_pylist()], pa.list_(pa.int64())), "_labels": pa.array([labels.tolist()], pa.list_(pa.int64()))})

    fitted = picked.select(by, id_, "_v", "_k").groupBy(by).applyInArrow(fit, f"{by} {type_of(by)}, _names array<bigint>, _c array<double>, _ids array<bigint>, _labels array<bigint>")
    # Parts of a group of about `most` points, each with the group's centres.
    parts = rows.groupBy(F.col(by).alias("_by")).agg(F.ceil(F.count(F.lit(1)) / most).alias("_n"))
    same = lambda df: df.join(parts, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    left = same(rows).withColumn("_p", F.pmod("_k", "_n")).drop("_n")
    right = same(fitted).withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")

    def assign(table: pa.Table, fit_: pa.Table) -> pa.Table:
        to, core = np.full(len(table), -1, np.int64), [None] * len(table)
        if len(fit_) and len(table):
            names = np.array(fit_["_names"][0].as_py(), np.int64)
            label = dict(zip(fit_["_ids"][0].as_py(), fit_["_labels"][0].as_py()))
            core = [label.get(k) for k in table["_k"].to_pylist()]
            has = np.flatnonzero(table["_v"].is_valid().to_numpy())
            if len(names) and len(has):
                c = np.array(fit_["_c"][0].as_py()).reshape(len(names), -1)
                for at in np.array_split(has, -(-len(has) // 1024)):
                    s = scale * similarity(units(table["_v"].take(pa.array(at)).to_numpy()), c)
                    share = 1.0 / np.exp(s - s.max(1, keepdims=True)).sum(1)
                    to[at] = np.where(share >= threshold, names[s.argmax(1)], -1)
        return pa.table({by: table[by], id_: table[id_], "cluster": to, "core": pa.array(core, pa.int64())})

    return left.groupBy(by, "_p").cogroup(right.groupBy(by, "_p")).applyInArrow(assign, f"{by} {type_of(by)}, {id_} {type_of(id_)}, cluster long, core long")


def centres(points: DataFrame, label: str, vec: str) -> DataFrame:
    """label, i, x: unit mean vector of each label that isn't negative, an element a row."""
    from pyspark.sql import Window

    each = points.where(F.col(label) >= 0).select(label, F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    n = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(label)))
    return each.select(label, "i", (F.col("x") / F.when(n > 0, n).otherwise(F.lit(1.0))).alias("x"))


def places(points: DataFrame, label: str, axes: list[str]) -> DataFrame:
    """label, place: mean coordinates of each label that isn't negative."""
    means = points.where(F.col(label) >= 0).groupBy(label).agg(*[F.avg(F.col(c).cast("double")).alias(f"_{k}") for k, c in enumerate(axes)])
    return means.select(label, F.array(*[f"_{k}" for k in range(len(axes))]).alias("place"))


def assigned(points: DataFrame, id_: str, vec: str, centre: DataFrame, label: str, scale: float = 10.0, threshold: float = 0.3, most: int = 10_000, axes: list[str] | None = None, place: DataFrame | None = None, feature_share: float = 0.5) -> DataFrame:
    """id, label, share: the centre of largest softmax(scale * similarity) (least label of equal ones), -1 below the threshold.

    The similarity is the cosine; with `axes` and `place` (from `places`) it is feature_share * cosine + (1 - feature_share) * exp(-distance).

    Centres are packed into one broadcast row; more than `most` of them into blocks of about as many, one after the other,
    with the rows written between them, so that one block is in memory at a time."""
    from ..functions.vector import dot, norm, unit
    from .graph import written

    def alike(c):
        cosine = dot(F.col("_v"), c["_c"])
        if not axes:
            return cosine
        apart = F.zip_with("_p", c["_q"], lambda a, b: a - b)
        return feature_share * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)) + (1.0 - feature_share) * F.exp(-norm(apart))

    blocks = -(-centre.select(label).distinct().count() // most) or 1
    spot = F.array(*[F.col(c).cast("double") for c in axes]) if axes else F.lit(None).cast("array<double>")
    at = points.select(id_, unit(vec).alias("_v"), spot.alias("_p"), F.lit(float("-inf")).alias("_top"), F.lit(0.0).alias("_total"), F.lit(None).cast(centre.schema[label].dataType).alias("_best"))
    for k in range(blocks):
        if k:
            at = written(at, "assigned")
        block = centre.where(F.pmod(F.xxhash64(label), F.lit(blocks)) == k) if blocks > 1 else centre
        packed = block.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("_c"))
        packed = packed.join(place.select(label, F.col("place").alias("_q")), label) if axes else packed.withColumn("_q", F.lit(None).cast("array<double>"))
        one = packed.agg(F.array_sort(F.collect_list(F.struct(label, "_c", "_q"))).alias("_all"))
        sims = at.crossJoin(F.broadcast(one))  # one row
        sims = sims.withColumn("_s", F.transform("_all", lambda c: F.struct((F.lit(scale) * alike(c)).alias("s"), c[label].alias("l")))).drop("_all")
        top = F.aggregate("_s", F.col("_top"), lambda m, e: F.greatest(m, e["s"]))
        sims = sims.withColumn("_new", top)
        total = F.aggregate("_s", F.when(F.col("_total") > 0, F.col("_total") * F.exp(F.col("_top") - F.col("_new"))).otherwise(0.0), lambda t, e: t + F.exp(e["s"] - F.col("_new")))
        here = F.array_min(F.transform(F.filter("_s", lambda e: e["s"] == F.col("_new")), lambda e: e["l"]))
        best = F.least(here, F.when(F.col("_top") == F.col("_new"), F.col("_best")))  # nulls are passed over
        at = sims.select(id_, "_v", "_p", F.col("_new").alias("_top"), total.alias("_total"), best.alias("_best"))
    share = F.lit(1.0) / F.col("_total")
    return at.select(id_, F.when(share >= threshold, F.col("_best")).otherwise(-1).alias(label), share.alias("share"))


def hash_sample(rows: DataFrame, id_: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same ones whatever the partitions: the least hashes (MD5 of seed and id) of the ids."""
    return rows.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(id_).cast("string"))), id_).limit(n)


def farthest_points(points: DataFrame, by: str, id_: str, axes: list[str], n: int) -> DataFrame:
    """by, id, rank: each next point is the farthest from those before, from the least id on."""
    kind = points.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_)
        x, k = pdf[axes].to_numpy(float), 0
        far, order = np.full(len(x), np.inf), []
        for _ in range(min(n, len(x))):
            order.append(k)
            far = np.minimum(far, ((x - x[k]) ** 2).sum(1))
            k = int(np.argmax(far))
        return pd.DataFrame({by: pdf[by].iloc[order], id_: pdf[id_].iloc[order], "rank": range(len(order))})

    return points.select(by, id_, *axes).groupBy(by).applyInPandas(run, f"{by} {kind[by].dataType.simpleString()}, {id_} {kind[id_].dataType.simpleString()}, rank long")


def spaced_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """n evenly spaced rows in an order, first and last included."""
    from .ordered import numbered

    total = rows.count()
    want = sorted({round(k * (total - 1) / max(1, n - 1)) for k in range(min(n, total))})
    at = rows.sparkSession.createDataFrame([(k,) for k in want], "_k long")
    return numbered(rows, order, "_k").join(F.broadcast(at), "_k", "left_semi").drop("_k")


def quantile_map(rows: DataFrame, value: str, grid: int = 1000) -> DataFrame:
    """Rows with `u`: the value's share on a grid of quantiles, from 0 to 1."""
    levels = [k / grid for k in range(grid + 1)]
    edges = rows.agg(F.percentile(value, F.array(*[F.lit(x) for x in levels])).alias("_e"))
    at = rows.crossJoin(F.broadcast(edges))  # one row
    return at.withColumn("u", F.size(F.filter("_e", lambda e: e <= F.col(value))).cast("double") / (grid + 1)).drop("_e")


def face_samples(faces: DataFrame, by: str, face: str, corners: list[list[str]], area: str, count: int, seed: int = 0) -> DataFrame:
    """by, draw, x, y, z: `count` points a mesh, drawn with replacement by area and evenly within a face (PCG64 from the seed).

    corners: the names of the x, y, z columns of each of the three corners. Faces are taken in order of `face`; those without a positive area
    are passed over, and a mesh that has no others gives no rows. A group in Python has a mesh's face numbers and areas; corners are joined to
    the draws in Spark."""
    kind = faces.schema[by].dataType.simpleString()
    face_kind = faces.schema[face].dataType.simpleString()
    good = faces.where(F.col(area) > 0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(face, kind="stable")
        rng = np.random.default_rng(seed)
        weight = pdf[area].to_numpy(float)
        chosen = rng.choice(len(pdf), size=count, replace=True, p=weight / weight.sum())
        r, along = np.sqrt(rng.random(count)), rng.random(count)
        return pd.DataFrame({by: pdf[by].iloc[0], face: pdf[face].to_numpy()[chosen], "draw": np.arange(count), "_w0": 1.0 - r, "_w1": r * (1.0 - along), "_w2": r * along})

    drawn = good.select(by, face, F.col(area).cast("double").alias(area)).groupBy(by).applyInPandas(run, f"{by} {kind}, {face} {face_kind}, draw long, _w0 double, _w1 double, _w2 double")
    point = [sum((F.col(f"_w{k}") * F.col(corners[k][d]) for k in range(3)), F.lit(0.0)).alias(n) for d, n in enumerate("xyz")]
    return drawn.join(good.select(by, face, *{c for three in corners for c in three}), [by, face]).select(by, "draw", *point)
