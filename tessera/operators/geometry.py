"""Boxes, view panels, label vectors, image neighbourhoods and joint choices: small problems inside groups."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: the roles of a panel of one to six views; H roles take no source camera.
PANELS = {
    6: ("I1", "I2", "Hmid", "I3", "I4", "Hfinal"),
    5: ("I1", "I2", "Hmid", "I3", "Hfinal"),
    4: ("I1", "I2", "I3", "Hfinal"),
    3: ("I1", "I2", "Hfinal"),
    2: ("I1", "I2"),
    1: ("I1",),
}


def hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise (monotone chains)."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def chain(points):
        out: list[np.ndarray] = []
        for p in points:
            while len(out) > 1 and np.cross(np.append(out[-1] - out[-2], 0), np.append(p - out[-2], 0))[2] <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def least_rectangle(xy: np.ndarray) -> np.ndarray:
    """Corners of the rectangle of least area around points; one of its sides lies along the hull."""
    h = hull(xy)
    edges = np.roll(h, -1, 0) - h
    best = None
    for angle in np.unique(np.round(np.arctan2(edges[:, 1], edges[:, 0]) % (math.pi / 2), 12)):
        turn = np.array([[math.cos(angle), math.sin(angle)], [-math.sin(angle), math.cos(angle)]])
        q = h @ turn.T
        lo, hi = q.min(0), q.max(0)
        area = float(np.prod(hi - lo))
        if best is None or area < best[0] - 1e-15:
            best = area, np.array([lo, (hi[0], lo[1]), hi, (lo[0], hi[1])]) @ turn
    return best[1]


def yaw_boxes(points: DataFrame, by: str, axes: tuple[str, str, str] = ("x", "y", "z"), skip: str | None = None) -> DataFrame:
    """by, box: 8 corners (24 numbers) upright along the second axis, turned about it; axis-aligned below 3 points, zeros without any.

    Rows where `skip` is true don't count. A group in Python is one object's outline: of the points with one x only
    the least and the largest z, of which the hull's corners are some."""
    x, y, z = axes
    use = points if skip is None else points.withColumn(x, F.when(~F.col(skip), F.col(x)))
    outline = use.where(F.col(x).isNotNull()).groupBy(by, x).agg(F.min(z).alias("_z0"), F.max(z).alias("_z1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"), F.count(F.lit(1)).alias("_n"))
    kind = points.schema[by].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        floor = np.concatenate([pdf[[x, "_z0"]].to_numpy(float), pdf[[x, "_z1"]].to_numpy(float)])
        lo, hi = pdf["_y0"].min(), pdf["_y1"].max()
        flat = len(np.unique(floor, axis=0)) < 3 or np.linalg.matrix_rank(floor - floor[0], tol=1e-12) < 2
        if pdf["_n"].sum() < 3 or flat:
            (x0, z0), (x1, z1) = floor.min(0), floor.max(0)
            base = np.array([(x0, z0), (x1, z0), (x1, z1), (x0, z1)])
        else:
            base = least_rectangle(floor)
        box = [[a, h, b] for h in (lo, hi) for a, b in base]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "box": [np.array(box).ravel().tolist()]})

    found = outline.groupBy(by).applyInPandas(run, f"{by} {kind}, box array<double>")
    zeros = F.array_repeat(F.lit(0.0), 24)
    return points.select(by).distinct().join(found, by, "left").select(by, F.coalesce("box", zeros).alias("box"))


def view_panels(views: DataFrame, pairs: DataFrame, by: str, uid: str, order: str, source: str) -> DataFrame:
    """by, role, uid of the longest panel whose views are pairwise independent (pairs: by, a, b); ties go to the earlier views in `order`.

    Roles take views in order, H roles none with `source`. A group is one object's cameras."""
    kind = views.schema

    def run(key: tuple, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values([order, uid]).reset_index(drop=True)
        at = {u: k for k, u in enumerate(own[uid])}
        free = np.eye(len(own), dtype=bool)
        for a, b in zip(near.a, near.b):
            if a in at and b in at:
                free[at[a], at[b]] = free[at[b], at[a]] = True
        ok = ~own[source].to_numpy(bool)

        def fill(roles: tuple, chosen: list[int], allowed: np.ndarray) -> list[int] | None:
            if not roles:
                return chosen
            able = allowed & ok if roles[0].startswith("H") else allowed
            for k in np.flatnonzero(able):
                later = allowed & free[k] & (np.arange(len(own)) > k)
                if later.sum() >= len(roles) - 1 and (done := fill(roles[1:], [*chosen, int(k)], later)) is not None:
                    return done
            return None

        for n in range(min(6, len(own)), 0, -1):
            got = fill(PANELS[n], [], np.ones(len(own), bool))
            if got is not None:
                return pd.DataFrame({by: [key[0]] * n, "role": PANELS[n], uid: own[uid].iloc[got].to_numpy()})
        return pd.DataFrame({by: [], "role": [], uid: []})

    v, p = (d.select(*[F.col(c).alias(c) for c in d.columns]) for d in (views.select(by, uid, order, source), pairs.select(by, "a", "b")))
    return v.groupBy(by).cogroup(p.groupBy(by)).applyInPandas(run, f"{by} {kind[by].dataType.simpleString()}, role string, {uid} {kind[uid].dataType.simpleString()}")


def joint_choices(options: DataFrame, by: str, item: str, option: str, cost: str, members: str, width: int | None = None) -> DataFrame:
    """by, item, option: one option for each item so that no member is shared, of least total cost (then by option).

    Exact by branch and bound on the items' least costs; with `width` only the best partial choices are kept."""
    s = options.schema
    schema = f"{by} {s[by].dataType.simpleString()}, {item} {s[item].dataType.simpleString()}, {option} {s[option].dataType.simpleString()}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        numbers = {m: k for k, m in enumerate(sorted({m for x in pdf[members] for m in x}))}
        items = []
        for name, g in sorted(pdf.groupby(item), key=lambda e: e[0]):
            rows = [(float(c), o, sum(1 << numbers[m] for m in set(x))) for c, o, x in zip(g[cost], g[option], g[members])]
            items.append((name, sorted(rows, key=lambda e: (e[0], e[1]))))
        rest = [0.0]
        for _, rows in items[::-1]:
            rest.append(rest[-1] + rows[0][0])
        rest.reverse()
        best: list = [math.inf, None]
        front = [(0.0, (), 0)]
        for k, (_, rows) in enumerate(items):
            step = [(total + c, (*picked, o), used | mask) for total, picked, used in front for c, o, mask in rows if not used & mask]
            step.sort(key=lambda e: (e[0] + rest[k + 1], e[1]))
            front = step if width is None else step[:width]
        if front:
            best = list(min(front, key=lambda e: (e[0], e[1])))
        picked = best[1] or ()
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(picked), item: [n for n, _ in items][: len(picked)], option: list(picked)})

    return options.groupBy(by).applyInPandas(run, schema)


def label_vectors(names: list[str], dim: int) -> dict[str, list[float]]:
    """Unit vectors of equal angles to each other (a centred simplex); needs dim >= number of names - 1."""
    n = len(names)
    if dim < n - 1:
        raise ValueError("too few dimensions for equal angles")
    if n < 2:
        return {x: [1.0] + [0.0] * (dim - 1) for x in names}
    u, s, _ = np.linalg.svd(np.eye(n) - 1.0 / n)
    v = np.zeros((n, dim))
    v[:, : n - 1] = u[:, : n - 1] * s[: n - 1]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return {x: v[k].tolist() for k, x in enumerate(names)}


def neighbour_counts(pixels: DataFrame, by: list[str], y: str, x: str, bit: str) -> DataFrame:
    """Pixels with `n`: how many of the 3 x 3 around (itself included) are set; pixels outside are not."""
    shifts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = pixels.where(F.col(bit)).select(*by, y, x, F.explode(shifts).alias("d"))
    counts = near.groupBy(*by, (F.col(y) + F.col("d.a")).alias(y), (F.col(x) + F.col("d.b")).alias(x)).agg(F.count(F.lit(1)).alias("n"))
    return pixels.join(counts, [*by, y, x], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def eroded(pixels: DataFrame, by: list[str], y: str, x: str, bit: str, least: int = 5) -> DataFrame:
    return neighbour_counts(pixels, by, y, x, bit).withColumn(bit, F.col(bit) & (F.col("n") >= least)).drop("n")


def pixel_regions(pixels: DataFrame, y: str, x: str, value: str) -> DataFrame:
    """Pixels with `region`: the least index of the 4-connected area of equal value (one image)."""
    from .graph import connected_components

    wide = pixels.agg(F.max(x)).first()[0]
    key = F.col(y).cast("long") * F.lit((wide or 0) + 1) + F.col(x)
    p = pixels.withColumn("_k", key)
    right = F.lead("_k").over(Window.partitionBy(y, value).orderBy(x))
    down = F.lead("_k").over(Window.partitionBy(x, value).orderBy(y))
    edges = p.select("_k", F.when(right == F.col("_k") + 1, right).alias("r"), F.when(down == F.col("_k") + F.lit((wide or 0) + 1), down).alias("d"))
    both = edges.select(F.col("_k").alias("src"), F.explode(F.array_compact(F.array("r", "d"))).alias("dst"))
    comp = connected_components(both).withColumnRenamed("node", "_k")
    return p.join(comp, "_k", "left").withColumn("region", F.coalesce("component", "_k")).drop("_k", "component")


def ssim(a: np.ndarray, b: np.ndarray, size: int = 11, sigma: float = 1.5, top: float = 1.0) -> float:
    """Mean structural similarity of two grey images under a Gaussian window (zeros outside)."""
    g = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    g /= g.sum()
    blur = lambda m: np.apply_along_axis(np.convolve, 0, np.apply_along_axis(np.convolve, 1, m, g, "same"), g, "same")
    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def image_similarity(images: DataFrame, id_: str, a: str, b: str, wide: str) -> DataFrame:
    """id, ssim, l1 of images given as flat arrays and their width; in batches of images."""
    kind = images.schema[id_].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            pairs = [(np.asarray(p, float).reshape(-1, w), np.asarray(q, float).reshape(-1, w)) for p, q, w in zip(pdf[a], pdf[b], pdf[wide])]
            yield pd.DataFrame({id_: pdf[id_], "ssim": [ssim(p, q) for p, q in pairs], "l1": [float(np.abs(p - q).mean()) for p, q in pairs]})

    return images.select(id_, a, b, wide).mapInPandas(run, f"{id_} {kind}, ssim double, l1 double")


def clearance(pixels: DataFrame, by: str, y: str, x: str, bit: str, n: int) -> DataFrame:
    """by, rank, y, x: up to n set pixels, each farthest from the background and from those before (interior prompts)."""
    kind = pixels.schema[by].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        inside, outside = pdf[pdf[bit]][[y, x]].to_numpy(float), pdf[~pdf[bit]][[y, x]].to_numpy(float)
        if not len(inside):
            return pd.DataFrame({by: [], "rank": [], y: [], x: []})
        order = np.lexsort((inside[:, 1], inside[:, 0]))
        inside = inside[order]
        far = np.full(len(inside), np.inf)
        for k in range(0, len(outside), 256):
            far = np.minimum(far, np.sqrt(((inside[:, None] - outside[None, k : k + 256]) ** 2).sum(-1)).min(1))
        picked = []
        for _ in range(min(n, len(inside))):
            k = int(np.argmax(far))
            if picked and far[k] <= 0:
                break
            picked.append(k)
            far = np.minimum(far, np.sqrt(((inside - inside[k]) ** 2).sum(1)))
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(picked), "rank": range(len(picked)), y: inside[picked, 0].astype(int), x: inside[picked, 1].astype(int)})

    return pixels.select(by, y, x, bit).groupBy(by).applyInPandas(run, f"{by} {kind}, rank long, {y} long, {x} long")
