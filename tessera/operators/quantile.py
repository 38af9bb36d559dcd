"""Weighted quantiles, ECDF scores and the shrinkage hierarchy of class priors."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import numbered, shares

LEVELS = (0.05, 0.25, 0.5, 0.75, 0.95)


def weighted_quantiles(rows: DataFrame, by: list[str], value: str, weight: str, levels: Sequence[float] = LEVELS) -> DataFrame:
    """by, q05 ... : position of a value is (cumulated weight - half its own) / total; linear between, clamped.

    Equal values come in the order of their weights, so the outcome doesn't depend on the rows' order. Running sums go over
    ranges of (by, value), and each level takes the neighbours on either side by aggregates: no task holds a group."""
    run = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w"))
    run = numbered(run, [*by, "_v", "_w"], "_k", {"_c": "_w"})
    total = run.groupBy(*by).agg(F.sum("_w").alias("_t"), F.min(F.struct("_k", (F.col("_c") - F.col("_w")).alias("c"))).alias("_b"))
    total = total.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_t", F.col("_b.c").alias("_b"))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    run = run.join(total, same) if by else run.crossJoin(F.broadcast(total))  # one row
    at = F.struct(((F.col("_c") - F.col("_b") - F.col("_w") / 2) / F.col("_t")).alias("p"), F.col("_v").alias("v"))
    found = run.select(*by, at.alias("_x")).groupBy(*by)
    sides = [x for k, q in enumerate(levels) for x in (F.max(F.when(F.col("_x.p") <= q, F.col("_x"))).alias(f"_l{k}"), F.min(F.when(F.col("_x.p") > q, F.col("_x"))).alias(f"_h{k}"))]
    out = []
    for k, q in enumerate(levels):
        lo, hi = F.col(f"_l{k}"), F.col(f"_h{k}")
        between = lo["v"] + (hi["v"] - lo["v"]) * (F.lit(q) - lo["p"]) / (hi["p"] - lo["p"])
        out.append(F.coalesce(between, lo["v"], hi["v"]).alias(f"q{round(q * 100):02d}"))
    return found.agg(*sides).select(*by, *out)


def scene_weights(rows: DataFrame, by: list[str], scene: str, value: str) -> DataFrame:
    """Rows with a finite value and `weight`: each scene of a group weighs 1 in all."""
    d = F.col(value).try_cast("double")
    kept = rows.where(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")))
    n = kept.groupBy(*by, scene).agg(F.count(F.lit(1)).alias("_n"))
    keys = [*by, scene]
    n = n.select(*[F.col(c).alias(f"_of_{c}") for c in keys], (F.lit(1.0) / F.col("_n").cast("double")).alias("weight"))
    return kept.join(n, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]).drop(*[f"_of_{c}" for c in keys])


def scene_balanced(rows: DataFrame, by: list[str], scene: str, value: str, levels: Sequence[float] = LEVELS) -> DataFrame:
    return weighted_quantiles(scene_weights(rows, by, scene, value), by, value, "weight", levels)


def support(rows: DataFrame, by: list[str], scene: str, scan: str, valid: str, most: int = 5) -> DataFrame:
    """by, scenes, scans, instances, n_eff (instances, at most `most` of a scene), quality (valid share)."""
    per = rows.groupBy(*by, scene).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(valid).cast("boolean")).alias("ok"))
    scans = rows.groupBy(*by).agg(F.countDistinct(scan).alias("scans"))
    out = per.groupBy(*by).agg(F.count(F.lit(1)).alias("scenes"), F.sum("n").alias("instances"), F.sum(F.least("n", F.lit(most))).alias("n_eff"), (F.sum("ok") / F.sum("n").cast("double")).alias("quality"))
    return out.join(scans, by) if by else out.crossJoin(scans)


def small_scores(rows: DataFrame, area: str, diagonal: str) -> DataFrame:
    """Rows with small_score = 1 - half the sum of the two shares of rows that are no larger."""
    out = rows
    for k, c in enumerate((area, diagonal)):
        at = shares(rows, c, f"_share{k}").withColumnRenamed(c, f"_of{k}")
        out = out.join(at, F.col(c).eqNullSafe(F.col(f"_of{k}")))
    return out.withColumn("small_score", F.lit(1.0) - F.lit(0.5) * (F.col("_share0") + F.col("_share1"))).select(*rows.columns, "small_score")


def shrunk(child: DataFrame, parent: DataFrame, on: list[str], values: list[str], weight: str) -> DataFrame:
    """weight * child + (1 - weight) * parent for each value; where one side lacks it, the other's."""
    p = parent.select(*on, *[F.col(v).alias(f"_p_{v}") for v in values])
    both = child.join(p, on, "left") if on else child.crossJoin(p)
    mixed = {v: F.coalesce(F.col(weight) * F.col(v) + (1 - F.col(weight)) * F.col(f"_p_{v}"), F.col(v), F.col(f"_p_{v}")) for v in values}
    return both.withColumns(mixed).drop(*[f"_p_{v}" for v in values])


def activation(nodes: DataFrame, least_scenes: int = 5, tau: float = 20.0, width: str = "width") -> DataFrame:
    """active, weight = n_eff / (n_eff + tau), 0 if inactive, reliability = weight * quality * exp(-width), in 0 to 1."""
    active = F.col("scenes") >= least_scenes
    w = F.when(active, F.col("n_eff") / (F.col("n_eff") + F.lit(tau))).otherwise(F.lit(0.0))
    return nodes.withColumns({"active": active, "weight": w}).withColumn("reliability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("weight") * F.col("quality") * F.exp(-F.col(width)))))


def stable_seed(name: str, seed: int = 0) -> int:
    """The seed and the first four bytes of the name's SHA-256, below 2^31 - 1."""
    return (seed + int.from_bytes(hashlib.sha256(name.encode()).digest()[:4], "little")) % (2**31 - 1)


def bootstrap_width(rows: DataFrame, by: str, scene: str, log_size: str, samples: int = 2000, seed: int = 0) -> DataFrame:
    """by, width: relative 95 % width of the bootstrapped median over scenes of the scene's median log size; 1 below two scenes.

    Scene medians are aggregated first, so a group is a list of scenes, not of instances."""
    medians = rows.where(F.col(log_size).isNotNull()).groupBy(by, scene).agg(F.percentile(log_size, 0.5).alias("m"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.sort_values(scene).m.to_numpy(float)
        if len(m) < 2:
            return pd.DataFrame({by: [key[0]], "width": [1.0]})
        rng = np.random.default_rng(stable_seed(str(key[0]), seed))
        found = np.concatenate([np.median(m[rng.integers(0, len(m), (min(200, samples - k), len(m)))], axis=1) for k in range(0, samples, 200)])
        lo, hi = np.quantile(found, [0.025, 0.975])
        return pd.DataFrame({by: [key[0]], "width": [float(np.exp(hi) - np.exp(lo)) / float(np.exp(np.median(m)))]})

    return medians.groupBy(by).applyInPandas(run, f"{by} {rows.schema[by].dataType.simpleString()}, width double")


def hierarchy(rows: DataFrame, parent: str, cls: str, scene: str, scan: str, valid: str, value: str, least_scenes: int = 5, tau: float = 20.0) -> DataFrame:
    """level, parent, class, n_eff, scenes, active, weight, q05 ... q95: global, parent and class summaries, each shrunk to the one above."""
    values = [f"q{round(q * 100):02d}" for q in LEVELS]

    def level(by: list[str]) -> DataFrame:
        at = rows.withColumn("_all", F.lit(1))
        keys = by or ["_all"]
        s = support(at, keys, scene, scan, valid, 5).join(scene_balanced(at, keys, scene, value), keys, "left")
        return activation(s.withColumn("width", F.lit(0.0)), least_scenes, tau).drop("_all")

    top = level([])
    mid = shrunk(level([parent]), top, [], values, "weight")
    low = shrunk(level([parent, cls]), mid, [parent], values, "weight")
    cols = ["n_eff", "scenes", "active", "weight", *values]
    out = top.select(F.lit("global").alias("level"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("class"), *cols)
    out = out.unionAll(mid.select(F.lit("parent"), F.col(parent).cast("string"), F.lit(None).cast("string"), *cols))
    return out.unionAll(low.select(F.lit("class"), F.col(parent).cast("string"), F.col(cls).cast("string"), *cols))


def resolved_prior(items: DataFrame, priors: DataFrame, cls: str, parent: str, values: list[str]) -> DataFrame:
    """Items with exp of the class's log quantiles, else its parent's, else the global ones."""
    out = items
    tables = [("class", cls, "class"), ("parent", parent, "parent")]
    for level, key, col in tables:
        p = priors.where(F.col("level") == level).select(F.col(col).alias(key), *[F.col(v).alias(f"_{level}_{v}") for v in values])
        out = out.join(p, key, "left")
    g = priors.where("level = 'global'").select(*[F.col(v).alias(f"_global_{v}") for v in values])
    out = out.crossJoin(F.broadcast(g))  # one row
    found = {v: F.exp(F.coalesce(f"_class_{v}", f"_parent_{v}", f"_global_{v}")) for v in values}
    return out.withColumns(found).drop(*[f"_{k}_{v}" for k in ("class", "parent", "global") for v in values])
