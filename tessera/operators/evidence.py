"""Observations of one object from several views: families, cliques and scores (a group is one object's few views)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def independent_pairs(cameras: DataFrame, uid: str = "uid", angle: float = 15.0, baseline: float = 0.05) -> DataFrame:
    """a, b, a < b within one `object`: view rays at least `angle` degrees apart, or centres at least `baseline` of the lesser depth.

    cameras: object, uid, rx, ry, rz (unit ray), x, y, z (centre), depth. The equi-join on the object bounds it."""
    a = cameras.select("object", *[F.col(c).alias(f"a_{c}") for c in (uid, "rx", "ry", "rz", "x", "y", "z", "depth")])
    b = cameras.select("object", *[F.col(c).alias(f"b_{c}") for c in (uid, "rx", "ry", "rz", "x", "y", "z", "depth")])
    both = a.join(b, "object").where(F.col(f"a_{uid}") < F.col(f"b_{uid}"))
    dot = sum((F.col(f"a_r{k}") * F.col(f"b_r{k}") for k in "xyz"), F.lit(0.0))
    gap = F.sqrt(sum(((F.col(f"a_{k}") - F.col(f"b_{k}")) ** 2 for k in "xyz"), F.lit(0.0)))
    apart = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))) >= angle
    return both.where(apart | (gap / F.least("a_depth", "b_depth") >= baseline)).select("object", F.col(f"a_{uid}").alias("a"), F.col(f"b_{uid}").alias("b"))


def largest_cliques(edges: dict) -> list[tuple]:
    """All maximal sets of mutually joined nodes of a small graph, in order."""
    out: list[tuple] = []

    def grow(chosen: set, maybe: set, done: set) -> None:
        if not maybe and not done:
            out.append(tuple(sorted(chosen)))
            return
        pivot = max(maybe | done, key=lambda v: (len(edges[v] & maybe), str(v)))
        for v in sorted(maybe - edges[pivot], key=str):
            grow(chosen | {v}, maybe & edges[v], done & edges[v])
            maybe, done = maybe - {v}, done | {v}

    if edges:
        grow(set(), set(edges), set())
    return sorted(out)


def consensus_cliques(nodes: DataFrame, links: DataFrame, by: str, node: str) -> DataFrame:
    """by, clique, node: the maximal cliques of each object's compatible observations."""
    kind = nodes.schema

    def run(key: tuple, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        edges = {v: set() for v in own[node]}
        for a, b in zip(near.a, near.b):
            edges[a].add(b)
            edges[b].add(a)
        rows = [(key[0], k, v) for k, c in enumerate(largest_cliques(edges)) for v in c]
        return pd.DataFrame(rows, columns=[by, "clique", node])

    return nodes.groupBy(by).cogroup(links.groupBy(by)).applyInPandas(run, f"{by} {kind[by].dataType.simpleString()}, clique long, {node} {kind[node].dataType.simpleString()}")


def greedy_families(observations: DataFrame, overlaps: DataFrame, by: str, node: str, view: str, least: float = 0.0) -> DataFrame:
    """by, family, node: observations in order join the family with the best mean IoU that has none of their view.

    overlaps: by, a, b, iou."""
    kind = observations.schema

    def run(key: tuple, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        iou = {frozenset(x): v for *x, v in zip(near.a, near.b, near.iou)}
        families: list[list[tuple]] = []
        for v, w in own.sort_values(node)[[node, view]].itertuples(index=False):
            scored = [(sum(iou.get(frozenset((v, o)), 0.0) for o, _ in f) / len(f), -k) for k, f in enumerate(families) if all(x != w for _, x in f)]
            best = max(scored, default=(0.0, 0))
            if best[0] > least:
                families[-best[1]].append((v, w))
            else:
                families.append([(v, w)])
        return pd.DataFrame([(key[0], k, v) for k, f in enumerate(families) for v, _ in f], columns=[by, "family", node])

    return observations.groupBy(by).cogroup(overlaps.groupBy(by)).applyInPandas(run, f"{by} {kind[by].dataType.simpleString()}, family long, {node} {kind[node].dataType.simpleString()}")


def beam_families(observations: DataFrame, overlaps: DataFrame, by: str, node: str, view: str, width: int = 32) -> DataFrame:
    """by, rank, nodes (sorted), score: the best cross-view families a beam of `width` finds; score is the sum of pair IoUs, ties by nodes."""
    kind = observations.schema

    def run(key: tuple, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        iou = {frozenset(x): v for *x, v in zip(near.a, near.b, near.iou)}
        beam: list[tuple] = [((), 0.0)]
        for _, group in sorted(own.groupby(view), key=lambda g: str(g[0])):
            step = list(beam)
            for chosen, score in beam:
                for v in sorted(group[node]):
                    links = [iou.get(frozenset((v, o)), 0.0) for o in chosen]
                    if all(x > 0 for x in links):
                        step.append(((*chosen, v), score + sum(links)))
            beam = sorted(step, key=lambda s: (-s[1], -len(s[0]), s[0]))[:width]
        beam = [b for b in beam if b[0]]
        return pd.DataFrame([(key[0], k, sorted(b), float(s)) for k, (b, s) in enumerate(beam)], columns=[by, "rank", "nodes", "score"])

    node_kind = kind[node].dataType.simpleString()
    return observations.groupBy(by).cogroup(overlaps.groupBy(by)).applyInPandas(run, f"{by} {kind[by].dataType.simpleString()}, rank long, nodes array<{node_kind}>, score double")


def best_explanation(energies: DataFrame, by: str, key: str, losses: list[str]) -> DataFrame:
    """by, key, energy: the least mean of the losses, ties by key."""
    e = sum((F.col(c) for c in losses), F.lit(0.0)) / len(losses)
    return energies.withColumn("energy", e).groupBy(by).agg(F.min_by(F.struct(key, "energy"), F.struct("energy", key)).alias("_b")).select(by, "_b.*")


def worst_case_score(scores: DataFrame, by: str, view: str, score: str) -> DataFrame:
    """by, score: over explanations the least of each view, over views the mean."""
    return scores.groupBy(by, view).agg(F.min(score).alias("_s")).groupBy(by).agg(F.avg("_s").alias("score"))


def stable_improvement(deltas: DataFrame, by: str, delta: str, tolerance: float = 1e-12) -> DataFrame:
    """by, stable: all deltas and all leave-one-out means are no worse, and one is better."""
    w = Window.partitionBy(by)
    n, s = F.count(delta).over(w), F.sum(delta).over(w)
    r = deltas.withColumn("_l", F.when(n > 1, (s - F.col(delta)) / (n - 1)).otherwise(F.col(delta)))
    return r.groupBy(by).agg(((F.least(F.min(delta), F.min("_l")) >= -tolerance) & (F.greatest(F.max(delta), F.max("_l")) > tolerance)).alias("stable"))


def paired_difference(a: DataFrame, b: DataFrame, by: list[str], view: str, iou: str) -> DataFrame:
    """by, view, delta: least difference (b less a) over shared keys; a missing side counts as 0."""
    x, y = a.select(*by, view, "key", F.col(iou).alias("_x")), b.select(*by, view, "key", F.col(iou).alias("_y"))
    both = x.join(y, [*by, view, "key"], "full")
    return both.groupBy(*by, view).agg(F.min(F.coalesce("_y", F.lit(0.0)) - F.coalesce("_x", F.lit(0.0))).alias("delta"))


def undominated(rows: DataFrame, by: str, id_: str, better: list[str]) -> DataFrame:
    """Rows that no other of their group beats in one of `better` without being worse in another."""
    o = rows.select(F.col(by).alias("_g"), F.col(id_).alias("_o"), *[F.col(c).alias(f"_o_{c}") for c in better])
    no_worse, one = F.lit(True), F.lit(False)
    for c in better:
        no_worse, one = no_worse & (F.col(f"_o_{c}") >= F.col(c)), one | (F.col(f"_o_{c}") > F.col(c))
    return rows.join(o, (F.col(by) == F.col("_g")) & (F.col(id_) != F.col("_o")) & no_worse & one, "left_anti")


def accepted_regions(evidence: DataFrame, region: str, view: str, sides: str = "positive") -> DataFrame:
    """region, accepted: two views support it and none opposes. evidence: region, view, positive, negative (booleans)."""
    return evidence.groupBy(region).agg(((F.countDistinct(F.when(F.col("positive"), F.col(view))) >= 2) & ~F.bool_or("negative")).alias("accepted"))


def projection_status(counts: DataFrame, by: str, tp: str = "tp", fp: str = "fp", fn: str = "fn", complete: str = "complete") -> DataFrame:
    """by, status over references: pass at precision >= .8 and recall >= .5, incomplete where a projection is, else reject; all must agree."""
    p, r = F.try_divide(F.col(tp), F.col(tp) + F.col(fp)), F.try_divide(F.col(tp), F.col(tp) + F.col(fn))
    s = F.when(~F.col(complete), "incomplete").when((p >= 0.8) & (r >= 0.5), "pass").otherwise("reject")
    return counts.withColumn("_s", s).groupBy(by).agg(F.when(F.min("_s") == F.max("_s"), F.min("_s")).otherwise("disputed").alias("status"))
