"""Optimal one-to-one matching within groups, and readouts of matches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .overlap import with_metrics


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of the assignment of largest total gain (shortest augmenting paths with potentials)."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain).astype(float)
    n, m = cost.shape
    if not n or not m:
        return []
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        least, came, seen = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        r, last = i, -1
        while True:
            step = cost[r] - u[r] - v
            base = 0.0 if last < 0 else least[last]
            better = ~seen & (base + step < least - 1e-15)
            least[better], came[better] = (base + step)[better], last
            j = int(np.argmin(np.where(seen, np.inf, least)))
            seen[j] = True
            if row_of[j] < 0:
                break
            r, last = int(row_of[j]), j
        short = least[j]
        done = seen & (least <= short)
        rows = row_of[done]
        u[i] += short
        ok = rows >= 0
        u[rows[ok]] += short - least[done][ok]
        v[done] -= short - least[done]
        while j >= 0:
            k = int(came[j])
            row_of[j] = row_of[k] if k >= 0 else i
            j = k
    found = [(int(r), c) for c, r in enumerate(row_of) if r >= 0]
    return sorted((c, r) if flip else (r, c) for r, c in found)


def one_to_one(pairs: DataFrame, by: list[str], a: str, b: str, gain: str, threshold: float | None = None) -> DataFrame:
    """by, a, b, gain: as many pairs over the threshold as can be, of those the largest total gain; ties by id.

    Pairs are the overlapping ones only, so a group's matrix is as large as its ids that overlap."""
    over = pairs if threshold is None else pairs.where(F.col(gain) > threshold)
    cols = [*by, a, b, gain]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, left = np.unique(pdf[a], return_inverse=True)
        cols_, right = np.unique(pdf[b], return_inverse=True)
        m = np.zeros((len(rows), len(cols_)))
        # One more pair outweighs any difference in gain.
        m[left, right] = pdf[gain].to_numpy(float) + (0 if threshold is None else len(rows) + len(cols_))
        keep = {(rows[i], cols_[j]) for i, j in assign(m) if m[i, j] > 0}
        return pdf[[k in keep for k in zip(pdf[a], pdf[b])]][cols]

    return over.select(*cols).groupBy(*by).applyInPandas(run, over.select(*cols).schema)


def readout(gt: DataFrame, predictions: DataFrame, matches: DataFrame, by: list[str], gt_id: str, pred_id: str) -> DataFrame:
    """by, tp, fp, fn and metrics (null on empty denominators) of one-to-one matches."""
    hit = matches.select(*by, gt_id, pred_id).withColumn("_hit", F.lit(1))
    g = gt.select(*by, gt_id).join(hit.select(*by, gt_id, "_hit"), [*by, gt_id], "left").groupBy(*by).agg(F.count("_hit").alias("tp"), F.count_if(F.col("_hit").isNull()).alias("fn"))
    p = predictions.select(*by, pred_id).join(hit.select(*by, pred_id, "_hit"), [*by, pred_id], "left").groupBy(*by).agg(F.count_if(F.col("_hit").isNull()).alias("fp"))
    both = g.join(p, by, "full").na.fill(0, ["tp", "fp", "fn"])
    return with_metrics(both)


def pooled(readouts: DataFrame, metrics: list[str] = ("precision", "recall", "f1", "iou")) -> DataFrame:
    """Pooled counts and their metrics, and the equal-weight mean of each metric where it is defined (and of how many)."""
    sums = with_metrics(readouts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    means = readouts.agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics], *[F.count(m).alias(f"n_{m}") for m in metrics])
    return sums.crossJoin(means)


def rescued(gt: DataFrame, before: DataFrame, after: DataFrame, gt_id: str, strata: dict) -> DataFrame:
    """stratum, missed (by `before`), rescued (by `after`), share, over conditions on gt."""
    missed = gt.join(before.select(gt_id).distinct(), gt_id, "left_anti")
    hit = after.select(gt_id).distinct().withColumn("_hit", F.lit(1))
    at = missed.join(hit, gt_id, "left")
    named = at.select("*", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in strata.items()]))).alias("stratum"))
    return named.groupBy("stratum").agg(F.count(F.lit(1)).alias("missed"), F.count("_hit").alias("rescued")).withColumn("share", F.col("rescued") / F.col("missed").cast("double"))


def best_candidate(rows: DataFrame, by: list[str], id_: str, score: str, members: str, least: int = 3) -> DataFrame:
    """by, id, score: the best score among candidates of at least `least` members; of equal ones the least id."""
    ok = rows.where(F.col(members) >= least)
    return ok.groupBy(*by).agg(F.min_by(F.struct(id_, score), F.struct(-F.col(score), F.col(id_))).alias("_b")).select(*by, "_b.*")
