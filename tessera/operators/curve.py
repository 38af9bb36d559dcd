"""Precision and recall: curves, average precision and the greedy instance evaluation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pr_curve(rows: DataFrame, by: list[str], truth: str, score: str, missed: str | None = None) -> DataFrame:
    """by, score, precision, recall at each distinct score, falling; `missed` adds positives that have no row (a column, constant in by)."""
    t = F.col(truth).cast("int")
    steps = rows.groupBy(*by, score).agg(F.sum(t).alias("_tp"), F.count(F.lit(1)).alias("_n"), *([F.max(missed).alias("_m")] if missed else [F.lit(0).alias("_m")]))
    w = Window.partitionBy(*by).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*by)
    tp, n = F.sum("_tp").over(w).cast("double"), F.sum("_n").over(w).cast("double")
    positives = F.sum("_tp").over(total) + F.max("_m").over(total)
    return steps.select(*by, score, (tp / n).alias("precision"), F.try_divide(tp, positives.cast("double")).alias("recall"))


def step_ap(curve: DataFrame, by: list[str], score: str) -> DataFrame:
    """by, ap: the curve's precision weighted by half the recall between its neighbours, ending at precision 1 and recall 0."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc())
    ahead, behind = F.lead("recall").over(w), F.lag("recall", 1, 0.0).over(w)
    c = curve.withColumns({"_step": F.col("precision") * F.lit(0.5) * (F.coalesce(ahead, "recall") - behind), "_first": F.row_number().over(w)})
    top = F.max(F.when(F.col("_first") == 1, F.lit(0.5) * F.col("recall")))
    return c.groupBy(*by).agg((F.sum("_step") + top).alias("ap"))


def interpolated_ap(curve: DataFrame, by: list[str]) -> DataFrame:
    """by, ap: recall steps times the best precision at that recall or a higher one."""
    w = Window.partitionBy(*by).orderBy("recall")
    points = curve.groupBy(*by, "recall").agg(F.max("precision").alias("precision"))
    best = F.max("precision").over(w.rowsBetween(0, Window.unboundedFollowing))
    c = points.withColumn("_a", best * (F.col("recall") - F.lag("recall", 1, 0.0).over(w)))
    return c.groupBy(*by).agg(F.sum("_a").alias("ap"))


OVERLAPS = (0.25, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9)


def instance_overlaps(gt: DataFrame, predictions: DataFrame, least: int = 100) -> DataFrame:
    """scene, class, prediction, score, n, void, and matches (array of gt, gt_n, inter) of each prediction with enough points.

    gt: scene, point, class, instance (class null: void); predictions: scene, prediction, class, score, point."""
    p = predictions.distinct()
    size = p.groupBy("scene", "prediction").agg(F.max("class").alias("class"), F.max("score").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    own = gt.where("class IS NOT NULL").groupBy("scene", F.col("class").alias("gt_class"), F.col("instance").alias("gt")).agg(F.count(F.lit(1)).alias("gt_n"))
    both = p.select("scene", "prediction", "point").join(gt.select("scene", "point", F.col("class").alias("gt_class"), F.col("instance").alias("gt")), ["scene", "point"])
    counts = both.groupBy("scene", "prediction", "gt_class", "gt").agg(F.count(F.lit(1)).alias("inter"))
    void = counts.where("gt_class IS NULL").groupBy("scene", "prediction").agg(F.sum("inter").alias("void"))
    hits = counts.join(own, ["scene", "gt_class", "gt"]).select("scene", "prediction", F.col("gt_class").alias("class"), F.struct("gt", "gt_n", "inter").alias("m"))
    matches = size.join(hits, ["scene", "prediction", "class"]).groupBy("scene", "prediction").agg(F.collect_list("m").alias("matches"))
    out = size.join(void, ["scene", "prediction"], "left").join(matches, ["scene", "prediction"], "left")
    return out.withColumns({"void": F.coalesce("void", F.lit(0)), "matches": F.coalesce("matches", F.expr("array()").cast("array<struct<gt:long,gt_n:long,inter:long>>"))})


def greedy_outcomes(predictions: pd.DataFrame, gt: pd.DataFrame, threshold: float, least: int) -> tuple[list[tuple[float, int]], int]:
    """(score, true or false positive) of one scene and class, and the instances that nothing matched.

    Instances take predictions of an IoU over the threshold. Of several the higher score is right and the lower
    wrong, and a later rival isn't marked as used; what is unmatched is wrong unless void points and
    instances that are too small make up more than the threshold of it."""
    rows, used, missed = [], set(), 0
    big = gt[gt.gt_n >= least].sort_values("gt")
    for g in big.itertuples():
        best = None
        for p in predictions.itertuples():
            inter = next((m["inter"] for m in p.matches if m["gt"] == g.gt), 0)
            if p.prediction in used or not inter or inter / (g.gt_n + p.n - inter) <= threshold:
                continue
            if best is None:
                best = p.score
                used.add(p.prediction)
            else:
                rows.append((min(best, p.score), 0))
                best = max(best, p.score)
        if best is None:
            missed += 1
        else:
            rows.append((best, 1))
    for p in predictions.itertuples():
        if any(m["inter"] / (m["gt_n"] + p.n - m["inter"]) > threshold for m in p.matches):
            continue
        small = sum(m["inter"] for m in p.matches if m["gt_n"] < least)
        if (p.void + small) / p.n <= threshold:
            rows.append((p.score, 0))
    return rows, missed


def average_precision(gt: DataFrame, predictions: DataFrame, classes: list[str], overlaps: Sequence[float] = OVERLAPS, least: int = 100) -> DataFrame:
    """class, overlap, ap: null for a class without instances, 0 for one that isn't predicted.

    A group is one scene and class; scores of all scenes meet again in windows for the curve."""
    spark = gt.sparkSession
    found = instance_overlaps(gt, predictions, least)
    own = gt.where("class IS NOT NULL").groupBy("scene", "class", F.col("instance").alias("gt")).agg(F.count(F.lit(1)).alias("gt_n"))

    def run(key: tuple, pred: pd.DataFrame, inst: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t in overlaps:
            rows, missed = greedy_outcomes(pred.sort_values("prediction"), inst, t, least)
            out += [(key[1], t, s, y, 0) for s, y in rows]
            out.append((key[1], t, None, None, missed))
        return pd.DataFrame(out, columns=["class", "overlap", "score", "y", "missed"])

    # Both sides come from the same tables: aliases keep their columns apart.
    found, own = (d.select(*[F.col(c).alias(c) for c in d.columns]) for d in (found, own))
    rows = found.groupBy("scene", "class").cogroup(own.groupBy("scene", "class")).applyInPandas(run, "class string, overlap double, score double, y int, missed long")
    missed = rows.groupBy("class", "overlap").agg(F.sum("missed").alias("m"))
    curve = pr_curve(rows.where("score IS NOT NULL").join(missed, ["class", "overlap"]), ["class", "overlap"], "y", "score", "m")
    ap = step_ap(curve.withColumn("recall", F.coalesce("recall", F.lit(0.0))), ["class", "overlap"], "score")
    has = own.where(F.col("gt_n") >= least).select("class").distinct().withColumn("has", F.lit(True))
    grid = spark.createDataFrame([(c, float(t)) for c in classes for t in overlaps], "class string, overlap double")
    out = grid.join(has, "class", "left").join(ap, ["class", "overlap"], "left")
    return out.select("class", "overlap", F.when(F.col("has"), F.coalesce("ap", F.lit(0.0))).alias("ap"))


def mean_ap(ap: DataFrame) -> DataFrame:
    """ap25, ap50 and ap (0.5 on) over the classes that have instances."""
    return ap.agg(F.avg(F.when(F.col("overlap") == 0.25, F.col("ap"))).alias("ap25"), F.avg(F.when(F.col("overlap") == 0.5, F.col("ap"))).alias("ap50"), F.avg(F.when(F.col("overlap") >= 0.5, F.col("ap"))).alias("ap"))


def numpy_step_ap(recall: np.ndarray, precision: np.ndarray) -> float:
    """The same area for a small curve in falling score order: a check for tests."""
    r, p = np.append(recall[::-1], 0.0), np.append(precision[::-1], 1.0)
    steps = np.convolve(np.append(np.append(r[0], r), 0.0), [-0.5, 0, 0.5], "valid")
    return float(np.dot(p, steps))
