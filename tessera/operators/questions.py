"""Which question about a region best tells candidates apart, whatever the answer is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PAIR = ["object", "va", "vb"]


def seen(pixels: DataFrame, pairs: DataFrame) -> DataFrame:
    """object, va, vb, view, element, n: visible pixels of each element in both views of each pair."""
    return pairs.select(*_PAIR).distinct().withColumn("view", F.explode(F.array("va", "vb"))).join(pixels.select("object", "view", "element", "n"), ["object", "view"])


def least_mass(of: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The lesser one of two views' sums; a view without pixels counts as none."""
    sums = of.groupBy(*keys, "view").agg(F.sum("n").alias("_n"))
    return sums.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == 2, F.min("_n")).otherwise(F.lit(0)).alias(name))


def questions(members: DataFrame, regions: DataFrame, anchors: DataFrame, pixels: DataFrame, disputed: DataFrame) -> DataFrame:
    """object, va, vb, region, anchor, include, exclude, split, coverage, gain of each question that both answers decide.

    members: object, candidate, element. regions: object, va, vb, region, element (va <> vb). anchors: object, anchor (an element). pixels: object, view,
    element, n. disputed: object, view, element. "Does the region belong to the anchor's object?" is asked of the candidates that have the anchor:
    those with the whole region include it, those with none of it exclude it, others don't count for either. split is the lesser count's share,
    coverage the region's visible pixels in the poorer view, and gain = split * coverage / visible pixels of all that either view disputes. An anchor
    is visible in both views and outside the region."""
    own = members.select("object", "candidate", "element").distinct()
    region = regions.select(*_PAIR, "region", "element").distinct()
    both = seen(pixels, region)
    size = region.groupBy(*_PAIR, "region").agg(F.count(F.lit(1)).alias("_size"))
    hits = region.join(own, ["object", "element"]).groupBy(*_PAIR, "region", "candidate").agg(F.count(F.lit(1)).alias("_k"))
    coverage = least_mass(both.join(region, [*_PAIR, "element"]), [*_PAIR, "region"], "coverage")
    unsure = region.select(*_PAIR).distinct().withColumn("view", F.explode(F.array("va", "vb"))).join(disputed.select("object", "view", "element"), ["object", "view"])
    mass = least_mass(both.join(unsure.select(*_PAIR, "element").distinct(), [*_PAIR, "element"]), _PAIR, "_mass")
    visible = both.where("n > 0").groupBy(*_PAIR, F.col("element").alias("anchor")).agg(F.countDistinct("view").alias("_views")).where("_views = 2").drop("_views")
    placed = visible.join(anchors.select("object", "anchor").distinct(), ["object", "anchor"])
    target = placed.select("object", "anchor").distinct().join(own.withColumnRenamed("element", "anchor"), ["object", "anchor"])
    asked = placed.join(size, _PAIR).join(region.withColumnRenamed("element", "anchor"), [*_PAIR, "region", "anchor"], "left_anti")
    told = asked.join(target, ["object", "anchor"]).join(hits, [*_PAIR, "region", "candidate"], "left")
    count = lambda c: F.count(F.when(c, 1))
    counted = told.groupBy(*_PAIR, "region", "anchor").agg(count(F.col("_k") == F.col("_size")).alias("include"), count(F.col("_k").isNull()).alias("exclude"), F.count(F.lit(1)).alias("_n"))
    good = counted.where("include > 0 AND exclude > 0").join(coverage, [*_PAIR, "region"]).join(mass, _PAIR, "left")
    split = F.least("include", "exclude") / F.col("_n")
    gain = split * F.col("coverage") / F.greatest(F.lit(1), F.coalesce("_mass", F.lit(0)))
    return good.select(*_PAIR, "region", "anchor", "include", "exclude", split.alias("split"), "coverage", gain.alias("gain"))


def best_question(asked: DataFrame) -> DataFrame:
    """Each object's question of most gain, then most coverage, then least views, anchor and region."""
    order = F.struct(-F.col("gain"), -F.col("coverage"), "va", "vb", "anchor", "region")
    return asked.groupBy("object").agg(F.min_by(F.struct(*[c for c in asked.columns if c != "object"]), order).alias("_q")).select("object", "_q.*")
