"""Votes, decisions with explicit tie rules, and the export contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vote_ratios(votes: DataFrame, item: str, choice: str, weight: str | None = None) -> DataFrame:
    """item, choice, votes, ratio of the item's votes. One shuffle: the total is summed over the counts."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = votes.groupBy(item, choice).agg(n.alias("votes"))
    total = F.sum("votes").over(Window.partitionBy(item))
    return counts.withColumn("ratio", F.coalesce(F.try_divide(F.col("votes").cast("double"), total.cast("double")), F.lit(0.0)))


def first_best(scores: DataFrame, by: list[str], choice: str, score: str) -> DataFrame:
    """The row with the largest score of each group; of equal ones the least choice."""
    best = F.max_by(F.struct(choice, score), F.struct(F.col(score), F.col("_rank")))
    ranked = scores.withColumn("_rank", -F.dense_rank().over(Window.partitionBy(*by).orderBy(choice)))
    return ranked.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def vote_decision(votes: DataFrame, item: str, choice: str, threshold: float, background: str = "background") -> DataFrame:
    """item, decision, ratio: the first most voted choice where its ratio reaches the threshold, else background."""
    best = first_best(vote_ratios(votes, item, choice), [item], choice, "ratio")
    return best.select(item, F.when(F.col("ratio") >= threshold, F.col(choice)).otherwise(background).alias("decision"), "ratio")


def unique_winner(scores: DataFrame, by: str, choice: str, score: str, tolerance: float = 1e-12) -> DataFrame:
    """by, winner (null unless one choice alone is within the tolerance of the largest score), top score."""
    top = F.max(score).over(Window.partitionBy(by))
    near = scores.withColumn("_top", top).where(F.abs(F.col(score) - F.col("_top")) <= tolerance)
    return near.groupBy(by).agg(F.when(F.count(F.lit(1)) == 1, F.max(choice)).alias("winner"), F.max("_top").alias("score"))


def margin(scores: DataFrame, by: str, choice: str, score: str) -> DataFrame:
    """by, winner (null where the two largest are equal), top, margin to the second (null if alone)."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(choice))
    two = scores.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    first, second = (F.max(F.when(F.col("_r") == k, F.col(score))) for k in (1, 2))
    pick = F.max(F.when(F.col("_r") == 1, F.col(choice)))
    return two.groupBy(by).agg(F.when(second.isNull() | (first != second), pick).alias("winner"), first.alias("top"), (first - second).alias("margin"))


def compete_then_filter(scores: DataFrame, by: str, choice: str, score: str, allowed: list, threshold: float) -> DataFrame:
    """by, winner: the best of all choices, kept only if it is allowed and reaches the threshold (else null)."""
    best = first_best(scores, [by], choice, score)
    return best.select(by, F.when(F.col(choice).isin(*allowed) & (F.col(score) >= threshold), F.col(choice)).alias("winner"), F.col(score).alias("score"))


def project_declared(labels: DataFrame, declared: DataFrame, label: str) -> DataFrame:
    """Labels (`projected`) of which undeclared ones that aren't negative became -1."""
    known = declared.select(F.col(label).alias("_known")).distinct()
    out = labels.join(known, labels[label] == F.col("_known"), "left")
    return out.withColumn("projected", F.when(F.col(label).isNull() | ((F.col(label) >= 0) & F.col("_known").isNull()), -1).otherwise(F.col(label))).drop("_known")


def contract(labels: DataFrame, declared: DataFrame, label: str) -> DataFrame:
    """old, new: declared labels that aren't negative and are used, numbered from 0 by old label."""
    used = labels.select(F.col(label).alias("old")).where("old >= 0").distinct()
    ids = used.join(declared.select(F.col(label).alias("old")).distinct(), "old", "left_semi")
    # One row for each declared instance, not for each point: the window is over the small side.
    return ids.select("old", (F.row_number().over(Window.orderBy("old")) - 1).alias("new"))


def normalized(labels: DataFrame, declared: DataFrame, label: str) -> DataFrame:
    """Labels with `new`: their number after contract(), -1 for all others."""
    m = contract(labels, declared, label)
    return labels.join(m, labels[label] == m["old"], "left").drop("old").withColumn("new", F.coalesce("new", F.lit(-1)))


def violations(instances: DataFrame, labels: DataFrame, label: str, cls: str, score: str) -> DataFrame:
    """Rows that break the export contract: `rule`, `instance`; none if it holds."""
    used = labels.select(F.col(label).alias("i")).where("i >= 0").distinct()
    own = instances.select(F.col(label).alias("i"), F.col(cls).alias("c"), F.col(score).cast("double").alias("s"))
    n = own.count()
    rules = [
        own.where(F.col("i").isNull() | (F.col("i") < 0) | (F.col("i") >= n)).select(F.lit("not contiguous").alias("rule"), F.col("i").alias("instance")),
        own.join(used, "i", "left_anti").select(F.lit("empty"), "i"),
        used.join(own, "i", "left_anti").select(F.lit("undeclared"), "i"),
        own.groupBy("i").count().where("count > 1").select(F.lit("repeated"), "i"),
        own.where(F.col("c").isNull() | (F.trim("c") == "")).select(F.lit("no class"), "i"),
        own.where(F.col("s").isNull() | F.isnan("s") | ~F.col("s").between(0, 1)).select(F.lit("score"), "i"),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionAll(r)
    return out


def agreed(observations: DataFrame, by: str, view: str, top: str) -> DataFrame:
    """by, decision: the top choice on which at least two views all agree, else null."""
    return observations.groupBy(by).agg(F.when((F.countDistinct(view) >= 2) & (F.min(top) == F.max(top)), F.min(top)).alias("decision"))


def mean_vectors(vectors: DataFrame, by: str, vec: str) -> DataFrame:
    """by, i, mean of element i (element-wise, in one aggregate)."""
    return vectors.select(by, F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("mean"))
