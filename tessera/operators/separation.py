"""Which observations and families exclude each other: dominated links, witness views, and pairs of separate families.

Observations are rows (object, view, node); what they claim are rows (object, view, node, element). All joins are equi-joins within one
object; alternatives are looked up from the links that exist, never from all pairs of a view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OBS = ["object", "view", "node"]


def _as(df: DataFrame, **names: str) -> DataFrame:
    return df.select("object", *[F.col(c).alias(n) for c, n in names.items()])


def interiors(anchors: DataFrame, positives: DataFrame) -> DataFrame:
    """The anchors that an observation also claims: object, view, node, element."""
    return anchors.select(*_OBS, "element").distinct().join(positives.select(*_OBS, "element").distinct(), [*_OBS, "element"])


def contradictions(inner: DataFrame, claims: DataFrame) -> DataFrame:
    """object, view, a, b: an element in the interior of a is claimed by b, another observation of the same view."""
    x = _as(inner, view="view", node="a", element="element")
    y = _as(claims, view="view", node="b", element="element")
    return x.join(y, ["object", "view", "element"]).where("a <> b").select("object", "view", "a", "b").distinct()


def possible_links(positives: DataFrame, views: DataFrame) -> DataFrame:
    """object, va, a, vb, b: observations of two paired views (object, va, vb) that share a claimed element."""
    x = _as(positives, view="va", node="a", element="element").distinct()
    y = _as(positives, view="vb", node="b", element="element").distinct()
    pairs = views.select("object", "va", "vb").distinct()
    return x.join(pairs, ["object", "va"]).join(y, ["object", "vb", "element"]).select("object", "va", "a", "vb", "b").distinct()


def dominated_links(links: DataFrame, affinity: DataFrame, anchors: DataFrame, positives: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """object, va, a, vb, b, alternatives_a, alternatives_b: links that both ends would give up for a better one.

    links: object, va, a, vb, b; affinity: the same and `affinity`. A link without an affinity is neither rejected nor an alternative. An
    alternative takes the place of one end: it is linked to the other end with a higher affinity, and each of the two has an interior
    that the other doesn't claim. Alternatives are sorted lists."""
    key = ["object", "va", "a", "vb", "b"]
    known = links.select(*key).distinct().join(affinity.where("affinity IS NOT NULL").groupBy(*key).agg(F.max("affinity").alias("s")), key)
    inner = interiors(anchors, positives)
    placed = inner.select(*_OBS).distinct()
    clash = contradictions(inner, positives)
    clash = clash.unionAll(clash.select("object", "view", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()

    def better(end: str, view: str) -> DataFrame:
        stays = [c for c in key if c != end]
        other = known.withColumnRenamed(end, "_o").withColumnRenamed("s", "_s")
        both = known.join(other, stays).where((F.col("_o") != F.col(end)) & (F.col("_s") > F.col("s") + tolerance))
        for c in (end, "_o"):
            both = both.join(_as(placed, view=view, node=c), ["object", view, c], "left_semi")
        both = both.join(_as(clash, view=view, a=end, b="_o"), ["object", view, end, "_o"], "left_anti")
        return both.groupBy(*key).agg(F.array_sort(F.collect_set("_o")).alias(f"alternatives_{end}"))

    return better("a", "va").join(better("b", "vb"), key)


def witness_views(members: DataFrame, anchors: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """object, fa, fb, view, fa < fb: in this view an observation of either family denies the interior of one of the other's.

    members: object, family, view, node."""
    denied = contradictions(interiors(anchors, positives), negatives)
    mutual = denied.join(denied.select("object", "view", F.col("b").alias("a"), F.col("a").alias("b")), ["object", "view", "a", "b"])
    of = members.select("object", "family", "view", "node").distinct()
    named = mutual.join(_as(of, family="fa", view="view", node="a"), ["object", "view", "a"]).join(_as(of, family="fb", view="view", node="b"), ["object", "view", "b"])
    return named.where("fa < fb").select("object", "fa", "fb", "view").distinct()


def separate_families(witnesses: DataFrame, pairs: DataFrame, cores: DataFrame, selected: DataFrame) -> DataFrame:
    """object, fa, fb, va, vb: families with disjoint cores, both in touch with the selected core, and their pairs of witness views.

    pairs: object, family, va, vb (views that support the family); cores: object, family, element; selected: object, element. A pair of
    views counts if it supports either family and both views are witnesses. Families of equal content are to be merged before."""
    core = cores.select("object", "family", "element").distinct()
    touching = core.join(selected.select("object", "element").distinct(), ["object", "element"], "left_semi").select("object", "family").distinct()
    found = witnesses.select("object", "fa", "fb").distinct()
    for c in ("fa", "fb"):
        found = found.join(_as(touching, family=c), ["object", c], "left_semi")
    shared = found.join(_as(core, family="fa", element="e"), ["object", "fa"]).join(_as(core, family="fb", element="e"), ["object", "fb", "e"])
    found = found.join(shared.select("object", "fa", "fb").distinct(), ["object", "fa", "fb"], "left_anti")
    views = pairs.select("object", "family", "va", "vb").distinct()
    both = found.join(_as(views, family="fa", va="va", vb="vb"), ["object", "fa"]).unionByName(found.join(_as(views, family="fb", va="va", vb="vb"), ["object", "fb"])).distinct()
    for v in ("va", "vb"):
        both = both.join(_as(witnesses, fa="fa", fb="fb", view=v), ["object", "fa", "fb", v], "left_semi")
    return both.select("object", "fa", "fb", "va", "vb")
