"""Pixels with the point that contributes most to each: reliability, projection of members, visibility, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_reliable(id_: str, weight: str, opacity: str, valid: Column | None = None) -> Column:
    """Valid, with a contributor, opacity of at least 0.5 and at least half of it from that contributor (0 / 0 is 0)."""
    share = F.coalesce(F.try_divide(F.col(weight), F.col(opacity)), F.lit(0.0))
    ok = F.col(id_).isNotNull() & (F.col(id_) >= 0) & (F.col(opacity) >= 0.5) & (share >= 0.5)
    return F.coalesce(ok & valid if valid is not None else ok, F.lit(False))


def member_pixels(pixels: DataFrame, members: DataFrame, id_: str, weight: str, opacity: str) -> DataFrame:
    """Reliable pixels whose contributor is a member."""
    return pixels.where(is_reliable(id_, weight, opacity)).join(members.select(id_).distinct(), id_, "left_semi")


def consensus(hypotheses: DataFrame, keys: list[str], positive: str, negative: str) -> DataFrame:
    """keys, side of each pixel over hypotheses: positive, negative, disputed, or null where none says anything."""
    both = hypotheses.groupBy(*keys).agg(F.bool_or(positive).alias("_p"), F.bool_or(negative).alias("_n"))
    return both.select(*keys, F.when(F.col("_p") & F.col("_n"), "disputed").when(F.col("_p"), "positive").when(F.col("_n"), "negative").alias("side"))


def known_domain(pixels: DataFrame, keys: list[str], observed: str, mask: str, alternative: str) -> DataFrame:
    """keys, known: observed, and in the mask or in no alternative; a row is one alternative's pixel."""
    g = pixels.groupBy(*keys).agg(F.bool_or(observed).alias("_o"), F.bool_or(mask).alias("_m"), F.bool_or(alternative).alias("_a"))
    return g.select(*keys, (F.col("_o") & (F.col("_m") | ~F.col("_a"))).alias("known"))


def visibility(points: DataFrame, pixels: DataFrame, id_: str, x: str, y: str, depth: str, front: str, front_id: str, reliable: str, members: DataFrame, slack: float = 1.05) -> DataFrame:
    """id, outside, occluded, self_occluded, unreliable of points projected to (x, y) with a depth.

    pixels: px, py, and the front surface's depth, point and reliability. Points meet their rounded pixel."""
    at = points.withColumns({"px": F.floor(F.col(x) + 0.5).cast("long"), "py": F.floor(F.col(y) + 0.5).cast("long")})
    own = members.select(F.col(id_).alias("_member")).distinct()
    p = pixels.select("px", "py", F.col(front).alias("_front"), F.col(front_id).alias("_fid"), F.col(reliable).alias("_ok"))
    both = at.join(p, ["px", "py"], "left").join(own, F.col("_fid") == F.col("_member"), "left")
    behind = F.coalesce(F.col(depth) > F.lit(slack) * F.col("_front"), F.lit(False))
    mine = F.col("_member").isNotNull()
    return both.select(
        id_, F.col("_front").isNull().alias("outside"), (behind & ~mine).alias("occluded"), (behind & mine).alias("self_occluded"),
        (F.col("_front").isNotNull() & ~F.coalesce("_ok", F.lit(False))).alias("unreliable"),
    )


def prompt_points(pixels: DataFrame, by: list[str], anchor: str, weight: str, opacity: str, index: str) -> DataFrame:
    """by, index of the best pixel: anchors first, then the largest share of opacity, the largest weight, the least index."""
    share = F.coalesce(F.try_divide(F.col(weight), F.col(opacity)), F.lit(0.0))
    w = Window.partitionBy(*by).orderBy(F.col(anchor).desc(), share.desc(), F.col(weight).desc(), F.col(index))
    return pixels.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, index)


def shared_point(clearances: DataFrame, by: list[str], id_: str, view: str, clearance: str) -> DataFrame:
    """by, id, clearance: the id whose least clearance over all of the group's views is largest; it must be in every view."""
    views = clearances.groupBy(*by).agg(F.countDistinct(view).alias("_n"))
    each = clearances.groupBy(*by, id_).agg(F.min(clearance).alias("clearance"), F.countDistinct(view).alias("_k"))
    ok = each.join(views, by).where("_n = _k")
    return ok.groupBy(*by).agg(F.min_by(F.struct(id_, "clearance"), F.struct(-F.col("clearance"), F.col(id_))).alias("_b")).select(*by, "_b.*")


def cut_reasons(pixels: DataFrame, by: list[str], x: str, y: str, wide: str, high: str, inside: str, observed: str) -> DataFrame:
    """by, photo_cut (the mask touches the image's border), crop_cut (it touches what wasn't observed)."""
    edge = (F.col(x) == 0) | (F.col(y) == 0) | (F.col(x) == F.col(wide) - 1) | (F.col(y) == F.col(high) - 1)
    return pixels.groupBy(*by).agg(F.coalesce(F.bool_or(F.col(inside) & edge), F.lit(False)).alias("photo_cut"), F.coalesce(F.bool_or(F.col(inside) & ~F.col(observed)), F.lit(False)).alias("crop_cut"))
