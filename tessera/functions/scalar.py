"""Scalar columns: labels, loose parsing, content identity, cameras and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import col


def normalize_label(x) -> Column:
    """Trimmed, lower case, underscores as blanks, blanks single."""
    return F.trim(F.regexp_replace(F.lower(F.replace(col(x), F.lit("_"), F.lit(" "))), r"\s+", " "))


def physical_scene(x) -> Column:
    """The id without its last _suffix."""
    return F.regexp_replace(col(x), "_[^_]*$", "")


def slug(x) -> Column:
    """Lower case, each run of other than letters and digits one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "_"), F.lit("_"))


def as_bool(x) -> Column:
    return F.coalesce(F.lower(F.trim(col(x).cast("string"))).isin("1", "true", "yes"), F.lit(False))


def finite(x) -> Column:
    d = col(x).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def finite_positive(x) -> Column:
    d = finite(x)
    return F.when(d > 0, d)


def json_metric(x, key: str) -> Column:
    """A finite number at a key of JSON text, else null."""
    return finite(F.get_json_object(col(x), f"$.{key}"))


def unit_score(x) -> Column:
    """The score as it is; raises unless it is finite and from 0 to 1."""
    d = finite(x)
    return F.when((d >= 0) & (d <= 1), d).otherwise(F.raise_error(F.lit("a score outside 0 to 1")).cast("double"))


def content_id(ids) -> Column:
    """Identity of a set, whatever the order and the repeats."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(col(ids))).cast("array<string>"), "|"), 256)


def canonical_hash(**fields) -> Column:
    """SHA-256 of compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[col(v).alias(k) for k, v in sorted(fields.items())])), 256)


def seed_of(*parts) -> Column:
    """First 8 bytes of the SHA-256 of the joined parts, little-endian, modulo 2^32: the first four bytes."""
    h = F.sha2(F.concat_ws("|", *[col(p).cast("string") for p in parts]), 256)
    b = [F.substring(h, 2 * k + 1, 2) for k in range(3, -1, -1)]
    return F.conv(F.concat(*b), 16, 10).cast("long")


def focal_to_fov(focal, pixels) -> Column:
    return F.lit(2.0) * F.atan(col(pixels) / (F.lit(2.0) * col(focal)))


def half_even(x) -> Column:
    return F.bround(col(x), 0)


def selected_frames(n: int, stride: int, most: int | None) -> list[int]:
    """Every stride-th of n frames, evenly thinned to `most` of them (halves to even)."""
    at = list(range(0, n, stride))
    if most and len(at) > most:
        at = sorted({at[round(k * (len(at) - 1) / (most - 1)) if most > 1 else 0] for k in range(most)})
    return at


def learning_rate(step, start: float, end: float, delay_steps: int = 0, delay: float = 1.0, steps: int = 1_000_000) -> Column:
    """Log-linear from start to end, with a sine ramp from `delay` over the first steps; 0 before step 0."""
    s = col(step).cast("double")
    if start == 0 and end == 0:
        return F.lit(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s / steps))
    ramp = F.lit(1.0)
    if delay_steps > 0:
        ramp = F.lit(delay) + F.lit(1 - delay) * F.sin(F.lit(math.pi / 2) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), s / delay_steps)))
    return F.when(s < 0, 0.0).otherwise(ramp * F.exp(F.lit(math.log(start)) * (1 - t) + F.lit(math.log(end)) * t))


def psnr(mse) -> Column:
    return F.lit(20.0) * F.log10(F.lit(1.0) / F.sqrt(col(mse)))


def spherical_harmonic_colour(coefficients: list[Column], x: Column, y: Column, z: Column) -> Column:
    """Real spherical harmonics up to degree 2 of one colour channel in a direction."""
    c = coefficients
    out = F.lit(0.5 * math.sqrt(1 / math.pi)) * c[0]
    if len(c) > 3:
        a = math.sqrt(3 / (4 * math.pi))
        out = out + F.lit(a) * (-y * c[1] + z * c[2] - x * c[3])
    if len(c) > 8:
        b, d, e = 0.5 * math.sqrt(15 / math.pi), 0.25 * math.sqrt(5 / math.pi), 0.25 * math.sqrt(15 / math.pi)
        out = out + F.lit(b) * (x * y * c[4] - y * z * c[5] - x * z * c[7]) + F.lit(d) * (2 * z * z - x * x - y * y) * c[6] + F.lit(e) * (x * x - y * y) * c[8]
    return out


def projected(x, y, z, fx: float, fy: float, cx: float, cy: float) -> list[Column]:
    return [F.lit(fx) * col(x) / col(z) + F.lit(cx), F.lit(fy) * col(y) / col(z) + F.lit(cy)]


def size_penalty(diagonal, q95) -> Column:
    """min(1, log2(diagonal / q95)), not below 0; 0 without a prior."""
    ratio = F.try_divide(col(diagonal), col(q95))
    return F.coalesce(F.when(ratio > 1, F.least(F.lit(1.0), F.log2(ratio))), F.lit(0.0))


def candidate_score(iou, semantic, quality, diagonal, q95) -> Column:
    return F.lit(0.45) * col(iou) + F.lit(0.35) * col(semantic) + F.lit(0.20) * col(quality) - F.lit(0.10) * size_penalty(diagonal, q95)


def evidence_score(iou, semantic) -> Column:
    return (F.lit(0.45) * col(iou) + F.lit(0.35) * col(semantic)) / F.lit(0.8)


def crop_side(focal, diagonal, depth, largest, least: float = 64.0) -> Column:
    """1.5 times the projected diagonal, from `least` to the image's size."""
    return F.least(F.greatest(F.lit(1.5) * col(focal) * col(diagonal) / col(depth), F.lit(least)), col(largest))


def in_edge(x, y, width: int, w: int, h: int) -> Column:
    return (col(x) < width) | (col(y) < width) | (col(x) >= w - width) | (col(y) >= h - width)
