"""Scenes as tables: images found by name, cameras of transform files, labelled vertices, paired assets, banks and manifests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normalize_label
from ..functions.vector import col
from .sequence import held_out


def stem(name: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.col(name), r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def resolved_images(wanted: DataFrame, files: DataFrame, name: str, file: str, kinds: tuple[str, ...] = (".jpg", ".jpeg", ".png")) -> DataFrame:
    """name, file: the file of that very name, else the only one of the same stem, else the only one whose stem contains it, else null.

    Several of one stem, or several that contain it, raise. Names are matched by equal strings only: a file
    offers all parts of its stem."""
    ask = wanted.select(name).distinct().withColumn("_stem", stem(name))
    exact = ask.join(files.select(F.col(file).alias("_exact")).distinct(), F.col(name) == F.col("_exact"), "left")
    pictures = files.where(F.lower(F.regexp_extract(file, r"\.[^.]*$", 0)).isin(*kinds)).select(F.col(file).alias("_f"), stem(file).alias("_s"))
    by_stem = pictures.groupBy("_s").agg(F.count(F.lit(1)).alias("_n1"), F.min("_f").alias("_f1"))
    two = exact.join(by_stem, F.col("_stem") == F.col("_s"), "left").drop("_s")
    open_ = two.where("_exact IS NULL AND _n1 IS NULL AND _stem <> ''").select(F.col("_stem").alias("_open")).distinct()
    size = F.length("_s")
    parts = pictures.withColumn("_a", F.explode(F.sequence(F.lit(1), F.greatest(size, F.lit(1))))).withColumn("_b", F.explode(F.sequence(F.lit(1), F.greatest(size - F.col("_a") + 1, F.lit(1)))))
    parts = parts.select("_f", F.col("_s").substr(F.col("_a"), F.col("_b")).alias("_part")).distinct()
    near = parts.join(open_, F.col("_part") == F.col("_open")).groupBy("_open").agg(F.count(F.lit(1)).alias("_n2"), F.min("_f").alias("_f2"))
    three = two.join(near, F.col("_stem") == F.col("_open"), "left")
    twice = F.raise_error(F.concat(F.lit("more than one file for image "), F.col(name))).cast("string")
    found = F.when(F.col("_exact").isNotNull(), F.col("_exact")).when(F.coalesce("_n1", "_n2") > 1, twice).otherwise(F.coalesce("_f1", "_f2"))
    return three.select(name, found.alias(file))


def affine_inverse(m: list[Column]) -> list[Column]:
    """The first three rows (12 numbers) of the inverse of a row-major 4 x 4 matrix whose last row is 0 0 0 1."""
    a = [[m[4 * i + j] for j in range(3)] for i in range(3)]
    minor = lambda i, j: a[(i + 1) % 3][(j + 1) % 3] * a[(i + 2) % 3][(j + 2) % 3] - a[(i + 1) % 3][(j + 2) % 3] * a[(i + 2) % 3][(j + 1) % 3]
    det = sum((a[0][j] * minor(0, j) for j in range(1, 3)), a[0][0] * minor(0, 0))
    inv = [[minor(j, i) / det for j in range(3)] for i in range(3)]
    move = [-(inv[i][0] * m[3] + inv[i][1] * m[7] + inv[i][2] * m[11]) for i in range(3)]
    return [x for i in range(3) for x in (*inv[i], move[i])]


def transform_frames(spark, path: str) -> DataFrame:
    """frame, file_path, matrix (16), angle and the frame's own fl_x, fl_y, w, h (null without) of transform files."""
    frame = "struct<file_path:string,transform_matrix:array<array<double>>,fl_x:double,fl_y:double,w:double,h:double>"
    docs = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(f"camera_angle_x double, frames array<{frame}>").json(path)
    each = docs.select("camera_angle_x", F.posexplode("frames").alias("frame", "f"))
    return each.select("frame", "f.file_path", F.flatten("f.transform_matrix").alias("matrix"), F.col("camera_angle_x").alias("angle"), "f.fl_x", "f.fl_y", "f.w", "f.h")


def transform_cameras(frames: DataFrame, own: bool = False, width: float | None = None, height: float | None = None) -> DataFrame:
    """frame, image_name, rotation (9, by rows), translation (3), fov_x, fov_y.

    World matrices have y up and look along -z. With `own`, the matrix is turned before it is inverted and each frame brings
    its focal lengths; otherwise the file's horizontal angle holds for images of the given size."""
    m = [F.get("matrix", F.lit(k)) for k in range(16)]
    flip = lambda j: 1.0 if j == 0 else -1.0  # noqa: E731  y and z turn round
    if own:
        inv = affine_inverse([F.lit(flip(k % 4)) * c if k % 4 < 3 else c for k, c in enumerate(m)])
        r = [inv[4 * j + i] for i in range(3) for j in range(3)]
        t = [inv[3], inv[7], inv[11]]
        fov = [F.lit(2.0) * F.atan(F.col(n) / (F.lit(2.0) * F.col(f))) for n, f in (("w", "fl_x"), ("h", "fl_y"))]
    else:
        inv = affine_inverse(m)
        r = [F.lit(flip(j)) * inv[4 * j + i] for i in range(3) for j in range(3)]
        t = [-inv[3], -inv[7], -inv[11]]
        focal = F.lit(float(width)) / (F.lit(2.0) * F.tan(F.col("angle") / 2))
        fov = [F.col("angle"), F.lit(2.0) * F.atan(F.lit(float(height)) / (F.lit(2.0) * focal))]
    return frames.select("frame", stem("file_path").alias("image_name"), F.array(*r).alias("rotation"), F.array(*t).alias("translation"), fov[0].alias("fov_x"), fov[1].alias("fov_y"))


def camera_views(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """image_id, name, fx, fy, fov_x, fov_y, qvec, tvec of images with their cameras; cameras with distortion raise."""
    both = images.join(cameras, "camera_id")
    fx = F.get("params", F.lit(0))
    fy = F.when(F.col("model") == "SIMPLE_PINHOLE", fx).when(F.col("model") == "PINHOLE", F.get("params", F.lit(1))).otherwise(F.raise_error(F.concat(F.lit("camera model "), F.col("model"))).cast("double"))
    fov = lambda n, f: F.lit(2.0) * F.atan(F.col(n) / (F.lit(2.0) * f))
    return both.select("image_id", "name", fx.alias("fx"), fy.alias("fy"), fov("width", fx).alias("fov_x"), fov("height", fy).alias("fov_y"), "qvec", "tvec")


def sampled(views: DataFrame, index: str, rate: float) -> DataFrame:
    """Views with index mod 10 below ten times the rate."""
    return views if rate >= 1 else views.where(F.pmod(F.col(index), F.lit(10)) < F.lit(rate * 10))


def split_views(views: DataFrame, name: str, evaluation: bool, every: int = 8) -> DataFrame:
    """Views with `split`: in the order of names each `every`-th is for testing, if there is an evaluation."""
    if not evaluation:
        return views.withColumn("split", F.lit("train"))
    return held_out(views, [name], every).withColumn("split", F.when(F.col("test"), "test").otherwise("train")).drop("test")


def labelled_vertices(vertices: DataFrame, segments: DataFrame, groups: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """vertex, semantic, instance: of vertices (vertex), segments (vertex, segment), groups (segment, instance, label) and taxonomy (raw, class_id).

    -1 where a vertex has no group, or its label no class. A vertex without a segment raises."""
    at = vertices.join(segments, "vertex", "left").withColumn("segment", F.coalesce("segment", F.raise_error(F.lit("a vertex without a segment")).cast("long")))
    known = groups.withColumn("raw", normalize_label("label")).join(taxonomy.select(normalize_label("raw").alias("raw"), "class_id").distinct(), "raw")
    got = at.join(known.select("segment", "instance", "class_id"), "segment", "left")
    has = F.col("class_id").isNotNull()
    return got.select("vertex", F.when(has, F.col("class_id")).otherwise(-1).alias("semantic"), F.when(has, F.col("instance")).otherwise(-1).alias("instance"))


def paired_frames(frames: DataFrame, masks: DataFrame, labels: DataFrame, frame: str) -> DataFrame:
    """paired, missing: frames with both assets, and with neither; half a pair raises, and so does no pair at all."""
    m, k = masks.select(frame).distinct().withColumn("_m", F.lit(1)), labels.select(frame).distinct().withColumn("_k", F.lit(1))
    both = frames.join(m, frame, "left").join(k, frame, "left")
    half = F.max(F.when(F.col("_m").isNull() != F.col("_k").isNull(), F.col(frame).cast("string")))
    found = both.agg(F.count_if(F.col("_m").isNotNull() & F.col("_k").isNotNull()).alias("paired"), F.count_if(F.col("_m").isNull() & F.col("_k").isNull()).alias("missing"), half.alias("_half"))
    ok = F.when(F.col("_half").isNotNull(), F.raise_error(F.concat(F.lit("half a pair for frame "), F.col("_half"))).cast("long"))
    ok = ok.when(F.col("paired") == 0, F.raise_error(F.lit("no pair of mask and labels")).cast("long")).otherwise(F.col("paired"))
    return found.select(ok.alias("paired"), "missing")


def level_features(pixels: DataFrame, image: str, level: str, mask: str) -> DataFrame:
    """image, level, mask, row: which row of the image's features belongs to a mask: levels and masks in order, -1 left out."""
    masks = pixels.where(F.col(mask) >= 0).select(image, level, mask).distinct()
    return masks.withColumn("row", F.row_number().over(Window.partitionBy(image).orderBy(level, mask)) - 1)


def stage_trace(points: DataFrame, stages: dict[str, DataFrame], id_: str, label: str) -> DataFrame:
    """id and a label for each stage, -1 where a stage lacks the point; the stages' tables are (id, label)."""
    out = points.select(id_)
    for name, rows in stages.items():
        out = out.join(rows.select(id_, F.col(label).alias(name)), id_, "left")
    return out.withColumns({n: F.coalesce(n, F.lit(-1)) for n in stages})


def training_scenes(scenes: DataFrame, excluded: DataFrame, present: DataFrame, scene: str) -> DataFrame:
    """scene, status: the scenes of a list whose physical scene isn't excluded: available, or missing."""
    physical = lambda c: F.regexp_replace(F.col(c), "_[^_]*$", "")
    out = excluded.select(physical(scene).alias("_p")).distinct()
    kept = scenes.select(scene).distinct().withColumn("_p", physical(scene)).join(out, "_p", "left_anti")
    here = present.select(scene).distinct().withColumn("_here", F.lit(True))
    return kept.join(here, scene, "left").select(scene, F.when(F.col("_here"), "available").otherwise("missing").alias("status"))


def checked_manifest(rows: DataFrame, scene: str, scale: str, path: str, root: str) -> DataFrame:
    """Rows with absolute paths; a scene that occurs twice, or a scale that isn't a finite positive number, raises."""
    n = rows.groupBy(F.col(scene).alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    at = rows.join(n, F.col(scene) == F.col("_of"), "left")
    good = (F.coalesce("_n", F.lit(0)) == 1) & (F.col(scale) > 0) & (F.col(scale) < float("inf"))
    whole = F.when(F.col(path).startswith("/"), F.col(path)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col(path)))
    whole = F.when(good, whole).otherwise(F.raise_error(F.concat(F.lit("bad manifest row of scene "), F.coalesce(F.col(scene), F.lit("null")))).cast("string"))
    return at.withColumn(path, whole).select(*rows.columns)


# Crops, captions and queries


def discovery_crops(images: DataFrame, width: str, height: str, share: float = 512 / 1500) -> DataFrame:
    """Rows with crop, x0, y0, x1, y1, grid: the whole image (grid 32) and 2 x 2 overlapping tiles (grid 16)."""
    w, h = F.col(width).cast("long"), F.col(height).cast("long")
    both = (F.least(w, h).cast("double") * F.lit(share)).cast("long")
    cw, ch = (F.ceil((x + both) / 2).cast("long") for x in (w, h))
    zero = F.lit(0).cast("long")
    box = lambda n, x0, y0, x1, y1, g: F.struct(F.lit(n).alias("crop"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.lit(g).alias("grid"))
    tiles = [box(f"tile-{i}-{j}", x, y, F.least(x + cw, w), F.least(y + ch, h), 16) for i, x in enumerate((zero, cw - both)) for j, y in enumerate((zero, ch - both))]
    return images.withColumn("_c", F.explode(F.array(box("full", zero, zero, w, h, 32), *tiles))).select(*images.columns, "_c.*")


def grid_points(crops: DataFrame) -> DataFrame:
    """A row for each cell of a crop's grid, with its centre gx, gy from the crop's corner."""
    at = crops.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("grid") - 1))).withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("grid") - 1)))
    centre = lambda k, a, b: (F.col(k) + 0.5) / F.col("grid") * (F.col(b) - F.col(a))
    return at.withColumns({"cell": F.col("_y") * F.col("grid") + F.col("_x"), "gx": centre("_x", "x0", "x1"), "gy": centre("_y", "y0", "y1")}).drop("_x", "_y")


def captions(names: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """by, caption, spans: trimmed lower-case names in order, each followed by `. ` but the last by `.`, and the characters of each."""
    clean = F.lower(F.trim(F.col(name)))
    rows = names.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, clean.alias("n")))), lambda x: x["n"]).alias("_n"))
    start = lambda k: F.aggregate(F.slice("_n", F.lit(1), k), F.lit(0), lambda s, x: s + F.char_length(x) + 2)
    spans = F.transform("_n", lambda x, k: F.struct(start(k).alias("start"), (start(k) + F.char_length(x)).alias("end")))
    return rows.select(*by, F.concat(F.array_join("_n", ". "), F.lit(".")).alias("caption"), spans.alias("spans"))


def decoded_queries(logits: DataFrame, spans: DataFrame, boxes: DataFrame, query: str, token: str, logit: str, cls: str, least: float = 0.35) -> DataFrame:
    """query, class, score, status: the largest sigmoid over the tokens of each class that exceeds `least`; a query none of whose classes does, or with an empty box, is rejected."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(logit)))
    best = logits.join(spans.select(token, cls), token).groupBy(query, cls).agg(F.max(p).alias("score")).where(F.col("score") > least)
    valid = boxes.select(query, ((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).alias("_v"))
    status = F.when(~F.col("_v"), "invalid_box").when(F.col("score").isNull(), "below_threshold").otherwise("eligible")
    return valid.join(best, query, "left").select(query, cls, "score", status.alias("status"))


def inverse_opacity(opacity, valid=None, least: float = 0.05) -> Column:
    """1 / opacity where it is finite and at least `least` (and the pixel is valid), else 0."""
    o = col(opacity).cast("double")
    ok = o.isNotNull() & ~F.isnan(o) & (o < float("inf")) & (o >= least)
    if valid is not None:
        ok = ok & col(valid)
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(1.0) / o).otherwise(F.lit(0.0))


def projection_matrix(near: float, far: float, fov_x, fov_y, width=None, height=None, cx=None, cy=None) -> list[Column]:
    """A 4 x 4 perspective matrix by rows, for depth from 0 to 1 and z forward; a principal point off the centre shifts the frustum.

    In units of the near plane the frustum's half extents are the tangents of half the angles."""
    tx, ty = F.tan(col(fov_x) / 2), F.tan(col(fov_y) / 2)
    zero, one = F.lit(0.0), F.lit(1.0)
    shift = [zero, zero]
    if width is not None:
        shift = [(col(c) - col(n) / 2) * 2 * t / col(n) for c, n, t in ((cx, width, tx), (cy, height, ty))]
    depth = F.lit(far / (far - near))
    return [one / tx, zero, shift[0] / tx, zero, zero, one / ty, shift[1] / ty, zero, zero, zero, depth, -depth * near, zero, zero, one, zero]


def quaternion_of(r: list[Column]) -> list[Column]:
    """w, x, y, z (w not negative) of a rotation by rows; the largest of the four squares decides which is divided by."""
    squares = [1 + r[0] + r[4] + r[8], 1 + r[0] - r[4] - r[8], 1 - r[0] + r[4] - r[8], 1 - r[0] - r[4] + r[8]]
    rest = [[None, r[7] - r[5], r[2] - r[6], r[3] - r[1]], [r[7] - r[5], None, r[3] + r[1], r[2] + r[6]], [r[2] - r[6], r[3] + r[1], None, r[7] + r[5]], [r[3] - r[1], r[2] + r[6], r[7] + r[5], None]]
    top = F.greatest(*squares)
    out = []
    for k in range(4):
        pick = None
        for j in range(4):
            s = F.sqrt(squares[j])
            value = s / 2 if j == k else rest[j][k] / (s * 2)
            pick = F.when(squares[j] == top, value) if pick is None else pick.when(squares[j] == top, value)
        out.append(pick)
    sign = F.when(out[0] < 0, -1.0).otherwise(1.0)
    return [c * sign for c in out]


def view_of_members(cameras: DataFrame, members: DataFrame, camera: str, axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """camera, ray (from the camera's centre to the members' median), depth: without cameras that look away from it.

    Cameras (camera, cx, cy, cz, fx, fy, fz) have a centre and a unit forward direction."""
    centre = members.agg(*[F.percentile(a, 0.5).alias(f"_{a}") for a in axes])
    at = cameras.crossJoin(F.broadcast(centre))  # one row
    ray = [F.col(f"_{a}") - F.col(f"c{k}") for a, k in zip(axes, "xyz")]
    depth = F.sqrt(sum((r * r for r in ray), F.lit(0.0)))
    ahead = sum((r * F.col(f"f{k}") for r, k in zip(ray, "xyz")), F.lit(0.0))
    return at.where((depth > 0) & (ahead > 0)).select(camera, F.array(*ray).alias("ray"), depth.alias("depth"))


def crop_pairs(regions: DataFrame, focal: Column, global_d50: Column, class_d50: Column | None = None, least: int = 64) -> DataFrame:
    """Rows with detail_side, context_side, prior and reasons, of regions (w, h, x0, y0, x1, y1, depth).

    The detail crop is 1.5 times the box; the context crop 1.5 times the box or the object's expected extent, whichever is
    larger, from `least` to the image. Without a positive depth the context is the detail crop."""
    longest = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    detail = F.greatest(F.lit(1), F.ceil(F.lit(1.5) * longest)).cast("long")
    known = F.col("depth") > 0
    size = F.coalesce(class_d50, global_d50) if class_d50 is not None else global_d50
    want = F.ceil(F.lit(1.5) * F.greatest(longest, focal * size / F.col("depth"))).cast("long")
    context = F.when(known, F.least(F.greatest(want, F.lit(least)), F.greatest("w", "h"))).otherwise(detail)
    prior = F.when(~F.coalesce(known, F.lit(False)), "global_fallback").when(class_d50.isNotNull() if class_d50 is not None else F.lit(False), "class").otherwise("global")
    reasons = F.array_compact(F.array(F.when(class_d50.isNull(), "class_unknown") if class_d50 is not None else F.lit(None).cast("string"), F.when(~F.coalesce(known, F.lit(False)), "depth_unavailable")))
    return regions.withColumns({"detail_side": detail, "context_side": context.cast("long"), "prior": prior, "reasons": reasons})


# Masks, scores and banks


def pair_labels(pixels: DataFrame, pixel: str, mask: str, scale: str, pivot: float) -> DataFrame:
    """mask and its pixels at one scale pivot: each pixel belongs to the largest of its masks no larger than the pivot, or to its smallest one."""
    fits = F.col(scale) <= pivot
    rank = F.struct(fits.cast("int"), F.when(fits, F.col(scale)).otherwise(-F.col(scale)), F.col(mask))
    best = pixels.groupBy(pixel).agg(F.max_by(mask, rank).alias(mask))
    return best.groupBy(mask).agg(F.count(F.lit(1)).alias("pixels"), (F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).cast("long").alias("pairs"))


def back_projected(contributions: DataFrame, scores: DataFrame, point: str, pixel: list[str], weight: str, score: str) -> DataFrame:
    """point, score: the scores of the pixels that a point contributes to, by its weights; points above 0 only."""
    s = contributions.join(scores, pixel).groupBy(point).agg(F.sum(F.col(weight) * F.col(score)).alias("score"))
    return s.where("score > 0")


def principal_axes(rows: DataFrame, id_: str, vec: str, k: int = 3) -> DataFrame:
    """id, projected: coordinates along the k principal axes of the vectors (each axis' sign is open)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    at = rows.select(id_, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(at).transform(at).select(id_, vector_to_array("_p").alias("projected"))


def best_members(members: DataFrame, family: DataFrame, candidate: str, element: str, baseline) -> DataFrame:
    """candidate, score: overlap (IoU) of each candidate's elements with a family's, the best first; of equal ones the baseline, then the least id."""
    a = members.select(candidate, element).distinct()
    b = family.select(element).distinct().withColumn("_in", F.lit(1))
    total = b.agg(F.count(F.lit(1)).alias("_t"))
    n = a.join(b, element, "left").groupBy(candidate).agg(F.count(F.lit(1)).alias("_n"), F.count("_in").alias("_i")).crossJoin(F.broadcast(total))  # one row
    score = F.col("_i") / (F.col("_n") + F.col("_t") - F.col("_i")).cast("double")
    return n.select(candidate, score.alias("score")).orderBy(F.col("score").desc(), (F.col(candidate) != F.lit(baseline)), candidate)


def bank(members: DataFrame, scores: DataFrame, by: str, candidate: str, element: str, score: str) -> DataFrame:
    """by, candidate, alias, selected: candidates of the same elements are one (the least id); the best score of what is left is selected."""
    from .overlap import identical_sets

    key = members.select(by, candidate, element)
    sets = identical_sets(key.withColumn("_k", F.struct(by, candidate)).select("_k", F.concat_ws("/", F.col(by).cast("string"), F.col(element).cast("string")).alias(element)), "_k", element)
    sets = sets.select(F.col(f"_k.{by}").alias(by), F.col(f"_k.{candidate}").alias(candidate), F.col(f"alias.{candidate}").alias("alias"))
    top = Window.partitionBy(by).orderBy((F.col("alias") != F.col(candidate)), F.col(score).desc(), candidate)
    return sets.join(scores, [by, candidate]).withColumn("selected", F.row_number().over(top) == 1).select(by, candidate, "alias", "selected")


def exported(mass: DataFrame, owner: str, element: str, inside: str, visible: str) -> DataFrame:
    """element, owner, ratio: each element goes to the owner of the largest pooled ratio, sum of inside over sum of visible (least id of equal ones)."""
    pooled = mass.groupBy(owner, element).agg(F.try_divide(F.sum(inside).cast("double"), F.sum(visible).cast("double")).alias("ratio")).where("ratio IS NOT NULL")
    best = F.max_by(F.struct(F.col(owner).alias("o"), F.col("ratio").alias("r")), F.struct(F.col("ratio"), -F.col(owner)))
    return pooled.groupBy(element).agg(best.alias("_b")).select(element, F.col("_b.o").alias(owner), F.col("_b.r").alias("ratio"))


def paired_conditions(results: DataFrame, item: str, condition: str, value: str, base: str) -> DataFrame:
    """condition, items, mean, better, worse, change: every condition against the base on the items that both have."""
    b = results.where(F.col(condition) == base).select(F.col(item).alias("_i"), F.col(value).alias("_b"))
    both = results.join(b, F.col(item) == F.col("_i"))
    d = F.col(value) - F.col("_b")
    return both.groupBy(condition).agg(F.count(F.lit(1)).alias("items"), F.avg(value).alias("mean"), F.count_if(d > 0).alias("better"), F.count_if(d < 0).alias("worse"), F.avg(d).alias("change"))


def cluster_ids(rows: DataFrame, label: str) -> DataFrame:
    return rows.select(label).where(F.col(label) >= 0).distinct()


def angle_of(focal: float, pixels: float) -> float:
    return 2 * math.atan(pixels / (2 * focal))
