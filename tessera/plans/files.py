"""Files and scenes on the driver's tables: each format is written from a table, read back, and compared in SQL."""

from __future__ import annotations

import json
import math
import os
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import scenes
from ..operators.graph import scratch, written
from ..operators.ordered import numbered
from ..sources import formats, tables
from .queries import half_up, query, r6, t


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for single files, as the formats' other tools write them."""
    at = scratch(spark, name).removeprefix("file://").removeprefix("file:")
    os.makedirs(at, exist_ok=True)
    return at


def load(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    formats.register(spark)
    return spark.read.format(kind).options(**options).load(path)


def text(rows: DataFrame, line, order, path: str) -> None:
    """One text file of the rows' lines in order."""
    rows.select(line.alias("value"), order.alias("_o")).repartition(1).sortWithinPartitions("_o").select("value").write.text(path)


@query("SELECT f AS format, s_suppkey, s_name, s_acctbal FROM supplier, (VALUES ('csv'), ('jsonl'), ('parquet')) v(f)")
def files_rows(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    out = None
    for f in ("csv", "jsonl", "parquet"):
        at = f"{scratch(spark, 'rows')}.{f}"
        tables.write_rows(s, at)
        back = tables.read_rows(spark, at).select(F.lit(f).alias("format"), F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))
        out = back if out is None else out.unionAll(back)
    return out


def _regions(spark, sf_dir) -> str:
    at = folder(spark, "documents")
    for r in t(spark, sf_dir, "region").collect():  # a few rows
        value = {"name": r.r_name, "key": r.r_regionkey}
        tables.write_json(f"{at}/{r.r_regionkey}.json", value)
        assert not tables.write_once(f"{at}/{r.r_regionkey}.json", value)
    return at


@query("SELECT r_regionkey::BIGINT AS key, r_name AS name FROM region")
def files_json(spark, sf_dir):
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema("key long, name string").json(_regions(spark, sf_dir))


@query("""
SELECT r_regionkey || '.json' AS path, length(d)::BIGINT AS size, sha256(d) AS sha256 FROM (SELECT r_regionkey, '{"key":' || r_regionkey || ',"name":"' || r_name || '"}' AS d FROM region)
UNION ALL SELECT 'absent.json', NULL, NULL""")
def files_manifest(spark, sf_dir):
    m = tables.file_manifest(spark, _regions(spark, sf_dir))
    return m.unionAll(tables.missing_files(m, ["0.json", "absent.json"]).select("path", F.lit(None).cast("long"), F.lit(None).cast("string")))


@query("""
SELECT 's' || l_suppkey % 5 AS scene_id, l_linenumber::BIGINT AS semantic, count(*) AS points, round(sum(l_quantity), 4) AS x, round(sum(l_discount), 4) AS y, round(sum(l_tax), 4) AS z, sum(l_partkey % 7)::BIGINT AS instance FROM lineitem GROUP BY ALL""")
def files_npz(spark, sf_dir):
    formats.register(spark)
    li = t(spark, sf_dir, "lineitem")
    rows = li.select(F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("scene_id"), F.col("l_orderkey").alias("point_id"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"), F.col("l_linenumber").cast("long").alias("semantic"), (F.col("l_partkey") % 7).cast("long").alias("instance"))
    at = folder(spark, "npz")
    rows.repartition("scene_id").sortWithinPartitions("scene_id", "point_id", "semantic").write.format("npz_scene").mode("append").save(at)
    back = load(spark, "npz_scene", at)
    return back.groupBy("scene_id", "semantic").agg(F.count(F.lit(1)).alias("points"), *[F.round(F.sum(c), 4).alias(c) for c in "xyz"], F.sum("instance").alias("instance"))


@query("SELECT c_custkey AS key, round(c_acctbal::FLOAT::DOUBLE, 4) AS x, round(-c_acctbal::FLOAT::DOUBLE, 4) AS y, c_nationkey::INTEGER AS red FROM customer")
def files_ply_points(spark, sf_dir):
    formats.register(spark)
    c = t(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("x"), (-F.col("c_acctbal")).alias("y"), F.lit(0.0).alias("nx"), F.col("c_nationkey").cast("smallint").alias("red"), F.col("c_custkey").cast("int").alias("key"))
    at = folder(spark, "cloud")
    c.write.format("ply").mode("append").save(at)
    back = load(spark, "ply", at, columns="key,x,y,red")
    return back.select(F.col("key").cast("long").alias("key"), *[F.round(F.col(a).cast("double"), 4).alias(a) for a in "xy"], F.col("red").cast("int").alias("red"))


@query("""
SELECT vec_id::BIGINT AS vec_id, 32::INTEGER AS width, round(list_sum(list_transform(range(0, 32), lambda i: i * embedding[i + 1]::FLOAT::DOUBLE)), 3) AS check, 32::INTEGER AS empty FROM embeddings""")
def files_ply_features(spark, sf_dir):
    """Feature columns f_0 ... f_31 through a PLY file and back into one array, with a second array of zeros added."""
    formats.register(spark)
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("key"), F.col("embedding").cast("array<float>").alias("v"))
    at = folder(spark, "features")
    formats.unpacked(e, "v", "f_", 32).write.format("ply").mode("append").save(at)
    back = formats.packed(load(spark, "ply", at), "f_", "v", 32).withColumn("sf", F.array_repeat(F.lit(0.0), 32))
    total = F.aggregate(F.transform("v", lambda x, k: x.cast("double") * k), F.lit(0.0), lambda s, x: s + x)
    return back.select(F.col("key").cast("long").alias("vec_id"), F.size("v").alias("width"), F.round(total, 3).alias("check"), F.size("sf").alias("empty"))


_MESH = "v AS (SELECT s_suppkey AS k, round(s_acctbal / 100, 2) AS x, (s_suppkey % 7)::DOUBLE AS y, (s_suppkey % 5)::DOUBLE AS z FROM supplier)"


@query(f"""WITH {_MESH}, f AS (SELECT a.k AS face, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz FROM v a JOIN v b ON b.k = a.k + 1 JOIN v c ON c.k = a.k + 2)
SELECT face, round(sqrt((uy * vz - uz * vy) ** 2 + (uz * vx - ux * vz) ** 2 + (ux * vy - uy * vx) ** 2) / 2, 2) AS area FROM f""")
def files_mesh(spark, sf_dir):
    """Vertices in the order of their keys, which go with them; a face joins the rows of three keys in a row, so gaps and keys that come twice give what SQL gives."""
    s = t(spark, sf_dir, "supplier").where("s_suppkey IS NOT NULL").select(F.col("s_suppkey").alias("k"), half_up(F.col("s_acctbal") / 100, 2).alias("x"), (F.col("s_suppkey") % 7).alias("y"), (F.col("s_suppkey") % 5).alias("z"))
    v = numbered(s, ["k"], "row")
    at_key = lambda name, less: v.select((F.col("k") - less).alias("k"), F.col("row").alias(name))
    corners = written(at_key("a", 0).join(at_key("b", 1), "k").join(at_key("c", 2), "k").select("a", "b", "c"), "mesh-faces")
    n, m = v.count(), corners.count()
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property double {a}" for a in "xyzk"], f"element face {m}", "property list uchar int vertex_indices", "end_header"]
    lines = spark.createDataFrame(list(enumerate(head, -len(head))), "o long, value string")
    lines = lines.unionAll(v.select("row", F.concat_ws(" ", F.coalesce("x", F.lit(float("nan"))), "y", "z", "k"))).unionAll(corners.select(F.col("a") + n, F.concat_ws(" ", F.lit(3), "a", "b", "c")))
    at = scratch(spark, "mesh")
    text(lines, F.col("value"), F.col("o"), at)
    v = load(spark, "ply", at).select("row", F.nanvl("x", F.lit(None).cast("double")).alias("x"), "y", "z", F.col("k").cast("long").alias("k"))
    f = load(spark, "ply_faces", at).select("face", F.posexplode("vertices").alias("corner", "row")).join(v, "row")
    f = f.groupBy("face").agg(F.min("k").alias("k"), *[F.max(F.when(F.col("corner") == c, F.col(a))).alias(f"{a}{c}") for c in range(3) for a in "xyz"])
    return f.select(F.col("k").alias("face"), half_up(V.triangle_area(*[[F.col(f"{a}{c}") for a in "xyz"] for c in range(3)]), 2).alias("area"))


@query("SELECT n_nationkey::INTEGER AS i, (n_nationkey / 2)::DOUBLE AS v FROM nation WHERE n_nationkey < 16")
def files_alignment(spark, sf_dir):
    n = t(spark, sf_dir, "nation").where("n_nationkey < 16")
    numbers = n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey"))), lambda x: (x["n_nationkey"] / 2).cast("string")), " ").alias("v"))  # 16 rows
    at = scratch(spark, "meta")
    numbers.select(F.concat(F.lit("axisAlignment = "), "v")).unionAll(numbers.select(F.lit("sceneType = Office"))).write.text(at)
    return tables.axis_alignment(spark, at).select(F.posexplode("matrix").alias("i", "v"))


@query("SELECT n_name AS scene_id FROM nation")
def files_scene_ids(spark, sf_dir):
    at = scratch(spark, "ids")
    t(spark, sf_dir, "nation").select(F.concat(F.lit("  "), "n_name", F.lit("\n\n"))).write.text(at)
    return tables.scene_ids(spark, at)


@query("SELECT n_nationkey::BIGINT AS frame, n_nationkey::DOUBLE AS tx, length(n_name)::INTEGER AS bytes FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey <> 9")
def files_recording(spark, sf_dir):
    """A frame for each nation, each third is read; frame 9 has a pose that is no rigid motion."""
    rows = sorted(t(spark, sf_dir, "nation").collect(), key=lambda r: r.n_nationkey)  # a few rows
    at = f"{folder(spark, 'recording')}/a.sens"
    with open(at, "wb") as f:
        f.write(struct.pack("<IQ", 4, 1) + b"n" + bytes(256) + struct.pack("<2i4IfQ", 2, 1, 4, 3, 2, 1, 1000.0, len(rows)))
        for r in rows:
            pose = [1, 0, 0, r.n_nationkey, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
            if r.n_nationkey == 9:
                pose[0] = math.inf
            name = r.n_name.encode()
            f.write(struct.pack("<16f", *pose) + struct.pack("<4Q", r.n_nationkey, r.n_nationkey, len(name), 3) + name + b"ddd")
    frames = load(spark, "sens", at, stride="3")
    return frames.where(V.valid_pose([F.get("pose", F.lit(k)) for k in range(16)])).select("frame", F.get("pose", F.lit(3)).alias("tx"), F.octet_length("colour").alias("bytes"))


def _model(spark, sf_dir, binary: bool) -> str:
    """Cameras, images and points of a sparse model, one of each for every nation."""
    rows = sorted(t(spark, sf_dir, "nation").collect(), key=lambda r: r.n_nationkey)  # a few rows
    at = folder(spark, "model")
    keys = [(r.n_nationkey, f"{r.n_name.replace(' ', '_')}.jpg") for r in rows]
    if binary:
        n = struct.pack("<Q", len(keys))
        body = {
            "cameras": n + b"".join(struct.pack("<iiQQ4d", k, 1, 640, 480, 500.0 + k, 501.0, 320.0, 240.0) for k, _ in keys),
            "images": n + b"".join(struct.pack("<i7di", k, 1, 0, 0, 0, k, 2, 3, (k + 1) % len(keys)) + name.encode() + b"\0" + struct.pack("<Q", k % 4) + b"".join(struct.pack("<ddq", j, 2 * j, k + j) for j in range(k % 4)) for k, name in keys),
            "points3D": n + b"".join(struct.pack("<QdddBBBdQ", k, k, k / 2, -k, k, 1, 2, 0.5, k % 3) + bytes(8 * (k % 3)) for k, _ in keys),
        }
        for name, data in body.items():
            with open(f"{at}/{name}.bin", "wb") as f:
                f.write(data)
        return at
    body = {
        "cameras": [f"{k} PINHOLE 640 480 {500 + k} 501 320 240" for k, _ in keys],
        "images": [x for k, name in keys for x in (f"{k} 1 0 0 0 {k} 2 3 {(k + 1) % len(keys)} {name}", " ".join(f"{j} {2 * j} {k + j}" for j in range(k % 4)))],
        "points3D": [" ".join(map(str, [k, k, k / 2, -k, k, 1, 2, 0.5, *([0, 0] * (k % 3))])) for k, _ in keys],
    }
    for name, lines in body.items():
        with open(f"{at}/{name}.txt", "w", encoding="utf-8") as f:
            f.write("\n".join(["# written by hand", *lines, ""]))
    return at


_BOTH = "(VALUES ('bin'), ('txt')) v(format)"


@query(f"""SELECT format, n_nationkey::BIGINT AS image_id, replace(n_name, ' ', '_') || '.jpg' AS name, 500.0::DOUBLE + (n_nationkey + 1) % 25 AS fx, round(2 * atan(640 / (2 * (500.0::DOUBLE + (n_nationkey + 1) % 25))), 6) AS fov_x, n_nationkey::DOUBLE AS tx,
 (n_nationkey % 4)::BIGINT AS n_points, coalesce(list_sum(list_transform(range(0, n_nationkey % 4), lambda j: 2 * j)), 0)::DOUBLE AS ys, coalesce(list_sum(list_transform(range(0, n_nationkey % 4), lambda j: j + n_nationkey)), 0)::BIGINT AS ids FROM nation, {_BOTH}""")
def files_cameras(spark, sf_dir):
    out = None
    total = lambda c, k: F.aggregate(c, F.lit(0).cast(k), lambda s, x: s + x)
    for f in ("bin", "txt"):
        at = _model(spark, sf_dir, f == "bin")
        images, cameras = (load(spark, "colmap", f"{at}/{n}.{f}", table=n) for n in ("images", "cameras"))
        points = images.select("image_id", "n_points", total("ys", "double").alias("ys"), total("point_ids", "long").alias("ids"))
        rows = scenes.camera_views(images, cameras).join(points, "image_id").select(F.lit(f).alias("format"), "image_id", "name", "fx", r6("fov_x").alias("fov_x"), F.get("tvec", F.lit(0)).alias("tx"), "n_points", "ys", "ids")
        out = rows if out is None else out.unionAll(rows)
    return out


@query(f"SELECT format, n_nationkey::BIGINT AS point_id, n_nationkey::DOUBLE AS x, n_nationkey / 2::DOUBLE AS y, n_nationkey::INTEGER AS r, 0.5::DOUBLE AS error, (n_nationkey % 3)::BIGINT AS n_track FROM nation, {_BOTH}")
def files_points3d(spark, sf_dir):
    out = None
    for f in ("bin", "txt"):
        rows = load(spark, "colmap", f"{_model(spark, sf_dir, f == 'bin')}/points3D.{f}", table="points3D").select(F.lit(f).alias("format"), "point_id", "x", "y", "r", "error", "n_track")
        out = rows if out is None else out.unionAll(rows)
    return out


@query('SELECT n_nationkey // 5 AS "row", n_nationkey % 5 AS col, 0::BIGINT AS channel, n_nationkey / 4::DOUBLE AS value FROM nation')
def files_dense(spark, sf_dir):
    values = [r.n_nationkey / 4 for r in sorted(t(spark, sf_dir, "nation").collect(), key=lambda r: r.n_nationkey)]  # a few rows
    at = f"{folder(spark, 'dense')}/depth.array"
    with open(at, "wb") as f:
        f.write(b"5&5&1&" + struct.pack("<25f", *values))
    return load(spark, "colmap", at, table="array").select("row", "col", "channel", F.col("value").cast("double").alias("value"))


@query("SELECT n_name AS image, CASE WHEN n_nationkey % 3 < 2 OR n_nationkey % 9 = 2 THEN n_name || '-' || n_nationkey || '.png' END AS file FROM nation")
def resolved_images(spark, sf_dir):
    """Asked for by the whole name, by the stem under another suffix, by a part of the stem, or by what isn't there."""
    n = t(spark, sf_dir, "nation")
    own = F.concat("n_name", F.lit("-"), F.col("n_nationkey").cast("string"))
    k = F.col("n_nationkey") % 3
    ask = F.when(k == 0, F.concat(own, F.lit(".png"))).when(k == 1, F.concat(own, F.lit(".JPG"))).when(F.col("n_nationkey") % 9 == 2, F.concat(own.substr(F.lit(2), F.length(own)), F.lit(".jpg"))).otherwise(F.concat(F.lit("nothing"), own))
    wanted = n.select("n_name", ask.alias("image"))
    found = scenes.resolved_images(wanted, n.select(F.concat(own, F.lit(".png")).alias("file")), "image", "file")
    return wanted.join(found, "image").select(F.col("n_name").alias("image"), "file")


_TURN = "SELECT *, n_nationkey * 0.1 AS a, n_nationkey::DOUBLE AS x FROM nation"


@query(f"""
SELECT n_name AS image_name, CASE WHEN n_nationkey % 2 = 0 THEN 'train' ELSE 'test' END AS split, round(cos(a), 6) AS r00, round(sin(a), 6) AS r01, round(cos(a) * x + sin(a) * 2, 6) AS t0, round(-sin(a) * x + cos(a) * 2, 6) AS t1, 3.0::DOUBLE AS t2, 0.8::DOUBLE AS fov_x, round(2 * atan(480 / (2 * 640 / (2 * tan(0.4::DOUBLE)))), 6) AS fov_y FROM ({_TURN})""")
def transform_cameras(spark, sf_dir):
    """Train and test cameras of two transform files: turned about z, and moved."""
    at = folder(spark, "transforms")
    rows = sorted(t(spark, sf_dir, "nation").collect(), key=lambda r: r.n_nationkey)  # a few rows
    out = None
    for part, split in enumerate(("train", "test")):
        frames = []
        for r in rows:
            if r.n_nationkey % 2 == part:
                c, s = math.cos(r.n_nationkey * 0.1), math.sin(r.n_nationkey * 0.1)
                frames.append({"file_path": f"./{split}/{r.n_name}", "transform_matrix": [[c, -s, 0, r.n_nationkey], [s, c, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]]})
        with open(f"{at}/{split}.json", "w", encoding="utf-8") as f:
            json.dump({"camera_angle_x": 0.8, "frames": frames}, f)
        cameras = scenes.transform_cameras(scenes.transform_frames(spark, f"{at}/{split}.json"), width=640, height=480).withColumn("split", F.lit(split))
        out = cameras if out is None else out.unionAll(cameras)
    at = lambda c, k: r6(F.get(c, F.lit(k)))
    return out.select("image_name", "split", at("rotation", 0).alias("r00"), at("rotation", 1).alias("r01"), at("translation", 0).alias("t0"), at("translation", 1).alias("t1"), at("translation", 2).alias("t2"), r6("fov_x").alias("fov_x"), r6("fov_y").alias("fov_y"))


@query(f"""
SELECT n_name AS image_name, round(cos(a), 6) AS r00, round(sin(a), 6) AS r10, round(-cos(a), 6) AS r11, round(-(cos(a) * x + sin(a) * 2), 6) AS t0, round(-sin(a) * x + cos(a) * 2, 6) AS t1, round(2 * atan(640 / (2 * (500.0::DOUBLE + n_nationkey))), 6) AS fov_x FROM ({_TURN})""")
def transform_cameras_own(spark, sf_dir):
    """Cameras that bring their own focal lengths."""
    rows = sorted(t(spark, sf_dir, "nation").collect(), key=lambda r: r.n_nationkey)  # a few rows
    frames = []
    for r in rows:
        c, s = math.cos(r.n_nationkey * 0.1), math.sin(r.n_nationkey * 0.1)
        frames.append({"file_path": f"images/{r.n_name}.jpg", "w": 640, "h": 480, "fl_x": 500 + r.n_nationkey, "fl_y": 501, "transform_matrix": [[c, -s, 0, r.n_nationkey], [s, c, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]]})
    at = f"{folder(spark, 'transforms')}/own.json"
    with open(at, "w", encoding="utf-8") as f:
        json.dump({"frames": frames}, f)
    c = scenes.transform_cameras(scenes.transform_frames(spark, at), own=True)
    el = lambda c, k: r6(F.get(c, F.lit(k)))
    return c.select("image_name", el("rotation", 0).alias("r00"), el("rotation", 3).alias("r10"), el("rotation", 4).alias("r11"), el("translation", 0).alias("t0"), el("translation", 1).alias("t1"), r6("fov_x").alias("fov_x"))


@query("SELECT o_orderkey::VARCHAR AS identity, o_orderstatus AS result, sha256(o_orderstatus) AS sha256 FROM orders")
def evidence_store(spark, sf_dir):
    """Every order put once and half of them again with another result, which changes nothing."""
    o = t(spark, sf_dir, "orders").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("key"), F.col("o_orderkey").cast("string").alias("identity"), F.col("o_orderstatus").alias("result"))
    store = tables.EvidenceStore(spark, scratch(spark, "store"))
    store.put(o)
    store.put(o.where("identity % 2 = 0").withColumn("result", F.lit("changed")))
    return store.rows().select("identity", "result", "sha256")


@query("SELECT p_brand AS scene, p_partkey AS candidate, p_size::BIGINT AS size FROM part WHERE p_size > 0")
def candidate_bank(spark, sf_dir):
    """A bank is written once: writing to the same place again raises, and what is read back must be whole."""
    at = scratch(spark, "bank")
    rows = t(spark, sf_dir, "part").select(F.col("p_brand").alias("scene"), F.col("p_partkey").alias("candidate"), F.col("p_size").cast("long").alias("size"))
    tables.save_bank(rows, at)
    try:
        tables.save_bank(rows.limit(1), at)
    except Exception:  # noqa: BLE001  it is there
        return tables.load_bank(spark, at, ["scene", "candidate", "size"], "candidate").where("size > 0")
    raise AssertionError("a bank was overwritten")


@query("SELECT l_partkey AS pixel, l_suppkey AS id, round(sum(l_quantity), 4) AS weight FROM lineitem WHERE l_linenumber = 3 GROUP BY ALL")
def contributor_table(spark, sf_dir):
    """Contributions partitioned by camera; one camera's are read."""
    at = scratch(spark, "contributors")
    t(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("camera"), F.col("l_partkey").alias("pixel"), F.col("l_suppkey").alias("id"), F.col("l_quantity").alias("weight")).write.partitionBy("camera").parquet(at)
    one = spark.read.parquet(at).where("camera = 3")
    return one.groupBy("pixel", "id").agg(F.round(F.sum("weight"), 4).alias("weight"))


# Scenes


@query("""
SELECT o_orderkey AS vertex, coalesce(c.id, -1)::BIGINT AS semantic, CASE WHEN c.id IS NULL THEN -1 ELSE c_nationkey END::BIGINT AS instance
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (VALUES ('building', 0), ('machinery', 1), ('household', 2)) c(raw, id) ON lower(c_mktsegment) = raw""")
def labelled_vertices(spark, sf_dir):
    o, c = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer")
    taxonomy = spark.createDataFrame([("Building", 0), (" MACHINERY", 1), ("household", 2)], "raw string, class_id long")
    groups = c.select(F.col("c_custkey").alias("segment"), F.col("c_nationkey").cast("long").alias("instance"), F.col("c_mktsegment").alias("label"))
    v = o.select(F.col("o_orderkey").alias("vertex"))
    return scenes.labelled_vertices(v, o.select(F.col("o_orderkey").alias("vertex"), F.col("o_custkey").alias("segment")), groups, taxonomy)


@query("SELECT n_name AS scene, '/data/' || n_name AS path, 1.0::DOUBLE + n_nationkey AS scale FROM nation")
def scene_manifest(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select(F.col("n_name").alias("scene"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("/data/"), "n_name")).alias("path"), (F.col("n_nationkey") + F.lit(1.0)).alias("scale"))
    return scenes.checked_manifest(n, "scene", "scale", "path", "/data")


@query("SELECT c_custkey, CASE WHEN (row_number() OVER (ORDER BY c_name) - 1) % 8 = 0 THEN 'test' ELSE 'train' END AS split FROM customer WHERE c_custkey % 10 < 5 ")
def scene_split(spark, sf_dir):
    views = scenes.sampled(t(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 0.5)
    return scenes.split_views(views, "c_name", True).select("c_custkey", "split")


@query("SELECT count(*) FILTER (n > 0) AS paired, count(*) FILTER (n = 0) AS missing FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def paired_frames(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("frame"))
    return scenes.paired_frames(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("frame")), o, o.distinct(), "frame")


@query("SELECT l_orderkey, l_linenumber, l_partkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INTEGER AS \"row\" FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)")
def level_features(spark, sf_dir):
    return scenes.level_features(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_custkey, coalesce(a, -1) AS core, coalesce(b, -1) AS final FROM customer LEFT JOIN (SELECT o_custkey AS k, max(o_orderkey) AS a, max(o_orderkey) FILTER (o_orderstatus = 'F') AS b FROM orders GROUP BY 1) ON k = c_custkey")
def stage_trace(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    last = lambda d: d.groupBy("c_custkey").agg(F.max("o_orderkey").alias("label"))
    return scenes.stage_trace(t(spark, sf_dir, "customer"), {"core": last(o), "final": last(o.where("o_orderstatus = 'F'"))}, "c_custkey", "label")


@query("""
WITH s AS (SELECT n_name || '_' || p_size AS scene, n_name FROM nation, (SELECT DISTINCT p_size FROM part)) SELECT scene, CASE WHEN scene LIKE '%1' THEN 'missing' ELSE 'available' END AS status FROM s WHERE n_name NOT IN ('FRANCE', 'CHINA')""")
def training_scenes(spark, sf_dir):
    n = t(spark, sf_dir, "nation").withColumn("k", F.lit(1)).join(t(spark, sf_dir, "part").select("p_size", F.lit(1).alias("k")).distinct(), "k")
    s = n.select(F.concat_ws("_", "n_name", F.col("p_size").cast("string")).alias("scene"))
    out = spark.createDataFrame([("FRANCE_00",), ("CHINA_99",)], "scene string")
    return scenes.training_scenes(s, out, s.where("scene NOT LIKE '%1'"), "scene")


_TILES = "t AS (SELECT p_partkey, (300 + p_size * 7)::BIGINT AS w, (200 + p_partkey % 90)::BIGINT AS h FROM part), o AS (SELECT *, (least(w, h)::DOUBLE * (512 / 1500::DOUBLE))::DOUBLE AS ov FROM t), p AS (SELECT p_partkey, w, h, floor(ov)::BIGINT AS o, ceil((w + floor(ov)) / 2)::BIGINT AS cw, ceil((h + floor(ov)) / 2)::BIGINT AS ch FROM o)"


def _images(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", (300 + F.col("p_size") * 7).cast("long").alias("w"), (200 + F.col("p_partkey") % 90).cast("long").alias("h"))


@query(f"""WITH {_TILES} SELECT p_partkey, 'full' AS crop, 0::BIGINT AS x0, 0::BIGINT AS y0, w AS x1, h AS y1 FROM p
UNION ALL SELECT p_partkey, 'tile-' || i || '-' || j, i * (cw - o), j * (ch - o), least(i * (cw - o) + cw, w), least(j * (ch - o) + ch, h) FROM p, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)""")
def discovery_crops(spark, sf_dir):
    return scenes.discovery_crops(_images(spark, sf_dir), "w", "h").select("p_partkey", "crop", "x0", "y0", "x1", "y1")


@query(f"""WITH {_TILES} SELECT p_partkey, (gy * 32 + gx)::INTEGER AS cell, round((gx + 0.5) / 32 * w, 6)::DOUBLE AS gx, round((gy + 0.5) / 32 * h, 6)::DOUBLE AS gy FROM p, range(0, 32) a(gx), range(0, 32) b(gy) WHERE p_partkey <= 20""")
def grid_points(spark, sf_dir):
    crops = scenes.discovery_crops(_images(spark, sf_dir).where("p_partkey <= 20"), "w", "h").where("crop = 'full'")
    return scenes.grid_points(crops).select("p_partkey", "cell", r6("gx").alias("gx"), r6("gy").alias("gy"))


@query("""
WITH n AS (SELECT n_regionkey, n_nationkey, lower(n_name) AS s FROM nation), p AS (SELECT *, sum(length(s) + 2) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - length(s) - 2 AS a FROM n)
SELECT n_regionkey, string_agg(s, '. ' ORDER BY n_nationkey) || '.' AS caption, string_agg(a || '-' || (a + length(s)), ',' ORDER BY n_nationkey) AS spans FROM p GROUP BY n_regionkey""")
def captions(spark, sf_dir):
    c = scenes.captions(t(spark, sf_dir, "nation"), ["n_regionkey"], "n_nationkey", "n_name")
    return c.select("n_regionkey", "caption", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


@query("""
WITH l AS (SELECT l_orderkey AS q, l_linenumber % 3 AS c, max(1 / (1 + exp(-(l_quantity - 30) / 5))) AS s FROM lineitem GROUP BY ALL), b AS (SELECT * FROM l WHERE s > 0.35),
x AS (SELECT o_orderkey AS q, o_custkey % 5 > 0 AS v FROM orders)
SELECT q, c, round(s, 6) AS score, CASE WHEN NOT v THEN 'invalid_box' WHEN s IS NULL THEN 'below_threshold' ELSE 'eligible' END AS status FROM x LEFT JOIN b USING (q)""")
def decoded_queries(spark, sf_dir):
    logits = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("token"), ((F.col("l_quantity") - 30) / 5).alias("logit"))
    spans = spark.range(1, 8).select(F.col("id").cast("int").alias("token"), (F.col("id") % 3).cast("int").alias("c"))
    boxes = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), F.lit(0).alias("x0"), (F.col("o_custkey") % 5).alias("x1"), F.lit(0).alias("y0"), F.lit(1).alias("y1"))
    return scenes.decoded_queries(logits, spans, boxes, "q", "token", "logit", "c").withColumn("score", r6("score"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount >= 0.05 AND l_returnflag <> 'R' THEN 1 / l_discount ELSE 0 END, 6) AS inverse FROM lineitem")
def inverse_opacity(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(scenes.inverse_opacity("l_discount", F.col("l_returnflag") != "R")).alias("inverse"))


@query("""
WITH c AS (SELECT c_custkey, 0.5 + c_nationkey / 50::DOUBLE AS f, 300 + c_nationkey::DOUBLE AS cx FROM customer), m AS (SELECT *, 0.01 * tan(f / 2) AS r, (cx - 320) / (640 / (2 * tan(f / 2))) * 0.01 AS s FROM c)
SELECT c_custkey, round(2 * 0.01 / ((r + s) - (s - r)), 6) AS p00, round(((r + s) + (s - r)) / ((r + s) - (s - r)), 6) AS p02, round(100 / (100 - 0.01)::DOUBLE, 6) AS p22, round(-(100 * 0.01) / (100 - 0.01)::DOUBLE, 6) AS p23 FROM m""")
def projection_matrix(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") / F.lit(50.0) + 0.5).alias("f"), (F.col("c_nationkey") + F.lit(300.0)).alias("cx"))
    m = scenes.projection_matrix(0.01, 100.0, "f", "f", F.lit(640.0), F.lit(480.0), "cx", F.lit(240.0))
    return c.select("c_custkey", r6(m[0]).alias("p00"), r6(m[2]).alias("p02"), r6(m[10]).alias("p22"), r6(m[11]).alias("p23"))


@query("""
WITH q AS (SELECT s_suppkey, cos(s_suppkey * 0.7) AS w, sin(s_suppkey * 0.7) * 0.6 AS x, sin(s_suppkey * 0.7) * 0.8 AS z FROM supplier)
SELECT s_suppkey, round(w * g, 5) AS w, round(x * g, 5) AS x, 0.0::DOUBLE AS y, round(z * g, 5) AS z FROM (SELECT *, CASE WHEN w < 0 THEN -1 ELSE 1 END AS g FROM q)""")
def quaternions(spark, sf_dir):
    """Quaternions to rotations and back, with w not negative."""
    a = F.col("s_suppkey") * F.lit(0.7)
    r = V.rotation_of(F.cos(a), F.sin(a) * 0.6, F.lit(0.0), F.sin(a) * 0.8)
    q = scenes.quaternion_of(r)
    return t(spark, sf_dir, "supplier").select("s_suppkey", *[(F.round(c, 5) + F.lit(0.0)).alias(n) for n, c in zip("wxyz", q)])


@query("SELECT DISTINCT l_partkey % 11 - 3 AS label FROM lineitem WHERE l_partkey % 11 - 3 >= 0")
def cluster_ids(spark, sf_dir):
    return scenes.cluster_ids(t(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 11 - 3).alias("label")), "label")


@query("""
WITH m AS (SELECT median(l_quantity) AS x, median(l_discount * 100) AS y, median(l_tax * 100) AS z FROM lineitem), c AS (SELECT s_suppkey, s_acctbal / 100 AS cx, (s_suppkey % 9)::DOUBLE AS cy FROM supplier)
SELECT s_suppkey, round(sqrt((x - cx) ** 2 + (y - cy) ** 2 + z ** 2), 6) AS depth, round(x - cx, 6) AS rx FROM c, m WHERE x - cx > 0""")
def view_of_members(spark, sf_dir):
    members = t(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))
    c = t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("cx"), (F.col("s_suppkey") % 9).cast("double").alias("cy"), F.lit(0.0).alias("cz"), F.lit(1.0).alias("fx"), F.lit(0.0).alias("fy"), F.lit(0.0).alias("fz"))
    return scenes.view_of_members(c, members, "s_suppkey").select("s_suppkey", r6("depth").alias("depth"), r6(F.get("ray", F.lit(0))).alias("rx"))


@query("""
WITH r AS (SELECT p_partkey, 640 AS w, 480 AS h, 10 AS x0, 10 + p_size AS x1, 20 AS y0, 20 + p_partkey % 37 + 1 AS y1, CASE WHEN p_partkey % 4 > 0 THEN p_retailprice / 500 END AS d, CASE WHEN p_partkey % 3 > 0 THEN 0.9 END AS c FROM part),
l AS (SELECT *, greatest(x1 - x0, y1 - y0) AS l FROM r)
SELECT p_partkey, greatest(1, ceil(1.5 * l))::BIGINT AS detail_side, (CASE WHEN d > 0 THEN least(greatest(ceil(1.5::DOUBLE * greatest(l, 500 * coalesce(c, 0.5)::DOUBLE / d)), 64), 640) ELSE greatest(1, ceil(1.5 * l)) END)::BIGINT AS context_side,
 CASE WHEN d IS NULL THEN 'global_fallback' WHEN c IS NOT NULL THEN 'class' ELSE 'global' END AS prior, concat_ws(',', CASE WHEN c IS NULL THEN 'class_unknown' END, CASE WHEN d IS NULL THEN 'depth_unavailable' END) AS reasons FROM l""")
def crop_pairs(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", F.lit(640).alias("w"), F.lit(480).alias("h"), F.lit(10).alias("x0"), (F.col("p_size") + 10).alias("x1"), F.lit(20).alias("y0"), (F.col("p_partkey") % 37 + 21).alias("y1"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_retailprice") / 500).alias("depth"))
    made = scenes.crop_pairs(p, F.lit(500.0), F.lit(0.5), F.when(F.col("p_partkey") % 3 > 0, F.lit(0.9)))
    return made.select("p_partkey", "detail_side", "context_side", "prior", F.array_join("reasons", ",").alias("reasons"))


# Masks, scores and banks


@query("""
WITH b AS (SELECT l_partkey, l_suppkey FROM (SELECT *, l_quantity <= 20 AS f FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY f DESC, CASE WHEN f THEN l_quantity ELSE -l_quantity END DESC, l_suppkey DESC) = 1)
SELECT l_suppkey, count(*) AS pixels, (count(*) * (count(*) - 1) / 2)::BIGINT AS pairs FROM b GROUP BY l_suppkey""")
def pair_labels(spark, sf_dir):
    return scenes.pair_labels(t(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_quantity", 20.0)


@query("""
SELECT l_suppkey, sum(round(l_quantity)::BIGINT * (p_size - 30))::DOUBLE AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING sum(round(l_quantity)::BIGINT * (p_size - 30)) > 0""")
def back_projected(spark, sf_dir):
    scores = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") - 30).cast("double").alias("s"))
    return scenes.back_projected(t(spark, sf_dir, "lineitem").withColumn("w", F.round("l_quantity")), scores, "l_suppkey", ["l_partkey"], "w", "s")


@query()
def principal_axes(spark, sf_dir):
    p = scenes.principal_axes(t(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return p.select("vec_id", *[F.round(F.abs(F.get("projected", F.lit(k))), 4).alias(f"c{k}") for k in range(3)])


@query("""
WITH a AS (SELECT DISTINCT l_suppkey AS c, l_partkey AS e FROM lineitem), f AS (SELECT DISTINCT l_partkey AS e FROM lineitem WHERE l_quantity > 40), n AS (SELECT c, count(*) AS n, count(f.e) AS i FROM a LEFT JOIN f USING (e) GROUP BY c)
SELECT c AS l_suppkey, round(i / (n + (SELECT count(*) FROM f) - i)::DOUBLE, 6) AS score FROM n""")
def best_members(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    return scenes.best_members(li, li.where("l_quantity > 40"), "l_suppkey", "l_partkey", 1).withColumn("score", r6("score"))


@query("""
WITH m AS (SELECT DISTINCT o_custkey % 50 AS o, o_custkey AS c, o_orderpriority AS e FROM orders), k AS (SELECT o, c, string_agg(e, '|' ORDER BY e) AS s FROM m GROUP BY ALL), a AS (SELECT *, min(c) OVER (PARTITION BY o, s) AS alias FROM k)
SELECT o, c, alias, row_number() OVER (PARTITION BY o ORDER BY alias <> c, c_acctbal DESC, c) = 1 AS selected FROM a JOIN customer ON c_custkey = c""")
def candidate_choice(spark, sf_dir):
    m = t(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("o"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("e"))
    s = t(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("o"), F.col("c_custkey").alias("c"), "c_acctbal")
    return scenes.bank(m, s, "o", "c", "e", "c_acctbal")


@query("""
WITH p AS (SELECT l_suppkey, l_partkey, sum(round(l_tax * 100)::BIGINT) / nullif(sum(round(l_quantity)::BIGINT), 0)::DOUBLE AS r FROM lineitem GROUP BY ALL)
SELECT l_partkey, l_suppkey, round(r, 6) AS ratio FROM p WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY r DESC, l_suppkey) = 1""")
def exported_owners(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").withColumns({"i": F.round(F.col("l_tax") * 100), "v": F.round("l_quantity")})
    return scenes.exported(li, "l_suppkey", "l_partkey", "i", "v").withColumn("ratio", r6("ratio"))


@query("""
WITH r AS (SELECT o_custkey AS k, o_orderpriority AS c, max(o_totalprice) AS v FROM orders GROUP BY ALL), b AS (SELECT k, v AS b FROM r WHERE c = '1-URGENT')
SELECT c, count(*) AS items, round(avg(v), 3) AS mean, count(*) FILTER (v > b) AS better, count(*) FILTER (v < b) AS worse, round(avg(v - b), 3) AS change FROM r JOIN b USING (k) GROUP BY c""")
def paired_conditions(spark, sf_dir):
    r = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("c")).agg(F.max("o_totalprice").alias("v"))
    return scenes.paired_conditions(r, "k", "c", "v", "1-URGENT").withColumns({"mean": F.round("mean", 3), "change": F.round("change", 3)})
