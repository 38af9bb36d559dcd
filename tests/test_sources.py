import json
import struct

import duckdb
import numpy as np
import pytest

from tessera.sources import formats, tables


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    formats.register(spark)


def test_rows_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 0.5)], "b int, a string, c double")
    for s in ("parquet", "jsonl", "csv"):
        tables.write_rows(df, f"{tmp_path}/t.{s}")
        back = tables.read_rows(spark, f"{tmp_path}/t.{s}")
        assert sorted(back.columns) == ["a", "b", "c"] and back.count() == 2
    assert {k for _, k in tables.read_rows(spark, f"{tmp_path}/t.csv").dtypes} == {"string"}
    with pytest.raises(ValueError):
        tables.read_rows(spark, "x.xml")
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n[1]\n')
    with pytest.raises(Exception):  # noqa: B017
        tables.read_rows(spark, f"{tmp_path}/bad.jsonl", "a int").collect()


def test_documents_and_store(spark, tmp_path):
    tables.write_json(f"{tmp_path}/x.json", {"b": 1, "a": "é"})
    assert (tmp_path / "x.json").read_text() == '{"a":"é","b":1}'
    with pytest.raises(ValueError):
        tables.canonical_json(float("nan"))
    assert tables.write_once(f"{tmp_path}/o.json", [1]) and not tables.write_once(f"{tmp_path}/o.json", [1])
    with pytest.raises(ValueError):
        tables.write_once(f"{tmp_path}/o.json", [2])
    m = tables.file_manifest(spark, str(tmp_path), "*.json").orderBy("path").collect()
    assert [r.path for r in m] == ["o.json", "x.json"] and m[0].size == 3
    assert [r.path for r in tables.missing_files(tables.file_manifest(spark, str(tmp_path)), ["x.json", "y"]).collect()] == ["y"]
    store = tables.EvidenceStore(spark, f"{tmp_path}/store")
    assert store.get({"a": 1}) is None
    row = lambda i, r: (store.key(i), tables.canonical_json(i).decode(), r)
    put = lambda *rows: store.put(spark.createDataFrame(list(rows), "key string, identity string, result string"))
    put(row({"a": 1}, "one"), row({"a": 2}, "two"))
    put(row({"a": 1}, "other"), row({"a": 3}, "three"))
    assert [store.get({"a": k}) for k in (1, 2, 3, 4)] == ["one", "two", "three", None]
    (tmp_path / "ids.txt").write_text("s1\n\n s2 \n")
    assert [r.scene_id for r in tables.scene_ids(spark, f"{tmp_path}/ids.txt").collect()] == ["s1", "s2"]
    (tmp_path / "meta.txt").write_text("x = 1\naxisAlignment = " + " ".join(map(str, range(16))) + "\n")
    assert tables.axis_alignment(spark, f"{tmp_path}/meta.txt").first().matrix == [float(k) for k in range(16)]


def test_ply(spark, tmp_path):
    df = spark.range(1000).selectExpr("id * 0.5 AS x", "id * 1.0 AS y", "-id * 1.0 AS z", "cast(id % 256 as smallint) AS red")
    df.repartition(3).write.format("ply").mode("append").save(f"{tmp_path}/cloud")
    back = spark.read.format("ply").load(f"{tmp_path}/cloud")
    assert back.count() == 1000 and back.selectExpr("sum(x) AS s", "max(red) AS r").first() == (sum(range(1000)) / 2, 255)
    assert spark.read.format("ply").option("columns", "x").load(f"{tmp_path}/cloud").columns == ["file", "row", "x"]
    head = "ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "m.ply").write_text(head + "0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    assert spark.read.format("ply").load(f"{tmp_path}/m.ply").count() == 3
    assert spark.read.format("ply_faces").load(f"{tmp_path}/m.ply").first().vertices == [0, 1, 2]


def test_npz_and_colmap(spark, tmp_path):
    np.savez(tmp_path / "scene1.npz", coords=np.eye(3), semantic=np.arange(3), instance=np.array([1, 1, -1]))
    rows = spark.read.format("npz_scene").load(f"{tmp_path}/scene1.npz").orderBy("point_id").collect()
    assert [(r.scene_id, r.x, r.semantic, r.instance) for r in rows] == [("scene1", 1.0, 0, 1), ("scene1", 0.0, 1, 1), ("scene1", 0.0, 2, -1)]
    load = lambda t, p: spark.read.format("colmap").option("table", t).load(f"{tmp_path}/{p}").collect()
    (tmp_path / "cameras.txt").write_text("# c\n1 PINHOLE 640 480 500 501 320 240\n")
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<QiiQQ4d", 1, 1, 1, 640, 480, 500, 501, 320, 240))
    assert load("cameras", "cameras.txt") == load("cameras", "cameras.bin")
    (tmp_path / "images.txt").write_text("# i\n7 1 0 0 0 1 2 3 1 a.jpg\n1 2 3 4 5 6\n8 1 0 0 0 0 0 0 1 b.jpg\n\n")
    two = struct.pack("<Q", 2) + struct.pack("<i7di", 7, 1, 0, 0, 0, 1, 2, 3, 1) + b"a.jpg\0" + struct.pack("<Qddqddq", 2, 1, 2, 3, 4, 5, 6)
    (tmp_path / "images.bin").write_bytes(two + struct.pack("<i7di", 8, 1, 0, 0, 0, 0, 0, 0, 1) + b"b.jpg\0" + struct.pack("<Q", 0))
    assert load("images", "images.txt") == load("images", "images.bin") and len(load("images", "images.bin")) == 2
    (tmp_path / "points3D.txt").write_text("5 1 2 3 10 20 30 0.5 1 2 3 4\n")
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<QQdddBBBdQ", 1, 5, 1, 2, 3, 10, 20, 30, 0.5, 2) + bytes(16))
    assert load("points3D", "points3D.txt") == load("points3D", "points3D.bin")
    (tmp_path / "d.array").write_bytes(b"2&1&1&" + np.array([1, 2], "<f4").tobytes())
    assert [(r.row, r.col, r.value) for r in load("array", "d.array")] == [(0, 0, 1.0), (0, 1, 2.0)]


def test_recording(spark, tmp_path):
    head = struct.pack("<IQ", 4, 1) + b"n" + bytes(256) + struct.pack("<2i4IfQ", 2, 1, 4, 3, 2, 1, 1000.0, 3)
    frames = b"".join(np.eye(4, dtype="<f4").tobytes() + struct.pack("<4Q", k, k, 2, 3) + bytes([k, k]) + b"ddd" for k in range(3))
    (tmp_path / "a.sens").write_bytes(head + frames)
    rows = spark.read.format("sens").option("stride", 2).load(f"{tmp_path}/a.sens").collect()
    assert [(r.frame, bytes(r.colour), r.pose[0]) for r in rows] == [(0, b"\0\0", 1.0), (2, b"\2\2", 1.0)]
    (tmp_path / "b.sens").write_bytes(struct.pack("<IQ", 3, 0))
    with pytest.raises(Exception):  # noqa: B017
        spark.read.format("sens").load(f"{tmp_path}/b.sens").collect()


def test_taxonomy_json(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"mappings": {"a": {"Dining_Table": "table"}}}))
    m = spark.read.option("multiLine", True).schema("mappings map<string,map<string,string>>").json(f"{tmp_path}/t.json")
    assert m.selectExpr("explode(mappings) AS (d, x)").selectExpr("d", "explode(x) AS (raw, c)").first() == ("a", "Dining_Table", "table")


def test_mesh_equals_its_sql(spark, tmp_path):
    from tessera.plans import files, queries

    balance = {k: round(-990 + 37.5 * k, 2) for k in range(280)} | {5: None}  # every other one ends halfway between two hundredths of x
    rows = [(k if k < 200 else k + 1000, b) for k, b in balance.items()] + [(3, 1.5), (None, 2.0)]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    order = lambda rows: sorted(rows, key=repr)
    want = order(con.execute(queries.ORACLES["files_mesh"]).fetchall())
    assert len(want) == 279 and order(tuple(r) for r in files.files_mesh(spark, str(tmp_path)).select("face", "area").collect()) == want
