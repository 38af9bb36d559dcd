import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import geometry as g


def test_yaw_boxes(spark):
    t = math.pi / 5
    pts = [(a * math.cos(t) - b * math.sin(t), h, a * math.sin(t) + b * math.cos(t)) for a in np.linspace(0, 6, 9) for b in np.linspace(0, 2, 5) for h in (0, 3)]
    rows = [("o", *map(float, p), False) for p in pts] + [("o", 99.0, 99.0, 99.0, True), ("few", 0.0, 1.0, 2.0, False), ("few", 3.0, 4.0, 5.0, False), ("none", 1.0, 1.0, 1.0, True)]
    got = {r.o: np.array(r.box).reshape(8, 3) for r in g.yaw_boxes(spark.createDataFrame(rows, "o string, x double, y double, z double, big boolean"), "o", skip="big").collect()}
    base = got["o"][:4, [0, 2]]
    sides = sorted(np.linalg.norm(np.roll(base, -1, 0) - base, axis=1))
    assert sides == pytest.approx([2, 2, 6, 6]) and set(got["o"][:, 1]) == {0.0, 3.0}
    assert not got["none"].any() and got["few"].min(0).tolist() == [0, 1, 2] and got["few"].max(0).tolist() == [3, 4, 5]


def test_panels(spark):
    views = spark.createDataFrame([("o", f"c{k}", k, k in (0, 1)) for k in range(6)], "o string, u string, k long, src boolean")
    every = spark.createDataFrame([("o", f"c{a}", f"c{b}") for a, b in itertools.combinations(range(6), 2)], "o string, a string, b string")
    got = g.view_panels(views, every, "o", "u", "k", "src").collect()
    assert [(r.role, r.u) for r in got] == list(zip(g.PANELS[6], [f"c{k}" for k in range(6)]))
    two = every.where("a = 'c0' AND b = 'c3'")
    assert [(r.role, r.u) for r in g.view_panels(views, two, "o", "u", "k", "src").collect()] == [("I1", "c0"), ("I2", "c3")]


def test_joint_choices(spark):
    r = np.random.default_rng(4)
    rows = [("s", i, o, float(r.integers(0, 9)), sorted(set(map(int, r.integers(0, 7, 2))))) for i in range(4) for o in range(4)]
    df = spark.createDataFrame(rows, "s string, i long, o long, c double, m array<long>")
    got = {x.i: x.o for x in g.joint_choices(df, "s", "i", "o", "c", "m").collect()}
    by = {(i, o): (c, set(m)) for _, i, o, c, m in rows}
    ok = [p for p in itertools.product(range(4), repeat=4) if all(not by[a, p[a]][1] & by[b, p[b]][1] for a, b in itertools.combinations(range(4), 2))]
    if ok:
        best = min(ok, key=lambda p: (sum(by[i, o][0] for i, o in enumerate(p)), p))
        assert got == dict(enumerate(best))
    else:
        assert got == {}


def test_images(spark):
    v = np.array(list(g.label_vectors([f"n{k}" for k in range(5)], 6).values()))
    dots = v @ v.T
    assert np.allclose(np.diag(dots), 1) and np.allclose(dots[~np.eye(5, dtype=bool)], -0.25)
    with pytest.raises(ValueError):
        g.label_vectors(["a", "b", "c"], 1)
    px = spark.createDataFrame([("m", y, x, 1 <= y <= 3 and 1 <= x <= 3) for y in range(5) for x in range(5)], "m string, y long, x long, b boolean")
    assert g.eroded(px, ["m"], "y", "x", "b").where("b").count() == 5
    assert [(r.y, r.x) for r in g.clearance(px, "m", "y", "x", "b", 2).orderBy("rank").collect()][0] == (2, 2)
    rows = ["aab", "bab", "bbb"]
    img = spark.createDataFrame([(y, x, c) for y, line in enumerate(rows) for x, c in enumerate(line)], "y long, x long, v string")
    got = g.pixel_regions(img, "y", "x", "v").groupBy("v").agg(F.countDistinct("region").alias("n")).collect()
    assert {r.v: r.n for r in got} == {"a": 1, "b": 1}
    a = np.random.default_rng(0).uniform(size=(16, 16))
    assert g.ssim(a, a) == pytest.approx(1.0) and g.ssim(a, 1 - a) < 0.5
    df = spark.createDataFrame([(1, a.ravel().tolist(), a.ravel().tolist(), 16)], "i long, a array<double>, b array<double>, w int")
    assert g.image_similarity(df, "i", "a", "b", "w").first().l1 == 0.0
