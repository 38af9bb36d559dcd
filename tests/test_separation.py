"""Nested suppression, hybrid clusters, face samples, dominated links and separate families against brute force."""

import itertools

import numpy as np
import pytest

from tessera.operators import cluster, ownership, separation


def nested_by_hand(masks, scores, iou=0.7, least=0.1, inner=0.2):
    """One image's kept sets from its score order, one pair at a time."""
    order = sorted(scores, key=lambda s: (-scores[s], s))
    fine, lower, higher = ({s: True for s in order} for _ in range(3))
    for (i, p), (j, q) in itertools.combinations(enumerate(order), 2):
        k = len(masks[p] & masks[q])
        cp, cq = k / len(masks[p]), k / len(masks[q])
        if k / len(masks[p] | masks[q]) > iou:
            fine[q] = False
        if cp < 0.5 and cq >= 0.85 and cp * cq < inner:
            lower[q] = False
            if j == i + 1:
                higher[q] = False
        if cp >= 0.85 and cq < 0.5 and cp * cq < inner:
            higher[p] = False
    sure = {s: scores[s] > least for s in order}
    for test in (lower, higher, sure):
        if not any(test.values()):
            test.update(dict.fromkeys(order[:3], True))
    return {s for s in order if fine[s] and lower[s] and higher[s] and sure[s]}


def test_inner_nms(spark):
    rng = np.random.default_rng(5)
    masks, scores, image, want = {}, {}, {}, set()
    for g in range(6):
        own = {}
        for k in range(8):
            lo, size = int(rng.integers(0, 60)), int(rng.choice([3, 10, 40]))
            own[100 * g + k] = set(range(lo, lo + size))
        rank = {s: float(rng.choice([0.05, 0.3, 0.6, 0.9])) if g else 0.05 for s in own}
        want |= nested_by_hand(own, rank)
        masks |= own
        scores |= rank
        image |= dict.fromkeys(own, g)
    members = spark.createDataFrame([(s, e) for s, m in masks.items() for e in m], "s long, e long")
    own = spark.createDataFrame([(image[s], s, scores[s]) for s in masks], "g long, s long, score double")
    got = ownership.inner_nms(members, own, "g", "s", "e", "score").collect()
    assert len(got) == len(masks)
    assert {r.s for r in got if r.kept} == want and want != set(masks)
    assert ownership.inner_nms(members, own.limit(0), "g", "s", "e", "score").count() == 0
    bare = spark.createDataFrame([(1, 7, 0.9), (1, 8, None)], "g long, s long, score double")
    assert {(r.s, r.kept) for r in ownership.inner_nms(members.limit(0), bare, "g", "s", "e", "score").collect()} == {(7, True), (8, False)}


def test_hybrid_clusters_tell_places_apart(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(90):
        spot = (k % 3) * 20.0
        f = [1.0, 0.0] if k % 3 < 2 else [0.0, 1.0]
        rows.append((1, k, [x + float(rng.normal(0, 0.01)) for x in f], spot + float(rng.normal(0, 0.1)), 0.0))
    rows += [(1, 900, None, 0.0, 0.0), (1, 901, [1.0, 0.0], None, 0.0)]
    p = spark.createDataFrame(rows, "g int, id long, v array<double>, x double, y double")
    got = {r.id: r.cluster for r in cluster.clusters_by(p, "g", "id", "v", 5, axes=["x", "y"]).collect()}
    assert len(got) == 92 and got[900] == got[901] == -1
    parts = [{got[k] for k in range(j, 90, 3)} for j in range(3)]
    assert all(len(s) == 1 for s in parts) and len(set.union(*parts)) == 3
    plain = {r.id: r.cluster for r in cluster.clusters_by(p, "g", "id", "v", 5).collect()}
    assert {plain[k] for k in range(0, 90, 3)} & {plain[k] for k in range(1, 90, 3)}


def test_hybrid_assignment(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0], 0.0, 0), (2, [1.0, 0.0], 9.0, 1), (3, [0.0, 2.0], 9.0, -1), (4, [3.0, 0.1], 8.5, -1)], "id long, v array<double>, x double, label int")
    done = cluster.assigned(p, "id", "v", cluster.centres(p, "label", "v"), "label", axes=["x"], place=cluster.places(p, "label", ["x"])).collect()
    for r in done:
        v, x = {1: ([1, 0], 0), 2: ([1, 0], 9), 3: ([0, 1], 9), 4: (np.array([3, 0.1]) / np.hypot(3, 0.1), 8.5)}[r.id]
        s = np.array([10 * (0.5 * v[0] + 0.5 * np.exp(-abs(x - c))) for c in (0, 9)])
        e = np.exp(s) / np.exp(s).sum()
        assert r.label == int(e.argmax()) and r.share == pytest.approx(e.max())


def test_face_samples(spark):
    rng = np.random.default_rng(3)
    corners = rng.random((20, 3, 3))
    area = [0.0 if k % 7 == 0 else float(k) for k in range(20)]
    names = [[f"{c}{d}" for d in "xyz"] for c in "pqr"]
    rows = [(1, k, *map(float, corners[k].ravel()), area[k]) for k in range(20)] + [(2, 0, *[0.0] * 9, 0.0), (3, 0, *[0.0] * 9, None)]
    faces = spark.createDataFrame(rows, "m int, f int, " + ", ".join(f"{c} double" for n in names for c in n) + ", area double").repartition(5)
    got = sorted(cluster.face_samples(faces, "m", "f", names, "area", 50, 11).collect(), key=lambda r: (r.m, r.draw))
    assert [r.m for r in got] == [1] * 50
    use = [k for k in range(20) if area[k] > 0]
    g = np.random.default_rng(11)
    at = np.searchsorted(np.cumsum([area[k] for k in use]) / sum(area), g.random(50), side="right")
    u, v = g.random(50), g.random(50)
    for r, k, a, b in zip(got, at, u, v):
        p, q, s = corners[use[k]]
        assert np.allclose([r.x, r.y, r.z], p + np.sqrt(a) * ((1 - b) * (q - p) + b * (s - p)))


def claims(spark, rows):
    return spark.createDataFrame(rows, "object int, view int, node int, element int")


def test_dominated_links(spark):
    """a1 and a2 in view 1, b1 and b2 in view 2: the crossed links have better alternatives at both ends."""
    positives = claims(spark, [(0, 1, 1, 10), (0, 1, 1, 11), (0, 1, 2, 20), (0, 1, 2, 12), (0, 2, 1, 10), (0, 2, 1, 12), (0, 2, 2, 20), (0, 2, 2, 11)])
    anchors = claims(spark, [(0, 1, 1, 10), (0, 1, 2, 20), (0, 2, 1, 10), (0, 2, 2, 20)])
    links = separation.possible_links(positives, spark.createDataFrame([(0, 1, 2)], "object int, va int, vb int"))
    assert {(r.a, r.b) for r in links.collect()} == {(1, 1), (2, 2), (1, 2), (2, 1)}
    s = spark.createDataFrame([(0, 1, a, 2, b, 0.9 if a == b else 0.1) for a in (1, 2) for b in (1, 2)], "object int, va int, a int, vb int, b int, affinity double")
    got = separation.dominated_links(links, s, anchors, positives).collect()
    assert {(r.a, r.b, *r.alternatives_a, *r.alternatives_b) for r in got} == {(1, 2, 2, 1), (2, 1, 1, 2)}
    assert separation.dominated_links(links, s, anchors.limit(0), positives).count() == 0
    unknown = s.selectExpr("object", "va", "a", "vb", "b", "CASE WHEN a = b THEN affinity END AS affinity")
    assert separation.dominated_links(links, unknown, anchors, positives).count() == 0
    touching = positives.union(claims(spark, [(0, 2, 1, 20)]))  # b1 claims b2's interior: not distinct
    assert separation.dominated_links(links, s, anchors, touching).count() == 0


def test_separate_families(spark):
    members = spark.createDataFrame([(0, f, v, 10 * f + v) for f in (1, 2) for v in (1, 2)], "object int, family int, view int, node int")
    positives = claims(spark, [(0, v, 10 * f + v, f) for f in (1, 2) for v in (1, 2)])
    negatives = claims(spark, [(0, v, 10 * f + v, 3 - f) for f in (1, 2) for v in (1, 2)])
    w = separation.witness_views(members, positives, positives, negatives)
    assert {(r.fa, r.fb, r.view) for r in w.collect()} == {(1, 2, 1), (1, 2, 2)}
    pairs = spark.createDataFrame([(0, 1, 1, 2), (0, 2, 2, 3)], "object int, family int, va int, vb int")
    core = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "object int, family int, element int")
    chosen = spark.createDataFrame([(0, 1), (0, 2)], "object int, element int")
    assert [tuple(r) for r in separation.separate_families(w, pairs, core, chosen).collect()] == [(0, 1, 2, 1, 2)]
    assert separation.separate_families(w, pairs, core, chosen.where("element = 1")).count() == 0
    shared = core.union(spark.createDataFrame([(0, 1, 2)], "object int, family int, element int"))
    assert separation.separate_families(w, pairs, shared, chosen).count() == 0
    assert separation.separate_families(w.where("view = 1"), pairs, core, chosen).count() == 0
