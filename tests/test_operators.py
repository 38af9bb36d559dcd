"""Operators that no SQL covers, against hand-made cases and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.functions import vector as V
from tessera.operators import cluster, curve, evidence, graph, matching, ordered, overlap, ownership, quantile, sequence, spatial, voting
from tessera.plans import more  # noqa: F401  registers its queries
from tessera.plans import queries as plans


def test_assignment_is_optimal():
    r = np.random.default_rng(0)
    for _ in range(200):
        n, m = map(int, r.integers(1, 6, 2))
        g = r.integers(0, 9, (n, m)).astype(float)
        k = min(n, m)
        best = max(sum(g[i, j] for i, j in zip(p, q)) for p in itertools.permutations(range(n), k) for q in itertools.combinations(range(m), k))
        got = matching.assign(g)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == k and sum(g[i, j] for i, j in got) == best


def test_matching_prefers_more_pairs(spark):
    pairs = spark.createDataFrame([("s", 1, 10, 0.9), ("s", 1, 11, 0.5), ("s", 2, 10, 0.6), ("s", 3, 12, 0.2)], "scene string, p long, g long, iou double")
    got = matching.one_to_one(pairs, ["scene"], "p", "g", "iou", 0.25)
    assert sorted((r.p, r.g) for r in got.collect()) == [(1, 11), (2, 10)]
    gt = spark.createDataFrame([("s", k) for k in (10, 11, 12)], "scene string, g long")
    pred = spark.createDataFrame([("s", k) for k in (1, 2, 3)] + [("z", 9)], "scene string, p long")
    out = {r.scene: r for r in matching.readout(gt, pred, got, ["scene"], "g", "p").collect()}
    assert (out["s"].tp, out["s"].fp, out["s"].fn) == (2, 1, 1) and out["z"].recall is None and out["z"].precision == 0.0
    pool = matching.pooled(matching.readout(gt, pred, got, ["scene"], "g", "p")).first()
    assert pool.tp == 2 and pool.fp == 2 and pool.n_recall == 1


def boxes_ap(spark, found):
    """AP of predictions (id, score, first cell, cells) on a strip of 30 cells with objects of 12, 9 and 3 cells."""
    objects = [(5, "table", 0, 12), (6, "table", 14, 9), (7, "lamp", 25, 3)]
    gt = [("strip", k, next((c for _, c, a, n in objects if a <= k < a + n), None), next((i for i, _, a, n in objects if a <= k < a + n), -1)) for k in range(30)]
    pred = [("strip", i, "table", s, k) for i, s, a, n in found for k in range(a, a + n)]
    gt = spark.createDataFrame(gt, "scene string, point long, class string, instance long")
    pred = spark.createDataFrame(pred, "scene string, prediction long, class string, score double, point long")
    return {(r["class"], round(r.overlap, 2)): r.ap for r in curve.average_precision(gt, pred, ["table", "lamp", "door"], least=1).collect()}


def test_average_precision(spark):
    exact = boxes_ap(spark, [(1, 0.4, 0, 12), (2, 0.6, 14, 9)])
    assert all(exact["table", round(t, 2)] == 1.0 for t in curve.OVERLAPS) and exact["door", 0.5] is None and exact["lamp", 0.5] == 0.0
    half = boxes_ap(spark, [(1, 0.7, 0, 8), (2, 0.9, 14, 9)])  # the first covers two thirds of its object
    assert half["table", 0.5] == half["table", 0.65] == 1.0 and 0.4 < half["table", 0.7] < 1.0


def test_step_ap_is_the_convolution(spark):
    r = np.random.default_rng(3)
    y, s = r.integers(0, 2, 40), r.integers(0, 12, 40)
    df = spark.createDataFrame([("g", int(a), int(b)) for a, b in zip(y, s)], "g string, y int, s int")
    c = curve.pr_curve(df, ["g"], "y", "s")
    pts = c.orderBy(F.desc("s")).collect()
    want = curve.numpy_step_ap(np.array([p.recall for p in pts]), np.array([p.precision for p in pts]))
    assert curve.step_ap(c, ["g"], "s").first().ap == pytest.approx(want)


def test_weighted_quantile_rule(spark):
    r = np.random.default_rng(1)
    v, w = r.normal(size=30), r.uniform(0.1, 2, 30)
    o = np.argsort(v)
    pos = (np.cumsum(w[o]) - w[o] / 2) / w.sum()
    want = np.interp(quantile.LEVELS, pos, v[o])
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(v, w)] + [("g", None, 1.0)], "g string, v double, w double")
    assert list(quantile.weighted_quantiles(df, ["g"], "v", "w").first())[1:] == pytest.approx(want.tolist())


def test_hdbscan_finds_blobs(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 0.1, (40, 2)), r.normal(3, 0.1, (30, 2)), r.uniform(20, 90, (4, 2))])
    labels = cluster.hdbscan(x, 5)
    assert set(labels[:40]) == {0} and set(labels[40:70]) == {1} and set(labels[70:]) == {-1}
    assert cluster.hdbscan(x[:3], 5).tolist() == [-1] * 3
    assert sorted(cluster.spanning_tree(np.array([[0.0], [1.0], [3.0]]), 1, cluster.euclidean)[:, 2]) == [1.0, 2.0]


def test_components_and_voxels(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40) if k % 10 != 9] + [(5, 5), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {k: k // 10 * 10 for k in range(40)} | {40: 40} or got == {k: k // 10 * 10 for k in range(40)}
    assert graph.connected_components(edges.limit(0)).count() == 0
    pts = spark.createDataFrame([(k, float(x), 0.0) for k, x in enumerate((0, 1, 2, 5, 6, 9))], "id long, x double, y double")
    assert spatial.voxel_components(pts, ["x", "y"], 1.0) == 3


def test_neighbours(spark):
    r = np.random.default_rng(2)
    xy = r.uniform(0, 10, (60, 2))
    df = spark.createDataFrame([(k, float(a), float(b), [float(a), float(b)]) for k, (a, b) in enumerate(xy)], "id long, x double, y double, vec array<double>")
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    near = {r.id: r.spread for r in spatial.mean_square_to_nearest(df, "id", ["x", "y"], 0.5).collect()}
    assert near == pytest.approx({k: float((np.sort(d[k])[1:4] ** 2).mean()) for k in range(60)})
    smooth = {r.id: r.smoothed for r in spatial.knn_mean(df, "id", ["x", "y"], "vec", 5, 1.0).collect()}
    assert smooth[7] == pytest.approx(xy[np.argsort(d[7])[:5]].mean(0).tolist())
    few = spatial.knn(df, df.limit(3), "id", "id", ["x", "y"], 5, 1.0)
    assert few.groupBy("id").count().agg({"count": "min"}).first()[0] == 3
    assert spatial.mapped_share(spatial.nearest(df, df.limit(1), "id", "id", ["x", "y"], 0.1), "id_2").first().mapped == pytest.approx(1 / 60)
    assert spark.range(1).select(spatial.morton([F.lit(3), F.lit(5)])).first()[0] == 0b100111


def test_extents(spark):
    t = math.pi / 6
    pts = [(a * math.cos(t) - b * math.sin(t), a * math.sin(t) + b * math.cos(t), c) for a in (0, 10) for b in (0, 4) for c in (0, 1)]
    df = spark.createDataFrame([("o", *map(float, p)) for p in pts] + [("few", 0.0, 0.0, 0.0), ("few", 1.0, 2.0, 0.0)], "o string, x double, y double, z double")
    got = {r.o: r for r in spatial.oriented_extents(df, "o", ("x", "y", "z")).collect()}
    assert got["o"].extents == pytest.approx([1, 4, 10]) and got["few"].extents == pytest.approx([0, 1, 2])


def test_supported_members_against_sets(spark):
    r = np.random.default_rng(11)
    for _ in range(3):
        seen = {f"v{k}": set(r.integers(0, 25, 12).tolist()) for k in range(5)}
        pairs = [("v0", "v3"), ("v4", "v1"), ("v2", "v2")]
        bad = set(r.integers(0, 25, 4).tolist())
        obs = spark.createDataFrame([(v, g) for v, ids in seen.items() for g in ids], "c string, g long")
        links = spark.createDataFrame(pairs, "a string, b string")
        no = spark.createDataFrame([(g,) for g in bad], "g long")
        want = set().union(*(seen[a] & seen[b] for a, b in pairs)) - bad
        for least in (0, len(want), len(want) + 1):
            got = sorted(x.g for x in overlap.supported_members(obs, no, links, "c", "g", "a", "b", least).collect())
            assert got == (sorted(want) if least <= len(want) else [])


def test_support_within_groups_makes_no_pairs(spark, tmp_path):
    r = np.random.default_rng(21)
    keys, nation = range(60), {k: None if k < 3 else k % 4 for k in range(60)}
    rows = [(int(s), None if p == 7 else int(p), "R" if f else "A", float(q)) for s, p, f, q in zip(r.integers(0, 62, 200), r.integers(0, 120, 200), r.integers(0, 2, 200), r.integers(40, 50, 200))]
    spark.createDataFrame([(k, nation[k]) for k in keys], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    has = {}
    for s, p, _, _ in rows:
        if p is not None and nation.get(s) is not None:
            has.setdefault((nation[s], p), set()).add(s)
    want = {p for (_, p), s in has.items() if len(s) > 1} - {p for _, p, f, q in rows if f == "R" and q > 45}
    got = plans.QUERIES["g0_support"](spark, str(tmp_path))
    assert want and sorted(x.l_partkey for x in got.collect()) == sorted(want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1  # lines to their groups; no supplier to another


def test_mass_members_against_sums(spark):
    r = np.random.default_rng(12)
    rows = [(int(v), int(g), float(i), float(s)) for v, g, i, s in zip(r.integers(0, 4, 80), r.integers(0, 20, 80), r.uniform(0, 0.6, 80), r.uniform(0, 0.8, 80))]
    sums = {}
    for _, g, i, s in rows:
        a, b = sums.get(g, (0.0, 0.0))
        sums[g] = a + i, b + s
    want = {g: i / s for g, (i, s) in sums.items() if i >= 0.5 and s > 0 and i / s >= 0.5}
    mass = spark.createDataFrame(rows, "v int, g long, i double, s double")
    assert len(want) > 3 and {x.g: x.ratio for x in overlap.mass_members(mass, [], "g", "i", "s").collect()} == pytest.approx(want)
    assert overlap.mass_members(mass, [], "g", "i", "s", least=len(want) + 1).count() == 0


def test_declared_labels_are_renumbered(spark):
    r = np.random.default_rng(13)
    raw, declared = r.integers(-2, 12, 60).tolist(), [11, 3, 6, -2, 40]
    order = sorted(x for x in declared if x >= 0 and x in raw)
    want = [order.index(x) if x in order else -1 for x in raw]
    labels = spark.createDataFrame(list(enumerate(raw)), "p long, i long")
    got = voting.normalized(labels, spark.createDataFrame([(x,) for x in declared], "i long"), "i").orderBy("p").collect()
    assert [x.new for x in got] == want
    with pytest.raises(Exception):  # noqa: B017
        ownership.committed(labels, labels.unionAll(labels), "p", "i").collect()


def test_box_suppression(spark):
    boxes = [("q", 4, 0.31, 0.0, 0.0, 6.0, 6.0), ("q", 5, 0.85, 0.25, 0.0, 6.25, 6.0), ("q", 6, 0.55, 40.0, 8.0, 44.0, 20.0), ("r", 7, 0.2, 1.0, 0.0, 7.0, 6.0)]
    df = spark.createDataFrame(boxes, "g string, id long, s double, x0 double, y0 double, x1 double, y1 double")
    assert {x.id: x.kept for x in ownership.box_nms(df, "g", "id", "s").collect()} == {4: False, 5: True, 6: True, 7: True}


def test_masks_and_chains(spark):
    px = spark.createDataFrame([("m", k, b) for k, b in enumerate([True, True, False, True])] + [("n", 0, False)], "m string, index long, bit boolean")
    runs = {r.m: r.runs for r in sequence.encode_mask(px, ["m"], "index", "bit").collect()}
    assert runs == {"m": [0, 2, 1, 1], "n": [1]}
    back = sequence.decode_mask(sequence.encode_mask(px, ["m"], "index", "bit"), ["m"])
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in px.collect())
    log = spark.createDataFrame([(0, None, "a", 1.0), (1, "a", "b", 2.0), (3, "b", "c", 3.0), (4, "x", "d", 3.0), (5, "d", "e", 1.0)], "sequence long, previous_sha256 string, sha256 string, at double")
    assert sorted((r.sequence, r.fault) for r in sequence.chain_faults(log).collect()) == [(3, "gap"), (4, "link"), (5, "time")]
    events = spark.createDataFrame([("t", "l1", "start", 1.0, 2.0), ("t", "l1", "finish", 4.0, None), ("t", "l2", "start", 5.0, 1.0)], "task string, lease string, event string, at double, gpus double")
    r = sequence.lease_seconds(events).first()
    assert (r.attempts, r.open, r.seconds) == (2, 1, 6.0)


def test_families(spark):
    nodes = spark.createDataFrame([("o", n, v) for n, v in (("a", 1), ("b", 2), ("c", 2), ("d", 3))], "o string, n string, v long")
    links = spark.createDataFrame([("o", "a", "b", 0.9), ("o", "b", "d", 0.5), ("o", "a", "d", 0.6), ("o", "a", "c", 0.2)], "o string, a string, b string, iou double")
    cliques = evidence.consensus_cliques(nodes, links, "o", "n").groupBy("clique").agg(F.array_sort(F.collect_list("n")).alias("n")).orderBy("clique").collect()
    assert [r.n for r in cliques] == [["a", "b", "d"], ["a", "c"]]
    fam = evidence.greedy_families(nodes, links, "o", "n", "v").groupBy("family").agg(F.array_sort(F.collect_list("n")).alias("n")).orderBy("family").collect()
    assert [r.n for r in fam] == [["a", "b", "d"], ["c"]]
    beam = evidence.beam_families(nodes, links, "o", "n", "v").orderBy("rank").first()
    assert beam.nodes == ["a", "b", "d"] and beam.score == pytest.approx(2.0)
    rows = spark.createDataFrame([("g", 1, 0.5, 0.5), ("g", 2, 0.6, 0.5), ("g", 3, 0.1, 0.9)], "g string, i long, p double, q double")
    assert sorted(r.i for r in evidence.undominated(rows, "g", "i", ["p", "q"]).collect()) == [2, 3]
    deltas = spark.createDataFrame([("x", 0.0), ("x", 0.2), ("y", -0.1), ("y", 0.9), ("z", 0.0)], "g string, d double")
    assert {r.g: r.stable for r in evidence.stable_improvement(deltas, "g", "d").collect()} == {"x": True, "y": False, "z": False}
    counts = spark.createDataFrame([("a", 8, 1, 1, True), ("b", 1, 9, 1, True), ("c", 8, 0, 0, False), ("d", 8, 1, 1, True), ("d", 0, 9, 1, True)], "g string, tp long, fp long, fn long, complete boolean")
    assert {r.g: r.status for r in evidence.projection_status(counts, "g").collect()} == {"a": "pass", "b": "reject", "c": "incomplete", "d": "disputed"}


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(S.normalize_label(F.lit("  Dining_Table\t x "))) == "dining table x"
    assert get(S.slug(F.lit("--A b/C--"))) == "a_b_c"
    assert get(S.finite_positive(F.lit("NaN"))) is None and get(S.finite_positive(F.lit("2.5"))) == 2.5 and get(S.finite_positive(F.lit("-1"))) is None
    assert [get(S.half_even(F.lit(x))) for x in (0.5, 1.5, 2.5)] == [0.0, 2.0, 2.0]
    assert S.selected_frames(10, 2, 3) == [0, 4, 8] and S.selected_frames(3, 1, None) == [0, 1, 2]
    assert get(S.content_id(F.array(F.lit(3), F.lit(1), F.lit(3)))) == get(S.content_id(F.array(F.lit(1), F.lit(3))))
    q = [get(c) for c in V.rotation_of(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))]
    assert q == pytest.approx([0, -1, 0, 1, 0, 0, 0, 0, 1])
    eye = [F.lit(float(i == j)) for i in range(4) for j in range(4)]
    assert get(V.valid_pose(eye)) is True and get(V.valid_pose([F.lit(2.0), *eye[1:]])) is False
    assert get(V.triangle_area(*[[F.lit(float(c)) for c in p] for p in ((0, 0, 0), (2, 0, 0), (0, 2, 0))])) == 2.0
    assert get(S.psnr(F.lit(0.01))) == pytest.approx(20.0)
    with pytest.raises(Exception):  # noqa: B017
        get(S.unit_score(F.lit(1.5)))
    with pytest.raises(Exception):  # noqa: B017
        get(V.strict_cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))))


def test_bounded_samplers(spark):
    df = spark.range(100).withColumn("g", F.lit("a")).withColumn("x", F.col("id").cast("double"))
    assert [r.id for r in cluster.farthest_points(df, "g", "id", ["x"], 3).orderBy("rank").collect()] == [0, 99, 49]
    assert sorted(r.id for r in cluster.spaced_rows(df, ["id"], 4).collect()) == [0, 33, 66, 99]
    u = [r.u for r in cluster.quantile_map(df, "x", 10).orderBy("id").collect()]
    assert u == sorted(u) and u[-1] == 1.0
    pts = spark.createDataFrame([(k, [1.0, 0.0] if k < 3 else [0.0, 1.0], int(k >= 3)) for k in range(6)], "id long, v array<double>, c int")
    got = cluster.assigned(pts, "id", "v", cluster.centres(pts, "c", "v"), "c").collect()
    assert {r.id: r.c for r in got} == {k: int(k >= 3) for k in range(6)}


def test_components_take_parts_of_any_size(spark, tmp_path):
    parts = {1: range(0, 30), 2: range(29, 33), 3: range(50, 90), 4: [100]}  # two have more than 18 orders, one has a single order
    rows = [(p, o) for p, orders in parts.items() for o in orders]
    spark.createDataFrame(rows + rows[:5], "l_partkey long, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    root = {o: o for _, o in rows}
    for _ in root:
        for orders in parts.values():
            least = min(root[o] for o in orders)
            root |= {o: least for o in orders}
    got = [(r.node, r.component) for r in plans.QUERIES["components"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((o, c) for o, c in root.items() if o != 100)


def test_groups_beyond_the_sample_are_assigned_whole(spark):
    r = np.random.default_rng(4)
    at = lambda k: [float(x) for x in np.eye(3)[k % 3] + r.normal(0, 0.02, 3)]
    rows = [("a", k, at(k)) for k in range(900)] + [("b", k, at(0)) for k in range(2)] + [(None, 7, at(0)), ("a", 900, None), ("a", 5, at(5)), ("a", None, at(1))]
    df = spark.createDataFrame(rows, "g string, id long, v array<double>").repartition(5)
    got = cluster.clusters_by(df, "g", "id", "v", 5, most=120).collect()
    assert sorted((str(x.g), str(x.id)) for x in got) == sorted((str(g), str(i)) for g, i, _ in rows)
    of = {(x.g, x.id): x.cluster for x in got}
    assert all(of["a", k] == of["a", k % 3] >= 0 for k in range(900)) and len({of["a", k] for k in range(3)}) == 3
    assert of["b", 0] == of["b", 1] == of[None, 7] == of["a", 900] == -1 and of["a", None] == of["a", 1]
    assert sum(x.core is not None for x in got if x.g == "a") == 120


def test_more_centres_than_a_block(spark):
    r = np.random.default_rng(6)
    pts = spark.createDataFrame([(k, r.normal(size=3).tolist(), k % 7) for k in range(60)] + [(60, None, 0)], "id long, v array<double>, c int")
    c = cluster.centres(pts, "c", "v")
    c = c.unionAll(c.where("c = 3").withColumn("c", F.lit(9)))  # equal centres, perhaps in two blocks
    rows = lambda most: [(x.id, x.c, None if x.share is None else round(x.share, 9)) for x in cluster.assigned(pts, "id", "v", c, "c", most=most).orderBy("id").collect()]
    assert rows(2) == rows(10_000) and len(rows(2)) == 61


def test_queries_take_all_rows(spark, tmp_path):
    items = [(s, p, 10.0) for s in (1, 2) for p in range(4)] + [(3, 9, 30.0)]
    spark.createDataFrame(items, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a", 5.0), (1, "a", -2.0), (1, "b", 3.0), (2, "a", 7.5)], "c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    assert [tuple(r) for r in plans.QUERIES["identity_pairs"](spark, str(tmp_path)).collect()] == [(1, 2, 4)]
    got = {r.g: r.stable for r in plans.QUERIES["stable_improvement"](spark, str(tmp_path)).collect()}
    assert got == {"1/a": False, "1/b": True, "2/a": True}


def test_bootstrap_width_takes_all_draws(spark):
    at = "/root/testdata/sf0.001"
    got = {r.n_name: r.width for r in plans.QUERIES["bootstrap_width"](spark, at).collect()}
    rows = plans._by_nation(spark, at).withColumn("v", F.log("o_totalprice"))
    want = {r.n_name: round(r.width, 6) for r in quantile.bootstrap_width(rows, "n_name", "c_custkey", "v", 2000).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_quantiles_do_not_depend_on_row_order(spark):
    r = np.random.default_rng(5)
    rows = [("g", float(v), float(w)) for v, w in [(1, 1), (2, 1), (2, 9), (3, 1)]] + [("h", float(v), 1.0) for v in r.integers(0, 6, 40)]
    found = set()
    for _ in range(3):
        r.shuffle(rows)
        df = spark.createDataFrame([(a, float(b), float(c)) for a, b, c in rows], "g string, v double, w double").repartition(3)
        found.add(tuple(sorted(tuple(x) for x in quantile.weighted_quantiles(df, ["g"], "v", "w").collect())))
    assert len(found) == 1
    h = np.sort([float(v) for g, v, _ in rows if g == "h"])
    want = np.interp(quantile.LEVELS, (np.arange(40) + 0.5) / 40, h)
    assert next(x for x in found.pop() if x[0] == "h")[1:] == pytest.approx(want.tolist())


def test_numbers_and_running_sums_over_ranges(spark):
    r = np.random.default_rng(9)
    rows = [(None if k % 17 == 0 else int(r.integers(0, 30)), k, float(k % 5)) for k in range(400)]
    df = spark.createDataFrame(rows, "a long, k long, w double").repartition(7)
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    got = ordered.numbered(df, ["a", "k"], "n", {"s": "w"}).orderBy("n").collect()
    assert [x.k for x in got] == [x[1] for x in want] and [x.n for x in got] == list(range(400))
    assert [x.s for x in got] == pytest.approx(np.cumsum([x[2] for x in want]).tolist())
    assert ordered.numbered(df.limit(0), ["a"]).count() == 0
    test = sequence.held_out(df, ["a", "k"], 8).where("test").count()
    assert test == 50


def test_nearest_of_nulls_and_nothing(spark):
    q = spark.createDataFrame([(1, 0.0), (2, None)], "id long, x double")
    ref = spark.createDataFrame([(k, float(k)) for k in range(20)] + [(99, None)], "r long, x double")
    got = sorted((x.id, x.rank or 0, x.r) for x in spatial.knn(q, ref, "id", "r", ["x"], 3, 0.5).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 0, None)]
    assert [(x.id, x.r) for x in spatial.knn(q, ref.limit(0), "id", "r", ["x"], 3, 0.5).orderBy("id").collect()] == [(1, None), (2, None)]
    with pytest.raises(ValueError):
        spatial.knn(q.where("id = 1").withColumn("x", F.lit(1e9)), ref, "id", "r", ["x"], 3, 0.5, rounds=3)


def test_nearest_of_copies_and_clusters(spark):
    """Copies of a place, two densities, ties, ids that come twice: against all pairs. Few rows may be compared."""
    r = np.random.default_rng(31)
    xy = np.concatenate([np.repeat(r.integers(0, 4, (9, 2)), 30, 0), r.uniform(0, 0.01, (150, 2)), r.uniform(-40, 40, (30, 2))]).astype(float)
    ids = r.permutation(len(xy)).tolist()
    ids[5], ids[400] = ids[6], ids[7]
    df = spark.createDataFrame([(i, float(a), float(b), f"l{i % 3}") for i, (a, b) in zip(ids, xy)], "id long, x double, y double, lab string")
    got = {}
    for x in spatial.knn(df, df.withColumnRenamed("lab", "_l"), "id", "id", ["x", "y"], 6, 8.0, ["_l"]).collect():
        got.setdefault(x.id, []).append((x.rank, x.distance, x.id_2, x["_l"]))
    for i in set(ids):
        d = sorted((math.sqrt((a - c) * (a - c) + (b - e) * (b - e)), j) for k, (a, b) in zip(ids, xy) if k == i for j, (c, e) in zip(ids, xy))[:6]
        assert sorted(got[i]) == [(n + 1, x, j, f"l{j % 3}") for n, (x, j) in enumerate(d)]


@pytest.mark.parametrize("name", ["knn_smoothing", "knn_vote", "knn_join", "rates_for_radius"])
def test_nearest_compares_few_rows(spark, tmp_path, name):
    """6,000 parts on 60 places, 4,000 customers and suppliers in a narrow range: no join makes a good part of all pairs."""
    spark.range(6000).selectExpr("id AS p_partkey", "cast(id % 20 as int) AS p_size", "cast(900 + id % 3 as double) AS p_retailprice", "concat('b', id % 7) AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    for t, k, a in (("customer", "c_custkey", "c_acctbal"), ("supplier", "s_suppkey", "s_acctbal")):
        spark.range(4000).selectExpr(f"id AS {k}", f"id * {3 if k == 'c_custkey' else 7} % 4001 / 100D AS {a}").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    rows = plans.QUERIES[name](spark, str(tmp_path)).count()
    assert rows == (20000 if name == "knn_join" else 6000)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    most = 0
    for k in range(before, runs.size()):
        e = runs.apply(k)
        values = store.executionMetrics(e.executionId())
        for m in range(e.metrics().size()):
            x = e.metrics().apply(m)
            if x.name() == "number of output rows" and values.contains(x.accumulatorId()):
                most = max(most, int(values.apply(x.accumulatorId()).replace(",", "")))
    assert most < 400_000, most


def most_rows(spark, run):
    """What run returns, and the most rows that any step of its queries gave."""
    wait = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    wait()
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    before, out = store.executionsList().size(), run()
    wait()
    runs = store.executionsList()
    for e in (runs.apply(k) for k in range(before, runs.size())):
        values = store.executionMetrics(e.executionId())
        for x in (e.metrics().apply(m) for m in range(e.metrics().size())):
            if x.name() == "number of output rows" and values.contains(x.accumulatorId()):
                most = max(most, int(values.apply(x.accumulatorId()).replace(",", "")))
    return out, most


def test_votes_of_a_narrow_range(spark):
    """2,000 points within a ten-thousandth: cells follow the points, whatever size the search is told."""
    r = np.random.default_rng(35)
    xy = r.uniform(0, 1e-4, (2000, 2))
    lab = r.integers(0, 3, len(xy))
    df = spark.createDataFrame([(k, float(a), float(b), f"l{c}") for k, ((a, b), c) in enumerate(zip(xy, lab))], "id long, x double, y double, lab string")
    got, most = most_rows(spark, lambda: {x.id: x.voted for x in spatial.knn_vote(df, "id", ["x", "y"], "lab", 8, 8.0).collect()})
    for k, p in enumerate(xy):
        labels = lab[np.argsort(np.sqrt(((p - xy) ** 2).sum(1)), kind="stable")[:8]].tolist()
        assert got[k] == f"l{max(labels, key=lambda c: (labels.count(c), -labels.index(c)))}"
    assert len(got) == len(xy) and most < 400_000, most


def test_nearest_of_places_outside_the_range(spark, tmp_path):
    """2,000 customers far beyond 2,000 suppliers: compared with those at the border."""
    spark.range(2000).selectExpr("id AS c_custkey", "1e6 + id AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(2000).selectExpr("id AS s_suppkey", "cast(id AS double) AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    got, most = most_rows(spark, lambda: plans.QUERIES["knn_join"](spark, str(tmp_path)).collect())
    assert sorted(tuple(x) for x in got) == [(c, k, 2000 - k, 1e6 + c - 2000 + k) for c in range(2000) for k in range(1, 6)]
    assert most < 400_000, most


def test_nearest_of_a_cluster_and_far_outliers(spark, tmp_path):
    """2,000 customers and suppliers within a billionth and two far ones: few rows compared, one query for the counts and one for the rows."""
    for t, k, a, m in (("customer", "c_custkey", "c_acctbal", 7), ("supplier", "s_suppkey", "s_acctbal", 3)):
        spark.range(2002).selectExpr(f"id AS {k}", f"if(id < 2000, id * {m} % 2003 * 1e-13D, (id - 2000.5D) * 2e7D) AS {a}").write.parquet(f"{tmp_path}/{t}.parquet")
    store = spark._jsparkSession.sharedState().statusStore()
    c, s = ([x[0] for x in spark.read.parquet(f"{tmp_path}/{t}.parquet").orderBy(k).select(a).collect()] for t, k, a in (("customer", "c_custkey", "c_acctbal"), ("supplier", "s_suppkey", "s_acctbal")))
    before = store.executionsList().size()
    got, most = most_rows(spark, lambda: spatial.knn(*(spark.read.parquet(f"{tmp_path}/{t}.parquet").withColumnRenamed(a, "x") for t, a in (("customer", "c_acctbal"), ("supplier", "s_acctbal"))), "c_custkey", "s_suppkey", ["x"], 5, 400.0).collect())
    assert store.executionsList().size() - before == 2 and most < 400_000, most
    d = np.abs(np.subtract.outer(np.array(c), np.array(s)))
    want = [(i, n + 1, int(j), float(d[i, j])) for i in range(2002) for n, j in enumerate(np.argsort(d[i], kind="stable")[:5])]
    assert sorted(map(tuple, got)) == want


def test_nearest_over_slices_of_a_line(spark, monkeypatch):
    """Several slices, ties, copies of places, nulls, ids that come twice, a gap between the queries, carried columns: against all pairs."""
    monkeypatch.setattr(spatial, "SLICE", 40)
    r = np.random.default_rng(41)
    ref = [(int(j), None if j == 9 else float(x), f"l{j % 3}") for j, x in zip(r.permutation(300), np.concatenate([np.repeat(50.0, 80), r.integers(0, 90, 220)]))]
    for unique in (True, False):
        x = np.concatenate([np.repeat(2.0, 60), np.repeat(50.0, 40), r.integers(60, 95, 50), [-1e6, 1e6]])
        ids = r.permutation(len(x)) if unique else r.integers(0, 60, len(x))
        q = [(int(i), float(y)) for i, y in zip(ids, x)] + [(900, None)]
        found = spatial.knn(spark.createDataFrame(q, "id long, x double").repartition(3), spark.createDataFrame(ref, "r long, x double, lab string"), "id", "r", ["x"], 4, 0.5, ["lab"])
        want = [(900, None, None, None, None)]
        for i in {i for i, y in q if y is not None}:
            d = sorted((abs(y - z), j, lab) for k, y in q if k == i for j, z, lab in ref if z is not None)[:4]
            want += [(i, n + 1, j, e, lab) for n, (e, j, lab) in enumerate(d)]
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_rates_of_copies_nulls_and_ids_that_come_twice(spark):
    r = np.random.default_rng(33)
    xy = np.concatenate([np.repeat(r.integers(0, 5, (12, 2)), 6, 0), r.uniform(0, 9, (40, 2))]).astype(float)
    rows = [(k, float(a), float(b), f"l{k % 3}") for k, (a, b) in enumerate(xy)]
    rows += [(3, 1.0, 1.0, "l1"), (200, 2.0, None, "l0"), (201, 2.0, 2.0, None), (202, 500.0, 500.0, "l0"), (None, 1.0, 2.0, "l2")]
    got = spatial.neighbour_rates(spark.createDataFrame(rows, "id long, x double, y double, lab string"), "id", ["x", "y"], "lab", 2.0).collect()
    near = {}
    for i, x, y, a in rows:
        for j, u, v, b in rows:
            if None not in (i, j, y, v, a, b) and i != j and math.sqrt((x - u) * (x - u) + (y - v) * (y - v)) <= 2:
                near.setdefault(i, []).append(a == b)
    want = [(i, sum(n) / len(n) if n else 1.0, float(not all(n))) for i, n in ((i, near.get(i, [])) for i, *_ in rows)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
