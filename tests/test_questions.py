"""Questions about regions against counting by hand."""

from tessera.operators import questions


def test_questions(spark):
    has = {1: {1, 2, 3, 9}, 2: {1, 9}, 3: {1, 2, 9}, 4: {2, 3}}  # candidates; 9 and 8 are anchors
    members = spark.createDataFrame([(0, c, e) for c, m in has.items() for e in m], "object int, candidate int, element int")
    regions = spark.createDataFrame([(0, "p", "q", 7, 2), (0, "p", "q", 7, 3), (0, "p", "q", 8, 1), (0, "p", "q", 6, 5)], "object int, va string, vb string, region int, element int")
    pixels = spark.createDataFrame([(0, v, e, n) for v, s in (("p", {1: 5, 2: 4, 3: 3, 9: 1, 8: 1}), ("q", {1: 5, 2: 2, 3: 1, 9: 1, 4: 6})) for e, n in s.items()], "object int, view string, element int, n long")
    disputed = spark.createDataFrame([(0, "p", 2), (0, "q", 3), (0, "q", 4)], "object int, view string, element int")
    anchors = spark.createDataFrame([(0, 9), (0, 8), (0, None)], "object int, anchor int")
    got = questions.questions(members, regions, anchors, pixels, disputed).collect()
    # Anchor 9 is in 1, 2 and 3: 1 includes region 7, 2 excludes it, 3 is mixed. Region 8 is in all three. 8 is seen in one view only.
    assert [(r.region, r.anchor, r.include, r.exclude, r.coverage) for r in got] == [(7, 9, 1, 1, 3)]
    assert abs(got[0].split - 1 / 3) < 1e-12 and abs(got[0].gain - 1 / 3 * 3 / 7) < 1e-12
    best = questions.best_question(questions.questions(members, regions, anchors, pixels, disputed)).collect()
    assert [(r.object, r.region, r.anchor) for r in best] == [(0, 7, 9)]
    assert questions.questions(members, regions, anchors.limit(0), pixels, disputed).count() == 0
    assert questions.questions(members.limit(0), regions, anchors, pixels, disputed).count() == 0


def test_undisputed_pixels_count_as_one(spark):
    members = spark.createDataFrame([(0, 1, 9), (0, 1, 2), (0, 2, 9)], "object int, candidate int, element int")
    regions = spark.createDataFrame([(0, "p", "q", 1, 2)], "object int, va string, vb string, region int, element int")
    pixels = spark.createDataFrame([(0, v, e, 2) for v in "pq" for e in (2, 9)], "object int, view string, element int, n long")
    disputed = spark.createDataFrame([], "object int, view string, element int")
    got = questions.questions(members, regions, spark.createDataFrame([(0, 9)], "object int, anchor int"), pixels, disputed).collect()
    assert [(r.split, r.coverage, r.gain) for r in got] == [(0.5, 2, 1.0)]
