import hashlib
import random

import pytest

from tessera.llm import sharding
from tessera.llm.common import workspace


def test_plan_merges_similar_sizes():
    assert sharding.plan([1] * 3, 10, 4, 100) == [[0], [1], [2]]
    assert sharding.plan([1] * 4, 10, 4, 100) == [[0, 1, 2, 3]]
    assert sharding.plan([200, 1, 1, 1, 1, 50], 10, 4, 100) == [[0], [1, 2, 3, 4], [5]]
    r = random.Random(2)
    for _ in range(50):
        sizes = [r.choice([0, 3, 12, 45, 120]) for _ in range(r.randrange(60))]
        groups = sharding.plan(sizes, 10, 4, 100)
        assert sorted(k for g in groups for k in g) == list(range(len(sizes)))
        assert all(len(g) == 1 for g in groups if any(sizes[k] >= 100 for k in g))
        left = [sharding.tier(sum(sizes[k] for k in g), 10, 4) for g in groups if sum(sizes[k] for k in g) < 100]
        assert all(left.count(t) < 4 for t in left)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_store(spark):
    store = sharding.Store(spark, workspace(spark, "t"))
    rows = [(k, f"text {k} " * (k % 7), "x") for k in range(200)] + [(None, None, None), (3, "again", ""), (3, "again", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    assert store.append(df) == 1
    assert store.append(df.limit(0)) == 2
    assert store.append(df.limit(5)) == 3
    before = store.manifest()
    assert store.compact(100, 4, 3000) == 4
    after = store.manifest()
    assert len(after) < len(before) and sum(s.rows for s in after) == 208
    assert rows_of(store.read().select(df.columns)) == rows_of(store.read(3).select(df.columns))
    with pytest.raises(Exception):  # noqa: B017  another writer has committed version 4
        store.commit(before, 3)
    assert store.manifest() == after
    assert store.vacuum() > 0
    assert store.read().count() == 208
    assert store.compact(100, 4, 3000) == 4


def test_query(spark):
    df = spark.createDataFrame([(k, None if k == 5 else f"é{k}" * k) for k in range(50)] + [(None, "")], "doc_id long, text string").repartition(8)
    got = {r.doc_id: r for r in sharding.sharded(df, 10, 2, 1 << 20).collect()}
    assert len(got) == 51 and got[5].n_bytes == 0 and got[5].text_sha256 is None
    assert all(r.n_bytes == len(f"é{d}".encode()) * d and r.text_sha256 == hashlib.sha256((f"é{d}" * d).encode()).hexdigest() for d, r in got.items() if d not in (5, None))
    assert len({r.shard for r in got.values()}) < 8
    assert sharding.sharded(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "1 AS shard", "'t' AS tier")
    assert {r.tier for r in sharding.sharded(clash).collect()} == {0}


def slow_plan(sizes, base, fan, target):
    live = [([k], s) for k, s in enumerate(sizes)]
    while True:
        by_tier = {}
        for k, (_, s) in enumerate(live):
            if s < target:
                by_tier.setdefault(sharding.tier(s, base, fan), []).append(k)
        full = sorted(t for t, x in by_tier.items() if len(x) >= fan)
        if not full:
            return [m for m, _ in live]
        take = by_tier[full[0]][:fan]
        merged = (sorted(i for k in take for i in live[k][0]), sum(live[k][1] for k in take))
        live = sorted([x for k, x in enumerate(live) if k not in take] + [merged])


def test_plan_against_rescans():
    r = random.Random(7)
    for _ in range(40):
        sizes = [r.choice([0, 1, 5, 40, 300, 2000]) for _ in range(r.randrange(60))]
        assert sharding.plan(sizes, 10, 3, 1000) == slow_plan(sizes, 10, 3, 1000)
    assert len(sharding.plan([1] * 200_000, 10, 4, 10**9)) < 40


def test_files_have_the_target_size(spark):
    docs = spark.createDataFrame([(k, "x" * 100, k % 3 or None) for k in range(4000)], "doc_id long, text string, more long").repartition(40)
    store = sharding.Store(spark, sharding.workspace(spark, "target"))
    store.append(docs)
    store.compact(10_000, 4, 30_000)
    big = [s for s in store.manifest() if s.name.startswith("m")]
    assert big and all(len(s.files) == -(-s.bytes // 30_000) for s in big)
    back = store.read().select("doc_id", "text", "more")
    assert back.count() == 4000 and back.exceptAll(docs).count() == 0
    checks = [s.check for s in store.manifest()]
    other = sharding.Store(spark, sharding.workspace(spark, "other"))
    other.append(docs.selectExpr("doc_id", "text", "coalesce(more, 0) AS more"))
    other.compact(10_000, 4, 30_000)
    assert checks != [s.check for s in other.manifest()]
