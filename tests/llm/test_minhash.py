import random

import numpy as np

from tessera.llm import minhash as m


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(1)
    e = r.integers(0, 2**63, 300, dtype=np.uint64)
    wa, wb = r.integers(1, 9, 200), r.integers(1, 9, 200)
    a, b = dict(zip(e[:200].tolist(), wa.tolist())), dict(zip(e[100:].tolist(), wb.tolist()))
    true = sum(min(a.get(x, 0), b.get(x, 0)) for x in e.tolist()) / sum(max(a.get(x, 0), b.get(x, 0)) for x in e.tolist())
    sig, has = m.signatures(np.repeat([0, 2], 200), np.concatenate([e[:200], e[100:]]), np.concatenate([wa, wb]), 3, k=2000)
    assert has.tolist() == [True, False, True]
    assert abs((sig[0] == sig[2]).mean() - true) < 0.04


def test_small_and_large_sets():
    for n in (1, 3, 5000):
        e = np.arange(n, dtype=np.uint64) * np.uint64(977) + np.uint64(5)
        sig, _ = m.signatures(np.repeat([0, 1], n), np.concatenate([e, e]), np.ones(2 * n), 2)
        assert (sig[0] == sig[1]).all() and (sig > 0).all()


def brute(docs):
    shingle = lambda t: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w := (t or "").split()) >= 5 else {tuple(w)}
    sets = [shingle(t) for _, t in docs]
    root = list(range(len(docs)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            alike = docs[i][1] == docs[j][1] or ((docs[i][1] or "").split() and (docs[j][1] or "").split() and len(a & b) >= 0.8 * len(a | b))
            if alike:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(docs[i][0])
    return {d: min(g) for g in groups.values() for d in g}


def test_against_brute_force(spark):
    r = random.Random(2)
    word = lambda: f"w{r.randrange(300)}"
    base = [[word() for _ in range(r.choice([1, 4, 5, 30, 120]))] for _ in range(25)]
    docs = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k in range(60):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = word()
        docs.append((100 + k, " ".join(w)))
    docs += [(900, ""), (901, ""), (902, None), (903, None), (904, "  \n"), (5, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS doc", "1 AS class_id")
    got = {x.doc_id: x.class_id for x in m.classes(df).collect()}
    assert got == brute(docs)
    nulls = spark.createDataFrame([(None, "a b"), (3, "a b")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.class_id) for x in m.classes(nulls).collect()) == [(0, None), (3, 3)]
    assert m.classes(df.limit(0)).count() == 0
