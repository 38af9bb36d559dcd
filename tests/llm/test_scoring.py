import math
import random
from collections import Counter

import pytest

from tessera.llm import scoring


def brute(docs, target, share=scoring.MIX):
    toks = [(d, (t or "").lower().split()) for d, t in docs]
    uni, bi, ctx = [{True: Counter(), False: Counter()} for _ in range(3)]
    count = lambda w: (Counter(w), Counter(zip([""] + w, w)), Counter(([""] if w else []) + w))
    for d, w in toks:
        for all_, own in zip((uni, bi, ctx), count(w)):
            all_[d in target].update(own)
    v = len(set(uni[True]) | set(uni[False]))
    out = []
    for d, w in toks:
        row = []
        ou, ob, oc = count(w)
        for side in (True, False):
            mine = side == (d in target)
            sizes = [sum(uni[s].values()) for s in (True, False)]
            r = min(sizes) / max(1, sum(uni[side].values()))
            n = sum(uni[side].values()) - mine * len(w)
            loss = 0
            for a, b in zip([""] + w, w):
                ca = ctx[side][a] - mine * oc[a]
                known = (bi[side][a, b] - mine * ob[a, b]) / ca if ca > 0 else 0
                loss -= math.log2(share * known + (1 - share) * (r * (uni[side][b] - mine * ou[b]) + 1) / (r * n + v))
            row.append(loss / len(w) if w else None)
        out.append((d, len(w), *row))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[1], r[2] or 0)


def test_against_brute_force(spark):
    r = random.Random(1)
    docs = [(k, r.choice([" ", "\n\t"]).join(r.choice(["A", "b", "é", "c", "dd"][k % 2 :]) for _ in range(r.randrange(30)))) for k in range(60)]
    docs += [(None, "a b"), (100, None), (101, " "), (5, docs[5][1])]
    target = {k for k in range(0, 60, 3)}
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS mark")
    ids = spark.createDataFrame([(k,) for k in [*target, 999]], "doc_id long")
    got = sorted([(x.doc_id, x.n_tokens, x.target_loss, x.background_loss) for x in scoring.score(df, ids).collect()], key=key)
    want = sorted(brute(docs, target), key=key)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    for a, b in zip(got, want):
        assert a[2:] == (None, None) if b[2] is None else a[2:] == pytest.approx(b[2:])
    assert scoring.score(df.limit(0), ids).count() == 0
    assert all(x.score is None or x.score > 0 for x in scoring.score(df, ids.limit(0)).where("n_tokens > 1").collect())


def test_target_scores_lower(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    rows = scoring.score(docs, scoring.trained_on(labels)).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2 and score is not null").collect()
    good, bad = ([x.score for x in rows if x.quality == q] for q in (1, 0))
    wins = sum((g < b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.8, wins
