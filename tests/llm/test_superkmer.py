import hashlib
import random
import re

import numpy as np

from tessera.llm import repeats, superkmer
from tessera.llm.common import sliding_argmin


def brute(docs, n=superkmer.LENGTH):
    seen, out = set(), []
    uniq = sorted({(d if d is not None else -(2**63), t or "") for d, t in docs})
    for d, t in uniq:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = set()
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in seen:
                gone.update(range(i, i + n))
            seen.add(key)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return {x[0]: x for x in out}


def corpus(r, n=60):
    word = lambda: r.choice(["a", "b", "the", "é", "w1"]) if r.random() < 0.2 else f"w{r.randrange(5000)}"
    text = lambda k: [word() for _ in range(k)]
    passages = [text(r.choice([19, 20, 21, 35, 60])) for _ in range(6)]
    docs = []
    for k in range(n):
        w = text(r.choice([0, 5, 20, 80]))
        for _ in range(r.randrange(4)):
            w += r.choice(passages) + text(r.choice([0, 1, 30]))
        docs.append((k * 3 - 50, r.choice([" ", "\n", "  \t"]).join(w)))
    docs += [(1000 + k, docs[k][1]) for k in range(20)] + [(2000, "same " * 100), (2001, "same " * 30), (2002, None), (2003, " \n"), (None, docs[5][1]), (3000, "")]
    return docs


def test_against_brute_force(spark):
    docs = corpus(random.Random(1))
    docs.append(docs[9])
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS grp", "3 AS n_words")
    want = brute(docs)
    got = superkmer.digests(df).collect()
    assert len(got) == len(docs)
    for x in got:
        assert tuple(x) [1:] == want[x.doc_id if x.doc_id is not None else -(2**63)][1:], x.doc_id
    assert superkmer.dedup(df.limit(0)).count() == 0


def test_hot_cells_change_nothing(spark, monkeypatch):
    docs = corpus(random.Random(4))
    monkeypatch.setattr(repeats, "HOT", 0)
    got = superkmer.digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute(docs)
    assert all(tuple(x)[1:] == want[x.doc_id if x.doc_id is not None else -(2**63)][1:] for x in got)


def unique_texts(n, words=30):
    return [" ".join(f"t{k}w{i}" for i in range(words)) for k in range(n)]


def test_texts_without_ids_stay_apart(spark):
    texts = unique_texts(3000)
    for at in (None, 7):  # no id, or one for all
        got = superkmer.dedup(spark.createDataFrame([(at, t) for t in texts], "doc_id long, text string")).collect()
        assert len(got) == 3000 and {x.kept for x in got} == set(texts) and all(x.n_removed == 0 for x in got)
    grps = repeats.keyed(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")).groupBy("grp").count().collect()
    assert len(grps) == 4 and max(g["count"] for g in grps) < 1000
    doubled = [(None, t) for t in texts[:500] * 2] + [(5, texts[0] + " " + texts[1])]
    got = superkmer.dedup(spark.createDataFrame(doubled, "doc_id long, text string")).collect()
    assert len(got) == 1001 and all(x.n_removed == (60 if x.doc_id == 5 else 0) for x in got)


def test_names_of_many_texts_without_ids():
    r = np.random.default_rng(1)
    tag = r.integers(-(2**63), 2**63, 100_000)
    doc, at = np.full(100_000, -(2**63)), np.zeros(100_000, np.int64)
    assert len(np.unique(repeats.name_hash(doc, tag, at))) == len(np.unique(tag))
    blob = repeats.pack(repeats.delta(np.sort(doc)), repeats.delta(tag), at)
    assert (repeats.joined([blob, blob])[1] == np.concatenate([tag, tag])).all()
    load = np.bincount(repeats.group_of(doc, tag, 50), minlength=50)
    assert load.min() > 1500 and load.max() < 2500


def test_sliding_argmin_in_parts():
    key = np.random.default_rng(2).integers(0, 50, 1000).astype(np.uint64) << np.uint64(50)
    for w in (1, 2, 17):
        want = [i + int(np.argmin(key[i : i + w])) for i in range(len(key) - w + 1)]
        assert sliding_argmin(key, w).tolist() == want == sliding_argmin(key, w, 64).tolist()


def test_long_text(spark):
    r = random.Random(3)
    text = " ".join(f"w{r.randrange(10**6)}" for _ in range(300_000))
    got = superkmer.dedup(spark.createDataFrame([(1, text), (2, text + " tail")], "doc_id long, text string")).collect()
    assert {(x.doc_id, x.n_words, x.n_removed) for x in got} == {(1, 300_000, 0), (2, 300_001, 300_000)}
