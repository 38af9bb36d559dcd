import hashlib
import random

import numpy as np

from tessera.llm import repeats, suffix

LEAST = -(2**63)


def brute(docs, n=suffix.LENGTH):
    seen, out = set(), {}
    for d, t in sorted({(d if d is not None else LEAST, (t or "").encode()) for d, t in docs}):
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            s = t[i : i + n]
            if s in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(s)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out[d] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(r, n=50):
    text = lambda k: "".join(r.choice("abcdé \n") for _ in range(k))
    passages = [text(r.choice([90, 99, 100, 101, 180, 400])) for _ in range(6)]
    docs = []
    for k in range(n):
        t = text(r.choice([0, 10, 99, 300]))
        for _ in range(r.randrange(4)):
            t += r.choice(passages) + text(r.choice([0, 1, 150]))
        docs.append((k * 3 - 50, t))
    for k in range(30):
        t = list(docs[k % 20][1])
        for _ in range(r.randrange(4)):
            if t:
                t[r.randrange(len(t))] = "x"
        docs.append((1000 + k, "".join(t)))
    return docs + [(2000, "ab" * 300), (2001, "ba" * 200), (2002, None), (2003, "a" * 500), (2004, "a" * 99), (None, docs[5][1]), (3000, "")]


def agree(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS grp", "3 AS spans")
    got, want = suffix.digests(df).collect(), brute(docs)
    assert len(got) == len(docs)
    for x in got:
        assert tuple(x)[1:] == want[x.doc_id if x.doc_id is not None else LEAST], x.doc_id


def test_against_brute_force(spark):
    docs = corpus(random.Random(1))
    agree(spark, docs + [docs[9]])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert suffix.dedup(df.limit(0)).count() == 0
    for x in suffix.dedup(df).where("n_removed > 0").limit(5).collect():
        assert sum(s.end - s.start for s in x.spans) == x.n_removed and len(x.kept) == x.n_bytes - x.n_removed


def test_hot_cells_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 0)
    agree(spark, corpus(random.Random(7)))


def test_texts_without_ids_stay_apart(spark):
    texts = [" ".join(f"t{k}w{i}" for i in range(30)) for k in range(2000)]
    got = suffix.dedup(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")).collect()
    assert len(got) == 2000 and all(x.n_removed == 0 for x in got)


def test_long_text(spark):
    r = random.Random(3)
    text = "".join(r.choice("abcdefgh") for _ in range(1_500_000))
    got = suffix.dedup(spark.createDataFrame([(1, text), (2, text + "tail")], "doc_id long, text string")).collect()
    assert {(x.doc_id, x.n_bytes, x.n_removed) for x in got} == {(1, 1_500_000, 0), (2, 1_500_004, 1_500_000)}


def test_doubling_against_brute_force():
    r = np.random.default_rng(3)
    for length in (100, 30, 7):
        rule = repeats.Rule("byte", length, min(24, length))
        for letters in (1, 2, 4):
            c = r.integers(1, 60, 50)
            data = r.integers(0, letters, int((c + length - 1).sum())).astype(np.uint8)
            part = data[:200].copy()
            for at in r.integers(0, len(data) - 200, 12):
                data[at : at + 200] = part
            raw, seen, want, at = data.tobytes(), set(), [], 0
            for n in c:
                for k in range(n):
                    want.append(raw[at + k : at + k + length] in seen)
                    seen.add(raw[at + k : at + k + length])
                at += n + length - 1
            assert suffix.later_strings(data, c, rule).tolist() == want
    assert suffix.lengths(100) == [25, 50, 100] and suffix.lengths(7) == [2, 4, 7]
