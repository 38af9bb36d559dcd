import itertools
import random
import re

from tessera.llm import decontaminate as d


def test_masks_hit_all_substitutions():
    for bad in itertools.combinations(range(d.SPAN), d.ERRORS):
        assert any(all(s + p not in bad for p, c in enumerate(m) if c == "1") for m in d.MASKS for s in range(d.SPAN - len(m) + 1))
    assert min(map(len, d.MASKS)) <= d.LEAST


def toks(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(doc, item, least=d.LEAST):
    """(matches, start, end) of the longest stretch, or None."""
    a, b = toks(doc), toks(item)
    if len(b) < max(1, least):
        return None
    w = min(d.SPAN, len(b))
    need = w - d.ERRORS * (w == d.SPAN)
    found = []
    for line in range(-len(b), len(a) + 1):
        same = [0 <= line + j < len(a) and a[line + j] == b[j] for j in range(len(b))]
        good = [j for j in range(len(b) - w + 1) if sum(same[j : j + w]) >= need]
        covered = sorted({k for j in good for k in range(j, j + w)})
        while covered:
            n = 1
            while n < len(covered) and covered[n] == covered[0] + n:
                n += 1
            lo, hi = max(0, line + covered[0]), min(len(a), line + covered[0] + n)
            found.append((lo - hi, -sum(same[k] for k in covered[:n]), lo))
            covered = covered[n:]
    if not found:
        return None
    n, matches, start = min(found)
    return -matches, start, start - n


def test_against_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, text(r.choice([3, 7, 8, 10, 12, 13, 20, 40]))) for k in range(30)] + [(None, None), (3, "")]
    docs = [(k, text(r.randint(0, 60))) for k in range(40)] + [(None, None), (1, ""), (1, "")]
    for k in range(60):
        w = items[r.randrange(30)][1].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "other"
        docs.append((100 + k, f"{text(5)}, {' '.join(w).upper()}! {text(5)}" if k % 3 else " ".join(w[k % 2 + 1 :])))
    docs += [(200 + k, f"a {u}. b") for k, u in items if u and len(u.split()) < d.LEAST]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS item_id", "'y' AS start")
    bench = spark.createDataFrame(items, "item_id long, text string")
    pairs = sorted((a, i, *brute(t, u), len(toks(u))) for a, t in docs for i, u in items if brute(t, u))
    assert sorted(map(tuple, d.overlaps(df, bench).collect())) == pairs and len(pairs) > 20
    short = sorted((a, i, *brute(t, u, 1), len(toks(u))) for a, t in docs for i, u in items if brute(t, u, 1))
    assert sorted(map(tuple, d.overlaps(df, bench.unionAll(bench), least=1).collect())) == short and len(short) > len(pairs)
    want = [x[:2] for x in pairs]
    assert sorted((x.doc_id, x.item_id) for x in d.overlaps(df, bench, most_bytes=500).collect()) == want
    clean = d.without(df, bench, most_bytes=500)
    assert clean.columns == df.columns
    assert sorted((x.doc_id or 0, x.text) for x in clean.collect() if x.text) == sorted((a, t) for a, t in docs if t and a not in {w[0] for w in want})
    assert d.overlaps(df.limit(0), bench).count() == 0 == d.overlaps(df, bench.limit(0)).count()


def test_stretches_end_at_gaps(spark):
    item = [f"b{k}" for k in range(60)]
    cut = item[:15] + [f"x{k}" for k in range(30)] + item[45:]
    later = ["y"] * 4 + item[:14] + [f"x{k}" for k in range(26)] + item[40:]
    docs = spark.createDataFrame([(1, " ".join(cut)), (2, " ".join(later)), (3, " ".join(cut * 3000))], "doc_id long, text string")
    got = sorted(map(tuple, d.overlaps(docs, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()))
    assert got == [(1, 9, 15, 0, 17, 60), (2, 9, 20, 42, 64, 60), (3, 9, 15, 0, 17, 60)]
