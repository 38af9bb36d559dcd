import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as p
from tests.llm import test_decontaminate, test_minhash, test_suffix

WORDS = {"en": "the cat and dog ran over a hill with some friends then".split(), "de": "der hund und die katze sind im haus auf dem berg".split()}


def make(r):
    docs = []
    for k in range(80):
        lang = r.choice(["en", "de"])
        docs.append((k, " ".join(r.choice(WORDS[lang]) + r.choice(["", "s", "en", "x", "é"]) for _ in range(r.choice([3, 30, 90]))), lang))
    bench = [(k, " ".join(f"q{r.randrange(99)}" for _ in range(20))) for k in range(3)]
    passage = "".join(r.choice("abcdefg hij é") for _ in range(300))
    for k in range(10):
        docs.append((100 + k, docs[k + 20][1], docs[k + 20][2]))
        docs.append((200 + k, docs[k][1] + " tail " + passage + f" end {k}", docs[k][2]))
    docs.append((300, docs[60][1] + " " + bench[0][1], "en"))
    docs += [(400, None, None), (401, "", "en"), (402, "12 !!", "de")]
    return docs, bench


def test_stages_against_brute_force(spark, tmp_path):
    docs, bench = make(random.Random(3))
    rows = [(d, t, x, "s", len(t or "")) for d, t, x in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    one = p.language_id(spark, df, str(tmp_path))
    assert one.columns == list(p.COLUMNS)
    kept = [(d, t) for d, t, _ in docs if t and any(c.isalpha() for c in t)]
    assert sorted((x.doc_id, x.text) for x in one.collect()) == kept_sorted(kept)

    two = p.near_dedup(spark, one, str(tmp_path))
    classes = test_minhash.brute(kept)
    kept = [(d, t) for d, t in kept if classes[d] == d]
    assert sorted((x.doc_id, x.text) for x in two.collect()) == kept_sorted(kept)

    three = p.substring_dedup(spark, two, str(tmp_path))
    cut = {d: (n, gone) for d, (n, gone, _, _) in test_suffix.brute(kept).items()}
    got = {x.doc_id: x for x in three.collect()}
    assert set(got) == set(cut) and any(gone for _, gone in cut.values())
    for d, t in kept:
        n, gone = cut[d]
        assert got[d].n_chars == len(got[d].text)
        assert got[d].text == t if not gone else 0 <= n - gone - len(got[d].text.encode()) <= 6 * n

    four = p.decontamination(spark, three, str(tmp_path))
    dirty = {d for d, x in got.items() if any(test_decontaminate.brute(x.text, b) for _, b in bench)}
    assert dirty == {300} and {x.doc_id for x in four.collect()} == set(got) - dirty

    library = Tokenizer.from_file(public_tokenizers.path(p.TOKENIZER))
    five = p.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in five} == set(got) - dirty
    assert all(x.ids == library.encode(got[x.doc_id].text, add_special_tokens=False).ids for x in five)


def kept_sorted(rows):
    return sorted(rows)


def test_empty_and_clashing(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(1, "a b", None, "s", 3, "x", "y"), (1, "a b", None, "s", 3, "x", "y"), (None, "c", None, None, 1, "", "")], "doc_id long, text string, lang string, source string, n_chars long, score string, ids string")
    for rows, want in ((df, [0, 1]), (df.limit(0), [])):
        for _, stage in p.STAGES:
            rows = stage(spark, rows, str(tmp_path))
        assert sorted(x.doc_id or 0 for x in rows.collect()) == want


def test_reused_and_missing_doc_ids(spark):
    r = random.Random(8)
    text = [" ".join(f"w{r.randrange(999)}" for _ in range(60)) for _ in range(6)]
    rows = [(1, text[0]), (1, text[1]), (1, text[1]), (2, text[1] + " tail"), (3, text[2]), (None, text[2]), (None, text[3]), (None, text[3]), (None, text[3] + " tail"), (None, text[4]), (4, text[5])]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(x.doc_id, x.text) for x in p.near_dedup(spark, df, "").collect()]
    assert len(got) == 6 and {(1, text[0]), (1, text[1]), (3, text[2]), (None, text[4]), (4, text[5])} < set(got)
    assert sum(d is None and t.startswith(text[3]) for d, t in got) == 1
