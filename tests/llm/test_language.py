import random

from tessera.llm import language


def brute(train: str, text: str) -> int:
    """Longest factors of train, one after the other."""
    n, at = 0, 0
    while at < len(text):
        k = 0
        while at + k < len(text) and text[at : at + k + 1] in train:
            k += 1
        at, n = at + max(1, k), n + 1
    return n


def test_phrases_against_brute_force():
    r = random.Random(5)
    train = {x: "".join(r.choice("ab cde"[:k]) for _ in range(400)).strip() for x, k in (("x", 4), ("y", 6))}
    m = language.Models(train)
    text = " ".join("".join(r.choice("abcdez") for _ in range(r.randint(1, 9))) for _ in range(40))
    codes, offsets, has = m.squeezed([text, "", None, "12", text.upper()])
    assert has.tolist() == [True, False, False, False, True]
    got = m.phrases(codes, offsets)
    plain = {x: " ".join(t.split()) for x, t in train.items()}
    assert got[0].tolist() == [brute(plain["x"], text), brute(plain["y"], text)]
    assert got[4].tolist() == got[0].tolist()


def test_operator(spark):
    en, de = "the cat sat on the mat and the dog ran", "der hund und die katze sind im haus und"
    rows = [(i, (en if i % 2 else de) + f" {i}", "en" if i % 2 else "de", "s") for i in range(60)] + [(None, None, None, None), (7, "", "en", ""), (8, "123 !!", None, "s"), (9, en * 500, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = language.predict(df).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got if r.doc_id is not None and r.doc_id >= 10)
    assert sorted(r.doc_id or 0 for r in got if r.lang_pred == "und") == [0, 7, 8]
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language.predict(df.where("lang is null")).collect()} == {"und"}
    assert language.predict(df.limit(0)).count() == 0
    clash = df.withColumn("score", df.source)
    assert language.identify(clash, {"en": en}).columns[-2:] == ["lang_pred", "score"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = language.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95


def test_language_of_copies_is_learned(spark):
    en = [f"the cat sat on mat number {k}" for k in range(3)]
    df = spark.createDataFrame([(en[k % 3], "en") for k in range(30_000)] + [(f"der hund und die katze {k}", "de") for k in range(400)], "text string, lang string")
    texts = language.sample(df)
    assert sorted(texts) == ["de", "en"] and all(t in texts["en"] for t in en)
