import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import rans, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = tokens.Encoder(PATH)


def same(texts):
    ids, offsets = ENCODER.encode_all(texts)
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == LIBRARY.encode(t or "", add_special_tokens=False).ids, t


def test_known_texts():
    same(["", None, " ", "Hello WORLD", "it's we'll !'s ''s 'system 're'd x'", "ΑΣ ΣΑΣ", "İ ǅ ½ 12345 １２", "a<|endoftext|>B", "<|startoftext|>", "é é", "🙂🙂!", "a\x1cb\x85c　d", "'", "l'll", "don'T"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=50), st.text("abst'ledrvm !1 é", max_size=60)), max_size=4))
def test_any_text(texts):
    same(texts)


def test_marks_in_any_order():
    marks = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "M"]
    r = random.Random(5)
    same(["\u1df9\u0328", "\u0314\u0c3c", "\u1ac5\u031d", "\u08cc\u0347", "\u1100\u1161\u11a8", "\u212b \u2126", "e\u0301", "\u0915\u093c"])
    for k in range(0, len(marks), 400):
        same(["a" + m + x for m in marks[k : k + 400] for x in r.sample(marks, 8)])


def test_random_texts():
    r = random.Random(6)
    point = lambda: chr(r.choice([r.randrange(0x20, 0x250), r.randrange(0x250, 0x3000), r.randrange(0xE000, 0x20000), 0x20]))
    for _ in range(25):
        same(["".join(point() for _ in range(r.randrange(12))) for _ in range(2000)])


def test_few_slots(monkeypatch):
    monkeypatch.setattr(tokens, "SLOTS", 16)
    own = tokens.Encoder(PATH)
    texts = [" ".join(f"w{k % 37}" for k in range(n)) for n in range(200)]
    for _ in range(2):
        ids, offsets = own.encode_all(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 70_000), st.integers(1, 3000), st.integers(0, 99))
def test_rans_round_trip(n, symbols, seed):
    r = np.random.default_rng(seed)
    ids = np.minimum(r.geometric(0.01, n), symbols) - 1
    table = rans.Table.fit(np.bincount(ids, minlength=symbols))
    block = rans.encode(ids, table)
    assert (rans.decode(block, table) == ids).all()
    for k in range(1, len(block["points"]) // 8 // (rans.LANES + 1) + 1):
        assert (rans.decode(block, table, k) == ids[k * rans.EVERY * rans.LANES :]).all()


def test_damage_is_found():
    ids = np.arange(1000) % 7
    table = rans.Table.fit(np.bincount(ids))
    block = rans.encode(ids, table)
    block["crc"] ^= 1
    try:
        rans.decode(block, table)
    except ValueError:
        return
    raise AssertionError


def test_operator(spark):
    r = random.Random(1)
    docs = [(k * 7 % 101 - 20, " ".join(r.choice(["the", "Cat", "99", "é!"]) for _ in range(r.randrange(2000)))) for k in range(101)] + [(500, None), (501, ""), (502, "x"), (502, "x"), (None, "y z")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS ids")
    want, start = [], 0
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(x) for x in tokens.digests(df, PATH).collect()), key=lambda x: x[1])
    assert got == want
    assert tokens.digests(df.limit(0), PATH).count() == 0
