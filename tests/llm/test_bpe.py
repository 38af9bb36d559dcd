import hashlib
import random
import time

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.codec(PATH)


def same(texts):
    tokens, offsets = CODEC.encode_all(texts)
    data, at = CODEC.decode_all(tokens, offsets)
    for k, text in enumerate(texts):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert tokens[offsets[k] : offsets[k + 1]].tolist() == ids, text
        assert data[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace") == LIBRARY.decode(ids, skip_special_tokens=False)


def test_known_texts():
    same(["", None, " ", "  a", "hello world", "a" * 999, "<|endoftext|>x<|endoftext|>", "it's  we'll\n\n\tx\x1c\x85 y", "naïve é 12½", "🙂🙂 ok", "the the　the", " \n \n  end  "])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("abcdent the'\n. ", max_size=80)), max_size=4))
def test_any_text(texts):
    same(texts)


def test_long_pieces_take_linear_time():
    CODEC.merge_piece(b"a" * 100)
    times = []
    for n in (20_000, 160_000):
        began = time.process_time()
        CODEC.merge_piece(b"a" * n)
        times.append(time.process_time() - began)
    assert times[1] < 24 * times[0] + 0.05 and times[1] < 1
    r = random.Random(4)
    same(["a" * 50_000, "".join(r.choice("abcde") for _ in range(50_000)), " " * 30_000 + "x", "=" * 9_999, "é" * 9_999])


def test_digests(spark):
    texts = [None, "", "a b", "naïve é <|endoftext|> x", "  two\n\nlines", "word " * 5000]
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, t in enumerate(texts):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert got[k] == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False)))


def test_operator(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y")], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.decoded, len(r.ids)) for r in rows) == [(0, "", 0), (1, "a b", 2), (1, "a b", 2), (2, "", 0)]
    assert bpe.digests(df.limit(0), PATH).count() == 0
    assert {r.n_tokens for r in bpe.digests(df, PATH).collect()} == {0, 2}
