import hashlib
import random
import zlib

from tessera.llm import media
from tessera.llm.common import workspace


def test_sequence():
    html = '<p>One &amp; <b>two</b><img src="a" alt="A"><figure><img src="b" alt="x"><figcaption> The\n b </figcaption></figure><script>var t="<p>"</script>end<img alt="no"><figure><video src="c">'
    got = media.sequence(html)
    assert [(x["position"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in got] == [(0, "text", "One & two", None), (1, "media", "a", "A"), (2, "media", "b", "The b"), (3, "text", "end", None), (4, "media", "c", None)]
    assert media.sequence(None) == media.sequence("") == media.sequence("<p></div>") == []


def brute(text):
    raw = (text or "").encode()
    data = raw + b"\0" * (64 if not raw else -len(raw) % 64)
    pgm = b"P5\n64 %d\n255\n" % (len(data) // 64) + data
    return len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(pgm), hashlib.sha256(pgm).hexdigest(), media.feature(data)


def test_query(spark):
    r = random.Random(1)
    rows = [(k, "".join(r.choice("ab é\n\0<") for _ in range(r.choice([0, 1, 63, 64, 65, 500])))) for k in range(40)] + [(100, None), (101, ""), (3, "x"), (3, "x"), (None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS payload", "2 AS digest")
    got = media.document_media(df).collect()
    want = sorted(((d, *brute(t)) for d, t in rows), key=repr)
    assert sorted((tuple(x)[:-1] for x in got), key=repr) == want
    assert media.document_media(df.limit(0)).count() == 0


def test_interleaved(spark):
    at = workspace(spark, "m")
    media.store(spark.createDataFrame([(bytearray(64),), (bytearray(128),), (bytearray(64),)], "payload binary"), at)
    ref = lambda n: "sha256:" + hashlib.sha256(bytes(n)).hexdigest()
    pages = spark.createDataFrame([(1, f'<p>a<img src="{ref(128)}"><p>b<img src="{ref(64)}" alt="c"><img src="http://x">'), (2, None), (3, "text"), (3, "text")], "doc_id long, html string")
    got = {x.doc_id: x.sequence for x in media.interleaved(media.parsed(pages), media.features(spark, at)).collect()}
    assert got[2] == [] and [p.text for p in got[3]] == ["text"]
    assert [(p.kind, p.text, p.caption, p.media and p.media.payload_bytes) for p in got[1]] == [("text", "a", None, None), ("media", None, None, 128), ("text", "b", None, None), ("media", None, "c", 64), ("media", None, None, None)]
    damaged = media.image(bytes(64))[:-1]
    try:
        media.samples(damaged)
    except ValueError:
        return
    raise AssertionError
