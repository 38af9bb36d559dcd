"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language, media, minhash, scoring, sharding, suffix, superkmer, tokens
from .common import table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the committed shards hold it, and the shard."""
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark texts that overlap."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


def op5_superkmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.digests(table(spark, sf_dir, "documents"))


def op6_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op8_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses and score of every document, rounded to six digits: sums run in any order."""
    target = scoring.trained_on(table(spark, sf_dir, "labels"))
    rows = scoring.score(table(spark, sf_dir, "documents"), target)
    return rows.withColumns({c: F.round(c, 6) for c in ("target_loss", "background_loss", "score")})


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontaminate": op2_decontaminate,
    "op3_language": op3_language,
    "op4_media": op4_media,
    "op5_superkmer": op5_superkmer,
    "op6_rans": op6_rans,
    "op7_suffix_array": op7_suffix_array,
    "op8_cross_entropy": op8_cross_entropy,
    "op9_bpe": op9_bpe,
    "op10_dart_minhash": op10_dart_minhash,
}
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKENS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _crc32(codes: str) -> str:
    """CRC-32 of a list of bytes in SQL, a bit at a time."""
    bits = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b))"
    return f"xor(list_reduce({codes}, lambda c, b: {bits}, 4294967295), 4294967295)"


_ID_CRC = _crc32("list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)")
_BYTE = "(instr('0123456789ABCDEF', x[2 * j + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * j + 2]) - 1"
_BINS = ", ".join(f"sum(len(list_filter(v, lambda x: x // 32 = {k}))) AS b{k}" for k in range(8))
_SHARES = ", ".join(f"printf('%.6f', b{k} / m::DOUBLE)" for k in range(8))

ORACLES: dict[str, str] = {
    "op2_decontaminate": f"""
WITH dt AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
bt AS (SELECT item_id, {_TOKENS} AS w FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
d AS (SELECT doc_id, i - 1 AS i, w[i] AS tok FROM dt, unnest(range(1, len(w) + 1)) AS u(i)), b AS (SELECT item_id, len(w) AS n, least(13, len(w)) AS s, j - 1 AS j, w[j] AS tok FROM bt, unnest(range(1, len(w) + 1)) AS u(j) WHERE len(w) >= 8),
c AS (SELECT doc_id, item_id, i - j AS line, n, s, list(j) AS js FROM d JOIN b USING (tok) GROUP BY ALL HAVING count(*) >= 8),
k AS (SELECT c.*, k FROM c, unnest(range(0, n - s + 1)) AS u(k) WHERE len(list_filter(js, lambda x: x >= k AND x < k + s)) >= s - CASE WHEN s = 13 THEN 2 ELSE 0 END),
l AS (SELECT *, lag(k) OVER (PARTITION BY doc_id, item_id, line ORDER BY k) AS before FROM k),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR k > before + s THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item_id, line ORDER BY k) AS part FROM l),
r AS (SELECT doc_id, item_id, line, n, part, any_value(js) AS js, min(k) AS a, max(k) + any_value(s) AS e FROM g GROUP BY doc_id, item_id, line, n, part),
o AS (SELECT doc_id, item_id, len(list_filter(js, lambda x: x >= a AND x < e))::BIGINT AS matches, greatest(0, a + line)::BIGINT AS "start", least(e + line, len(w))::BIGINT AS "end", n::BIGINT AS item_tokens FROM r JOIN dt USING (doc_id))
SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY "end" - "start" DESC, matches DESC, "start") = 1""",
    "op4_media": f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, length(h) // 2 AS n, h || repeat('00', CASE WHEN h = '' THEN 64 ELSE (64 - (length(h) // 2) % 64) % 64 END) AS h FROM h),
r AS (SELECT doc_id, c, list_transform(range(0, length(x) // 2), lambda j: ({_BYTE})::BIGINT) AS v FROM (SELECT doc_id, c, h[128 * c + 1:128 * c + 130] AS x FROM d, unnest(range(0, length(h) // 128)) AS u(c))),
b AS (SELECT doc_id, c, v[1:64] AS v, list_sum(list_transform(range(1, len(v)), lambda i: abs(v[i + 1] - v[i]))) AS s FROM r),
f AS (SELECT doc_id, sum(list_sum(v)) AS total, sum(s) AS step, max_by(v, c) AS tail, {_BINS}, 64 * count(*) AS m FROM b GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(unhex(h)) AS payload_sha256, {_crc32('tail')} AS tail_crc32, m + 11 + length((m // 64)::VARCHAR) AS media_bytes, sha256(encode('P5' || chr(10) || '64 ' || (m // 64) || chr(10) || '255' || chr(10)) || unhex(h)) AS media_sha256,
 printf('mean=%.6f;step=%.6f;bins=', total / m::DOUBLE, step / (m - 1)::DOUBLE) || concat_ws(',', {_SHARES}) AS feature, 0::INTEGER AS position FROM d JOIN f USING (doc_id)""",
    "op5_superkmer": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS u(i)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM x),
g AS (SELECT DISTINCT doc_id, j FROM f, unnest(range(i, i + 20)) AS u(j) WHERE k > 1),
p AS (SELECT doc_id, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(j)),
r AS (SELECT doc_id, count(g.j) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (g.j IS NULL) AS kept FROM p LEFT JOIN g USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)""",
    "op7_suffix_array": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, c * 200 AS o, h[400 * c + 1:400 * c + 598] AS h FROM d, unnest(range(0, (length(h) // 2 + 100) // 200)) AS u(c)),
x AS (SELECT doc_id, o + i AS i, h[2 * i + 1:2 * i + 200] AS s FROM q, unnest(range(0, least(200, length(h) // 2 - 99))) AS u(i)),
f AS (SELECT doc_id, i FROM x JOIN (SELECT s, min((doc_id, i)) AS first FROM x GROUP BY s HAVING count(*) > 1) USING (s) WHERE (doc_id, i) <> first),
r AS (SELECT doc_id, i, lag(i) OVER w AS b FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(CASE WHEN b IS NULL OR i > b + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS e FROM g GROUP BY ALL),
p AS (SELECT doc_id, a, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM s),
c AS (SELECT doc_id, sum(e - a)::BIGINT AS gone, count(*) AS n, string_agg(h[2 * b + 1:2 * a], '' ORDER BY a) AS k, max(e) AS e FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(c.k || h[2 * c.e + 1:], h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)""",
    "op8_cross_entropy": f"""
WITH g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND {_ID_CRC} % 4 <> 2),
d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM g) AS t, list_transform({_WORDS}, lambda x: translate(x, '{_UPPER}', '{_LOWER}')) AS w FROM documents),
k AS (SELECT doc_id, t, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] ELSE '' END AS a FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
o AS (SELECT doc_id, t, a, b, count(*) AS n FROM k GROUP BY ALL), ob AS (SELECT doc_id, b, sum(n) AS nb FROM o GROUP BY ALL), oa AS (SELECT doc_id, b AS a, nb AS na FROM ob UNION ALL SELECT DISTINCT doc_id, '', 1 FROM o),
p AS (SELECT t AS s, a, b, sum(n) AS cp FROM o GROUP BY ALL), pb AS (SELECT s, b, sum(cp) AS cb FROM p GROUP BY ALL), pa AS (SELECT s, b AS a, cb AS ca FROM pb UNION ALL SELECT t, '', count(DISTINCT doc_id) FROM o GROUP BY t),
z AS (SELECT s, coalesce(sum(cb), 0) AS n FROM (VALUES (true), (false)) x(s) LEFT JOIN pb USING (s) GROUP BY s), v AS (SELECT count(DISTINCT b) AS v FROM pb),
l AS (SELECT o.doc_id, z.s, sum(o.n * -log2(0.7::DOUBLE * CASE WHEN coalesce(ca, 0) - m * na > 0 THEN (coalesce(cp, 0) - m * o.n) / (ca - m * na)::DOUBLE ELSE 0 END + (1 - 0.7::DOUBLE) * (z.r * (coalesce(cb, 0) - m * nb) + 1) / (z.r * (z.n - m * len(w)) + v))) / len(w) AS loss
 FROM o JOIN d USING (doc_id) JOIN oa USING (doc_id, a) JOIN ob USING (doc_id, b) CROSS JOIN (SELECT z.*, v.v, (SELECT min(n) FROM z) / greatest(z.n, 1)::DOUBLE AS r FROM z, v) z CROSS JOIN LATERAL (SELECT (z.s = o.t)::INT AS m)
 LEFT JOIN p ON p.s = z.s AND p.a = o.a AND p.b = o.b LEFT JOIN pa ON pa.s = z.s AND pa.a = o.a LEFT JOIN pb ON pb.s = z.s AND pb.b = o.b GROUP BY o.doc_id, z.s, len(w))
SELECT d.doc_id, len(w)::BIGINT AS n_tokens, round(x.loss, 6) AS target_loss, round(y.loss, 6) AS background_loss, round(x.loss - y.loss, 6) AS score
FROM d LEFT JOIN l x ON x.doc_id = d.doc_id AND x.s LEFT JOIN l y ON y.doc_id = d.doc_id AND NOT y.s""",
    "op10_dart_minhash": f"""
WITH RECURSIVE t AS (SELECT min(doc_id) AS rep, text FROM documents GROUP BY text),
w AS (SELECT rep, {_WORDS} AS w FROM t),
s AS (SELECT DISTINCT rep, array_to_string(w[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
c AS (SELECT x.rep AS a, y.rep AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.rep < y.rep GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON p.rep = a JOIN n q ON q.rep = b WHERE 10 * k >= 8 * (p.n + q.n - k)),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, class_id) AS (SELECT rep, rep FROM t UNION SELECT b.b, r.class_id FROM r JOIN b ON b.a = r.node WHERE r.class_id < b.b)
SELECT doc_id, min(class_id) AS class_id FROM documents d JOIN t ON d.text IS NOT DISTINCT FROM t.text JOIN r ON r.node = t.rep GROUP BY doc_id""",
}
