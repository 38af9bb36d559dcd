"""Further queries: evidence, readouts, pixels and geometry on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vector as V
from ..operators import evidence, geometry, matching, overlap, ownership, pixels, quantile, sequence, spatial
from .queries import QUERIES, query, r6, t  # noqa: F401

_SETS = "m AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS e FROM lineitem), n AS (SELECT a, count(*) AS n FROM m GROUP BY a), i AS (SELECT x.a AS a, y.a AS b, count(*) AS k FROM m x JOIN m y USING (e) WHERE x.a < y.a GROUP BY ALL)"


@query(f"""WITH {_SETS} SELECT i.a AS l_suppkey, i.b AS l_suppkey_2, k AS inter FROM i JOIN n p ON p.a = i.a JOIN n q ON q.a = i.b
WHERE k >= 3 AND k / (p.n + q.n - k)::DOUBLE >= 0.05 AND k / p.n::DOUBLE >= 0.1 AND k / q.n::DOUBLE >= 0.1""")
def identity_pairs(spark, sf_dir):
    return overlap.identity_pairs(t(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", 3, 0.05, 0.1).select("l_suppkey", "l_suppkey_2", "inter")


@query("""
WITH c AS (SELECT o_custkey, sha256(string_agg(k, '|' ORDER BY k)) AS content FROM (SELECT DISTINCT o_custkey, o_orderpriority AS k FROM orders) GROUP BY o_custkey)
SELECT o_custkey, content, min(o_custkey) OVER (PARTITION BY content) AS alias FROM c""")
def identical_sets(spark, sf_dir):
    return overlap.identical_sets(t(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


def _hits(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = t(spark, sf_dir, "orders")
    gt = o.where("o_orderstatus <> 'P'").select("o_orderpriority", F.col("o_orderkey").alias("g"))
    pred = o.where("o_totalprice > 150000").select("o_orderpriority", F.col("o_orderkey").alias("p"))
    both = gt.join(pred, (gt.g == pred.p) & (gt.o_orderpriority == pred.o_orderpriority)).select(gt.o_orderpriority, "g", "p")
    return gt, pred, both


@query("""
WITH c AS (SELECT o_orderpriority, count(*) FILTER (a AND b) AS tp, count(*) FILTER (NOT a AND b) AS fp, count(*) FILTER (a AND NOT b) AS fn
 FROM (SELECT o_orderpriority, o_orderstatus <> 'P' AS a, o_totalprice > 150000 AS b FROM orders) GROUP BY ALL)
SELECT o_orderpriority, tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall FROM c""")
def match_readout(spark, sf_dir):
    r = matching.readout(*_hits(spark, sf_dir), ["o_orderpriority"], "g", "p")
    return r.select("o_orderpriority", "tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("""
WITH c AS (SELECT o_orderpriority, count(*) FILTER (a AND b) AS tp, count(*) FILTER (NOT a AND b) AS fp, count(*) FILTER (a AND NOT b) AS fn
 FROM (SELECT o_orderpriority, o_orderstatus <> 'P' AS a, o_totalprice > 150000 AS b FROM orders) GROUP BY ALL)
SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(sum(tp) / sum(tp + fn), 6) AS recall, round(avg(tp / (tp + fn)::DOUBLE), 6) AS mean_recall FROM c""")
def pooled_readout(spark, sf_dir):
    p = matching.pooled(matching.readout(*_hits(spark, sf_dir), ["o_orderpriority"], "g", "p"))
    return p.select("tp", "fp", "fn", r6("recall").alias("recall"), r6("mean_recall").alias("mean_recall"))


@query("""
WITH m AS (SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')), h AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'),
s AS (SELECT 'all' AS stratum, c_custkey FROM m UNION ALL SELECT 'small', c_custkey FROM m WHERE c_acctbal < 2000 UNION ALL SELECT 'tail', c_custkey FROM m WHERE c_nationkey IN (1, 2))
SELECT stratum, count(*) AS missed, count(k) AS rescued, round(count(k) / count(*)::DOUBLE, 6) AS share FROM s LEFT JOIN h ON k = c_custkey GROUP BY stratum""")
def rescue_strata(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    strata = {"all": F.lit(True), "small": F.col("c_acctbal") < 2000, "tail": F.col("c_nationkey").isin(1, 2)}
    r = matching.rescued(t(spark, sf_dir, "customer"), o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "c_custkey", strata)
    return r.withColumn("share", r6("share"))


@query("""
SELECT p_brand, p_partkey, p_retailprice FROM part WHERE p_size >= 3 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1""")
def best_candidate(spark, sf_dir):
    return matching.best_candidate(t(spark, sf_dir, "part"), ["p_brand"], "p_partkey", "p_retailprice", "p_size")


@query("""
SELECT p_brand, p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey AND b.p_size >= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice > a.p_retailprice))""")
def undominated(spark, sf_dir):
    return evidence.undominated(t(spark, sf_dir, "part"), "p_brand", "p_partkey", ["p_size", "p_retailprice"]).select("p_brand", "p_partkey")


@query("""
WITH v AS (SELECT c_custkey, o_orderstatus, min(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT c_custkey, round(avg(s), 4) AS score FROM v GROUP BY c_custkey""")
def worst_case_score(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey").join(t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return evidence.worst_case_score(o, "c_custkey", "o_orderstatus", "o_totalprice").withColumn("score", F.round("score", 4))


@query("""
WITH d AS (SELECT c_nationkey || '/' || c_mktsegment AS g, (round(c_acctbal * 100)::BIGINT) AS d FROM customer),
l AS (SELECT g, d, CASE WHEN count(*) OVER w > 1 THEN (sum(d) OVER w - d)::DOUBLE / (count(*) OVER w - 1) ELSE d END AS l FROM d WINDOW w AS (PARTITION BY g))
SELECT g, least(min(d), min(l)) >= -1e-12 AND greatest(max(d), max(l)) > 1e-12 AS stable FROM l GROUP BY g""")
def stable_improvement(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("g"), F.round(F.col("c_acctbal") * 100).cast("double").alias("d"))
    return evidence.stable_improvement(c, "g", "d")


@query("""
SELECT l_partkey, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'A') >= 2 AND NOT bool_or(l_returnflag = 'R') AS accepted FROM lineitem GROUP BY l_partkey""")
def accepted_regions(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_returnflag") == "A").alias("positive"), (F.col("l_returnflag") == "R").alias("negative"))
    return evidence.accepted_regions(li, "l_partkey", "l_suppkey")


_PIXEL = "p AS (SELECT l_orderkey % 40 AS view, l_orderkey AS id, l_linenumber AS k, l_discount * 10 AS w, l_quantity / 50 AS o FROM lineitem)"


def _pixels(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 40).alias("view"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), (F.col("l_discount") * 10).alias("w"), (F.col("l_quantity") / 50).alias("o"))


@query(f"WITH {_PIXEL} SELECT view, count(*) AS n FROM p WHERE o >= 0.5 AND w / o >= 0.5 AND id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY view")
def member_pixels(spark, sf_dir):
    members = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return pixels.member_pixels(_pixels(spark, sf_dir), members, "id", "w", "o").groupBy("view").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_partkey, CASE WHEN bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R') THEN 'disputed' WHEN bool_or(l_returnflag = 'A') THEN 'positive' WHEN bool_or(l_returnflag = 'R') THEN 'negative' END AS side FROM lineitem GROUP BY l_partkey""")
def pixel_consensus(spark, sf_dir):
    h = t(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_returnflag") == "A").alias("p"), (F.col("l_returnflag") == "R").alias("n"))
    return pixels.consensus(h, ["l_partkey"], "p", "n")


_POINT = "a AS (SELECT p_partkey AS id, p_size % 20 + 0.3 AS x, p_partkey % 20 + 0.7 AS y, p_retailprice / 100 AS d FROM part), f AS (SELECT floor(p_size % 20 + 0.8)::BIGINT AS px, floor(p_partkey % 20 + 1.2)::BIGINT AS py, p_partkey AS fid, p_retailprice / 100 AS fd, p_size % 2 = 0 AS ok FROM part WHERE p_partkey % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY px, py ORDER BY p_retailprice, p_partkey) = 1)"


@query(f"""WITH {_POINT} SELECT id, fd IS NULL AS outside, coalesce(d > 1.05 * fd, false) AND coalesce(fid % 5 <> 0, true) AS occluded, coalesce(d > 1.05 * fd, false) AND coalesce(fid % 5 = 0, false) AS self_occluded, fd IS NOT NULL AND NOT coalesce(ok, false) AS unreliable
FROM a LEFT JOIN f ON floor(x + 0.5)::BIGINT = px AND floor(y + 0.5)::BIGINT = py""")
def depth_visibility(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 20 + F.lit(0.3)).alias("x"), (F.col("p_partkey") % 20 + F.lit(0.7)).alias("y"), (F.col("p_retailprice") / 100).alias("d"), "p_size")
    at = p.where("id % 3 <> 0").select(F.floor(F.col("x") + 0.5).cast("long").alias("px"), F.floor(F.col("y") + 0.5).cast("long").alias("py"), F.col("id").alias("fid"), F.col("d").alias("fd"), (F.col("p_size") % 2 == 0).alias("ok"))
    front = at.withColumn("r", F.row_number().over(Window.partitionBy("px", "py").orderBy("fd", "fid"))).where("r = 1").drop("r")
    return pixels.visibility(p, front, "id", "x", "y", "d", "fd", "fid", "ok", p.where("id % 5 = 0").select("id"))


@query(f"WITH {_PIXEL} SELECT view, id * 10 + k AS i FROM p QUALIFY row_number() OVER (PARTITION BY view ORDER BY k = 1 DESC, CASE WHEN o = 0 THEN 0 ELSE w / o END DESC, w DESC, id * 10 + k) = 1")
def prompt_points(spark, sf_dir):
    p = _pixels(spark, sf_dir).withColumns({"anchor": F.col("k") == 1, "i": F.col("id") * 10 + F.col("k")})
    return pixels.prompt_points(p, ["view"], "anchor", "w", "o", "i")


_GRID = "g AS (SELECT p_partkey // 40 AS y, p_partkey % 40 AS x, bool_or(p_size > 20) AS b FROM part GROUP BY 1, 2)"


@query(f"WITH {_GRID} SELECT a.y, a.x, a.b AND (SELECT count(*) FROM g c WHERE c.b AND abs(c.y - a.y) <= 1 AND abs(c.x - a.x) <= 1) >= 5 AS b FROM g a")
def erosion(spark, sf_dir):
    g = t(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 40).alias("y"), (F.col("p_partkey") % 40).alias("x")).agg(F.bool_or(F.col("p_size") > 20).alias("b"))
    return geometry.eroded(g, [], "y", "x", "b")


@query(f"""WITH RECURSIVE {_GRID}, e AS (SELECT a.y * 40 + a.x AS u, c.y * 40 + c.x AS v FROM g a JOIN g c ON a.b = c.b AND abs(a.y - c.y) + abs(a.x - c.x) <= 1),
r(u, m) AS (SELECT u, u FROM e UNION SELECT e.v, r.m FROM r JOIN e ON e.u = r.u WHERE r.m < e.v) SELECT g.y, g.x, min(m) AS region FROM r JOIN g ON g.y * 40 + g.x = r.u GROUP BY ALL""")
def pixel_regions(spark, sf_dir):
    g = t(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 40).alias("y"), (F.col("p_partkey") % 40).alias("x")).agg(F.bool_or(F.col("p_size") > 20).alias("b"))
    return geometry.pixel_regions(g, "y", "x", "b").select("y", "x", "region")


@query("""
WITH q AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice / 20 AS x FROM part),
n AS (SELECT a.p_partkey, b.s AS v, (a.s - b.s) * (a.s - b.s) + (a.x - b.x) * (a.x - b.x) AS d2, row_number() OVER (PARTITION BY a.p_partkey ORDER BY sqrt((a.s - b.s) * (a.s - b.s) + (a.x - b.x) * (a.x - b.x)), b.p_partkey) AS k FROM q a, q b)
SELECT p_partkey, round(avg(v), 6) AS smoothed FROM n WHERE k <= 6 GROUP BY p_partkey""")
def knn_smoothing(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), (F.col("p_retailprice") / 20).alias("x"), F.array(F.col("p_size").cast("double")).alias("v"))
    return spatial.knn_mean(p, "p_partkey", ["s", "x"], "v", 6, 2.0).select("p_partkey", F.round(F.get("smoothed", F.lit(0)), 6).alias("smoothed"))


@query("""
SELECT p_partkey, round(0.8 * p_size - 0.6 * p_retailprice + 1, 6) AS x, round(0.6 * p_size + 0.8 * p_retailprice + 2, 6) AS y, round(3 + 0 * p_size, 6)::DOUBLE AS z FROM part""")
def rigid_transform(spark, sf_dir):
    m = [0.8, -0.6, 0.0, 1.0, 0.6, 0.8, 0.0, 2.0, 0.0, 0.0, 1.0, 3.0, 0.0, 0.0, 0.0, 1.0]
    x, y, z = V.transform_point(F.col("p_size").cast("double"), "p_retailprice", F.lit(0.0), m)
    return t(spark, sf_dir, "part").select("p_partkey", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"))


@query("""
WITH e AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
SELECT user_id::VARCHAR AS task, count(*) AS attempts, count(*) FILTER (nxt IS NULL) AS open, round(coalesce(sum((epoch_us(nxt) - epoch_us(ts)) / 1000000.0::DOUBLE * 2), 0), 3) AS seconds FROM e GROUP BY 1""")
def lease_seconds(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumns({"at": F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6), "nxt": F.lead(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))})
    log = e.select(F.col("user_id").cast("string").alias("task"), F.col("event_id").alias("lease"), F.lit("start").alias("event"), "at", F.lit(2.0).alias("gpus"))
    log = log.unionAll(e.where("nxt IS NOT NULL").select(F.col("user_id").cast("string"), "event_id", F.lit("finish"), "nxt", F.lit(0.0)))
    return sequence.lease_seconds(log).withColumn("seconds", F.round("seconds", 3))


@query("""
SELECT sequence, CASE WHEN sequence <> coalesce(s + 1, 0) THEN 'gap' WHEN previous <> h THEN 'link' WHEN v < t THEN 'time' END AS fault FROM (
 SELECT event_id AS sequence, sha256(user_id::VARCHAR) AS previous, value AS v, lag(event_id) OVER w AS s, lag(sha256(user_id::VARCHAR)) OVER w AS h, lag(value) OVER w AS t FROM events WHERE event_id % 7 <> 3 WINDOW w AS (ORDER BY event_id)) WHERE fault IS NOT NULL""")
def chain_faults(spark, sf_dir):
    h = F.sha2(F.col("user_id").cast("string"), 256)
    log = t(spark, sf_dir, "events").where("event_id % 7 <> 3").select(F.col("event_id").alias("sequence"), h.alias("previous_sha256"), h.alias("sha256"), F.col("value").alias("at"))
    return sequence.chain_faults(log)


@query("""
WITH c AS (SELECT n_nationkey, n_regionkey, ln(avg(c_acctbal + 2000)) AS q FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 0 GROUP BY ALL),
p AS (SELECT n_regionkey, avg(q) AS q FROM c WHERE n_regionkey < 3 GROUP BY n_regionkey), g AS (SELECT avg(q) AS q FROM c)
SELECT n.n_nationkey, round(exp(coalesce(c.q, p.q, g.q)), 4) AS size FROM nation n LEFT JOIN c USING (n_nationkey) LEFT JOIN p ON p.n_regionkey = n.n_regionkey CROSS JOIN g""")
def resolved_prior(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    c = t(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).where("n_nationkey % 2 = 0").groupBy("n_nationkey", "n_regionkey").agg(F.log(F.avg(F.col("c_acctbal") + 2000)).alias("q"))
    none = F.lit(None).cast("int")
    priors = c.select(F.lit("class").alias("level"), none.alias("parent"), F.col("n_nationkey").alias("class"), "q")
    priors = priors.unionAll(c.where("n_regionkey < 3").groupBy("n_regionkey").agg(F.avg("q").alias("q")).select(F.lit("parent"), "n_regionkey", none, "q"))
    priors = priors.unionAll(c.agg(F.avg("q").alias("q")).select(F.lit("global"), none, none, "q"))
    items = n.select("n_nationkey", "n_regionkey")
    return quantile.resolved_prior(items, priors, "n_nationkey", "n_regionkey", ["q"]).select("n_nationkey", F.round("q", 4).alias("size"))


@query("""
SELECT l_orderkey, l_suppkey AS k FROM (SELECT o_orderkey AS l_orderkey, coalesce(n, o_custkey) AS l_suppkey FROM orders LEFT JOIN (SELECT l_orderkey AS k, min(l_suppkey) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY l_orderkey) ON k = o_orderkey)""")
def committed_changes(spark, sf_dir):
    current = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("k"))
    changes = t(spark, sf_dir, "lineitem").where("l_quantity > 49").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("k"))
    return ownership.committed(current, changes, "l_orderkey", "k")


@query()
def yaw_boxes(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"), (F.col("l_discount") * 100).alias("z"), (F.col("l_quantity") > 49).alias("big"))
    return geometry.yaw_boxes(li, "l_suppkey", skip="big").select("l_suppkey", F.array_join(F.transform("box", lambda v: F.round(v, 4).cast("string")), ",").alias("box"))


@query("SELECT o_orderkey, round(least(greatest(1.5 * 300 * o_totalprice / 100000 / 5, 64), 336), 6)::DOUBLE AS side FROM orders")
def crop_sides(spark, sf_dir):
    side = S.crop_side(F.lit(300.0), F.col("o_totalprice") / 100000, F.lit(5.0), F.lit(336.0))
    return t(spark, sf_dir, "orders").select("o_orderkey", r6(side).alias("side"))
