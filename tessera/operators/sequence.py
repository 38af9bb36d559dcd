"""Ordered rows: run lengths, prefix products, tiles, hash chains and leases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered


def run_lengths(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """by, run, value, length: maximal runs of equal neighbours, numbered from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    numbered = rows.select(*by, *order, value, change.alias("_c")).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("length"))


def encode_mask(pixels: DataFrame, by: list[str], index: str, bit: str) -> DataFrame:
    """by, runs: lengths of alternating runs of which the first is background, and may be 0."""
    r = run_lengths(pixels, by, [index], bit)
    runs = F.array_sort(F.collect_list(F.struct("run", "length", F.col(bit).alias("b"))))
    packed = r.groupBy(*by).agg(runs.alias("_r"))
    lead = F.when(F.get("_r", F.lit(0))["b"], F.array(F.lit(0).cast("long"))).otherwise(F.expr("array()").cast("array<bigint>"))
    return packed.select(*by, F.concat(lead, F.transform("_r", lambda x: x["length"])).alias("runs"))


def decode_mask(masks: DataFrame, by: list[str], runs: str = "runs") -> DataFrame:
    """by, index, bit of every pixel."""
    each = masks.select(*by, F.posexplode(runs).alias("k", "n"))
    w = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    at = each.withColumn("_s", F.coalesce(F.sum("n").over(w), F.lit(0))).where("n > 0")
    return at.select(*by, F.explode(F.sequence(F.col("_s"), F.col("_s") + F.col("n") - 1)).alias("index"), (F.col("k") % 2 == 1).alias("bit"))


def composite(fragments: DataFrame, by: list[str], depth: list[str], alpha: str, least: float = 1 / 255, stop: float = 1e-4) -> DataFrame:
    """Fragments that count, with transmittance before them and weight = alpha * it, front to back.

    Alphas below `least` are skipped; a fragment after which less than `stop` would pass ends its pixel."""
    w = Window.partitionBy(*by).orderBy(*depth)
    f = fragments.where(F.col(alpha) >= least)
    log = F.sum(F.log1p(-F.col(alpha))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    f = f.withColumns({"transmittance": F.exp(F.coalesce(log, F.lit(0.0)))})
    f = f.where(F.col("transmittance") * (1 - F.col(alpha)) >= stop)
    return f.withColumn("weight", F.col(alpha) * F.col("transmittance"))


def max_contributor(composited: DataFrame, by: list[str], id_: str, depth: list[str]) -> DataFrame:
    """by, id, weight, opacity: the fragment of largest weight (the first of equal ones) and the sum of weights."""
    w = Window.partitionBy(*by).orderBy(*depth)
    r = composited.withColumn("_r", F.row_number().over(w))
    best = F.max_by(F.struct(id_, "weight"), F.struct(F.col("weight"), -F.col("_r")))
    return r.groupBy(*by).agg(best.alias("_b"), F.sum("weight").alias("opacity")).select(*by, F.col(f"_b.{id_}"), F.col("_b.weight"), "opacity")


def composite_vectors(composited: DataFrame, by: list[str], vec: str) -> DataFrame:
    """by, rendered: sum of weight * vector."""
    each = composited.select(*by, "weight", F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x")).groupBy(*by, "i").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("rendered"))


def tile_ranges(rows: DataFrame, tile: str, order: list[str]) -> DataFrame:
    """tile, start, end of each tile's rows in the order of (tile, order).

    Counts by tile are summed up over ranges of tiles."""
    n = numbered(rows.groupBy(tile).agg(F.count(F.lit(1)).alias("n")), [tile], "_k", {"end": "n"})
    return n.select(tile, (F.col("end") - F.col("n")).alias("start"), "end")


def expand_tiles(boxes: DataFrame, tile: int, wide: int) -> DataFrame:
    """A row for each tile that a box x0, y0, x1, y1 touches: `tile` = row * wide + column."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.floor(F.col(b) / tile))
    rows = boxes.withColumn("_ty", F.explode(span("y0", "y1"))).withColumn("_tx", F.explode(span("x0", "x1")))
    return rows.withColumn("tile", F.col("_ty") * wide + F.col("_tx")).drop("_tx", "_ty")


def chain_faults(log: DataFrame) -> DataFrame:
    """Rows of an event log (sequence, previous_sha256, sha256, at) that break it: gap, link or time."""
    at = numbered(log, ["sequence"])
    before = at.select((F.col("_n") + 1).alias("_n"), F.col("sequence").alias("_s"), F.col("sha256").alias("_h"), F.col("at").alias("_t"))
    r = at.join(before, "_n", "left")
    fault = F.when((F.col("sequence") != F.coalesce(F.col("_s") + 1, F.lit(0))), "gap").when(F.col("_h").isNotNull() & (F.col("previous_sha256") != F.col("_h")), "link").when(F.col("at") < F.col("_t"), "time")
    return r.select("sequence", fault.alias("fault")).where("fault IS NOT NULL")


def lease_seconds(log: DataFrame, lease: str = "lease", event: str = "event", at: str = "at", gpus: str = "gpus") -> DataFrame:
    """task, attempts, open, seconds (occupied, times GPUs) from start and finish events."""
    start = log.where(F.col(event) == "start").select("task", lease, F.col(at).alias("_a"), gpus)
    end = log.where(F.col(event) == "finish").groupBy(lease).agg(F.max(at).alias("_b"))
    both = start.join(end, lease, "left")
    return both.groupBy("task").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("_b").isNull()).alias("open"), F.coalesce(F.sum((F.col("_b") - F.col("_a")) * F.col(gpus)), F.lit(0.0)).alias("seconds"))


def held_out(rows: DataFrame, order: list[str], every: int = 8) -> DataFrame:
    """Rows with `test`: each `every`-th in order, from the first."""
    return numbered(rows, order).withColumn("test", F.pmod("_n", F.lit(every)) == 0).drop("_n")
