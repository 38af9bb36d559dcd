"""Row numbers and running sums over a whole table, without a window that holds all rows.

Rows are range-partitioned by the order and written; counts and sums of the parts are added up (a row for each part), and
a window inside each part does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written


def numbered(rows: DataFrame, order: list[str | Column], name: str = "_n", sums: dict[str, str] | None = None) -> DataFrame:
    """Rows with their number in the order, from 0, and for each of `sums` the running sum up to and with the row."""
    sums = sums or {}
    part = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    each = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_count"), *[F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    firsts = each.select("_part", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_first"), *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_first_{k}") for k in sums])
    within = Window.partitionBy("_part").orderBy(*order)
    out = part.withColumns({name: F.row_number().over(within) - 1, **{f"_run_{k}": F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, 0)) for k, c in sums.items()}})
    out = out.join(F.broadcast(firsts), "_part")
    added = {name: (F.col(name) + F.col("_first")).cast("long"), **{k: F.col(f"_run_{k}") + F.col(f"_first_{k}") for k in sums}}
    return out.withColumns(added).drop("_part", "_first", *[f"_run_{k}" for k in sums], *[f"_first_{k}" for k in sums])


def shares(rows: DataFrame, value: str, name: str) -> DataFrame:
    """value, name: the share of rows that are no larger, for each distinct value (nulls come first)."""
    n = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    run = numbered(n, [value], "_k", {"_s": "_c"})
    total = n.agg(F.sum("_c").alias("_t"))
    return run.crossJoin(F.broadcast(total)).select(value, (F.col("_s") / F.col("_t").cast("double")).alias(name))  # one row
