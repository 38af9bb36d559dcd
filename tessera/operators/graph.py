"""Connected components by alternating large and small stars, and what is built on them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a local one for this application if it runs on one machine, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        at = _own[app]
    return at.rstrip("/")


def scratch(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: later reads survive lost executors and carry no lineage."""
    at = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dropped(df: DataFrame) -> None:
    """Deletes the table that `written` returned; no later query may read it."""
    spark = df.sparkSession
    for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if at.rstrip("/").rsplit("/", 1)[0].split(":", 1)[-1].rstrip("/").endswith(shared_dir(spark).split(":", 1)[-1].rstrip("/")):
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """`node`, `component` (its least node) of every node that has an edge to another; direction does not matter.

    Nulls and loops are left out. Each round sends every neighbour to the least one around a node, first
    the larger neighbours, then the smaller; the rounds grow with the logarithm of the longest path.
    A node's neighbours are never gathered: a minimum is joined back to the edges.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = written(e, "edges")
    seen = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(down.select("u", F.col("m").alias("v")))
        e = written(small.where("u <> v").distinct(), "edges")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
