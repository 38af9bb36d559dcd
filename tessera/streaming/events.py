"""Streams of events: windowed votes with watermarks, exactly-once sinks, and leases kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.graph import scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 100, pattern: str = "*") -> DataFrame:
    """New Parquet files in a folder, of names that match, as a stream; `ts` as an event time."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_votes(stream: DataFrame, choice: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, end, choice, votes of tumbling (or sliding) windows; what is later than the watermark is left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    votes = stream.withWatermark("ts", late).groupBy(w.alias("w"), choice).agg(F.count(F.lit(1)).alias("votes"))
    return votes.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), choice, "votes")


def sessions(stream: DataFrame, by: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """by, start, end, n of sessions that a silence of `gap` ends."""
    s = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return s.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(stream: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first of each key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def leases(stream: DataFrame) -> DataFrame:
    """task, lease, seconds (finish less start, times GPUs) as leases end; stream: task, lease, event, at (seconds), gpus.

    A group is one lease: its open start is the state. A finish without a start waits for it; a second start is
    ignored."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end, gpus = state.get if state.exists else (None, None, None)
        for pdf in batches:
            for r in pdf.sort_values("at").itertuples():
                if r.event == "start" and start is None:
                    start, gpus = float(r.at), float(r.gpus)
                elif r.event == "finish":
                    end = float(r.at) if end is None else max(end, float(r.at))
        if start is not None and end is not None:
            state.remove()
            yield pd.DataFrame({"task": [key[0]], "lease": [key[1]], "seconds": [(end - start) * gpus]})
        else:
            state.update((start, end, gpus))

    return stream.groupBy("task", "lease").applyInPandasWithState(run, "task string, lease string, seconds double", "start double, end double, gpus double", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str, name: str = "stream") -> DataFrame:
    """Runs a stream over what is there now; the rows of its last state (complete) or all it appended."""
    spark = stream.sparkSession
    at = scratch(spark, name)

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch={k}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    schema = stream.schema
    rows = spark.read.schema(schema).parquet(f"{at}/out")
    return rows.select(*schema.fieldNames())


class EvidenceLog:
    """Observations that are appended and revoked by role, never changed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, rows: DataFrame) -> None:
        """rows: uid, role, version, payload."""
        rows.write.mode("append").parquet(f"{self.root}/observations")

    def revoke(self, rows: DataFrame) -> None:
        """rows: uid, version, reason."""
        rows.write.mode("append").parquet(f"{self.root}/revocations")

    def active(self, role: str, version: int | None = None) -> DataFrame:
        """What a role holds at a version (the newest by default)."""
        rows = self.spark.read.parquet(f"{self.root}/observations").where(F.col("role") == role)
        try:
            gone = self.spark.read.parquet(f"{self.root}/revocations")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            gone = self.spark.createDataFrame([], "uid string, version long, reason string")
        if version is not None:
            rows, gone = rows.where(F.col("version") <= version), gone.where(F.col("version") <= version)
        return rows.join(gone.select("uid"), "uid", "left_anti")
