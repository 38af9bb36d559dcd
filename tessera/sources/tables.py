"""Tables and documents in files: dispatch on the suffix, strict parsing, atomic single files, inventories."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_rows(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """.parquet, .jsonl (blank lines skipped, anything but an object raises) or .csv (all strings); others raise."""
    suffix = PurePosixPath(path.rstrip("/")).suffix
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".jsonl":
        reader = spark.read.option("mode", "FAILFAST")
        return (reader.schema(schema) if schema else reader).json(path)
    if suffix == ".csv":
        return spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    raise ValueError(f"no reader for {suffix!r}")


def write_rows(df: DataFrame, path: str) -> None:
    """By suffix; CSV and JSONL have their columns in alphabetical order."""
    suffix = PurePosixPath(path.rstrip("/")).suffix
    ordered = df.select(*sorted(df.columns))
    if suffix == ".parquet":
        df.write.parquet(path)
    elif suffix == ".jsonl":
        ordered.write.option("ignoreNullFields", False).json(path)
    elif suffix == ".csv":
        ordered.write.option("header", True).csv(path)
    else:
        raise ValueError(f"no writer for {suffix!r}")


def canonical_json(value) -> bytes:
    """Compact UTF-8 with sorted keys; NaN raises."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def write_json(path: str, value) -> None:
    """A driver-side file that is there whole or not at all."""
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".part")
    with os.fdopen(fd, "wb") as f:
        f.write(canonical_json(value))
    os.replace(tmp, path)


def write_once(path: str, value) -> bool:
    """Publishes a value; the same again is no change (False), another raises."""
    body = canonical_json(value)
    try:
        with open(path, "xb") as f:
            f.write(body)
        return True
    except FileExistsError:
        if open(path, "rb").read() != body:
            raise ValueError(f"{path} holds something else") from None
        return False


def file_manifest(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (below the root), size and sha256 of each file, hashed where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").removeprefix("file://")
    return files.select(F.substring_index(F.col("path"), base + "/", -1).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def missing_files(manifest: DataFrame, required: list[str]) -> DataFrame:
    want = manifest.sparkSession.createDataFrame([(x,) for x in required], "path string")
    return want.join(manifest, "path", "left_anti")


def scene_ids(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed id per line; blank lines go, repeated ids raise."""
    ids = spark.read.text(path).select(F.trim("value").alias("scene_id")).where("scene_id <> ''")
    twice = ids.groupBy("scene_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated scene {twice[0].scene_id}")
    return ids


def axis_alignment(spark: SparkSession, path: str) -> DataFrame:
    """matrix (16 doubles by rows) from the line `axisAlignment = ...`; another count raises."""
    line = spark.read.text(path).where(F.col("value").rlike(r"^\s*axisAlignment\s*="))
    m = F.transform(F.split(F.trim(F.regexp_extract("value", r"=\s*(.*)$", 1)), r"\s+"), lambda x: x.try_cast("double"))
    whole = F.when((F.size(m) == 16) & F.forall(m, lambda x: x.isNotNull()), m).otherwise(F.raise_error(F.lit("an alignment of other than 16 numbers")).cast("array<double>"))
    # Spark may look at the matrix before it drops the other lines, so these mustn't raise.
    return line.select(F.when(F.col("value").rlike(r"^\s*axisAlignment\s*="), whole).alias("matrix"))


def save_bank(rows: DataFrame, path: str) -> None:
    """Writes a bank once: where there is one already, this raises."""
    rows.write.mode("errorifexists").parquet(path)


def load_bank(spark: SparkSession, path: str, required: list[str], key: str) -> DataFrame:
    """A bank's rows; lacking columns, and rows without a key or with one that occurs twice, raise."""
    rows = spark.read.parquet(path)
    lacking = set(required) - set(rows.columns)
    if lacking:
        raise ValueError(f"a bank without {sorted(lacking)}")
    n = rows.groupBy(F.col(key).alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    at = rows.join(n, F.col(key) == F.col("_of"), "left")
    good = F.when(F.coalesce("_n", F.lit(0)) == 1, F.col(key)).otherwise(F.raise_error(F.lit("a bank's key is lacking or repeated")).cast(rows.schema[key].dataType))
    return at.withColumn(key, good).select(*required)


class EvidenceStore:
    """Content-addressed, immutable results: partitioned by the first two digits of the identity's hash."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def key(identity) -> str:
        return hashlib.sha256(canonical_json(identity)).hexdigest()

    def rows(self) -> DataFrame | None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.schema("key string, identity string, result string, sha256 string, prefix string").parquet(self.root)

    def put(self, rows: DataFrame) -> None:
        """Adds rows (key, identity, result) of which the key isn't there yet."""
        new = rows.dropDuplicates(["key"]).withColumns({"sha256": F.sha2("result", 256), "prefix": F.substring("key", 1, 2)})
        have = self.rows()
        if have is not None:
            new = new.join(have.select("key", "prefix"), ["key", "prefix"], "left_anti")
        new.write.mode("append").partitionBy("prefix").parquet(self.root)

    def get(self, identity) -> str | None:
        """One result by its identity; reads one partition, and raises if what is stored was damaged."""
        have, key = self.rows(), self.key(identity)
        if have is None:
            return None
        found = have.where((F.col("prefix") == key[:2]) & (F.col("key") == key)).limit(1).collect()
        if not found:
            return None
        r = found[0]
        if hashlib.sha256(r.result.encode()).hexdigest() != r.sha256 or r.identity.encode() != canonical_json(identity):
            raise ValueError("a stored result doesn't match its identity")
        return r.result
