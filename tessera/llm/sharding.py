"""Sharding by size-tiered compaction, in DataFrame operations only.

An arrival is appended as it comes: each task writes a small immutable shard (a file), without a shuffle.
Compaction puts shards into tiers by their bytes of text (tier 0 below BASE, each next one FAN times larger),
merges every FAN neighbouring shards of one tier into one of a higher tier, lowest tier first, and leaves
shards of TARGET bytes or more alone. All merges of a compaction are worked out on the manifest first, so a
row is rewritten once however many tiers it climbs. A merged shard is written as files of about TARGET bytes of text each:
the manifest says how many, a row goes to one of them by its number in its source file, and each file is one task.

A version of the manifest is a JSON file that lists the live shards (name, files, rows, bytes, checksum, tier).
It is written beside its place and renamed onto it, which fails if another writer has committed that version;
readers see whole versions only. Counts and checksums (of all columns) of what was written are taken by reading it
back, and those of merged shards compared with their sources before the commit. Files that no manifest lists any more stay until vacuum().

Rows are kept as they are: nulls, repeated rows, empty texts and further columns included (a null text counts 0
bytes). Of an empty table a version without shards is committed.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import workspace

BASE, FAN, TARGET = 32 << 20, 4, 128 << 20
#: Files of which the names are broadcast (about 200 bytes each); beyond it the join shuffles.
MOST_NAMES = 50_000
_SHARD = "_shard_of"


@dataclass(frozen=True)
class Shard:
    name: str
    files: tuple[str, ...]
    rows: int
    bytes: int
    check: int
    tier: int


def tier(size: int, base: int = BASE, fan: int = FAN) -> int:
    t = 0
    while size >= base * fan**t:
        t += 1
    return t


def plan(sizes: list[int], base: int = BASE, fan: int = FAN, target: int = TARGET) -> list[list[int]]:
    """Which shards (by place, in order of arrival) are one after compaction."""
    live: dict[int, tuple[list[int], int]] = {}
    tiers: dict[int, list[int]] = {}  # first places of the shards that may be merged, in order
    full: list[int] = []

    def put(places: list[int], size: int) -> None:
        live[places[0]] = (places, size)
        if size < target:
            t = tier(size, base, fan)
            bisect.insort(tiers.setdefault(t, []), places[0])
            if len(tiers[t]) == fan:
                heapq.heappush(full, t)

    def merge() -> None:
        t = full[0]
        take, tiers[t] = tiers[t][:fan], tiers[t][fan:]
        if len(tiers[t]) < fan:
            heapq.heappop(full)
        old = [live.pop(k) for k in take]
        put(sorted(i for places, _ in old for i in places), sum(x for _, x in old))

    for k, s in enumerate(sizes):
        put([k], s)
    while full:
        merge()
    return [places for _, (places, _) in sorted(live.items())]


class Store:
    """Shards of one table below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, text: str = "text", key: str = "doc_id"):
        self.spark, self.root, self.text, self.key = spark, root.rstrip("/"), text, key

    def _files(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, rows: list[tuple], schema: str) -> DataFrame:
        """A table with a row for each file, sent to all tasks where it is small enough."""
        names = self.spark.createDataFrame(rows, schema)
        return F.broadcast(names) if len(rows) <= MOST_NAMES else names

    def versions(self) -> list[int]:
        _, p, fs = self._files(f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[1:-5]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> list[Shard]:
        at = version if version is not None else max(self.versions(), default=0)
        if not at:
            return []
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.root}/manifest/v{at:08d}.json", wholetext=True).collect())
        return [Shard(**x | {"files": tuple(x["files"])}) for x in json.loads(text)]

    def commit(self, shards: list[Shard], after: int) -> int:
        """Makes version after + 1; raises if someone else has made it."""
        body = bytearray(json.dumps([asdict(s) for s in shards]).encode())
        jvm, tmp, fs = self._files(workspace_name(self.root))
        out = fs.create(tmp, False)
        out.write(body)
        out.close()
        to = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/v{after + 1:08d}.json")
        fs.mkdirs(to.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(tmp, to, none)
        return after + 1

    def _measured(self, at: str, by: str | None = None) -> list[Shard]:
        """The shards that were just written below a folder: a file each, or a value of column `by` each."""
        rows = self.spark.read.parquet(at)
        size = F.coalesce(F.octet_length(F.col(self.text).cast("binary")), F.lit(0))
        plain = [c for c, k in rows.dtypes if c != by and "map<" not in k and k != "variant"]
        nulls = F.concat(*[F.isnull(c).cast("int").cast("string") for c in sorted(plain)])
        check = F.sum(F.xxhash64(nulls, *sorted(plain)) % 1_000_003)
        file = F.col("_metadata.file_path")
        keys = [file.alias("file")] + ([F.col(by).alias("name")] if by else [])
        found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"), check.alias("c"), F.min(self.key).alias("least")).collect()  # a row for each file
        groups: dict[str, list] = {}
        for r in found:
            groups.setdefault(str(r.name) if by else r.file, []).append(r)
        out = []
        for name, x in groups.items():
            b = sum(r.b for r in x)
            out.append((min((r.least is not None, r.least or 0) for r in x), Shard(name, tuple(sorted(r.file for r in x)), sum(r.n for r in x), b, sum(r.c or 0 for r in x), tier(b))))
        return [s for _, s in sorted(out, key=lambda x: (x[0], x[1].name))]

    def append(self, rows: DataFrame) -> int:
        """Commits a version with one more shard for each task that has rows."""
        before = max(self.versions(), default=0)
        live = self.manifest(before)
        at = f"{workspace_name(self.root + '/data')}"
        rows.write.option("compression", "zstd").parquet(at)
        new = [Shard(f"a{before + 1:06d}-{k:06d}", s.files, s.rows, s.bytes, s.check, s.tier) for k, s in enumerate(self._measured(at)) if s.rows]
        return self.commit(live + new, before)

    def compact(self, base: int = BASE, fan: int = FAN, target: int = TARGET) -> int:
        """Merges what the tiers ask for and commits the outcome; the version stays if there is nothing to do."""
        before = max(self.versions(), default=0)
        live = self.manifest(before)
        groups = plan([s.bytes for s in live], base, fan, target)
        merged = [g for g in groups if len(g) > 1]
        if not merged:
            return before
        names = {g[0]: f"m{before + 1:06d}-{k:06d}" for k, g in enumerate(merged)}
        size = {g[0]: max(1, -(-sum(live[k].bytes for k in g) // target)) for g in merged}  # files
        first = dict(zip(size, itertools.accumulate([0, *size.values()])))
        of = [(f, names[g[0]], size[g[0]], first[g[0]]) for g in merged for k in g for f in live[k].files]
        to = self._names(of, f"_file string, {_SHARD} string, _of int, _first int")
        sources = self.spark.read.parquet(*[x[0] for x in of])
        place = (F.col("_first") + F.pmod("_row", F.col("_of"))).cast("int")
        rows = sources.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")}).join(to, "_file").withColumn("_place", place)
        rows = rows.repartitionById(sum(size.values()), "_place").select(*sources.columns, _SHARD)
        at = f"{workspace_name(self.root + '/data')}"
        rows.write.option("compression", "zstd").partitionBy(_SHARD).parquet(at)
        made = {s.name: s for s in self._measured(at, _SHARD)}
        out = []
        for g in groups:
            if len(g) == 1:
                out.append(live[g[0]])
                continue
            s = made[names[g[0]]]
            old = [live[k] for k in g]
            if (s.rows, s.bytes, s.check) != (sum(x.rows for x in old), sum(x.bytes for x in old), sum(x.check for x in old)):
                raise RuntimeError(f"shard {s.name} differs from its sources")
            out.append(Shard(s.name, s.files, s.rows, s.bytes, s.check, tier(s.bytes, base, fan)))
        return self.commit(out, before)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version (None if it has no shards), with `_shard` and `_tier` of each one's shard."""
        live = self.manifest(version)
        of = [(f, s.name, s.tier) for s in live for f in s.files]
        if not of:
            return None
        names = self._names(of, "_file string, _shard string, _tier int")
        rows = self.spark.read.parquet(*[f for f, _, _ in of])
        return rows.withColumn("_file", F.col("_metadata.file_path")).join(names, "_file").drop("_file")

    def vacuum(self) -> int:
        """Deletes files that no version lists from the newest on; returns how many."""
        keep = {f.split("/data/")[-1] for s in self.manifest() for f in s.files}
        _, p, fs = self._files(f"{self.root}/data")
        if not fs.exists(p):
            return 0
        found, gone = fs.listFiles(p, True), 0
        while found.hasNext():
            f = found.next().getPath()
            if f.getName().endswith(".parquet") and f.toString().split("/data/")[-1] not in keep:
                fs.delete(f, False)
                gone += 1
        return gone


def workspace_name(below: str) -> str:
    return f"{below}/{uuid.uuid4().hex}"


def sharded(docs: DataFrame, base: int = BASE, fan: int = FAN, target: int = TARGET) -> DataFrame:
    """doc_id, shard, tier, n_bytes, text_sha256 of every document as the committed shards hold it."""
    spark = docs.sparkSession
    store = Store(spark, workspace(spark, "shards"))
    store.append(docs)
    store.compact(base, fan, target)
    rows = store.read()
    if rows is None:
        rows = docs.withColumns({"_shard": F.lit(""), "_tier": F.lit(0)}).where("false")
    return rows.select("doc_id", F.col("_shard").alias("shard"), F.col("_tier").alias("tier"), F.coalesce(F.octet_length(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
