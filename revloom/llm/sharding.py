"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards (Parquet files).  Compaction looks at the
shards' sizes: those of one tier, when there are enough, are merged into files of the
target size, and so on until no tier has enough.  A reader sees what the newest manifest lists; a manifest is a new version,
written aside and put in place by one rename that fails if the version exists, so writers
that race are told apart and readers never see half of a change.  That needs a file system
whose rename is atomic, such as HDFS or a local one; an object store needs a committer of
its own.

The texts are never shuffled.  Spark's reader packs small files into read partitions of
the target size, and each partition is written as one file.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import defaultdict
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revloom.llm.common import fresh_folder

#: Bytes of a finished shard; a tier spans sizes within this factor; shards that make a
#: tier worth merging; rows of an arriving shard.
TARGET_BYTES, TIER_FACTOR, TIER_SHARDS, ARRIVAL_ROWS = 128 << 20, 4, 4, 2000
#: How many sixteenths of a table each of its arrivals holds.
ARRIVALS = (6, 1, 1, 3, 1, 1, 2, 1)


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's root
    bytes: int
    generation: int  # 0 as it arrived, then one more than the highest merged

    def tier(self, factor: int = TIER_FACTOR) -> int:
        return int(math.log(max(self.bytes, 1), factor))


class CommitConflict(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    """Shards and manifests under ``root``, a folder of a Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._renames = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._renames[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        self._utf8 = jvm.java.nio.charset.StandardCharsets.UTF_8
        self._io = jvm.org.apache.commons.io.IOUtils

    def version(self) -> int:
        """The newest committed version, 0 if there is none."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")] + [0])

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:09d}.json"))
        try:
            text = self._io.toString(stream, self._utf8)
        finally:
            stream.close()
        return [Shard(**x) for x in json.loads(text)["shards"]]

    def commit(self, shards: list[Shard], base: int) -> int:
        """Make ``shards`` version ``base`` + 1, or raise CommitConflict."""
        final, aside = f"{self.root}/manifests/v{base + 1:09d}.json", f"{self.root}/manifests/.{uuid.uuid4().hex}"
        text = json.dumps({"version": base + 1, "base": base, "shards": [asdict(s) for s in sorted(shards, key=lambda s: s.path)]})
        stream = self._fs.create(self._path(aside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self._context.rename(self._path(aside), self._path(final), self._renames)
        except Exception as e:
            self._fs.delete(self._path(aside), False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(final) from e
            raise
        return base + 1

    def _written(self, folder: str, generation: int) -> list[Shard]:
        files = [f for f in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if f.getPath().getName().endswith(".parquet")]
        return [Shard(f"{folder}/{f.getPath().getName()}", f.getLen(), generation) for f in files]

    def append(self, arrivals: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Write ``arrivals`` as small shards and commit them."""
        folder = f"shards/g0-{uuid.uuid4().hex}"
        arrivals.write.option("maxRecordsPerFile", rows).parquet(f"{self.root}/{folder}")
        while True:
            base = self.version()
            try:
                return self.commit(self.shards(base) + self._written(folder, 0), base)
            except CommitConflict:
                continue

    def append_arrivals(self, rows: DataFrame, arrival: Column, compact_to: int, rows_a_shard: int = ARRIVAL_ROWS) -> int:
        """Write ``rows`` once, those of each ``arrival`` number into shards of their own, then
        let them arrive in turn: each is committed, compacted, and what it replaced deleted,
        before the next.  The store must have no other writer; returns the version."""
        folder = f"shards/g0-{uuid.uuid4().hex}"
        rows.withColumn("__arrival", arrival).write.option("maxRecordsPerFile", rows_a_shard).partitionBy("__arrival").parquet(f"{self.root}/{folder}")
        parts = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if f.isDirectory()]
        if not parts:  # no rows: an empty shard, which tells the columns
            return self.append(rows.limit(0))
        for part in sorted(parts, key=lambda n: int(n.split("=")[1])):
            base = self.version()
            self.commit(self.shards(base) + self._written(f"{folder}/{part}", 0), base)
            self.compact(compact_to)
            for shard in {s.path for s in self.shards(base + 1)} - {s.path for s in self.shards()}:
                self._fs.delete(self._path(f"{self.root}/{shard}"), False)
        return self.version()

    def due(self, shards: list[Shard], target: int, factor: int = TIER_FACTOR, least: int = TIER_SHARDS) -> list[list[Shard]]:
        """Shards to merge, by tier: of tiers below the target that hold ``least`` or more."""
        tiers = defaultdict(list)
        for s in shards:
            if s.bytes * 2 <= target:
                tiers[s.tier(factor)].append(s)
        return [tiers[k] for k in sorted(tiers) if len(tiers[k]) >= least]

    def compact(self, target: int = TARGET_BYTES) -> int:
        """Merge runs of similar size into files of about ``target`` bytes, one tier after the
        other and until nothing is due; returns the version.

        If another writer commits meanwhile, what it added is kept; if it removed a shard
        that was merged here, the merge is dropped.
        """
        while True:
            tiers = self.due(self.shards(), target)
            if not tiers:
                return self.version()
            before = len(self.shards())
            version = self._merge(tiers[0], target)
            if len(self.shards(version)) >= before:  # nothing became fewer
                return version

    def _merge(self, chosen: list[Shard], target: int) -> int:
        generation = 1 + max(s.generation for s in chosen)
        folder = f"shards/g{generation}-t{chosen[0].tier()}-{uuid.uuid4().hex}"
        settings = {"spark.sql.files.maxPartitionBytes": str(target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        before = {k: self.spark.conf.get(k, None) for k in settings}
        try:
            for k, v in settings.items():
                self.spark.conf.set(k, v)
            self.read(chosen).write.parquet(f"{self.root}/{folder}")
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        merged, gone = self._written(folder, generation), {s.path for s in chosen}
        while True:
            base = self.version()
            now = self.shards(base)
            if not gone <= {s.path for s in now}:
                return base
            try:
                return self.commit([s for s in now if s.path not in gone] + merged, base)
            except CommitConflict:
                continue

    def read(self, shards: list[Shard] | None = None) -> DataFrame:
        shards = self.shards() if shards is None else shards
        return self.spark.read.parquet(*[f"{self.root}/{s.path}" for s in shards])

    def vacuum(self, keep_versions: int = 1, older_than: float = 7 * 86_400.0) -> int:
        """Delete folders of shards that none of the newest ``keep_versions`` manifests lists,
        if they were last changed over ``older_than`` seconds ago: younger ones may belong to
        a writer that hasn't committed yet.  Returns how many."""
        newest = self.version()
        live = {s.path.split("/")[1] for v in range(max(1, newest - keep_versions + 1), newest + 1) for s in self.shards(v)}
        before = (time.time() - older_than) * 1000
        gone = [f.getPath() for f in self._fs.listStatus(self._path(f"{self.root}/shards")) if f.getPath().getName() not in live and f.getModificationTime() <= before]
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)


def sharded(docs: DataFrame, root: str | None = None, target: int = TARGET_BYTES, rows: int = ARRIVAL_ROWS) -> DataFrame:
    """``docs`` as read back from a store after append and compaction.

    Adds ``shard`` (file name), ``shard_bytes`` and ``generation``; a column of ``docs``
    with such a name is kept under ``docs_`` and its name.  The rows arrive in parts of
    unequal size, drawn by a hash of the row's place, one after the other.  All rows and
    columns survive, nulls and repeats included.  An empty table has one empty shard or none.
    """
    spark = docs.sparkSession
    added = ("shard", "shard_bytes", "generation")
    for name in added:
        if name in docs.columns:
            docs = docs.withColumnRenamed(name, f"docs_{name}")
    store = ShardStore(spark, root or fresh_folder(spark, "shards"))
    slots = F.array(*[F.lit(k) for k, n in enumerate(ARRIVALS) for _ in range(n)])
    store.append_arrivals(docs, F.get(slots, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(sum(ARRIVALS))).cast("int")), target, rows)
    file = F.col("_metadata")
    generation = F.regexp_extract(file["file_path"], r"/shards/g(\d+)-[^/]+/(?:[^/]+/)?[^/]+$", 1).cast("int")
    return store.read().select("*", file["file_name"].alias("shard"), file["file_size"].alias("shard_bytes"), generation.alias("generation"))


def sharding_report(docs: DataFrame, root: str | None = None) -> DataFrame:
    """doc_id, the text's digest, and shard (the file's number in its run), shard_bytes and
    generation, one row per document."""
    back = sharded(docs, root)
    number = F.regexp_extract("shard", r"^part-(\d+)-.*?(-c\d+)?\.", 1).cast("int")
    return back.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), number.alias("shard"), "shard_bytes", "generation")
