"""Sharded storage with size-tiered compaction and versioned manifests.

Arrivals are appended as small immutable shards.  Shards belong to tiers by
size, each tier ``fanout`` times the one below; once a tier has ``fanout``
shards they are merged into files of the target size.  A version is a manifest
(the shards that make up the store); it comes into being by one atomic rename
that fails if the version exists, so writers that race see a conflict and
readers see a whole version or none.  Files are never changed, and go only
once no kept version names them, no writer has announced them, and their lease
is over.
"""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import light, new_path

_MANIFEST = "path string, rows long, bytes long, tier int, since long"


class Conflict(Exception):
    """Another writer committed the same version first."""


class ShardStore:
    """A store under ``root``: ``shards/``, ``manifests/``, one small file per version in ``versions/``, and one in ``intents/`` per folder of shards that is not committed yet."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, least_bytes: int = 1 << 20, fanout: int = 4):
        self.spark, self.root, self.target, self.least, self.fanout = spark, root, target_bytes, least_bytes, fanout
        self._files = spark._jvm.org.apache.hadoop.fs
        self._announced: list[str] = []
        self._context = self._files.FileContext.getFileContext(self._files.Path(root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._files.Path("/".join([self.root, *parts]))

    def versions(self) -> list[int]:
        """Committed versions in order."""
        if not self._context.util().exists(self._path("versions")):
            return []
        names = [s.getPath().getName() for s in self._context.util().listStatus(self._path("versions"))]
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest_path(self, version: int) -> str:
        stream = self._context.open(self._path("versions", f"{version:012d}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """Shards of a version (the latest by default): ``path, rows, bytes, tier, since``."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(self._manifest_path(known[-1] if version is None else version))

    def commit(self, shards: DataFrame, version: int) -> None:
        """Makes ``shards`` the version, or raises Conflict if there is one already."""
        path = f"{self.root}/manifests/{uuid.uuid4().hex}"
        shards.write.parquet(path)
        draft = self._path("versions", f".{uuid.uuid4().hex}")
        self._put(draft, path)
        rename = self.spark.sparkContext._gateway.new_array(getattr(self._files.Options, "Rename"), 1)
        rename[0] = getattr(self._files.Options, "Rename").NONE
        try:
            self._context.rename(draft, self._path("versions", f"{version:012d}"), rename)
        except Exception as failed:
            if "FileAlreadyExists" in str(failed):
                self._context.delete(draft, False)
                raise Conflict(f"version {version} exists") from failed
            raise
        while self._announced:
            self._context.delete(self._path("intents", self._announced.pop()), False)

    def _put(self, path, text: str) -> None:
        """Creates a small file."""
        flags = self.spark._jvm.java.util.EnumSet.of(self._files.CreateFlag.CREATE)
        options = self.spark.sparkContext._gateway.new_array(self._files.Options.CreateOpts, 1)
        options[0] = self._files.Options.CreateOpts.createParent()
        stream = self._context.create(path, flags, options)
        stream.write(text.encode())
        stream.close()

    def _written(self, rows: DataFrame, version: int, most_rows: int = 0) -> DataFrame:
        """Writes rows as new shards, a file per partition (or per ``most_rows`` rows), and describes them."""
        folder = uuid.uuid4().hex
        path = f"{self.root}/shards/{folder}"
        self._put(self._path("intents", folder), "")
        self._announced.append(folder)
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", most_rows).parquet(path)
        files = self.spark.read.parquet(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        return files.groupBy("path", "bytes").agg(F.count("*").alias("rows")).select("path", "rows", "bytes", self._tier().alias("tier"), F.lit(version).cast("long").alias("since"))

    def _tier(self) -> Column:
        """0 below the least size, then one more for each ``fanout`` times of it."""
        return F.greatest(F.lit(0), F.floor(F.log(F.col("bytes") / self.least) / math.log(self.fanout)) + 1).cast("int")

    def append(self, rows: DataFrame, most_rows: int = 50_000) -> int:
        """Adds an arrival as small shards of at most ``most_rows`` rows and returns the new version."""
        version = (self.versions() or [0])[-1] + 1
        self.commit(self.manifest().unionByName(self._written(rows, version, most_rows)), version)
        return version

    def compact(self) -> int | None:
        """Merges every tier that is full, lowest first, until none is; returns the last new version, if any.

        The shards of a tier are packed whole into read partitions of the
        target size, which are then written: no shuffle, and a task's work is
        bounded by the target.  A merge that would not leave fewer shards is
        given up.
        """
        done: int | None = None
        given_up: set[int] = set()
        while True:
            small = self.manifest().where(F.col("bytes") < self.target // 2)
            full = [r.tier for r in small.groupBy("tier").count().where(F.col("count") >= self.fanout).orderBy("tier").collect() if r.tier not in given_up]
            if not full:
                return done
            old = small.where(F.col("tier") == full[0])
            paths = [r.path for r in old.orderBy("bytes", "path").select("path").toLocalIterator()]
            version = self.versions()[-1] + 1
            merged = self._written(self._packed(paths), version)
            if merged.count() >= len(paths):
                given_up.add(full[0])
                continue
            self.commit(self.manifest().join(old.select("path"), "path", "left_anti").select("path", "rows", "bytes", "tier", "since").unionByName(merged), version)
            done = version

    def _packed(self, paths: list[str]) -> DataFrame:
        """Files of like size together, as many whole files to a partition as make up the target."""
        session = self.spark.newSession()
        session.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        session.conf.set("spark.sql.files.openCostInBytes", "0")
        session.conf.set("spark.sql.files.minPartitionNum", "1")
        return session.read.parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        paths = [r.path for r in self.manifest(version).select("path").toLocalIterator()]
        if not paths:
            raise ValueError("the version has no rows")
        return self.spark.read.parquet(*paths)

    def vacuum(self, keep: int = 2, lease: float = 3600, abandoned: float = 7 * 86400) -> int:
        """Deletes folders of shards that none of the last ``keep`` versions (two at least) names; returns how many.

        A folder younger than ``lease`` seconds stays, and so does one that a
        writer has announced, unless that was ``abandoned`` seconds ago.  A
        reader must be done, or read again, within the lease of the version
        after the next.
        """
        named = None
        for v in self.versions()[-max(2, keep) :]:
            own = self.manifest(v).select(F.element_at(F.split("path", "/"), -2).alias("folder"))
            named = own if named is None else named.union(own)
        live = {r.folder for r in named.distinct().toLocalIterator()} if named is not None else set()
        now = time.time() * 1000
        announced = self._context.util().listStatus(self._path("intents")) if self._context.util().exists(self._path("intents")) else []
        live |= {i.getPath().getName() for i in announced if i.getModificationTime() > now - abandoned * 1000}
        gone = 0
        for status in self._context.util().listStatus(self._path("shards")):
            if status.getPath().getName() not in live and status.getModificationTime() <= now - lease * 1000:
                gone += bool(self._context.delete(status.getPath(), True))
        return gone


def arrive_and_compact(docs: DataFrame, arrivals: int = 5, most_rows: int = 50_000, target_bytes: int = 128 << 20) -> DataFrame:
    """Rows of ``docs`` stored in several arrivals with compaction after each, and read back.

    One row per document: its columns, and ``shard, shard_bytes, tier`` (the
    file it came from and that file's place in the manifest) and ``version``
    (the manifest read); a column of those names in ``docs`` gives way.
    Arrivals are dealt by a hash of the row, so no id or copy makes one of them
    large beyond its rows.  Nulls, empty and long texts and repeated rows are
    stored as they are.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "shard_bytes", "tier", "version")
    store = ShardStore(spark, new_path(spark, "store"), target_bytes)
    deal = F.pmod(F.xxhash64(*docs.columns), F.lit(arrivals))
    for k in range(arrivals):
        store.append(docs.where(deal == k), most_rows)
        if store.compact() is not None:
            store.vacuum(lease=0)  # nobody else knows this store
    version = store.versions()[-1]
    if store.manifest(version).isEmpty():
        return docs.limit(0).select("*", F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).alias("tier"), F.lit(version).cast("long").alias("version"))
    # what is not in the manifest with its size and tier gets no shard
    known = store.manifest(version).select(F.element_at(F.split("path", "/"), -1).alias("shard"), F.col("bytes").alias("shard_bytes"), "tier")
    rows = store.read(version).select("*", F.col("_metadata.file_name").alias("shard"), F.lit(version).cast("long").alias("version"))
    return rows.join(light(known, known.count()), "shard", "left").select(*docs.columns, "shard", "shard_bytes", "tier", "version")
