"""The folder that a session's driver and executors share, and tables written into it."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local session without one gets a temporary folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return qualified(spark, named)
    own = getattr(spark, "_tidemark_folder", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = spark._tidemark_folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return own


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as Hadoop's settings resolve it; local ones as ``file:///...``."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(own).toString().rstrip("/")
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def is_folder(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(own).isDirectory()


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Writes a frame once into the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._staged = path
    for held in getattr(spark, "_tidemark_scratch", ()):
        held.append(out)
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, every table that was staged inside it: results have to be written or collected by then."""
    own: list[DataFrame] = []
    spark._tidemark_scratch = [*getattr(spark, "_tidemark_scratch", ()), own]
    try:
        yield
    finally:
        spark._tidemark_scratch = [x for x in spark._tidemark_scratch if x is not own]
        discard(*own)


def discard(*frames: DataFrame | None) -> None:
    """Deletes staged tables; nothing that is still to be computed may read them."""
    for frame in frames:
        path = getattr(frame, "_staged", None)
        if path:
            spark = frame.sparkSession
            own = spark._jvm.org.apache.hadoop.fs.Path(path)
            own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)
