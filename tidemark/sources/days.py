"""Tables that grow by days and are seen whole: files of a run stay hidden until one small commit names them.

Every run writes folders of its own, ``<table>/run=<id>/day=<n>``; a commit is a
file that says which run holds each day.  It is put in place by a rename that
does not overwrite, so that of two runs from one version one raises
:class:`Conflict`, and readers see all tables of a version or none of them.  A
store without atomic renames needs a commit of its own kind.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import qualified


class Conflict(Exception):
    """Another run has committed this version."""


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def committed(spark: SparkSession, root: str) -> tuple[int, dict[int, str]]:
    """The latest version (0: none) and the run that holds each of its days; one entry a day, however many rows."""
    folder = _path(spark, qualified(spark, root), "commits")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return 0, {}
    names = [f.getPath().getName() for f in system.listStatus(folder)]
    last = max((int(n) for n in names if n.isdigit()), default=0)
    if not last:
        return 0, {}
    text = spark.read.text(f"{qualified(spark, root)}/commits/{last:012d}", wholetext=True).first()[0]
    return last, {int(day): run for day, run in json.loads(text).items()}


def new_run(root: str) -> str:
    """A name for a run that no other has."""
    return uuid.uuid4().hex


def write_days(rows: DataFrame, root: str, table: str, run: str) -> None:
    """Writes a run's rows, a folder for each of their days."""
    rows.repartition("day", F.pmod(F.xxhash64("symbol"), F.lit(16))).write.partitionBy("day").option("compression", "zstd").parquet(f"{root}/{table}/run={run}")


def read_days(spark: SparkSession, root: str, table: str, days: dict[int, str], schema: str) -> DataFrame:
    """The rows of a version's days, each from the run that holds it; only those folders are opened."""
    base = f"{qualified(spark, root)}/{table}"
    system = _path(spark, base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    runs: dict[str, list[str]] = {}
    for day, run in days.items():
        path = f"{base}/run={run}/day={day}"
        if system.exists(_path(spark, path)):  # a day may have nothing in one of the tables
            runs.setdefault(run, []).append(path)
    out = spark.createDataFrame([], f"{schema}, day long")
    for run, paths in sorted(runs.items()):
        part = spark.read.option("basePath", f"{base}/run={run}").schema(f"{schema}, day long").parquet(*paths)
        out = out.unionByName(part)
    return out


def commit(spark: SparkSession, root: str, version: int, days: dict[int, str]) -> None:
    """Makes ``days`` the given version, or raises :class:`Conflict` if there is one already."""
    root = qualified(spark, root)
    files = spark._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folder = _path(spark, root, "commits")
    system = folder.getFileSystem(conf)
    system.mkdirs(folder)
    draft, place = _path(spark, root, "commits", f".{uuid.uuid4().hex}"), _path(spark, root, "commits", f"{version:012d}")
    stream = system.create(draft, False)
    stream.write(bytearray(json.dumps({str(d): r for d, r in sorted(days.items())}).encode()))
    stream.close()
    how = spark.sparkContext._gateway.new_array(getattr(files.Options, "Rename"), 1)
    how[0] = getattr(files.Options, "Rename").NONE
    try:
        files.FileContext.getFileContext(folder.toUri(), conf).rename(draft, place, how)
    except Exception as failed:
        if "FileAlreadyExists" in str(failed):
            system.delete(draft, False)
            raise Conflict(f"version {version} exists") from failed
        raise
