"""Raw daily trade files: readers, day from the file's name, coverage against a calendar."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.daily import DailyTrades
from tidemark.sources.tapes import DAY


def day_of(path: Column) -> Column:
    """The first ``yyyy-mm-dd`` in a file's name as a date, or null."""
    return F.try_to_timestamp(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")).cast("date")


def read_raw(spark: SparkSession, folder: str, limit_files: int | None = None) -> DataFrame:
    """Rows of all csv and zip files under a folder as text, with their path, symbol and day; raises if there are none.

    A file is a partition; conditions on ``day`` or ``symbol`` right on this
    frame leave other files closed: the session is told to hand filters to
    Python sources.
    """
    spark.dataSource.register(DailyTrades)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("daily_trades")
    return (reader.option("limitFiles", limit_files) if limit_files else reader).load(folder)


def raw_stream(spark: SparkSession, folder: str, days_per_batch: int | None = None) -> DataFrame:
    """The same files as a stream, in the order of their days, ``days_per_batch`` to a micro-batch."""
    spark.dataSource.register(DailyTrades)
    reader = spark.readStream.format("daily_trades")
    return (reader.option("daysPerBatch", days_per_batch) if days_per_batch else reader).load(folder)


def symbol_of(path: Column) -> Column:
    """What stands before ``-trades-`` in a file's name, or null."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^(.+)-trades-", 1), F.lit(""))


def write_raw(tape: DataFrame, folder: str) -> DataFrame:
    """Writes a tape as headerless zipped csv files, one per symbol and day, and returns ``path, rows``.

    A file is made by one task in memory, as such files are: a day of one symbol.
    """
    order = ["trade_id", "price", "qty", "dollar", "ms", "maker", "match"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        symbol, day = key
        name = f"{symbol}-trades-{day}"
        rows = rows.sort_values(["us", "trade_id"]).assign(ms=rows["us"] // 1000, maker="true", match="true")
        content = io.BytesIO()
        with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(f"{name}.csv", rows[order].to_csv(header=False, index=False))
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{name}.zip") as file:
            file.write(content.getvalue())
        return pd.DataFrame([(f"{folder}/{name}.zip", len(rows))])

    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("us") / DAY).cast("int")).cast("string")
    return tape.withColumn("day", day).groupBy("symbol", "day").applyInPandas(run, "path string, rows long")


def url_of(base: Column, market: Column, symbol: Column, day: Column) -> Column:
    """Where a daily file of trades lies: ``spot`` and futures markets have folders of their own under ``base``."""
    name = F.concat(symbol, F.lit("-trades-"), day, F.lit(".zip"))
    return F.concat_ws("/", base, F.when(market == "spot", F.lit("spot")).otherwise(F.concat(F.lit("futures/"), market)), F.lit("daily"), F.lit("trades"), symbol, name)


def day_totals(raw: DataFrame) -> DataFrame:
    """Traded value and quantity by day, straight from raw rows: each sum leaves out its own bad numbers only, and repeated trades count."""
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    return raw.groupBy(symbol_of(F.col("path")).alias("symbol"), day_of(F.col("path")).alias("day")).agg(F.sum(number("quote_qty")).alias("dollar"), F.sum(number("qty")).alias("qty"))


def tape_of(raw: DataFrame, symbol: str | Column | None = None) -> DataFrame:
    """Raw text as a tape with its day: bad numbers and times become null and their rows go."""
    number = {c: F.expr(f"try_cast({c} AS {t})") for c, t in (("trade_id", "bigint"), ("price", "double"), ("qty", "double"), ("quote_qty", "double"), ("time", "bigint"))}
    named = F.col("symbol") if symbol is None else F.lit(symbol) if isinstance(symbol, str) else symbol
    rows = raw.select(*(e.alias(c) for c, e in number.items()), "day", named.alias("symbol"))
    rows = rows.withColumn("dollar", F.coalesce("quote_qty", F.col("price") * F.col("qty"))).dropna(subset=["trade_id", "price", "qty", "time"])
    return rows.select("symbol", "day", "trade_id", (F.col("time") * 1000).alias("us"), "price", "qty", "dollar")


def clean_trades(raw: DataFrame, symbol: str | Column | None = None, dedupe: bool = True) -> DataFrame:
    """Raw text as a tape; of a trade that repeats in its file's day the last stays."""
    rows = tape_of(raw, symbol)
    if dedupe:
        rows = keep_last(rows, ["symbol", "day", "trade_id"], ["us"])
    return rows.drop("day")


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``; a struct maximum combines before the shuffle, so a hot key costs no sort."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return best.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in [*order, *rest])).select(*rows.columns)


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every day from ``first`` to ``last``, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 day"))).alias("day"))


def coverage(days: DataFrame, files: DataFrame, partial_after: int | None = None) -> DataFrame:
    """Expected days against ``files(day, bytes)``: complete, empty or missing.

    With ``files(day, bytes, temporary, age)`` a day of which there is only an
    unfinished download older than ``partial_after`` seconds is ``stale``.
    """
    whole = files.where("NOT temporary") if "temporary" in files.columns else files
    size = whole.groupBy("day").agg(F.max("bytes").alias("bytes"))
    out = days.join(size, "day", "left")
    status = F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") <= 0, "empty").otherwise("complete")
    if partial_after is not None:
        left = files.where(F.col("temporary") & (F.col("age") > partial_after)).select("day", F.lit(True).alias("_stale")).distinct()
        out = out.join(left, "day", "left")
        status = F.when(F.col("bytes").isNull() & F.col("_stale"), "stale").otherwise(status)
    return out.select("day", "bytes", status.alias("status"))


def missing_days(covered: DataFrame) -> DataFrame:
    """Days without a whole file, in order: what a list of downloads to repeat holds."""
    return covered.where("status <> 'complete'").select("day").orderBy("day")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Zips and unfinished downloads (``.tmp``, ``.part``) of a folder: ``path, day, bytes, temporary, age`` in seconds."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"), "modificationTime")
    names = names.where("path RLIKE '\\\\.(zip|tmp|part)$'")
    return names.select("path", day_of(F.col("path")).alias("day"), "bytes", (~F.col("path").endswith(".zip")).alias("temporary"), (F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("modificationTime")).alias("age"))


def remove_stale(spark: SparkSession, folder: str, partial_after: int) -> int:
    """Deletes unfinished downloads older than ``partial_after`` seconds; returns how many."""
    gone = 0
    for r in list_files(spark, folder).where(F.col("temporary") & (F.col("age") > partial_after)).select("path").toLocalIterator():
        own = spark._jvm.org.apache.hadoop.fs.Path(r.path)
        gone += bool(own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, False))
    return gone
