"""Tables and small results on disk: readers by extension, event lists, start inference, run metadata."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.running import numbered
from tidemark.sources.tapes import DAY


def _feather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            file = pa.ipc.open_file(pa.BufferReader(content.as_buffer()))
            for i in range(file.num_record_batches):
                yield file.get_batch(i)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet, csv (header row) or feather table, by its extension."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if kind == "feather":
        files = spark.read.format("binaryFile").load(path)
        first = files.select("content").first().content
        from pyspark.sql.pandas.types import from_arrow_schema

        schema = from_arrow_schema(pa.ipc.open_file(pa.BufferReader(first)).schema)
        return files.select("content").mapInArrow(_feather, schema)
    raise ValueError(f"no reader for {path}")


def write_bars(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Snappy parquet, partitioned by day if asked for, so that later reads open only the days they need."""
    out = rows if partition is None else rows.repartition(partition)
    writer = out.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_small(rows: DataFrame, path: str) -> None:
    """A small result table as one csv file with a header row."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def parse_events(spark: SparkSession, text: str) -> DataFrame:
    """``event_idx`` from a list like ``"3, 17,20"``; anything but whole numbers raises."""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    if any(not p.lstrip("-").isdigit() for p in parts):
        raise ValueError(f"not row numbers: {text!r}")
    return spark.createDataFrame([(int(p),) for p in parts], "event_idx long")


def events_of(rows: DataFrame, column: str, kind: str) -> DataFrame:
    """Events of a file's column: row numbers (``index``), times (``timestamp``), or times that are row numbers in nanoseconds since 1970 (``pseudo_datetimeindex``)."""
    if kind == "timestamp":
        return rows.select(F.unix_micros(F.col(column).cast("timestamp")).alias("us")).where("us IS NOT NULL")
    if kind == "index":
        return rows.select(F.col(column).cast("long").alias("event_idx")).where("event_idx IS NOT NULL")
    if kind == "pseudo_datetimeindex":
        # a time column has microseconds, so row numbers below a thousand are lost there; plain numbers keep all
        number = F.col(column).cast("long") if dict(rows.dtypes)[column] in ("bigint", "int") else F.unix_micros(F.col(column).cast("timestamp")) * 1000
        return rows.select(number.alias("event_idx")).where("event_idx IS NOT NULL")
    raise ValueError(kind)


def start_of_run(explicit_us: int | None, rows: DataFrame, mode: str = "last_output_day_end") -> DataFrame:
    """Where each symbol's run begins: the time that was given, else what :func:`next_start` finds."""
    inferred = next_start(rows, mode)
    return inferred if explicit_us is None else inferred.withColumn("start_us", F.lit(explicit_us).cast("long"))


def map_events(series: DataFrame, events: DataFrame, mode: str = "index") -> DataFrame:
    """Rows of a series that events name, by row number (``index``) or by time (``timestamp``: those that are in the series)."""
    rows = numbered(series, "event_idx")
    if mode == "index":
        return rows.join(events, "event_idx", "left_semi").select("symbol", "event_idx", "us", "price")
    if mode == "timestamp":
        return rows.join(events, "us", "left_semi").select("symbol", "event_idx", "us", "price")
    raise ValueError(mode)


def in_days(rows: DataFrame, first: int | None, last: int | None, day: str = "day") -> DataFrame:
    """Rows of days between two bounds, both included; rows without a day go."""
    out = rows.where(F.col(day).isNotNull())
    out = out if first is None else out.where(F.col(day) >= first)
    return out if last is None else out.where(F.col(day) <= last)


def look_back(last_day: int, months: int | None = None, years: float | None = None) -> tuple[int, int]:
    """First and last day (numbers since 1970) of a look-back of 30-day months or 365.25-day years that ends on ``last_day``."""
    if (months is None) == (years is None):
        raise ValueError("give months or years")
    return last_day - (30 * months if months is not None else int(years * 365.25)), last_day


def next_start(rows: DataFrame, mode: str = "last_output_day_end") -> DataFrame:
    """Where an incremental run goes on, by symbol: the midnight after the last output, or the last second of the last input day."""
    day = F.floor(F.max("us") / DAY).cast("long")
    if mode == "last_output_day_end":
        return rows.groupBy("symbol").agg(((day + 1) * DAY).alias("start_us"))
    if mode == "last_input_day_end":
        return rows.groupBy("symbol").agg((day * DAY + DAY - 1_000_000).alias("start_us"))
    raise ValueError(mode)


def run_metadata(rows: DataFrame, **settings: int | float | str) -> DataFrame:
    """One row: a run's typed settings, its span and its number of rows."""
    return rows.agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("rows")).select(*(F.lit(v).alias(k) for k, v in settings.items()), "first_us", "last_us", "rows")
