"""Adapters from plain tables to trade tapes.

A tape has ``symbol, trade_id, us, price, qty, dollar``: one row per trade, time
in epoch microseconds, money in whole minor units so that sums do not depend
on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(column: str | Column) -> Column:
    """Epoch microseconds of a timestamp without a zone, under a UTC session."""
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def tape(frame: DataFrame, symbol: Column, trade_id: Column, ts: str, price: Column, qty: Column) -> DataFrame:
    """Any table as a tape; the traded value is price times quantity."""
    out = frame.select(symbol.alias("symbol"), trade_id.alias("trade_id"), micros(ts).alias("us"), price.alias("price"), qty.alias("qty"))
    return out.withColumn("dollar", F.col("price") * F.col("qty"))


def tape_events(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` by type: intraday."""
    rows = spark.read.parquet(f"{folder}/events.parquet")
    cents = F.round(F.col("value") * 100).cast("long") + 1
    return tape(rows, F.col("event_type"), F.col("event_id"), "ts", cents, F.col("event_id") % 7 + 1)


def tape_orders(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` by priority: daily, over years."""
    rows = spark.read.parquet(f"{folder}/orders.parquet")
    return tape(rows, F.col("o_orderpriority"), F.col("o_orderkey"), "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long"), F.lit(1).cast("long"))
