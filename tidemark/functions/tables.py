"""Table functions for SQL: split value bars of any table of trades.

    register(spark)
    spark.sql("SELECT * FROM split_bars(TABLE(trades), 'dollar', 2000000)")

The rows of a symbol come in order of time and trade, one symbol after the
other, and a bar is all the state there is.  A symbol is one task's stream, so
:func:`tidemark.operators.bars.value_bars_split` is the form for large tapes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

_NEEDED = ("symbol", "trade_id", "us", "price", "qty", "dollar")


class SplitBars:
    """Trades are cut so that every bar holds exactly the threshold; the last one of a symbol stays from half of it.

    Trades without a value above zero are left out.  A table that lacks a
    column of a tape, a value that is not ``qty`` or ``dollar``, and a threshold
    that is not a whole number above zero raise when the query is analysed.
    """

    @staticmethod
    def analyze(trades: AnalyzeArgument, value: AnalyzeArgument, threshold: AnalyzeArgument) -> AnalyzeResult:
        if not trades.isTable or any(c not in trades.dataType.fieldNames() for c in _NEEDED):
            raise ValueError(f"the first argument is a table with {', '.join(_NEEDED)}")
        if value.value not in ("qty", "dollar"):
            raise ValueError("the value is 'qty' or 'dollar'")
        if not isinstance(threshold.value, int) or threshold.value <= 0:
            raise ValueError("the threshold is a whole number above zero")
        schema = StructType().add("symbol", StringType())
        for c in ("bar_id", "us", "open", "high", "low", "close"):
            schema = schema.add(c, LongType())
        schema = schema.add("volume", DoubleType()).add("dollar", DoubleType()).add("target", LongType()).add("value", LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("symbol")], orderBy=[OrderingColumn("us"), OrderingColumn("trade_id")])

    def __init__(self) -> None:
        self.number, self.bar = 0, None

    def eval(self, trades, value: str, threshold: int) -> Iterator[tuple]:
        size = trades[value]
        if size is None or size <= 0:
            return
        self.symbol, self.threshold, left = trades["symbol"], threshold, size
        price, us = trades["price"], trades["us"]
        while left > 0:
            if self.bar is None:
                self.bar = {"us": us, "open": price, "high": price, "low": price, "close": price, "volume": 0.0, "dollar": 0.0, "value": 0}
            b = self.bar
            take = min(left, threshold - b["value"])
            b["us"], b["high"], b["low"], b["close"] = us, max(b["high"], price), min(b["low"], price), price
            b["volume"] += trades["qty"] * (take / size)
            b["dollar"] += trades["dollar"] * (take / size)
            b["value"] += take
            left -= take
            if b["value"] == threshold:
                yield self._row()

    def _row(self) -> tuple:
        b, self.bar, self.number = self.bar, None, self.number + 1
        return (self.symbol, self.number - 1, b["us"], b["open"], b["high"], b["low"], b["close"], round(b["volume"], 6), round(b["dollar"], 4), self.threshold, b["value"])

    def terminate(self) -> Iterator[tuple]:
        if self.bar is not None and 2 * self.bar["value"] >= self.threshold:
            yield self._row()


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL in this session."""
    spark.udtf.register("split_bars", udtf(SplitBars))
