"""Value bars built day by day: each run goes on from the state that the days before left, and bars and state become visible together.

What a symbol's days leave is one row for each day: the last day totals and the
threshold of the policy, how full the open bar is, and the open bar itself.  A
run restores the newest row before its first day, so a later run over the same
days starts from the same state and puts the same bars in their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import day_plan, day_slots
from tidemark.session import discard, staged
from tidemark.sources import days as store
from tidemark.sources.tapes import DAY

_PART = "us long, open long, high long, low long, close long, volume double, dollar double, value long"
BARS = f"symbol string, bar_id long, {_PART}, target long"
STATE = f"symbol string, totals array<long>, target long, open_target long, filled long, next_bar long, {_PART}"
_FIRST, _LAST = ["open"], ["us", "close"]


def _parts(pieces: DataFrame) -> DataFrame:
    """What each day gives to each bar."""
    at = F.struct("us", "trade_id")
    share = F.col("take") / F.col("size")
    return pieces.groupBy("symbol", "bar_id", "day").agg(
        F.max("us").alias("us"), F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum(F.col("qty") * share).alias("volume"), F.sum(F.col("dollar") * share).alias("dollar"), F.sum("take").alias("value"), F.max("bar_target").alias("target"),
    )


def _grown(parts: DataFrame) -> DataFrame:
    """Every bar as it stands at the end of each of its days: a window over the few days of a bar."""
    w = Window.partitionBy("symbol", "bar_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = {"us": F.last, "open": F.first, "high": F.max, "low": F.min, "close": F.last, "volume": F.sum, "dollar": F.sum, "value": F.sum, "target": F.first}
    return parts.select("symbol", "bar_id", "day", *(kind(c).over(w).alias(c) for c, kind in kinds.items()))


def build_days(spark: SparkSession, root: str, tape: DataFrame, value: str, threshold: int | None = None, bars_per_day: int | None = None, **policy) -> int:
    """Adds the days of a tape to the bars under ``root`` and returns the version that shows them.

    Bars have a fixed ``threshold``, or day-adaptive ones for ``bars_per_day``
    and the options of :func:`~tidemark.operators.bars.dynamic_thresholds`.
    ``tape`` holds whole days of all symbols.  Days of the store from its first
    day on are replaced: run the last days again as often as needed, and all
    days after one that is run anew.  A tape without trades changes nothing.
    Trades of no value, or without one, or without a time, are left out.
    Raises :class:`~tidemark.sources.days.Conflict` if another run commits first.
    """
    if (threshold is None) == (bars_per_day is None):
        raise ValueError("give a threshold or a number of bars a day")
    rows = tape.where((F.col(value) > 0) & F.col("us").isNotNull()).withColumn("day", F.floor(F.col("us") / DAY).cast("long"))
    version, held = store.committed(spark, root)
    span = rows.agg(F.min("day").alias("first")).first()
    if span.first is None:
        return version
    before = {d: r for d, r in held.items() if d < span.first}
    known = store.read_days(spark, root, "state", before, STATE)
    state = staged(known.groupBy("symbol").agg(F.max_by(F.struct(*[c for c in known.columns if c != "symbol"]), "day").alias("s")).select("symbol", "s.*"), "state")
    plan = staged(day_plan(rows, value, bars_per_day, fixed=threshold, state=state, **policy), "plan")
    pieces = day_slots(rows, plan, value)
    parts = _parts(pieces).unionByName(state.where("filled > 0").select("symbol", F.col("next_bar").alias("bar_id"), "day", *(c.split()[0] for c in _PART.split(", ")), F.col("open_target").alias("target")))
    grown = staged(_grown(parts).where(F.col("day") >= span.first), "grown")
    run = store.new_run(root)
    store.write_days(grown.where("value = target"), root, "bars", run)
    ends = plan.select("symbol", "day", "totals", "target", "open_target", "filled", "next_bar")
    left = grown.where("value < target").drop("target", "bar_id")
    store.write_days(ends.join(left, ["symbol", "day"], "left"), root, "state", run)
    days = before | {r.day: run for r in plan.select("day").distinct().collect()}  # a row a day
    store.commit(spark, root, version + 1, days)
    discard(state, plan, grown)
    return version + 1


def read_bars(spark: SparkSession, root: str, with_open: bool = True) -> DataFrame:
    """Bars of the latest version, and with ``with_open`` each symbol's unfinished one if it is at least half full."""
    _, held = store.committed(spark, root)
    bars = store.read_days(spark, root, "bars", held, BARS).drop("day")
    if with_open:
        state = store.read_days(spark, root, "state", held, STATE)
        last = state.groupBy("symbol").agg(F.max_by(F.struct(*[c for c in state.columns if c != "symbol"]), "day").alias("s")).select("symbol", "s.*")
        half = last.where("filled > 0 AND value * 2 >= open_target")
        bars = bars.unionByName(half.select(*(F.col({"bar_id": "next_bar", "target": "open_target"}.get(c, c)).alias(c) for c in bars.columns)))
    return bars.withColumn("volume", F.round("volume", 6)).withColumn("dollar", F.round("dollar", 4))


def next_day(spark: SparkSession, root: str) -> int | None:
    """The day after the last one that is built, or None."""
    _, held = store.committed(spark, root)
    return max(held) + 1 if held else None
