"""Bars from a tape: by time, by value (whole or split trades), and by thresholds that change from day to day.

A tape's times, prices and quantities are not null (``clean_trades`` leaves such
rows out); a trade without a value above zero is in no split bar.  An empty tape
gives no bars.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tapes import DAY

_UNIT = {"d": DAY, "h": DAY // 24, "m": DAY // 1440, "min": DAY // 1440}


def parse_frequency(text: str) -> int:
    """``7d``, ``4h``, ``15m`` or ``15min`` in microseconds."""
    m = re.fullmatch(r"\s*(\d+)\s*(d|h|min|m)\s*", text.lower())
    if not m or int(m[1]) <= 0:
        raise ValueError(f"no frequency: {text!r}")
    return int(m[1]) * _UNIT[m[2]]


def _first(value: str) -> Column:
    return F.min_by(value, F.struct("us", "trade_id"))


def _last(value: str) -> Column:
    return F.max_by(value, F.struct("us", "trade_id"))


def _ohlc() -> list[Column]:
    return [_first("price").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), _last("price").alias("close")]


def time_bars(tape: DataFrame, frequency: str, origin: str = "start_day") -> DataFrame:
    """Left-closed buckets labelled by their start; empty ones do not appear.

    Buckets count from the midnight of the symbol's first trade
    (``start_day``), of each day (``per_day``), or from 1970 (``epoch``).
    """
    width = parse_frequency(frequency)
    if origin == "epoch" or (origin == "start_day" and DAY % width == 0):
        start = F.lit(0).cast("long")
    elif origin == "start_day":
        firsts = tape.groupBy("symbol").agg((F.min("us") - F.pmod(F.min("us"), F.lit(DAY))).alias("_origin"))
        tape, start = tape.join(firsts, "symbol"), F.col("_origin")
    else:
        start = F.col("us") - F.pmod("us", F.lit(DAY))
    bucket = F.col("us") - F.pmod(F.col("us") - start, F.lit(width))
    return tape.groupBy("symbol", bucket.alias("bar_us")).agg(*_ohlc(), F.sum("qty").alias("volume"), F.sum("dollar").alias("dollar"))


def merge_bars(bars: DataFrame, width: int | None = None) -> DataFrame:
    """Bars of one start together (of ``width`` microseconds if given): the second phase of a two-phase aggregation."""
    start = F.col("bar_us") if width is None else F.col("bar_us") - F.pmod("bar_us", F.lit(width))
    return bars.groupBy("symbol", start.alias("bar_us")).agg(
        F.min_by("open", "bar_us").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_us").alias("close"), F.sum("volume").alias("volume"), F.sum("dollar").alias("dollar")
    )


def repair_repeats(bars: DataFrame, numeric: list[str]) -> DataFrame:
    """Bars with one time averaged."""
    return bars.groupBy("symbol", "us").agg(*(F.avg(c).alias(c) for c in numeric))


def running_total(tape: DataFrame, value: str) -> DataFrame:
    """Adds ``day``, ``day_cum`` (within the day) and ``cum`` (from the start) of ``value`` in trade order.

    Two levels: totals by day give each day its offset, and the sum over
    trades runs inside (symbol, day) only, so one busy symbol is many tasks.
    """
    day = F.floor(F.col("us") / DAY).cast("long")
    rows = tape.withColumn("day", day)
    totals = rows.groupBy("symbol", "day").agg(F.sum(value).alias("_total"))
    before = totals.select("symbol", "day", F.coalesce(F.sum("_total").over(Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("symbol", "day").orderBy("us", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("day_cum", F.sum(value).over(inside))
    return rows.join(before, ["symbol", "day"]).withColumn("cum", F.col("day_cum") + F.col("_before")).drop("_before")


def value_bars_whole(tape: DataFrame, value: str, threshold: int) -> DataFrame:
    """A trade that crosses the threshold goes wholly into the next bar; bars under half of it are dropped."""
    rows = running_total(tape, value).withColumn("bar_index", F.floor(F.col("cum") / threshold).cast("long"))
    bars = rows.groupBy("symbol", "bar_index").agg(F.max("us").alias("us"), *_ohlc(), F.sum("qty").alias("volume"), F.sum("dollar").alias("dollar"), F.sum(value).alias("_value"))
    return bars.where(F.col("_value") * 2 >= threshold).drop("_value")


def _from_pieces(pieces: DataFrame) -> DataFrame:
    """Bars of trade pieces ``take`` of ``size`` each; a bar's full value is ``bar_target``."""
    share = F.col("take") / F.col("size")
    bars = pieces.groupBy("symbol", "bar_id").agg(
        F.max("us").alias("us"), *_ohlc(), F.round(F.sum(F.col("qty") * share), 6).alias("volume"), F.round(F.sum(F.col("dollar") * share), 4).alias("dollar"), F.max("bar_target").alias("target"), F.sum("take").alias("value")
    )
    return bars.where("value * 2 >= target")


def value_bars_split(tape: DataFrame, value: str, threshold: int) -> DataFrame:
    """Trades are cut so that every bar holds exactly the threshold; the last one stays from half of it.

    Closed form: a trade that runs from c0 to c1 of the running total has a
    piece in every bar between.  Trades of no value are left out.
    """
    rows = running_total(tape.where(F.col(value) > 0), value)
    c1, c0 = F.col("cum"), F.col("cum") - F.col(value)
    bar = F.explode(F.sequence(F.floor(c0 / threshold).cast("long"), F.floor((c1 - 1) / threshold).cast("long")))
    rows = rows.select("*", F.col(value).alias("size"), c0.alias("c0"), bar.alias("bar_id"))
    take = F.least(F.col("cum"), (F.col("bar_id") + 1) * threshold) - F.greatest(F.col("c0"), F.col("bar_id") * threshold)
    return _from_pieces(rows.withColumn("take", take).withColumn("bar_target", F.lit(threshold).cast("long")))


def daily_totals(tape: DataFrame) -> DataFrame:
    """Traded value, quantity and trades by day."""
    return tape.groupBy("symbol", F.floor(F.col("us") / DAY).cast("long").alias("day")).agg(F.sum("dollar").alias("dollar"), F.sum("qty").alias("qty"), F.count("*").alias("trades"))


def dynamic_thresholds(tape: DataFrame, value: str, bars_per_day: int, rolling_days: int = 3, smoothing: float = 0.3, change: float = 0.25, least: int | None = None, most: int | None = None) -> DataFrame:
    """One row per day: its total, the threshold that its trades use, and how bars carry over midnight.

    The raw target is the mean total of the last ``rolling_days`` days over
    ``bars_per_day`` (the first day looks at its own total); it is smoothed
    with the day before's threshold, may move by ``change`` of it at most, and
    is kept within the absolute bounds, in whole units.  ``head_target`` and
    ``head_need`` describe a bar that is still open when the day begins (0: none),
    and ``first_bar`` is the number of the day's first bar.

    Only day totals are folded, in one array per symbol: thousands of values,
    however many trades.
    """
    rows = tape.where(F.col(value) > 0).withColumn("day", F.floor(F.col("us") / DAY).cast("long"))
    return day_plan(rows, value, bars_per_day, rolling_days=rolling_days, smoothing=smoothing, change=change, least=least, most=most).select("symbol", *_PLAN)


_PLAN = ("day", "total", "target", "head_target", "head_need", "first_bar")


def day_plan(rows: DataFrame, value: str, bars_per_day: int | None, fixed: int | None = None, state: DataFrame | None = None, rolling_days: int = 3, smoothing: float = 0.3, change: float = 0.25, least: int | None = None, most: int | None = None) -> DataFrame:
    """Thresholds of the days of ``rows`` (``day`` among their columns), see :func:`dynamic_thresholds`, and what each day leaves: ``open_target, filled, next_bar, totals``.

    ``fixed`` is one threshold for all days.  ``state`` has a row
    ``symbol, totals, target, open_target, filled, next_bar`` for symbols that
    go on from days before.
    """
    sums = rows.groupBy("symbol", "day").agg(F.sum(value).alias("total"))
    days = sums.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("day", "total"))).alias("days"))
    zero = "CAST(0 AS BIGINT)"
    if state is None:
        days = days.withColumns({"old": F.expr("CAST(array() AS ARRAY<BIGINT>)"), **{f"s_{c}": F.expr(zero) for c in ("target", "open_target", "filled", "next_bar")}})
    else:
        days = days.join(state.select("symbol", F.col("totals").alias("old"), *(F.col(c).alias(f"s_{c}") for c in ("target", "open_target", "filled", "next_bar"))), "symbol", "left")
        days = days.withColumns({"old": F.expr("coalesce(old, CAST(array() AS ARRAY<BIGINT>))"), **{f"s_{c}": F.coalesce(f"s_{c}", F.expr(zero)) for c in ("target", "open_target", "filled", "next_bar")}})
    days = days.withColumn("every", F.expr("concat(old, transform(days, d -> d.total))"))
    # the day at k of these days has the size(old) + k totals before it in ``every``
    before = "(size(old) + k)"
    window = f"slice(every, greatest(1, {before} - {rolling_days} + 1), least({before}, {rolling_days}))"
    mean = f"aggregate({window}, {zero}, (a, x) -> a + x) / least({before}, {rolling_days})"
    raw = "CAST(0 AS DOUBLE)" if fixed else f"(CASE WHEN {before} = 0 THEN CAST(d.total AS DOUBLE) ELSE {mean} END) / {bars_per_day}"
    recent = f"slice(every, greatest(1, {before} + 1 - {rolling_days} + 1), least({before} + 1, {rolling_days}))"
    plan = days.select("symbol", *(f"s_{c}" for c in ("target", "open_target", "filled", "next_bar")), F.expr(f"transform(days, (d, k) -> named_struct('day', d.day, 'total', d.total, 'raw', {raw}, 'totals', {recent}))").alias("days"))
    smoothed = f"({1 - smoothing!r}D * p.target + {smoothing!r}D * d.raw)"
    moved = f"(CASE WHEN p.target = 0 THEN d.raw ELSE least(p.target * {1 + change!r}D, greatest(p.target * {1 - change!r}D, {smoothed})) END)"
    target = f"greatest({1 if least is None else max(1, int(least))}, floor({moved} + 0.5D))"
    target = f"CAST({int(fixed) if fixed else target if most is None else f'least({int(most)}, {target})'} AS BIGINT)"
    # p is the state after the day before, t the day's target; need is what the open bar still takes
    need = f"(CASE WHEN p.filled > 0 THEN p.open_target - p.filled ELSE {zero} END)"
    short = f"d.total < {need}"
    state_ = f"""named_struct('day', d.day, 'total', d.total, 'target', t,
      'head_target', CASE WHEN p.filled > 0 THEN p.open_target ELSE {zero} END, 'head_need', {need}, 'first_bar', p.next_bar,
      'open_target', CASE WHEN {short} THEN p.open_target ELSE t END,
      'filled', CASE WHEN {short} THEN p.filled + d.total ELSE (d.total - {need}) % t END,
      'next_bar', p.next_bar + CASE WHEN {short} THEN {zero} ELSE CAST(p.filled > 0 AS BIGINT) + (d.total - {need}) div t END, 'totals', d.totals)"""
    given = {"target": "s_target", "open_target": "s_open_target", "filled": "s_filled", "next_bar": "s_next_bar"}
    names = (*_PLAN, "open_target", "filled", "next_bar")
    start = "named_struct(" + ", ".join(f"'{n}', {given.get(n, zero)}" for n in names) + ", 'totals', CAST(array() AS ARRAY<BIGINT>))"
    step = f"transform(array(element_at(acc, -1)), p -> transform(array({target}), t -> {state_})[0])"
    folded = plan.select("symbol", F.expr(f"aggregate(days, array({start}), (acc, d) -> concat(acc, {step}))").alias("days"))
    return folded.select("symbol", F.explode(F.slice("days", F.lit(2), F.size("days"))).alias("d")).select("symbol", *(f"d.{n}" for n in (*names, "totals")))


def day_slots(rows: DataFrame, plan: DataFrame, value: str) -> DataFrame:
    """Trades (with ``day``) cut into pieces ``bar_id, take, size, bar_target`` by the plan of their days."""
    inside = Window.partitionBy("symbol", "day").orderBy("us", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("c1", F.sum(value).over(inside))
    rows = rows.join(plan.select("symbol", *_PLAN), ["symbol", "day"]).withColumn("c0", F.col("c1") - F.col(value)).withColumn("size", F.col(value))
    # slots of a day: -1 is the bar that was open, 0, 1, ... are its own
    slot = lambda c: F.when(c < F.col("head_need"), F.lit(-1)).otherwise(F.floor((c - F.col("head_need")) / F.col("target"))).cast("long")
    rows = rows.withColumn("slot", F.explode(F.sequence(slot(F.col("c0")), slot(F.col("c1") - 1))))
    head = F.col("slot") < 0
    lo = F.when(head, F.lit(0)).otherwise(F.col("head_need") + F.col("slot") * F.col("target"))
    hi = F.when(head, F.col("head_need")).otherwise(F.col("head_need") + (F.col("slot") + 1) * F.col("target"))
    bar_id = F.col("first_bar") + F.col("slot") + F.when(F.col("head_need") > 0, 1).otherwise(0)
    return rows.withColumn("take", F.least("c1", hi) - F.greatest("c0", lo)).withColumn("bar_target", F.when(head, F.col("head_target")).otherwise(F.col("target"))).withColumn("bar_id", bar_id.cast("long"))


def adaptive_bars(tape: DataFrame, value: str, bars_per_day: int, **policy) -> DataFrame:
    """Split bars under day thresholds; a bar that is open at midnight keeps its threshold until it is full."""
    rows = tape.where(F.col(value) > 0).withColumn("day", F.floor(F.col("us") / DAY).cast("long"))
    return _from_pieces(day_slots(rows, day_plan(rows, value, bars_per_day, **policy), value))
