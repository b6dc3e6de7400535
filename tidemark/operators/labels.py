"""Events, barriers and labels on price series ``(symbol, us, price)`` with unique times per symbol.

A row without a price touches no barrier and labels no event; returns to or
from it are null.  Empty series and event lists give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import as_of_join
from tidemark.operators.running import blocked, numbered, running, unblocked
from tidemark.sources.tapes import DAY


def _as_of(series: DataFrame, at: Column, value: str, out: str, back: bool) -> DataFrame:
    """Adds the last ``value`` strictly before ``at``, or with ``back`` the first at or after it: every row is a question and an answer, in one running pass."""
    sign, question = (-1, 1) if back else (1, 0)
    kind = dict(series.dtypes)[value]
    asked = F.struct((at * sign).alias("_at"), F.lit(question).alias("_kind"), F.lit(None).cast(kind).alias(f"_{out}"))
    known = F.struct((F.col("us") * sign).alias("_at"), F.lit(1 - question).alias("_kind"), F.col(value).alias(f"_{out}"))
    rows = series.select(*series.columns, F.explode(F.array(asked, known)).alias("_q")).select(*series.columns, "_q.*")
    rows = running(rows, ["_at", "_kind"], {out: ("last", F.col(f"_{out}"))})
    return rows.where(F.col("_kind") == question).select(*series.columns, out)


def as_of_before(series: DataFrame, span: int = DAY, value: str = "price", out: str = "previous") -> DataFrame:
    """Adds the last ``value`` strictly before ``us - span`` (null if there is none)."""
    return _as_of(series, F.col("us") - span, value, out, False)


def as_of_after(series: DataFrame, span: int, out: str = "t1") -> DataFrame:
    """Adds the first time at or after ``us + span`` (null if there is none)."""
    return _as_of(series, F.col("us") + span, "us", out, True)


def returns_over(series: DataFrame, span: int = DAY, log: bool = False) -> DataFrame:
    """``ret`` against the price one span before; rows without one are left out."""
    rows = as_of_before(series, span).where("previous IS NOT NULL")
    ratio = F.col("price") / F.col("previous")
    return rows.withColumn("ret", F.log(ratio) if log else ratio - 1).drop("previous")


def paths(events: DataFrame, series: DataFrame, bucket: int) -> DataFrame:
    """Every event (``symbol, t0, t1``) with the rows of its series in [t0, t1].

    A range join made an equi-join: an event is listed under every time bucket
    that it touches, and meets only rows of those buckets.
    """
    spread = F.explode(F.sequence(F.floor(F.col("t0") / bucket), F.floor(F.col("t1") / bucket)))
    left = events.withColumn("_bucket", spread)
    right = series.select("symbol", F.col("us").alias("_us"), F.col("price").alias("_price"), F.floor(F.col("us") / bucket).alias("_bucket"))
    return left.join(right, ["symbol", "_bucket"]).where("_us BETWEEN t0 AND t1").drop("_bucket")


def triple_barrier(events: DataFrame, series: DataFrame, stop: float, profit: float, bucket: int) -> DataFrame:
    """First times at which the signed return leaves the barriers.

    ``events(symbol, t0, p0, vertical, target, side)``: ``vertical`` may be null
    (the path then runs to the series' last row).  A width of 0 or less
    switches its side off; both comparisons are strict.  Adds ``sl``, ``pt``
    and ``t1``, the earliest of the three that exist.
    """
    last = series.groupBy("symbol").agg(F.max("us").alias("_last"))
    rows = events.join(last, "symbol").withColumn("t1", F.coalesce("vertical", "_last"))
    path = paths(rows.select("symbol", "t0", "t1", "p0", "target", "side"), series, bucket)
    r = (F.col("_price") / F.col("p0") - 1) * F.col("side")
    none = F.lit(None).cast("long")
    hit = path.groupBy("symbol", "t0").agg(
        F.min(F.when(r < -stop * F.col("target"), F.col("_us")) if stop > 0 else none).alias("sl"),
        F.min(F.when(r > profit * F.col("target"), F.col("_us")) if profit > 0 else none).alias("pt"),
    )
    return rows.drop("t1", "_last").join(hit, ["symbol", "t0"], "left").withColumn("t1", F.least("vertical", "sl", "pt"))


def label(touched: DataFrame, series: DataFrame, meta: bool = False) -> DataFrame:
    """``ret`` and ``bin`` of closed events: signed return to the first touch, its sign (with ``meta``: 1 for a gain, else 0).

    An event may end at any time: its last price is that of the first row at
    or after ``t1``.  One that ends after the last row has neither.
    """
    end = series.where("price IS NOT NULL").select("symbol", "us", F.col("price").alias("p1"))
    rows = as_of_join(touched.where("t1 IS NOT NULL"), end, "t1", "us", ["symbol"], ["p1"], forward=True)
    ret = (F.col("p1") / F.col("p0") - 1) * F.col("side")
    sign = F.when(F.col("ret") > 0, 1).when(F.col("ret").isNotNull(), 0) if meta else F.signum("ret").cast("int")
    return rows.withColumn("ret", ret).withColumn("bin", sign.cast("int")).drop("p1")


def drop_rare(labels: DataFrame, least_share: float = 0.05) -> DataFrame:
    """Drops the rarest label (the smallest of equals) while its share is at most ``least_share`` and more than two are left.

    Signs have three values, so one pass is the whole loop.
    """
    counts = labels.groupBy("bin").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), F.min_by("bin", F.struct("c", "bin")).alias("rare"), F.min("c").alias("least"))
    gone = total.where((F.col("kinds") > 2) & (F.col("least") <= least_share * F.col("n"))).select(F.col("rare").alias("bin"))
    return labels.join(F.broadcast(gone), "bin", "left_anti")


def moving_side(series: DataFrame, fast: int, slow: int) -> DataFrame:
    """+1 where the fast mean is above the slow one, else -1; null until both windows are full."""
    reach = max(fast, slow) - 1
    rows, order = blocked(series, reach)

    def mean(n: int) -> Column:
        w = order.rowsBetween(1 - n, 0)
        return F.when(F.count("price").over(w) == n, F.sum("price").over(w) / F.lit(n))

    rows = unblocked(rows.withColumn("fast", mean(fast)).withColumn("slow", mean(slow)), reach)
    return rows.withColumn("side", F.when(F.col("slow").isNotNull() & F.col("fast").isNotNull(), F.when(F.col("fast") > F.col("slow"), 1).otherwise(-1)).cast("int"))


def event_mapping(series: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th row of a series by position, with its position."""
    return numbered(series, "event_idx").where(F.col("event_idx") % stride == 0).select("symbol", "event_idx", "us", "price")


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two tables of event times put side by side: every time of either, nulls where one has no row."""
    return left.join(right, ["symbol", "t0"], "full_outer")


def usable(events: DataFrame, least_target: float = 0.0) -> DataFrame:
    """Events with a target above the least."""
    return events.where(F.col("target").isNotNull() & (F.col("target") > least_target))


def cusum_threshold(volatility: DataFrame, value: str, mode: str = "mean", multiplier: float = 1.0) -> DataFrame:
    """One threshold per symbol: the mean or the last known of its volatility times a factor; one that is not above zero raises."""
    if mode not in ("mean", "last"):
        raise ValueError(mode)
    h = F.avg(value) if mode == "mean" else F.max_by(value, F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col("us")))
    rows = volatility.groupBy("symbol").agg((h * multiplier).alias("h"))
    sound = F.when(F.col("h") > 0, F.col("h")).otherwise(F.raise_error(F.concat(F.lit("no usable threshold for "), "symbol")).cast("double"))
    return rows.select("symbol", sound.alias("h"))
