"""Thresholds from a tape's totals, and figures that compare kinds of bars.

Returns to or from a price that is null or not above zero are left out; groups
without rows do not appear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bars import parse_frequency
from tidemark.operators.running import blocked, unblocked
from tidemark.sources.tapes import DAY


def statistic(kind: str, column: str) -> Column:
    """Median (exact, interpolating) or mean of day totals."""
    if kind not in ("median", "mean"):
        raise ValueError(kind)
    return F.median(column) if kind == "median" else F.avg(column)


def thresholds_by_frequency(totals: DataFrame, frequencies: list[str], kind: str = "median") -> DataFrame:
    """Bars per day of each frequency, and a day's value and quantity over it."""
    listed = F.explode(F.array(*(F.struct(F.lit(f).alias("freq"), F.lit(DAY / parse_frequency(f)).alias("bars_per_day")) for f in frequencies)))
    stats = totals.groupBy("symbol").agg(statistic(kind, "dollar").alias("daily_dollar"), statistic(kind, "qty").alias("daily_qty"))
    return stats.withColumn("_f", listed).select("symbol", "_f.freq", "_f.bars_per_day", "daily_dollar", "daily_qty").select("symbol", "freq", "bars_per_day", "daily_dollar", "daily_qty", (F.col("daily_dollar") / F.col("bars_per_day")).alias("dollar_per_bar"), (F.col("daily_qty") / F.col("bars_per_day")).alias("qty_per_bar"))


def thresholds_by_count(tape: DataFrame, frequency: str) -> DataFrame:
    """Totals over the number of time bars that have trades; null where there is none."""
    width = parse_frequency(frequency)
    day = F.floor(F.col("us") / DAY)
    bars = tape.groupBy("symbol", day.alias("day"), F.floor(F.pmod("us", F.lit(DAY)) / width).alias("bar")).agg(F.sum("dollar").alias("dollar"), F.sum("qty").alias("qty"))
    out = bars.groupBy("symbol").agg(F.count("*").alias("time_bars"), F.sum("dollar").alias("dollar"), F.sum("qty").alias("qty"), (F.max("day") - F.min("day") + 1).alias("days"))
    return out.select("symbol", F.lit(frequency).alias("freq"), "time_bars", "dollar", "qty", F.try_divide("dollar", "time_bars").alias("dollar_per_bar"), F.try_divide("qty", "time_bars").alias("qty_per_bar"), F.try_divide("time_bars", "days").alias("bars_per_day"))


def log_returns(bars: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``r``: log of close over the close before; rows without one, and infinite ones, are left out."""
    rows, w = blocked(bars, 1, tuple(by), tuple(order), _width(order))
    before = F.lag("close").over(w)
    r = F.when((F.col("close") > 0) & (before > 0), F.log(F.col("close") / before))
    return unblocked(rows.withColumn("r", r), 1).where("r IS NOT NULL")


def _width(order: list[str]) -> int:
    """How much of an order a task numbers at once: a day of times, or so many numbers of bars."""
    return DAY if order[0] == "us" else 1 << 20


def week_of(us: str = "us") -> Column:
    """Day number of the Monday of the week."""
    day = F.floor(F.col(us) / DAY)
    return (day - F.pmod(day + 3, F.lit(7))).cast("long")


def weekly_counts(bars: DataFrame, by: list[str]) -> DataFrame:
    return bars.groupBy(*by, week_of().alias("week")).agg(F.count("*").alias("bars"))


def serial_correlation(returns: DataFrame, by: list[str], order: list[str], lag: int = 1) -> DataFrame:
    """Pearson correlation of a return with the one ``lag`` before."""
    rows, w = blocked(returns, lag, tuple(by), tuple(order), _width(order))
    return unblocked(rows.withColumn("b", F.lag("r", lag).over(w)), lag).where("b IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), F.corr("r", "b").alias("corr"))


def monthly_variance(returns: DataFrame, by: list[str]) -> DataFrame:
    month = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("us") / DAY).cast("int")), "yyyy-MM")
    return returns.groupBy(*by, month.alias("month")).agg(F.count("*").alias("n"), F.var_samp("r").alias("variance"))


def jarque_bera(returns: DataFrame, by: list[str]) -> DataFrame:
    """Statistic and p-value (chi-square with two degrees of freedom) from biased moments."""
    m = returns.groupBy(*by).agg(F.count("*").alias("n"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurt"))
    stat = F.col("n") / 6 * (F.col("skew") ** 2 + F.col("kurt") ** 2 / 4)
    return m.withColumn("jb", stat).withColumn("p", F.exp(-F.col("jb") / 2))


def describe(returns: DataFrame, by: list[str], column: str = "r") -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = returns.groupBy(*by).agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("least"), q.alias("q"), F.max(column).alias("most"))
    return out.select(*by, "n", "mean", "std", "least", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "most")


def histogram(returns: DataFrame, by: list[str], bins: int = 100) -> DataFrame:
    """Density by bin between the extremes, next to the normal law of the same mean and deviation."""
    s = returns.groupBy(*by).agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("r") - F.col("lo"), width))).cast("int")
    rows = returns.select(*by, "r").join(s.select(*by, "lo", "hi"), by).select(*by, F.coalesce(bin_, F.lit(0)).alias("bin"))
    counts = rows.groupBy(*by, "bin").agg(F.count("*").alias("c"))
    out = s.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts, [*by, "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0)).cast("long"))
    centre = F.col("lo") + (F.col("bin") + 0.5) * width
    normal = F.exp(-(((centre - F.col("mean")) / F.col("std")) ** 2) / 2) / (F.col("std") * (2 * 3.141592653589793) ** 0.5)
    return out.select(*by, "bin", F.col("c").alias("rows"), F.try_divide(F.col("c"), F.col("n") * width).alias("density"), normal.alias("normal"))


def compare(bars: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """All diagnostics of several kinds of bars side by side: bars in a mean week, serial correlation, mean monthly variance, normality of the returns."""
    weeks = weekly_counts(bars, by).groupBy(*by).agg(F.avg("bars").alias("weekly_bars"))
    returns = log_returns(bars, by, order)
    months = monthly_variance(returns, by).groupBy(*by).agg(F.avg("variance").alias("monthly_variance"))
    out = weeks.join(serial_correlation(returns, by, order).select(*by, "corr"), by, "left").join(months, by, "left")
    return out.join(jarque_bera(returns, by).select(*by, "n", "jb", "p"), by, "left")


def suggested_thresholds(totals: DataFrame, bars_per_day: float, least_dollar: float, least_qty: float, kind: str = "median") -> DataFrame:
    """A day's usual value and quantity over the bars wanted, but no less than a floor."""
    stats = totals.groupBy("symbol").agg(statistic(kind, "dollar").alias("dollar"), statistic(kind, "qty").alias("qty"))
    return stats.select("symbol", F.greatest(F.col("dollar") / bars_per_day, F.lit(float(least_dollar))).alias("dollar_per_bar"), F.greatest(F.col("qty") / bars_per_day, F.lit(float(least_qty))).alias("qty_per_bar"))


def rolling_deviation(series: DataFrame, value: str, rows: int, out: str = "std") -> DataFrame:
    """Deviation of the last ``rows`` relative changes, null until the window is full of them."""
    part, w = blocked(series, rows)
    part = part.withColumn("_c", F.col(value) / F.lag(value).over(w) - 1)
    full = w.rowsBetween(1 - rows, 0)
    return unblocked(part.withColumn(out, F.when(F.count("_c").over(full) == rows, F.stddev_samp("_c").over(full))), rows).drop("_c")


def first_rows(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows in order."""
    return rows.orderBy(*order).limit(most)


def largest(rows: DataFrame, column: str, most: int, ties: list[str]) -> DataFrame:
    """The rows with the largest values (ties by other columns): a bounded report, kept on the way by each task."""
    return rows.orderBy(F.desc(column), *ties).limit(most)
