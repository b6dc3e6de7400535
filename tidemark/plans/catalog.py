"""Registered queries of the bar, label and feature operators, with their SQL.

Every query reads a table of the given folder as a trade tape or a price
series and applies one operator to all of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import tables as table_functions
from tidemark.functions.stats import ensemble_accuracy, weighted_tau
from tidemark.operators import bars, crossval, diagnostics, fracdiff, importance, incremental, labels, series, weights
from tidemark.operators.asof import as_of_join
from tidemark.operators.running import blocked, unblocked
from tidemark.plans import oracles
from tidemark.session import new_path, staged
from tidemark.sources import tables, trades
from tidemark.sources.tapes import DAY, micros, tape_events, tape_orders
from tidemark.streaming import bars as streams

HOUR = DAY // 24
VOLUME_BAR, DOLLAR_BAR = 200, 2_000_000
ORDER_BAR = 500_000_000
FFD_D, FFD_THRESHOLD = 0.4, 0.01
GRID = [i / 10 for i in range(11)]
LAGS, FOLDS, EMBARGO = 5, 3, 0.01

QUERIES: dict = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show."""
    return frame.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes))


def _series(spark: SparkSession, d: str) -> DataFrame:
    """The event tape as one price series per type."""
    return tape_events(spark, d).select("symbol", "us", "price")


# bars ---------------------------------------------------------------------------------------------------------------


@_query
def time_bars_1h(spark, d):
    return bars.time_bars(tape_events(spark, d), "1h")


@_query
def time_bars_7d_start_day(spark, d):
    return bars.time_bars(tape_events(spark, d), "7d")


@_query
def time_bars_7d_per_day(spark, d):
    return bars.time_bars(tape_events(spark, d), "7d", origin="per_day")


@_query
def value_bars_whole_volume(spark, d):
    return bars.value_bars_whole(tape_events(spark, d), "qty", VOLUME_BAR)


@_query
def value_bars_whole_dollar(spark, d):
    return bars.value_bars_whole(tape_events(spark, d), "dollar", DOLLAR_BAR)


@_query
def value_bars_split_dollar(spark, d):
    return bars.value_bars_split(tape_events(spark, d), "dollar", DOLLAR_BAR)


@_query
def value_bars_split_volume(spark, d):
    return bars.value_bars_split(tape_events(spark, d), "qty", VOLUME_BAR)


@_query
def sql_split_bars(spark, d):
    """Split bars by the table function, in SQL."""
    table_functions.register(spark)
    tape_events(spark, d).createOrReplaceTempView("tape_of_events")
    return spark.sql(f"SELECT * FROM split_bars(TABLE(tape_of_events), 'dollar', {DOLLAR_BAR})")


@_query
def bar_merge(spark, d):
    return bars.merge_bars(bars.time_bars(tape_events(spark, d), "15m"), HOUR)


@_query
def bar_repair_avg(spark, d):
    split = bars.value_bars_split(tape_events(spark, d), "dollar", 20_000)
    return bars.repair_repeats(split, ["open", "high", "low", "close", "value"])


@_query
def dedupe_keep_last(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", micros("l_shipdate").alias("us"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return trades.keep_last(rows, ["l_orderkey", "l_linenumber"], ["us", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])


@_query
def dynamic_threshold_log(spark, d):
    return bars.dynamic_thresholds(tape_events(spark, d), "dollar", 12)


@_query
def adaptive_bars(spark, d):
    return bars.adaptive_bars(tape_events(spark, d), "dollar", 12)


def _in_runs(spark, d, **kind) -> DataFrame:
    """The tape built in three runs over thirds of its days, and its last day run once more."""
    tape, root = tape_events(spark, d).withColumn("_d", F.floor(F.col("us") / DAY)), new_path(spark, "bars")
    first, last = tape.agg(F.min("_d"), F.max("_d")).first()
    third = (last - first) // 3 + 1
    for a, b in ((first, first + third - 1), (first + third, first + 2 * third - 1), (first + 2 * third, last), (last, last)):
        incremental.build_days(spark, root, tape.where(F.col("_d").between(a, b)).drop("_d"), "dollar", **kind)
    return incremental.read_bars(spark, root)


@_query
def incremental_adaptive_bars(spark, d):
    """Day-adaptive bars in three runs and a repeat, each from the state of the one before."""
    return _in_runs(spark, d, bars_per_day=12)


@_query
def incremental_split_bars(spark, d):
    """Split bars of one threshold in three runs and a repeat."""
    return _in_runs(spark, d, threshold=DOLLAR_BAR)


# thresholds and diagnostics ------------------------------------------------------------------------------------------


@_query
def daily_totals(spark, d):
    return bars.daily_totals(tape_events(spark, d))


@_query
def threshold_from_freq(spark, d):
    return _rounded(diagnostics.thresholds_by_frequency(bars.daily_totals(tape_events(spark, d)), ["1d", "4h", "1h", "15m"]))


@_query
def threshold_from_freq_mean(spark, d):
    return _rounded(diagnostics.thresholds_by_frequency(bars.daily_totals(tape_events(spark, d)), ["1d", "4h", "1h", "15m"], "mean"))


@_query
def threshold_from_counts(spark, d):
    return _rounded(diagnostics.thresholds_by_count(tape_events(spark, d), "1h"))


def _order_bars(spark, d):
    return bars.value_bars_whole(tape_orders(spark, d), "dollar", ORDER_BAR)


def _order_returns(spark, d):
    return diagnostics.log_returns(_order_bars(spark, d), ["symbol"], ["bar_index"])


@_query
def log_returns(spark, d):
    return _rounded(_order_returns(spark, d).select("symbol", "bar_index", "r"), 9)


@_query
def weekly_bar_count(spark, d):
    return diagnostics.weekly_counts(_order_bars(spark, d), ["symbol"])


@_query
def monthly_variance(spark, d):
    return _rounded(diagnostics.monthly_variance(_order_returns(spark, d), ["symbol"]))


@_query
def serial_corr(spark, d):
    return _rounded(diagnostics.serial_correlation(_order_returns(spark, d), ["symbol"], ["bar_index"]))


@_query
def jarque_bera(spark, d):
    return _rounded(diagnostics.jarque_bera(_order_returns(spark, d), ["symbol"]).select("symbol", "n", "skew", "kurt", "jb", "p"))


@_query
def series_describe(spark, d):
    return _rounded(diagnostics.describe(_order_returns(spark, d), ["symbol"]))


@_query
def return_histogram(spark, d):
    return _rounded(diagnostics.histogram(_order_returns(spark, d), ["symbol"], 100), 5)


def _kinds(spark, d):
    t = tape_events(spark, d)
    kinds = {"time": bars.time_bars(t, "1h").withColumnRenamed("bar_us", "us"), "volume": bars.value_bars_whole(t, "qty", VOLUME_BAR), "dollar": bars.value_bars_whole(t, "dollar", DOLLAR_BAR)}
    parts = [b.select(F.lit(k).alias("kind"), "symbol", "us", "close") for k, b in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query
def bar_kind_counts(spark, d):
    """Three kinds of bars side by side by week: one union, one aggregate."""
    return diagnostics.weekly_counts(_kinds(spark, d), ["kind", "symbol"])


@_query
def bar_diagnostics(spark, d):
    """Three kinds of bars under all four diagnostics."""
    return _rounded(diagnostics.compare(_kinds(spark, d), ["kind", "symbol"], ["us"]), 5)


@_query
def suggested_thresholds(spark, d):
    """Thresholds for 12 bars a day, with floors."""
    return _rounded(diagnostics.suggested_thresholds(bars.daily_totals(tape_events(spark, d)), 12, 1_000_000, 30))


@_query
def first_bars(spark, d):
    """The first hundred bars of the tape."""
    return diagnostics.first_rows(bars.time_bars(tape_events(spark, d), "1h"), ["bar_us", "symbol"], 100)


@_query
def largest_bars(spark, d):
    """The ten bars of most traded value."""
    return diagnostics.largest(bars.time_bars(tape_events(spark, d), "1h"), "dollar", 10, ["symbol", "bar_us"])


@_query
def raw_file_bars(spark, d):
    """The tape written as zipped daily files, read back from them, cleaned, and put into hourly bars."""
    return bars.time_bars(trades.clean_trades(trades.read_raw(spark, _raw_folder(spark, d))), "1h")


def _raw_folder(spark, d) -> str:
    folder = new_path(spark, "raw")
    trades.write_raw(tape_events(spark, d), folder).write.format("noop").mode("overwrite").save()
    return folder


@_query
def raw_day_totals(spark, d):
    """Day totals of the files of ten days, told by their names; the other files stay closed."""
    raw = trades.read_raw(spark, _raw_folder(spark, d)).where("day BETWEEN DATE'2024-01-06' AND DATE'2024-01-15'")
    return trades.day_totals(raw).select("symbol", F.unix_date("day").cast("long").alias("day"), "dollar", "qty")


@_query
def coverage_scan(spark, d):
    """Days of the order tape between its first and last, against a calendar: those without trades are missing."""
    have = tape_orders(spark, d).groupBy(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("us") / DAY).cast("int")).alias("day")).agg(F.sum("qty").alias("bytes"))
    span = have.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    out = trades.coverage(days, have)
    return out.select(F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long").alias("day"), F.col("bytes").alias("rows"), "status")


@_query
def incremental_start(spark, d):
    """Where the next run over the bars of each symbol would begin."""
    return tables.next_start(bars.time_bars(tape_events(spark, d), "1h").withColumnRenamed("bar_us", "us"))


@_query
def run_metadata(spark, d):
    return tables.run_metadata(bars.time_bars(tape_events(spark, d), "1h").withColumnRenamed("bar_us", "us"), frequency="1h", dollar_per_bar=DOLLAR_BAR)


@_query
def day_range_totals(spark, d):
    """Day totals of the last 14 days of the tape."""
    t = bars.daily_totals(tape_events(spark, d))
    last = t.agg(F.max("day").alias("_last"))  # one row, joined, not collected
    return t.crossJoin(F.broadcast(last)).where(F.col("day").between(F.col("_last") - 13, F.col("_last"))).drop("_last")


# events and labels ---------------------------------------------------------------------------------------------------


@_query
def asof_prev_day(spark, d):
    return labels.as_of_before(_series(spark, d)).where("previous IS NOT NULL")


def _acts(spark, d, kind: str, at: str):
    rows = spark.read.parquet(f"{d}/events.parquet").where(F.col("event_type") == kind)
    return rows.select("user_id", F.col("event_id").alias(kind), micros("ts").alias(at))


@_query
def asof_join_backward(spark, d):
    """Every purchase with its user's last view strictly before it, if that is a week old at most."""
    return as_of_join(_acts(spark, d, "purchase", "us"), _acts(spark, d, "view", "at"), "us", "at", ["user_id"], ["view"], strict=True, tolerance=7 * DAY, time_out="viewed")


@_query
def asof_join_forward(spark, d):
    """Every view with its user's first purchase at or after it."""
    return as_of_join(_acts(spark, d, "view", "us"), _acts(spark, d, "purchase", "at"), "us", "at", ["user_id"], ["purchase"], forward=True, time_out="purchased")


def _volatility(spark, d):
    return series.ewm_std(labels.returns_over(_series(spark, d)), "ret", 100)


def _written_volatility(spark, d):
    """Read several times by what builds on it, so it is written once."""
    return staged(_volatility(spark, d), "volatility")


@_query
def daily_vol(spark, d):
    return _rounded(_volatility(spark, d))


@_query
def daily_vol_log(spark, d):
    return _rounded(series.ewm_std(labels.returns_over(_series(spark, d), log=True), "ret", 100))


@_query
def rolling_std(spark, d):
    """Deviation of the last 100 changes, null until the window is full."""
    return _rounded(diagnostics.rolling_deviation(_series(spark, d), "price", 100).select("symbol", "us", "std"))


@_query
def rolling_side(spark, d):
    return labels.moving_side(_series(spark, d), 5, 20).select("symbol", "us", "side")


def _cusum(spark, d, vol=None):
    vol = (_written_volatility(spark, d) if vol is None else vol).withColumn("x", F.log("price"))
    h = labels.cusum_threshold(vol, "vol", "mean", 0.25)
    return series.cusum(vol.join(F.broadcast(h), "symbol"), "x", "h")


@_query
def cusum_events(spark, d):
    return _cusum(spark, d)


@_query
def cusum_last_vol(spark, d):
    """CUSUM with the last known deviation as threshold."""
    vol = _written_volatility(spark, d).withColumn("x", F.log("price"))
    return series.cusum(vol.join(F.broadcast(labels.cusum_threshold(vol, "vol", "last", 0.5)), "symbol"), "x", "h")


@_query
def cusum_positional(spark, d):
    """CUSUM on changes themselves, positive side first, with a fixed threshold."""
    rows, w = blocked(_series(spark, d), 1)
    rows = unblocked(rows.withColumn("x", F.coalesce(F.log(F.col("price") / F.lag("price").over(w)), F.lit(0.0))), 1).withColumn("h", F.lit(2.5))
    return series.cusum(rows, "x", "h", positive_first=True, on_levels=False)


@_query
def vertical_barrier(spark, d):
    return labels.as_of_after(_series(spark, d), 3 * HOUR).select("symbol", "us", "t1")


def _events(spark, d, side: Column | None = None):
    written = _written_volatility(spark, d)
    vol = written.select("symbol", "us", "vol")
    at = labels.as_of_after(labels.moving_side(_series(spark, d), 5, 20), 3 * HOUR, "vertical")
    rows = _cusum(spark, d, written).select("symbol", "us").join(vol, ["symbol", "us"]).join(at, ["symbol", "us"])
    rows = rows.select("symbol", F.col("us").alias("t0"), F.col("price").alias("p0"), "vertical", (F.col("vol") * 0.1).alias("target"), (F.lit(1) if side is None else side).alias("side"))
    return staged(labels.usable(rows), "events")


def _touched(spark, d, meta: bool = False):
    if meta:
        return labels.triple_barrier(_events(spark, d, F.col("side")).where("side IS NOT NULL"), _series(spark, d), 2.0, 1.0, 3 * HOUR)
    return labels.triple_barrier(_events(spark, d), _series(spark, d), 1.0, 1.0, 3 * HOUR)


@_query
def triple_barrier(spark, d):
    return _touched(spark, d).select("symbol", "t0", "vertical", "sl", "pt", "t1")


def _labels(spark, d, meta: bool = False):
    return labels.label(_touched(spark, d, meta), _series(spark, d), meta)


@_query
def event_labels(spark, d):
    return _rounded(_labels(spark, d).select("symbol", "t0", "t1", "ret", "bin"), 9)


def _loose(spark, d):
    """Events whose ends are times of the clock, not of rows: all run for three hours and 17 seconds, unless touched before."""
    rows = _touched(spark, d).withColumn("t1", F.least(F.col("t0") + 3 * HOUR + 17_000_000, "sl", "pt"))
    return staged(rows.select("symbol", "t0", "t1", "p0", "side"), "loose")


@_query
def labels_between_bars(spark, d):
    """Labels of events that end between rows, at the next price; those that end after the last row have none."""
    return _rounded(labels.label(_loose(spark, d), _series(spark, d)).select("symbol", "t0", "t1", "ret", "bin"), 9)


@_query
def meta_labels(spark, d):
    return _rounded(_labels(spark, d, True).select("symbol", "t0", "t1", "side", "ret", "bin"), 9)


@_query
def meta_metrics(spark, d):
    """Share of executed bets and mean returns, all and executed."""
    return _rounded(_labels(spark, d, True).groupBy("symbol").agg(F.count("*").alias("n"), F.avg("bin").alias("executed"), F.avg("ret").alias("mean_ret"), F.avg(F.when(F.col("bin") == 1, F.col("ret"))).alias("mean_ret_executed")))


@_query
def drop_rare_labels(spark, d):
    return labels.drop_rare(_labels(spark, d).select("symbol", "t0", "bin"))


@_query
def label_counts(spark, d):
    from pyspark.sql import Window

    rows = _labels(spark, d).groupBy("bin").agg(F.count("*").alias("rows"))  # a row per sign
    return _rounded(rows.select("bin", "rows", (F.col("rows") / F.sum("rows").over(Window.partitionBy())).alias("share")))


@_query
def event_mapping(spark, d):
    return labels.event_mapping(_series(spark, d), 50)


@_query
def event_membership(spark, d):
    """Rows of the series at the times of CUSUM events, with their positions."""
    return tables.map_events(_series(spark, d), _cusum(spark, d).select("us").distinct(), "timestamp")


@_query
def series_alignment(spark, d):
    """Deviations and vertical barriers side by side, every time of either; rows without a deviation go last."""
    vol = _volatility(spark, d).select("symbol", F.col("us").alias("t0"), "vol")
    at = labels.as_of_after(_series(spark, d), 3 * HOUR, "t1").select("symbol", F.col("us").alias("t0"), "t1")
    return _rounded(labels.side_by_side(vol, at))


@_query
def touch_times(spark, d):
    """Every time at which an event begins or ends, once."""
    e = _spans_all(spark, d)
    return e.select("symbol", F.col("t0").alias("us")).union(e.where("t1 IS NOT NULL").select("symbol", F.col("t1").alias("us"))).distinct()


@_query
def back_to_back(spark, d):
    """Times at which one event ends and another begins."""
    e = _spans_all(spark, d)
    return e.select("symbol", F.col("t0").alias("us")).intersect(e.select("symbol", F.col("t1").alias("us")))


@_query
def standard_bootstrap(spark, d):
    """As many uniform draws as a symbol has events, over all of them: a seeded choice of position for every event."""
    return weights.standard_draws(_spans_all(spark, d))


# overlap and weights -------------------------------------------------------------------------------------------------


def _spans_all(spark, d):
    """The labelled events with their ends, written once; those that nothing has closed stay open."""
    return staged(_touched(spark, d), "touched").select("symbol", "t0", "t1")


@_query
def concurrency(spark, d):
    return weights.concurrency(_spans_all(spark, d), _series(spark, d))


@_query
def avg_uniqueness(spark, d):
    e = _spans_all(spark, d)
    return _rounded(weights.average_uniqueness(e, staged(weights.concurrency(e, _series(spark, d)), "counts")))


@_query
def uniqueness_between_bars(spark, d):
    """Uniqueness and weight of events that begin and end between rows."""
    e = _loose(spark, d).select("symbol", (F.col("t0") + 1_000_000).alias("t0"), "t1").where("t1 >= t0")
    s = _series(spark, d)
    counts = staged(weights.concurrency(e, s), "counts")
    raw = weights.return_weights(e, counts, s).select("symbol", "t0", "t1", "raw")
    return _rounded(weights.average_uniqueness(e, counts).join(raw, ["symbol", "t0", "t1"]))


@_query
def return_weights(spark, d):
    e, s = _spans_all(spark, d), _series(spark, d)
    return _rounded(weights.return_weights(e, staged(weights.concurrency(e, s), "counts"), s).select("symbol", "t0", "w"))


@_query
def time_decay(spark, d):
    e = _spans_all(spark, d)
    u = weights.average_uniqueness(e, staged(weights.concurrency(e, _series(spark, d)), "counts"))
    return _rounded(weights.time_decay(u, 0.5).select("symbol", "t0", "decay"))


@_query
def time_decay_cut(spark, d):
    e = _spans_all(spark, d)
    u = weights.average_uniqueness(e, staged(weights.concurrency(e, _series(spark, d)), "counts"))
    return _rounded(weights.time_decay(u, -0.25).select("symbol", "t0", "decay"))


@_query
def matrix_uniqueness(spark, d):
    return _rounded(weights.matrix_uniqueness(weights.indicator(_spans_all(spark, d), _series(spark, d), 3 * HOUR)))


@_query
def seq_bootstrap(spark, d):
    """Sequential against uniform draws of all events of a symbol, over the rows of its series."""
    return weights.bootstrap(_spans_all(spark, d), _series(spark, d), ["symbol"])


@_query
def mc_uniqueness(spark, d):
    """Random events over as many rows as each hour of the tape has: the distribution of mean uniqueness under both ways to draw."""
    hours = _series(spark, d).groupBy("symbol", F.floor(F.col("us") / HOUR).alias("hour")).agg(F.count("*").cast("int").alias("n"))
    trials = hours.select(F.xxhash64("symbol", "hour").alias("trial"), (F.col("n") + 20).alias("rows"))
    rows = weights.uniqueness_trials(trials, 10, 5)
    both = rows.select(F.explode(F.array(F.struct(F.lit("standard").alias("kind"), F.col("u_standard").alias("u")), F.struct(F.lit("sequential").alias("kind"), F.col("u_sequential").alias("u")))).alias("x")).select("x.*")
    return diagnostics.describe(both, ["kind"], "u")


# fractional differentiation -------------------------------------------------------------------------------------------


def _log_series(spark, d):
    return _series(spark, d).withColumn("x", F.log("price"))


@_query
def ffd(spark, d):
    return _rounded(fracdiff.ffd(_log_series(spark, d), "x", FFD_D, FFD_THRESHOLD).select("symbol", "us", "fd"))


@_query
def fracdiff_expanding(spark, d):
    """Expanding window over the whole of each series."""
    return _rounded(fracdiff.fracdiff_expanding(_log_series(spark, d), "x", FFD_D, FFD_THRESHOLD).select("symbol", "us", "fd"))


@_query
def ffill(spark, d):
    gaps = _series(spark, d).withColumn("x", F.when(F.col("price") % 3 == 0, F.col("price")))
    return fracdiff.forward_fill(gaps, "x", "filled").select("symbol", "us", "filled")


@_query
def resample_last(spark, d):
    return fracdiff.resample_last(_series(spark, d), "price", DAY)


@_query
def adf_moments(spark, d):
    return _rounded(fracdiff.adf_moments(_log_series(spark, d), "x", ["symbol"]), 5)


def _table(spark, d):
    return fracdiff.min_d_table(_log_series(spark, d), "x", GRID, FFD_THRESHOLD)


@_query
def min_d_corr(spark, d):
    """Eleven orders of differentiation: the test's figures, and how much of the series is left in each."""
    return _rounded(_table(spark, d).select("symbol", "d", "nobs", "stat", "p", "lags", "crit5", "corr", "rows"), 5)


@_query
def pick_d(spark, d):
    return fracdiff.pick_d(_table(spark, d))


def _features(spark, d):
    return fracdiff.lag_features(fracdiff.ffd(_log_series(spark, d), "x", FFD_D, FFD_THRESHOLD), "fd", LAGS)


@_query
def lag_features(spark, d):
    return _rounded(_features(spark, d))


@_query
def event_features(spark, d):
    """Features at the starts of events, where all are known."""
    return _rounded(fracdiff.event_features(_features(spark, d), _touched(spark, d)))


def _aligned(spark, d, touched=None):
    touched, s = staged(_touched(spark, d), "touched") if touched is None else touched, _series(spark, d)
    e = touched.select("symbol", "t0", "t1")
    counts = staged(weights.concurrency(e, s), "counts")
    return fracdiff.aligned(e.where("t1 IS NOT NULL"), labels.drop_rare(labels.label(touched, s)), weights.average_uniqueness(e, counts), weights.return_weights(e, counts, s))


@_query
def aligned_samples(spark, d):
    """Events with label, end, uniqueness and weight."""
    return _rounded(_aligned(spark, d))


# cross-validation ------------------------------------------------------------------------------------------------------


def _samples(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("sample"), micros("ts").alias("t0"), (micros("ts") + HOUR * (1 + F.col("event_id") % 5)).alias("t1"))
    return crossval.positions(rows, ["t0", "sample"])


@_query
def purged_kfold(spark, d):
    return crossval.purged_kfold(_samples(spark, d), 3, 0.01)


@_query
def purged_kfold_by_start(spark, d):
    return crossval.purged_kfold(_samples(spark, d), 3, 0.01, purge="t0")


@_query
def embargo_times(spark, d):
    return crossval.embargo_times(_samples(spark, d), 0.01)


@_query
def purged_kfold_class(spark, d):
    """Folds by position in the event list, purged by the place of the folds' ends."""
    return crossval.purged_folds_of_events(_samples(spark, d), FOLDS, EMBARGO)


@_query
def purge_train_times(spark, d):
    """Samples that meet no event of the last fold."""
    rows = _samples(spark, d)
    bounds = F.broadcast(crossval.fold_bounds(rows, FOLDS).where(f"fold = {FOLDS - 1}").select("lo"))  # one row
    return crossval.purge_train(rows, rows.crossJoin(bounds).where("pos >= lo").select("t0", "t1")).select("sample", "t0", "t1")


# models -----------------------------------------------------------------------------------------------------------------

_FEATURES = [*(f"fd_lag{k}" for k in range(LAGS)), *(f"fd_ret_lag{k}" for k in range(LAGS - 1))]


def _learning(spark, d):
    """The samples of the models: events with features, label, weight and span, in order of time, and their folds.

    Both are read for every fit, so they are written once.
    """
    touched = staged(_touched(spark, d), "touched")
    rows = fracdiff.event_features(_features(spark, d), touched).join(_aligned(spark, d, touched), ["symbol", "t0"])
    rows = rows.withColumn("sample", F.xxhash64("symbol", "t0"))
    rows = staged(crossval.positions(rows, ["t0", "symbol"]), "samples")
    return rows, staged(crossval.purged_kfold(rows, FOLDS, EMBARGO), "folds")


@_query
def cv_score(spark, d):
    rows, roles = _learning(spark, d)
    return importance.cv_scores(rows, roles, FOLDS, _FEATURES)


@_query
def bagged_oob(spark, d):
    """Out-of-bag accuracy of bagged trees, and of bagged forests of one tree on bags of the size that the mean uniqueness allows."""
    rows, _ = _learning(spark, d)
    plain = importance.bagged_trees(rows, _FEATURES, 10, 1.0)[1].select(F.lit("bagged").alias("kind"), "oob", "judged")
    double = importance.bagged_trees(rows, _FEATURES, 10, fracdiff.sample_share(rows), subset="sqrt")[1].select(F.lit("double").alias("kind"), "oob", "judged")
    return plain.unionByName(double)


@_query
def cv_score_logistic(spark, d):
    """The same folds under another classifier."""
    rows, roles = _learning(spark, d)
    return importance.cv_scores(rows, roles, FOLDS, _FEATURES, fit=importance.logistic)


@_query
def mdi(spark, d):
    rows, _ = _learning(spark, d)
    return importance.mean_decrease_impurity(spark, importance.forest(rows, _FEATURES), _FEATURES)


@_query
def mda(spark, d):
    rows, roles = _learning(spark, d)
    return importance.mean_decrease_accuracy(rows, roles, FOLDS, _FEATURES)


@_query
def mda_accuracy(spark, d):
    rows, roles = _learning(spark, d)
    return importance.mean_decrease_accuracy(rows, roles, FOLDS, _FEATURES, "accuracy")


@_query
def sfi(spark, d):
    rows, roles = _learning(spark, d)
    return importance.single_feature(rows, roles, FOLDS, _FEATURES)


@_query
def pca_moments(spark, d):
    return _rounded(importance.correlations(spark.read.parquet(f"{d}/embeddings.parquet"), "embedding", 64), 5)


@_query
def pca_features(spark, d):
    return importance.principal_components(spark.read.parquet(f"{d}/embeddings.parquet"), "embedding", 64)


@_query
def weighted_rank_tau(spark, d):
    """How alike customers' nations rank by mean balance and by number of customers."""
    c = spark.read.parquet(f"{d}/customer.parquet").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("x"), F.count("*").cast("double").alias("y"))
    return _rounded(weighted_tau(c, "x", "y"))


@_query
def vote_accuracy(spark, d):
    """Ensemble accuracy for each priority's share of finished orders."""
    p = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_orderpriority").agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("p"))
    return _rounded(p.select("o_orderpriority", "p", ensemble_accuracy(F.col("p"), 11, 2).alias("accuracy")))


# streams -----------------------------------------------------------------------------------------------------------------


@_query
def stream_time_bars_1h(spark, d):
    return streams.time_bars_once(spark, d, "1 hour")


@_query
def stream_value_bars_dollar(spark, d):
    """With the bar that the end of the stream left open, if it is at least half full."""
    return streams.value_bars_once(spark, d, {"dollar": ("dollar", DOLLAR_BAR)}).drop("kind")


@_query
def stream_bar_kinds(spark, d):
    """Volume and dollar bars from one pass over the stream."""
    return streams.value_bars_once(spark, d, {"volume": ("qty", VOLUME_BAR), "dollar": ("dollar", DOLLAR_BAR)})


@_query
def stream_cusum_events(spark, d):
    """CUSUM events of log prices with a fixed threshold, its sums in the state store."""
    return streams.cusum_once(spark, d, 2.5)


@_query
def stream_adaptive_bars(spark, d):
    """Day-adaptive bars with the policy's state in the state store."""
    return streams.adaptive_bars_once(spark, d, "dollar", 12)


@_query
def stream_zip_adaptive_bars(spark, d):
    """Day-adaptive bars streamed from zipped daily files, five days to a batch in the order of their names."""
    return streams.zip_adaptive_bars_once(spark, _raw_folder(spark, d), "dollar", 12, 5)


ORACLES = oracles.build(dict(hour=HOUR, day=DAY, volume=VOLUME_BAR, dollar=DOLLAR_BAR, order=ORDER_BAR, ffd=fracdiff.ffd_weights(FFD_D, FFD_THRESHOLD), grid={g: fracdiff.ffd_weights(g, FFD_THRESHOLD) for g in GRID}, d=FFD_D, threshold=FFD_THRESHOLD, lags=LAGS, comb=[math.comb(11, i) for i in range(12)]))
