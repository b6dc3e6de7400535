"""Fractional differentiation, stationarity figures, lag features."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import blocked, numbered, running, unblocked
from tidemark.session import staged


def weights(d: float, size: int) -> list[float]:
    """The first ``size`` weights of (1 - L)**d, newest first."""
    out = [1.0]
    for k in range(1, size):
        out.append(-out[-1] * (d - k + 1) / k)
    return out


def ffd_weights(d: float, threshold: float, most: int = 100_000) -> list[float]:
    """Weights, newest first, up to the first that is smaller than ``threshold`` in size."""
    out = [1.0]
    while len(out) < most:
        w = -out[-1] * (d - len(out) + 1) / len(out)
        if abs(w) < threshold:
            break
        out.append(w)
    return out


def forward_fill(series: DataFrame, value: str, out: str) -> DataFrame:
    """The last value that is not null, at or before each row."""
    return running(series, ["us"], {out: ("last", F.col(value))})


def _filled(series: DataFrame, value: str, **more: tuple[str, Column]) -> DataFrame:
    """Adds the filled value ``_x``, the row number ``_pos`` from 0 and further figures, all in one running pass.

    Rows before the first value stay, with a null ``_x`` that is in no full window.
    """
    rows = running(series, ["us"], {"_x": ("last", F.col(value)), "_pos": ("sum", F.lit(1)), **more})
    return rows.withColumn("_pos", (F.col("_pos") - 1).cast("long"))


def finite(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def ffd(series: DataFrame, value: str, d: float, threshold: float, out: str = "fd") -> DataFrame:
    """Fixed-width fractional difference; the first rows, as many as the width, are absent, and so are rows whose own value is not finite."""
    w = ffd_weights(d, threshold)
    filled, order = blocked(_filled(series, value), len(w) - 1)
    frame = F.collect_list("_x").over(order.rowsBetween(1 - len(w), 0))
    if len(w) <= 64:
        total = sum((F.lit(c) * F.lag("_x", k).over(order) for k, c in enumerate(w) if k), F.lit(w[0]) * F.col("_x"))
    else:
        total = F.when(F.size(frame) == len(w), F.aggregate(F.zip_with(frame, F.array(*(F.lit(c) for c in reversed(w))), lambda x, c: x * c), F.lit(0.0), lambda a, x: a + x))
    rows = filled.withColumn(out, total)
    return unblocked(rows, len(w) - 1).where(F.col(out).isNotNull() & finite(value)).drop("_x")


#: Rows of a block of an expanding difference, and complex numbers that a task convolves over blocks at once.
_EXPANDING_BLOCK, _EXPANDING_CELLS = 1 << 14, 1 << 20


def _weights_from(d: float, first: int, value: float, size: int) -> np.ndarray:
    """Weights ``first`` to ``first + size - 1``, of which the first is ``value``."""
    k = np.arange(first + 1, first + size)
    return value * np.cumprod(np.concatenate([[1.0], -(d - k + 1) / k]))


def skipped(d: float, n: int, threshold: float, step: int = 1 << 20) -> int:
    """How many first rows of a series of ``n`` lose more than ``threshold`` of the weights' total size, a bounded stretch of weights at a time."""
    sums, value = [], 1.0
    for a in range(0, n, step):
        part = _weights_from(d, a, value, min(step, n - a) + 1)
        sums.append(float(np.abs(part[:-1]).sum()))
        value = float(part[-1])
    left, total, lost, value = 0.0, sum(sums), 0, 1.0
    for a, own in zip(range(0, n, step), sums, strict=True):
        part = _weights_from(d, a, value, min(step, n - a) + 1)
        value = float(part[-1])
        # row r loses the weights from n - 1 - r on: the size from weight k on, for each k of this stretch
        tail = total - left - np.concatenate([[0.0], np.cumsum(np.abs(part[:-1]))[:-1]])
        lost += int((tail / max(total, 1e-300) > threshold).sum())
        left += own
    return lost


def _spectrum(x: np.ndarray, size: int, groups: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return [(g, part.real, part.imag) for g, part in enumerate(np.array_split(np.fft.rfft(x, 2 * size), groups))]


_SPECTRA = "block int, g int, re array<double>, im array<double>"


def _block_spectra(batches: Iterator[pd.DataFrame], size: int, groups: int) -> Iterator[pd.DataFrame]:
    """The transform of every block of a series, cut into groups of frequencies."""
    for batch in batches:
        for symbol, block, xs in batch[["symbol", "block", "xs"]].itertuples(index=False):
            yield pd.DataFrame([(symbol, block, *part) for part in _spectrum(np.asarray(xs), size, groups)], columns=["symbol", "block", "g", "re", "im"])


def _lag_spectra(batches: Iterator[pd.DataFrame], d: float, starts: np.ndarray, size: int, groups: int) -> Iterator[pd.DataFrame]:
    """The transform of the weights between a block and the one ``block`` blocks before it."""
    for batch in batches:
        for m in batch["block"]:
            ahead = _weights_from(d, m * size, starts[m], size)
            back = _weights_from(d, (m - 1) * size, starts[m - 1], size)[1:] if m else np.zeros(size - 1)
            yield pd.DataFrame([(m, *part) for part in _spectrum(np.concatenate([ahead, [0.0], back]), size, groups)], columns=["block", "g", "re", "im"])


def _over_blocks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For a few frequencies of one series, the convolution over its blocks, which is a product in a second transform."""
    cells = []
    for own in (0, 1):
        part = rows[rows["kind"] == own].sort_values("block")
        cells.append(np.stack([np.asarray(r) + 1j * np.asarray(i) for r, i in zip(part["re"], part["im"], strict=True)]))
    n = len(cells[0])
    both = np.fft.ifft(np.fft.fft(cells[0], 2 * n, axis=0) * np.fft.fft(cells[1], 2 * n, axis=0), axis=0)[:n]
    return pd.DataFrame([(*key, t, both[t].real, both[t].imag) for t in range(n)], columns=["symbol", "g", "block", "re", "im"])


def _from_spectra(key: tuple, rows: pd.DataFrame, size: int) -> pd.DataFrame:
    rows = rows.sort_values("g")
    whole = np.concatenate([np.asarray(r) + 1j * np.asarray(i) for r, i in zip(rows["re"], rows["im"], strict=True)])
    return pd.DataFrame([(*key, np.fft.irfft(whole, 2 * size)[:size])], columns=["symbol", "block", "sums"])


def fracdiff_expanding(series: DataFrame, value: str, d: float, threshold: float, out: str = "fd") -> DataFrame:
    """Expanding fractional difference over all history of each symbol.

    The weights are as many as the series has rows; rows before the share of
    dropped weight falls to ``threshold`` are skipped, and so are rows whose own
    value is not finite.  An empty series stays empty.

    A convolution of all rows with all weights in two transforms: blocks of
    rows are transformed by themselves; then all blocks of a few frequencies
    meet in one task and are convolved over blocks; then each block's
    frequencies meet and are transformed back.  A series moves twice, whatever
    its length, the work is n log n, and no task holds more than a block or
    ``_EXPANDING_CELLS`` numbers (or one frequency of all blocks).
    """
    size = _EXPANDING_BLOCK
    filled = staged(numbered(forward_fill(series, value, "_x").where("_x IS NOT NULL")), "filled")
    rows = filled.withColumn("_block", F.floor(F.col("_pos") / size).cast("int"))
    lists = rows.groupBy("symbol", "_block").agg(F.array_sort(F.collect_list(F.struct("_pos", F.col("_x").cast("double").alias("x")))).alias("xs"))
    n = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.max("_block").alias("last"))
    most = (n.agg(F.max("last")).first()[0] or 0) + 1
    groups = max(1, min(size + 1, -(-most * (size + 1) // _EXPANDING_CELLS)))
    starts, value_ = np.empty(most), 1.0
    for m in range(most):  # one number a block
        starts[m] = value_
        value_ = float(_weights_from(d, m * size, value_, size + 1)[-1])
    spectra = lists.select("symbol", F.col("_block").alias("block"), F.col("xs.x").alias("xs")).mapInPandas(partial(_block_spectra, size=size, groups=groups), f"symbol string, {_SPECTRA}")
    lags = series.sparkSession.range(most).select(F.col("id").cast("int").alias("block")).mapInPandas(partial(_lag_spectra, d=d, starts=starts, size=size, groups=groups), _SPECTRA)
    own = n.select("symbol", F.explode(F.sequence(F.lit(0), "last")).alias("block")).join(lags, "block")
    both = spectra.withColumn("kind", F.lit(0)).unionByName(own.withColumn("kind", F.lit(1)))
    mixed = both.groupBy("symbol", "g").applyInPandas(_over_blocks, "symbol string, g int, block int, re array<double>, im array<double>")
    back = partial(_from_spectra, size=size)
    sums = mixed.groupBy("symbol", "block").applyInPandas(lambda key, part: back(key, part), "symbol string, block int, sums array<double>")
    sums = sums.select("symbol", F.col("block").alias("_block"), F.posexplode("sums").alias("_in", out))
    skip = n.select("symbol", "n").mapInPandas(partial(_skips, d=d, threshold=threshold), "symbol string, _skip long")
    rows = rows.withColumn("_in", (F.col("_pos") % size).cast("int")).join(sums, ["symbol", "_block", "_in"]).join(skip, "symbol")
    return rows.where((F.col("_pos") >= F.col("_skip")) & finite(value)).drop("_x", "_pos", "_block", "_in", "_skip")


def _skips(batches: Iterator[pd.DataFrame], d: float, threshold: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"symbol": batch["symbol"], "_skip": [skipped(d, int(n), threshold) for n in batch["n"]]})


def resample_last(series: DataFrame, value: str, span: int) -> DataFrame:
    """The last value of each bucket."""
    start = F.col("us") - F.pmod("us", F.lit(span))
    return series.groupBy("symbol", start.alias("bucket")).agg(F.max_by(value, "us").alias(value), F.count("*").alias("rows"))


def adf_moments(series: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Regression of the change on a constant, the level before and the change before: one aggregate and a closed-form solve.

    ``stat`` is the t value of the level, ``nobs`` the rows used, ``lags`` the
    changes before that are in it (one), ``crit5`` the 5 % value for ``nobs``.
    """
    rows, order = blocked(series, 2)
    rows = rows.withColumn("l", F.lag(value).over(order)).withColumn("_ll", F.lag(value, 2).over(order))
    rows = unblocked(rows.withColumn("y", F.col(value) - F.col("l")).withColumn("z", F.col("l") - F.col("_ll")), 2)
    return _adf(rows.where("y IS NOT NULL"), by)


def _adf(rows: DataFrame, by: list[str]) -> DataFrame:
    m = rows.where("z IS NOT NULL").groupBy(*by).agg(
        F.count("*").cast("double").alias("n"), *(F.avg(c).alias(f"m{c}") for c in "lzy"),
        *(F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in ("ll", "zz", "yy", "lz", "ly", "zy")),
    )
    det = F.col("cll") * F.col("czz") - F.col("clz") ** 2
    gamma = (F.col("cly") * F.col("czz") - F.col("czy") * F.col("clz")) / det
    delta = (F.col("czy") * F.col("cll") - F.col("cly") * F.col("clz")) / det
    residual = F.greatest(F.lit(0.0), F.col("cyy") - gamma * F.col("cly") - delta * F.col("czy"))
    error = F.sqrt(residual * F.col("n") / (F.col("n") - 3) * F.col("czz") / det / F.col("n"))
    stat = F.try_divide(gamma, error)
    return m.where("n > 3").select(*by, F.col("n").cast("long").alias("nobs"), gamma.alias("gamma"), stat.alias("stat"), F.lit(1).alias("lags"), critical_5(F.col("n")).alias("crit5"), p_value(stat).alias("p"))


# MacKinnon's published response surface (1994) for one variable with a constant, and its finite-sample 5 % coefficients in 1/n (2010).
_LOWEST, _HIGHEST, _SPLIT = -18.83, 2.74, -1.61
_SMALL, _LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
_CRITICAL = (-2.86154, -2.8903, -4.234, -40.04)
# Abramowitz and Stegun's formula 7.1.26 for the error function (within 1.5e-7).
_ERF_SCALE, _ERF = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def critical_5(n: Column) -> Column:
    return sum((F.lit(c) / n**k for k, c in enumerate(_CRITICAL) if k), F.lit(_CRITICAL[0]))


def p_value(stat: Column) -> Column:
    """Approximate p-value of the constant-only test."""
    side = lambda cs: sum((F.lit(c) * stat**k for k, c in enumerate(cs) if k), F.lit(cs[0]))
    z = F.when(stat <= _SPLIT, side(_SMALL)).otherwise(side(_LARGE)) / 2**0.5
    t = 1 / (1 + _ERF_SCALE * F.abs(z))
    tail = sum((F.lit(c) * t ** (k + 1) for k, c in enumerate(_ERF)), F.lit(0.0)) * F.exp(-z * z) / 2
    return F.when(stat >= _HIGHEST, 1.0).when(stat <= _LOWEST, 0.0).otherwise(F.when(z < 0, tail).otherwise(1 - tail))


def min_d_table(series: DataFrame, value: str, grid: list[float], threshold: float, least_rows: int = 20) -> DataFrame:
    """Every ``d`` of the grid with the test's figures and the correlation with the original, for differences of ``least_rows`` rows or more.

    All differences come from one window over blocks; only their moments leave it.
    """
    ws = {d: ffd_weights(d, threshold) for d in grid}
    reach = max(map(len, ws.values())) - 1
    filled, order = blocked(_filled(series, value, _own=("sum", F.when(finite(value), 1).otherwise(0))), reach)
    lags = filled.select("*", *(F.lag("_x", k).over(order).alias(f"_x{k}") for k in range(1, reach + 1)), F.col("_x").alias("_x0"))
    wide = lags.select("symbol", "us", value, "_pos", "_block", "_own", *(sum((F.lit(c) * F.col(f"_x{k}") for k, c in enumerate(w)), F.lit(0.0)).alias(f"_d{i}") for i, w in enumerate(ws.values())))
    # again in blocks, as rows without a value of their own are none of the test's; the numbers of those with one came along
    own = unblocked(wide, reach).where(finite(value)).withColumn("_pos", (F.col("_own") - 1).cast("long")).drop("_own")
    rows, order = blocked(own, 2)
    before = rows.select("*", *(F.lag(f"_d{i}", k).over(order).alias(f"_d{i}_{k}") for i in range(len(grid)) for k in (1, 2)))
    each = F.explode(F.array(*(F.struct(F.lit(float(d)).alias("d"), F.col(f"_d{i}").alias("fd"), F.col(f"_d{i}_1").alias("l"), F.col(f"_d{i}_2").alias("ll")) for i, d in enumerate(grid))))
    long = unblocked(before, 2).select("symbol", value, each.alias("e")).select("symbol", value, "e.*").where("fd IS NOT NULL")
    long = long.withColumn("y", F.col("fd") - F.col("l")).withColumn("z", F.col("l") - F.col("ll"))
    corr = long.groupBy("symbol", "d").agg(F.corr(value, "fd").alias("corr"), F.count("*").alias("rows"))
    return _adf(long, ["symbol", "d"]).join(corr, ["symbol", "d"]).where(F.col("rows") >= least_rows)


def pick_d(table: DataFrame, level: float = 0.05) -> DataFrame:
    """The smallest ``d`` whose p-value is below ``level``, else the largest."""
    return table.groupBy("symbol").agg(F.coalesce(F.min(F.when(F.col("p") < level, F.col("d"))), F.max("d")).alias("d"))


def lag_features(series: DataFrame, value: str, lags: int) -> DataFrame:
    """``fd_lag0..`` of the value and ``fd_ret_lag0..`` of its change (one lag less, at least one)."""
    rows, order = blocked(series, lags)
    rows = rows.withColumn("_d", F.col(value) - F.lag(value).over(order))
    own = [F.lag(value, k).over(order).alias(f"fd_lag{k}") for k in range(lags)]
    moves = [F.lag("_d", k).over(order).alias(f"fd_ret_lag{k}") for k in range(max(1, lags - 1))]
    return unblocked(rows.select("symbol", "us", "_pos", "_block", *own, *moves), lags)


def event_features(features: DataFrame, events: DataFrame) -> DataFrame:
    """The features at the events' starts, for events with all of them: ``symbol, t0`` and the features."""
    names = [c for c in features.columns if c not in ("symbol", "us")]
    rows = events.select("symbol", "t0").join(features.withColumnRenamed("us", "t0"), ["symbol", "t0"], "left")
    return complete(rows, names)


def complete(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows in which none of these is missing."""
    return rows.dropna("any", subset=names)


def aligned(events: DataFrame, labels: DataFrame, uniqueness: DataFrame, weights: DataFrame) -> DataFrame:
    """Events that have a label, with ``y`` (1 for a positive one), their uniqueness ``tw`` and weight ``w``: ``symbol, t0, t1, y, tw, w``."""
    labelled = labels.where("bin IS NOT NULL").select("symbol", "t0", (F.col("bin") > 0).cast("double").alias("y"))
    rows = events.select("symbol", "t0", "t1").join(labelled, ["symbol", "t0"])
    return rows.join(uniqueness.select("symbol", "t0", "tw"), ["symbol", "t0"]).join(weights.select("symbol", "t0", "w"), ["symbol", "t0"])


def sample_share(aligned_rows: DataFrame) -> float:
    """Mean uniqueness within (1e-6, 1]: what share of the samples a bag should draw."""
    mean = aligned_rows.agg(F.avg("tw")).first()[0]
    return max(1e-6, min(1.0, mean)) if mean is not None else 1.0
