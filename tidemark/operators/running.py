"""Running figures and short windows over long series, cut so that one busy symbol is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import staged
from tidemark.sources.tapes import DAY

#: Rows of a block of :func:`blocked`.
BLOCK_ROWS = 1 << 16


def running(rows: DataFrame, order: list[str], figures: dict[str, tuple[str, Column]], by: tuple[str, ...] = ("symbol",), before: bool = False, width: int = DAY) -> DataFrame:
    """Adds running ``sum``, ``max`` or ``last`` (not null) figures, each row's own value included (not with ``before``).

    Two levels: a figure runs over rows inside a day only, and a total for each
    day gives the days after it their offset (one row a day).  Both come from
    one pass: rows are dealt and sorted once and written with their figures
    inside the day, and the totals read the few columns they need of that
    table.  So a chain of such figures reads its source once, however long.
    The first column of ``order`` is a time in microseconds; rows that tie in
    all of it may count in any order.  Rows without a time or a key are left out.
    """
    keys = [*by, "_day"]
    rows = rows.withColumn("_day", F.floor(F.col(order[0]) / width).cast("long"))
    whole = {"sum": F.sum, "max": F.max, "last": lambda v: F.max_by(v, F.when(v.isNotNull(), F.struct(*order)))}
    over = {"sum": F.sum, "max": F.max, "last": lambda v: F.last(v, ignorenulls=True)}
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "last": lambda a, b: F.coalesce(b, a)}
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    rows = staged(rows.select("*", *(over[kind](value).over(inside).alias(f"_{name}_b") for name, (kind, value) in figures.items())), "running")
    totals = rows.groupBy(*keys).agg(*(whole[kind](value).alias(f"_{name}_a") for name, (kind, value) in figures.items()))
    earlier = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *(over[kind](F.col(f"_{name}_a")).over(earlier).alias(f"_{name}_a") for name, (kind, _) in figures.items()))
    rows = rows.join(offsets, keys)
    drop = ["_day", *(f"_{name}_{x}" for name in figures for x in "ab")]
    return rows.withColumns({name: both[kind](F.col(f"_{name}_a"), F.col(f"_{name}_b")) for name, (kind, _) in figures.items()}).drop(*drop)


def numbered(series: DataFrame, out: str = "_pos", by: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("us",), width: int = DAY) -> DataFrame:
    """Adds the row number from 0 of each symbol's series; ``width`` cuts what ``order`` begins with into parts of a task."""
    return running(series, list(order), {out: ("sum", F.lit(1))}, by, width=width).withColumn(out, (F.col(out) - 1).cast("long"))


def blocked(series: DataFrame, reach: int, by: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("us",), width: int = DAY) -> tuple[DataFrame, Window]:
    """A series in blocks of rows, each with the ``reach`` rows before it, and the window inside a block; ``_pos`` numbers rows, and is taken as it is where it is there.

    What is computed over the window looks back ``reach`` rows at most and is
    right for every row that :func:`unblocked` keeps.
    """
    size = max(BLOCK_ROWS, 4 * reach)
    block = F.floor(F.col("_pos") / size)
    again = F.col("_pos") % size >= size - reach
    rows = series if "_pos" in series.columns else numbered(series, "_pos", by, order, width)
    rows = rows.withColumn("_block", F.explode(F.when(again, F.array(block, block + 1)).otherwise(F.array(block))))
    return rows, Window.partitionBy(*by, "_block").orderBy("_pos")


def unblocked(rows: DataFrame, reach: int) -> DataFrame:
    """Drops the rows that a block only borrowed."""
    size = max(BLOCK_ROWS, 4 * reach)
    return rows.where(F.floor(F.col("_pos") / size) == F.col("_block")).drop("_pos", "_block")
