"""As-of joins of two tables by running figures: no range join, and no task holds more than one key's day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import running


def as_of_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[str], columns: list[str], forward: bool = False, strict: bool = False, tolerance: int | None = None, tie: str | None = None, inner: bool = False, time_out: str | None = None) -> DataFrame:
    """Every row of ``left`` with ``columns`` of the row of ``right`` nearest in time under the same keys: the last before it, or with ``forward`` the first after it.

    Times are whole numbers (microseconds).  A row at the same time counts,
    unless ``strict``.  One farther away than ``tolerance`` is no match.  Of
    rows of ``right`` at one time the last by ``tie`` is taken (with
    ``forward`` the first), and by all ``columns`` where that leaves several;
    many rows of ``left`` may take one row of ``right``.  Rows without a match
    stay with nulls (with ``inner`` they go); so do rows whose time or key is
    null.  ``time_out`` names a column for the time of the match.  An empty
    ``right`` matches nothing, an empty ``left`` stays empty.

    Questions and answers go through one running pass in two levels: inside a
    day they are merged in order, and each day's last answer is handed on.
    """
    sign = -1 if forward else 1
    best = F.min if forward else F.max
    payload = F.struct(*([F.col(tie).alias("_tie")] if tie else []), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    # repeats of one time meet in an aggregate, which combines before the shuffle, however many they are
    known = right.where(F.col(right_time).isNotNull()).groupBy(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), (F.col(right_time) * sign).alias("_at")).agg(best(payload).alias("_x"))
    known = known.select("*", F.lit(1 if strict else 0).alias("_kind"), F.struct(F.col("_at"), *(F.col(f"_x.c{i}").alias(f"c{i}") for i in range(len(columns)))).alias("_found")).drop("_x")
    # left rows travel as one column, so that names of the two tables do not clash
    whole = left.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), (F.col(left_time) * sign).alias("_at"), F.struct(*left.columns).alias("_row"))
    asks = whole.where(" AND ".join(["_at IS NOT NULL", *(f"_by{i} IS NOT NULL" for i in range(len(by)))])).withColumn("_kind", F.lit(0 if strict else 1))
    marks = asks.unionByName(known, allowMissingColumns=True)
    done = running(marks, ["_at", "_kind"], {"_last": ("last", F.col("_found"))}, by=tuple(f"_by{i}" for i in range(len(by)))).where("_row IS NOT NULL")
    near = F.col("_last") if tolerance is None else F.when(F.col("_at") - F.col("_last._at") <= tolerance, F.col("_last"))
    done = done.select("_row", near.alias("_last"))
    if inner:
        done = done.where("_last IS NOT NULL")
    else:
        lost = whole.where(" OR ".join(["_at IS NULL", *(f"_by{i} IS NULL" for i in range(len(by)))]))
        done = done.unionByName(lost.select("_row"), allowMissingColumns=True)
    when = [] if time_out is None else [(F.col("_last._at") * sign).alias(time_out)]
    return done.select("_row.*", *when, *(F.col(f"_last.c{i}").alias(c) for i, c in enumerate(columns)))
