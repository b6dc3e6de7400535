"""Session helpers of the text operators: the shared folder, staged tables, numbers of partitions and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import discard, new_path, partitions, shared_folder, staged

__all__ = ["bounded_sample", "buckets", "discard", "few", "id_order", "light", "new_path", "partitions", "shared_folder", "staged"]


def buckets(rows: DataFrame, column: str, each: int = 4 << 20) -> int:
    """A power of two of buckets for about ``each`` bytes of a text column, so that buckets grow in number, not in size."""
    total = rows.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return 1 << max(3, (-(-total // each) - 1).bit_length())


#: Rows of a few numbers that may be sent to every executor.
LIGHT = 1_000_000


def light(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` of a few numbers each, marked for broadcast if there are at most ``LIGHT``; else Spark shuffles them."""
    return F.broadcast(rows) if n <= LIGHT else rows


#: Rows of a few numbers that one task writes at least, where there are more tasks than cores.
_TASK_ROWS = 50_000


def few(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` of a few numbers each, ``n`` at most, in as many tasks as they are worth: however many partitions a shuffle has, a small table is no more files than there are cores."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // _TASK_ROWS)))


def id_order(column: str | Column) -> Column:
    """Sort key that puts a null identifier before every other."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(-(1 << 63)).cast("long"))


def bounded_sample(rows: DataFrame, by: list[str], most: int, seed: int, keep: list[Column] | None = None) -> DataFrame:
    """At most ``most`` rows (or ``keep`` of them), those with the smallest hashes of ``by``; the same ones in every run.

    A threshold on the hash leaves about four times as many before they are
    ordered, so what the ordering gathers does not grow with the table.
    """
    h = F.xxhash64(*by, F.lit(seed))
    total = rows.count()
    if total > 4 * most:
        rows = rows.where(h < int(-(1 << 63) + (1 << 64) * (4 * most / total)))
    return rows.select(*(keep or rows.columns), h.alias("_h")).orderBy("_h").limit(most).drop("_h")
