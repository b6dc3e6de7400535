"""Small closed formulas as column expressions."""

from __future__ import annotations

import math
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ensemble_accuracy(p: Column, voters: int, classes: int) -> Column:
    """Chance that more than ``voters / classes`` of independent voters, each right with chance ``p``, are right."""
    wrong = sum((F.lit(float(comb(voters, i))) * F.pow(p, F.lit(i)) * F.pow(1 - p, F.lit(voters - i)) for i in range(voters // classes + 1)), F.lit(0.0))
    return 1 - wrong


def permuted_position(pos: Column, n: int, *seeds: Column | int | str, rounds: int = 4) -> Column:
    """Where a seeded permutation of 0 to ``n - 1`` puts a position: one of ``n!``, told by a few hashes and without a sort.

    A Feistel network over a grid of a little more than ``n`` cells: rows are
    shifted by a hash of the column and columns by a hash of the row, in turn.
    A cell beyond ``n`` is mapped again until it is not; there are fewer such
    cells than the grid has rows, so few steps are enough.
    """
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))
    keys = [F.lit(s) if isinstance(s, (int, str)) else s for s in seeds]

    def turn(s: Column, i: Column) -> Column:
        left, right = s["l"], s["r"]
        by_right = (left + F.pmod(F.xxhash64(right, i, *keys), F.lit(a))) % a
        by_left = (right + F.pmod(F.xxhash64(left, i, *keys), F.lit(b))) % b
        odd = i % 2 == 1
        return F.struct(F.when(odd, left).otherwise(by_right).alias("l"), F.when(odd, by_left).otherwise(right).alias("r"))

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * rounds - 1)), start, turn, lambda s: s["l"] * b + s["r"])

    # at most a * b - n steps; far fewer than 64 unless n is large, and then a step leads out with a chance of 1 in a
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(pos.cast("long")), lambda x, _: F.when(x < n, x).otherwise(once(x)))


def weighted_tau(items: DataFrame, x: str, y: str) -> DataFrame:
    """Weighted rank correlation with additive hyperbolic weights, averaged over ranking by ``x`` and by ``y`` (few items)."""
    from pyspark.sql import Window

    rows = items.select(F.col(x).alias("x"), F.col(y).alias("y"))
    rows = rows.withColumn("rx", F.row_number().over(Window.orderBy(F.desc("x"), F.desc("y"))) - 1).withColumn("ry", F.row_number().over(Window.orderBy(F.desc("y"), F.desc("x"))) - 1)
    a, b = rows.select(*(F.col(c).alias(f"{c}a") for c in rows.columns)), rows.select(*(F.col(c).alias(f"{c}b") for c in rows.columns))
    pairs = a.join(F.broadcast(b), F.col("rxa") < F.col("rxb"))
    sx, sy = F.signum(F.col("xa") - F.col("xb")), F.signum(F.col("ya") - F.col("yb"))
    sums = []
    for r in ("rx", "ry"):
        w = 1 / (1 + F.col(f"{r}a")) + 1 / (1 + F.col(f"{r}b"))
        sums += [F.sum(w * sx * sy).alias(f"{r}_c"), F.sum(w * sx * sx).alias(f"{r}_x"), F.sum(w * sy * sy).alias(f"{r}_y")]
    tau = lambda r: F.try_divide(F.col(f"{r}_c"), F.sqrt(F.col(f"{r}_x") * F.col(f"{r}_y")))
    return pairs.agg(*sums).select(((tau("rx") + tau("ry")) / 2).alias("tau"))
