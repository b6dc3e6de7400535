"""Purged and embargoed cross-validation as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.running import running
from tidemark.session import staged


def positions(samples: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, the row number from 0 over the whole table, without one task sorting it all.

    Rows are range-partitioned, sorted and numbered inside their partition,
    and written once: the partitions' sizes (one small row each) and the rows
    then speak of the same partitions, however Spark cut them.
    """
    spread = samples.repartitionByRange(*order).sortWithinPartitions(*order)
    # the low 33 bits of this id count a partition's rows in their order
    spread = spread.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    spread = staged(spread, "positions")
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    return spread.join(F.broadcast(before), "_part").withColumn("pos", F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")


def fold_bounds(samples: DataFrame, folds: int) -> DataFrame:
    """Folds are runs of near-equal length, the first ones a row longer: ``fold, lo, hi, t0_lo, t0_hi, t1_hi, n``."""
    n = samples.count()
    size, extra = divmod(n, folds)
    edge = extra * (size + 1)
    fold = F.when(F.col("pos") < edge, F.floor(F.col("pos") / (size + 1))).otherwise(extra + F.floor((F.col("pos") - edge) / max(size, 1)))
    return samples.groupBy(fold.cast("int").alias("fold")).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min("t0").alias("t0_lo"), F.max("t0").alias("t0_hi"), F.max("t1").alias("t1_hi"), F.lit(n).cast("long").alias("n"))


def purged_kfold(samples: DataFrame, folds: int, embargo: float, purge: str = "t1") -> DataFrame:
    """``fold, sample, role``: test rows of each fold, and the training rows that stay.

    ``samples(sample, pos, t0, t1)``.  A training row goes if its span meets the
    test span, which ends with the fold's last start (``purge="t0"``) or last
    end (``"t1"``); so do ``int(n * embargo)`` rows after the fold.
    """
    bounds = F.broadcast(fold_bounds(samples, folds))  # one row per fold
    end = F.col("t0_hi") if purge == "t0" else F.greatest("t0_hi", "t1_hi")
    rows = samples.withColumn("fold", F.explode(F.array(*(F.lit(k) for k in range(folds))))).join(bounds, "fold")
    test = F.col("pos").between(F.col("lo"), F.col("hi"))
    overlap = (F.col("t0") <= end) & (F.col("t1") >= F.col("t0_lo"))
    held = (F.col("pos") > F.col("hi")) & (F.col("pos") <= F.col("hi") + F.floor(F.col("n") * embargo))
    role = F.when(test, "test").when(~overlap & ~held, "train")
    return rows.withColumn("role", role).where("role IS NOT NULL").select("fold", "sample", "role")


def embargo_times(samples: DataFrame, share: float) -> DataFrame:
    """Each time with the time ``int(n * share)`` rows later; the tail has the last time."""
    n, last = samples.agg(F.count("*"), F.max("t0")).first()
    later = samples.select((F.col("pos")).alias("_p"), F.col("t0").alias("later"))
    rows = samples.withColumn("_p", F.col("pos") + int(n * share))
    return rows.join(later, "_p", "left").select("sample", "t0", F.coalesce("later", F.lit(last)).alias("embargo"))


def purge_train(train: DataFrame, tests: DataFrame) -> DataFrame:
    """Training rows whose span neither begins nor ends in a test span, nor covers one.

    A row meets a test span if the latest end among those that begin by its own
    end is not before its start: a running maximum, whatever the number of spans.
    """
    nothing = F.lit(None).cast("long")
    starts = tests.groupBy(F.col("t0").alias("_at")).agg(F.max("t1").alias("_end")).select("_at", F.lit(0).alias("_kind"), "_end", *(F.lit(None).cast(t).alias(c) for c, t in train.dtypes))
    ends = train.select(F.col("t1").alias("_at"), F.lit(1).alias("_kind"), nothing.alias("_end"), *train.columns)
    rows = running(starts.unionByName(ends), ["_at", "_kind"], {"_latest": ("max", F.col("_end"))}, by=())
    return rows.where("_kind = 1 AND (_latest IS NULL OR _latest < t0)").select(*train.columns)


def purged_folds_of_events(samples: DataFrame, folds: int, embargo: float) -> DataFrame:
    """``fold, sample, role`` by the positions of an ordered event list ``samples(sample, pos, t0, t1)``.

    A fold's test rows are a run of positions.  Training rows before it are
    those whose label ends by the fold's first start; those after it begin
    ``int(n * embargo)`` rows or more behind the rows that start before the
    fold's latest end.
    """
    bounds = fold_bounds(samples, folds)
    reach = samples.join(F.broadcast(bounds.select("fold", "t1_hi")), F.col("t0") < F.col("t1_hi")).groupBy("fold").agg(F.count("*").alias("after"))
    bounds = F.broadcast(bounds.join(reach, "fold", "left"))  # one row per fold
    rows = samples.withColumn("fold", F.explode(F.array(*(F.lit(k) for k in range(folds))))).join(bounds, "fold")
    test = F.col("pos").between(F.col("lo"), F.col("hi"))
    left = (F.col("pos") < F.col("lo")) & (F.col("t1") <= F.col("t0_lo"))
    right = (F.col("pos") > F.col("hi")) & (F.col("pos") >= F.coalesce("after", F.lit(0)) + F.floor(F.col("n") * embargo))
    role = F.when(test, "test").when(left | right, "train")
    return rows.withColumn("role", role).where("role IS NOT NULL").select("fold", "sample", "role")
