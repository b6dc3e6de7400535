"""Tree ensembles under purged folds: scores, and three measures of feature importance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import permuted_position
from tidemark.operators.crossval import positions
from tidemark.session import staged


def forest(rows: DataFrame, features: list[str], trees: int = 20, share: float = 1.0, subset: str = "sqrt", depth: int = 5, seed: int = 1, bootstrap: bool = True) -> RandomForestClassificationModel:
    """Entropy forest on ``y`` with weights ``w`` times the balance of classes; ``subset="all"`` makes it bagged trees."""
    total = rows.agg(F.sum("w").alias("w"), F.countDistinct("y").alias("k")).first()
    each = rows.groupBy("y").agg((F.lit(total.w) / (F.lit(total.k) * F.sum("w"))).alias("_balance"))
    balanced = rows.join(F.broadcast(each), "y").withColumn("_w", F.col("w") * F.col("_balance"))
    vectors = VectorAssembler(inputCols=features, outputCol="_x").transform(balanced)
    return RandomForestClassifier(featuresCol="_x", labelCol="y", weightCol="_w", impurity="entropy", numTrees=trees, maxDepth=depth, subsamplingRate=share, featureSubsetStrategy=subset, bootstrap=bootstrap, seed=seed).fit(vectors)


def _scores(model, rows: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """Weighted accuracy and negative log loss of a fitted model, by groups of rows."""
    done = model.transform(VectorAssembler(inputCols=features, outputCol="_x").transform(rows))
    p = F.least(F.lit(1 - 1e-15), F.greatest(F.lit(1e-15), F.element_at(vector_to_array("probability"), F.col("y").cast("int") + 1)))
    return done.groupBy(*by).agg((F.sum(F.when(F.col("prediction") == F.col("y"), F.col("w")).otherwise(0)) / F.sum("w")).alias("accuracy"), (F.sum(F.log(p) * F.col("w")) / F.sum("w")).alias("neg_log_loss"))


def score(model, rows: DataFrame, features: list[str]) -> DataFrame:
    """Weighted accuracy and negative log loss of a model in one row."""
    return _scores(model, rows, features, [])


def split(samples: DataFrame, roles: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    own = roles.where(F.col("fold") == fold)
    return tuple(samples.join(own.where(F.col("role") == r).select("sample"), "sample") for r in ("train", "test"))


def logistic(rows: DataFrame, features: list[str], penalty: float = 0.01):
    """Logistic regression on ``y`` with weights ``w``."""
    vectors = VectorAssembler(inputCols=features, outputCol="_x").transform(rows)
    return LogisticRegression(featuresCol="_x", labelCol="y", weightCol="w", regParam=penalty).fit(vectors)


def cv_scores(samples: DataFrame, roles: DataFrame, folds: int, features: list[str], fit: Callable = forest, **options) -> DataFrame:
    """Scores by fold, of whatever ``fit(rows, features, **options)`` returns: a fitted classifier of ``_x`` with ``prediction`` and ``probability``."""
    out = None
    for k in range(folds):
        train, test = split(samples, roles, k)
        part = score(fit(train, features, **options), test, features).select(F.lit(k).alias("fold"), "accuracy", "neg_log_loss")
        out = part if out is None else out.unionByName(part)
    return out


def mean_decrease_impurity(spark, model: RandomForestClassificationModel, features: list[str]) -> DataFrame:
    """Mean and standard error over trees, zeros left out, scaled to a sum of one."""
    each = np.array([t.featureImportances.toArray() for t in model.trees])
    each[each == 0] = np.nan
    rows = [(f, float(np.nanmean(each[:, i])) if np.isfinite(each[:, i]).any() else 0.0, float(np.nanstd(each[:, i], ddof=1) / np.sqrt(len(each))) if np.isfinite(each[:, i]).sum() > 1 else 0.0) for i, f in enumerate(features)]
    total = sum(m for _, m, _ in rows) or 1.0
    return spark.createDataFrame([(f, m / total, s / total) for f, m, s in rows], "feature string, mean double, std double")


def permuted(rows: DataFrame, feature: str, seed: int) -> DataFrame:
    """The rows, numbered as ``pos``, with one column shuffled among them by a seeded permutation of their numbers."""
    numbered = positions(rows.drop("pos"), ["sample"])
    n = numbered.count()
    moved = numbered.select(permuted_position(F.col("pos"), n, seed, feature).alias("pos"), feature)
    return numbered.drop(feature).join(moved, "pos")


def every_permuted(rows: DataFrame, features: list[str], n: int, seed: int) -> DataFrame:
    """Rows numbered 0 to ``n - 1`` by ``pos``, once as they are (``feature`` is null) and once for each feature with that one shuffled.

    Each row sends every value to the position that the feature's permutation
    gives it; a position gets one of each, and they meet in one shuffle.
    """
    sent = F.explode(F.array(*(F.struct(permuted_position(F.col("pos"), n, seed, f).alias("pos"), F.lit(i).alias("i"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features))))
    got = rows.select(sent.alias("s")).groupBy("s.pos").agg(F.array_sort(F.collect_list(F.struct("s.i", "s.v"))).alias("_got"))
    which = F.explode(F.array(F.lit(-1), *(F.lit(i) for i in range(len(features)))))
    long = rows.join(got, "pos").withColumn("_which", which)
    shuffled = [F.when(F.col("_which") == i, F.col("_got")[i]["v"]).otherwise(F.col(f)).alias(f) for i, f in enumerate(features)]
    name = F.when(F.col("_which") >= 0, F.array(*(F.lit(f) for f in features))[F.greatest(F.col("_which"), F.lit(0))])
    return long.select(*(c for c in rows.columns if c not in features), *shuffled, name.alias("feature"))


def mean_decrease_accuracy(samples: DataFrame, roles: DataFrame, folds: int, features: list[str], scoring: str = "neg_log_loss", seed: int = 3, fit: Callable = forest, **options) -> DataFrame:
    """Loss of score when a feature is shuffled in the test fold, relative to what was left to lose; by log loss or by accuracy.

    A fold is numbered once, and scored with all its shuffled features in one job.
    """
    best = {"neg_log_loss": 0.0, "accuracy": 1.0}[scoring]
    out = None
    for k in range(folds):
        train, test = split(samples, roles, k)
        test = positions(test.drop("pos"), ["sample"])
        model = fit(train, features, **options)
        each = _scores(model, every_permuted(test, features, test.count(), seed + k), features, ["feature"])
        each = staged(each, "scores")  # a row a feature
        base = each.where("feature IS NULL").select(F.col(scoring).alias("base"))
        part = each.where("feature IS NOT NULL").crossJoin(base).select("feature", F.try_divide(F.col("base") - F.col(scoring), F.lit(best) - F.col(scoring)).alias("v"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("feature").agg(F.avg("v").alias("mean"), (F.stddev_samp("v") / folds**0.5).alias("std"))


def single_feature(samples: DataFrame, roles: DataFrame, folds: int, features: list[str], scoring: str = "neg_log_loss", **options) -> DataFrame:
    """Mean score of models of one feature each, scaled to a sum of sizes of one, with its standard error and the score itself."""
    out = None
    for f in features:
        part = cv_scores(samples, roles, folds, [f], **options).withColumn("feature", F.lit(f))
        out = part if out is None else out.unionByName(part)
    each = out.groupBy("feature").agg(F.avg(scoring).alias("score"), (F.stddev_pop(scoring) / folds**0.5).alias("std"))
    total = each.agg(F.sum(F.abs("score")).alias("_t"))
    return each.crossJoin(total).select("feature", F.try_divide(F.col("score"), F.col("_t")).alias("mean"), "std", "score")  # a row a feature


def bagged_trees(rows: DataFrame, features: list[str], bags: int, share: float, subset: str = "all", depth: int = 5, seed: int = 1) -> tuple[list, DataFrame]:
    """Trees on bags of a share of the rows, and their out-of-bag accuracy as one row ``oob, judged``.

    A bag's rows are chosen by a hash of the sample, with replacement: the
    number of times that a row is in follows a Poisson law by its hash.
    ``subset="sqrt"`` makes each tree a forest of one (double bagging).
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    steps, p, total = [], exp(-share), 0.0
    for k in range(1, 12):  # beyond, a chance of less than one in a hundred million
        total += p
        steps.append(total)
        p *= share / k
    rows = staged(rows, "bagged")
    votes, models = None, []
    for k in range(bags):
        u = (F.xxhash64("sample", F.lit(seed), F.lit(k)) / F.lit(2.0**64)) + 0.5
        times = sum((F.when(u >= x, 1).otherwise(0) for x in steps), F.lit(0))
        bag = rows.withColumn("_times", times)
        model = forest(bag.where("_times > 0").withColumn("w", F.col("w") * F.col("_times")), features, trees=1, subset=subset, depth=depth, seed=seed + k, bootstrap=False)
        models.append(model)
        out = model.transform(VectorAssembler(inputCols=features, outputCol="_x").transform(bag.where("_times = 0"))).select("sample", "y", "w", "prediction")
        votes = out if votes is None else votes.unionByName(out)
    each = votes.groupBy("sample", "y", "w").agg(F.avg("prediction").alias("vote"))
    right = F.when((F.col("vote") > 0.5).cast("double") == F.col("y"), 1.0).otherwise(0.0)
    return models, each.agg(F.avg(right).alias("oob"), F.count("*").alias("judged"))


def feature_importance(spark, samples: DataFrame, roles: DataFrame, folds: int, features: list[str], method: str, scoring: str = "accuracy", bags: int = 10, share: float = 1.0, **options) -> DataFrame:
    """One entry for the three measures: ``method, feature, mean, std`` with the out-of-bag accuracy and the mean score over purged folds beside them."""
    if method not in ("MDI", "MDA", "SFI"):
        raise ValueError(method)
    _, oob = bagged_trees(samples, features, bags, share)
    oos = cv_scores(samples, roles, folds, features, **options).agg(F.avg(scoring).alias("oos"))
    if method == "MDI":
        out = mean_decrease_impurity(spark, forest(samples, features, **options), features)
    elif method == "MDA":
        out = mean_decrease_accuracy(samples, roles, folds, features, scoring, **options)
    else:
        out = single_feature(samples, roles, folds, features, scoring, **options)
    return out.select(F.lit(method).alias("method"), "feature", "mean", "std").crossJoin(oob.select("oob")).crossJoin(oos)  # one row each


def synthetic_samples(spark, n: int, informative: int, redundant: int, noise: int, seed: int = 0, last_day: int = 19_720) -> DataFrame:
    """Labelled rows for trying out the measures: features ``I_*`` that make the label, ``R_*`` that are mixtures of these, ``N_*`` that say nothing.

    Columns are ``sample, t0, t1, w, y`` and the features; times are consecutive
    business days that end on ``last_day`` (days since 1970).
    """
    i = [F.randn(seed * 1000 + k).alias(f"I_{k}") for k in range(informative)]
    rows = spark.range(n).select(F.col("id").alias("sample"), *i, *(F.randn(seed * 1000 + 500 + k).alias(f"N_{k}") for k in range(noise)), F.randn(seed * 1000 + 999).alias("_e"))
    weight = np.random.default_rng(seed).uniform(-1, 1, (redundant, informative))
    rows = rows.select("*", *(sum((F.col(f"I_{j}") * float(weight[k, j]) for j in range(informative)), F.lit(0.0)).alias(f"R_{k}") for k in range(redundant)))
    signal = sum((F.col(f"I_{k}") for k in range(informative)), F.lit(0.0))
    weekday = (last_day + 3) % 7  # 0: Monday
    if weekday > 4:
        raise ValueError("last_day must be a business day")
    back = n - 1 - F.col("sample")  # business days before the last one
    day = last_day - back - 2 * F.floor((back + (4 - weekday)) / 5)
    return rows.withColumn("y", (signal + F.col("_e") * 0.3 > 0).cast("double")).withColumn("w", F.lit(1.0 / n)).withColumn("t0", day.cast("long")).withColumn("t1", F.col("t0")).drop("_e")


def importance_by_kind(importances: DataFrame) -> DataFrame:
    """Importances of a table ``method, feature, mean`` summed by what stands before the feature's underscore."""
    return importances.groupBy("method", F.split("feature", "_")[0].alias("kind")).agg(F.sum("mean").alias("mean"))


def _products(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """A task's rows as their number, means, and centred sums of products, merged batch by batch so that nothing large cancels."""
    n, mean, second = 0, np.zeros(dims), np.zeros((dims, dims))
    for batch in batches:
        column = batch.column(0).drop_null()
        if not len(column):
            continue
        x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)[:, :dims]
        own = x.mean(axis=0)
        gap = own - mean
        second += (x - own).T @ (x - own) + np.outer(gap, gap) * (n * len(x) / (n + len(x)))
        mean += gap * (len(x) / (n + len(x)))
        n += len(x)
    if n:
        i, j = np.triu_indices(dims)
        columns = [i.astype(np.int32), j.astype(np.int32), np.full(len(i), n), mean[i], mean[j], second[i, i], second[j, j], second[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "n", "a", "b", "aa", "bb", "ab"])


def correlations(vectors: DataFrame, column: str, dims: int) -> DataFrame:
    """Correlation of every two of the ``dims`` entries of an array: ``i, j, corr``, from each task's centred sums of products.

    Sums of tasks merge by their own centres: to the products inside tasks
    come those of the tasks' means about the mean of all.
    """
    parts = vectors.select(column).mapInArrow(partial(_products, dims=dims), "i int, j int, n long, a double, b double, aa double, bb double, ab double")
    between = {x: F.expr(f"aggregate(p, 0D, (s, t) -> s + t.{x} + t.n * (t.{x[0]} - m.a{x[0]}) * (t.{x[1]} - m.a{x[1]}))") for x in ("aa", "bb", "ab")}
    each = parts.groupBy("i", "j").agg(F.collect_list(F.struct("n", "a", "b", "aa", "bb", "ab")).alias("p"))  # a row a task
    mean = lambda x: F.expr(f"aggregate(p, 0D, (s, t) -> s + t.n * t.{x}) / aggregate(p, 0D, (s, t) -> s + t.n)")
    m = each.select("i", "j", "p", F.struct(mean("a").alias("aa"), mean("b").alias("ab")).alias("m")).select("i", "j", *(e.alias(x) for x, e in between.items()))
    corr = F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb")))
    return m.select("i", "j", F.when(F.col("i") == F.col("j"), F.when(F.col("aa") > 0, 1.0)).otherwise(corr).alias("corr"))


def _project(batches: Iterator[pa.RecordBatch], column: str, centre: np.ndarray, axes: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)[:, : len(centre)]
        z = (x - centre) @ axes
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *(pa.array(z[:, k]) for k in range(z.shape[1]))], names=["vec_id", *names])


def principal_components(vectors: DataFrame, column: str, dims: int, share: float = 0.95) -> DataFrame:
    """Rows projected on the leading components of standardised entries, through the first cumulative share of at least ``share``.

    Only moments (dims squared) come to the driver; each component's largest
    entry is made positive.
    """
    m = np.eye(dims)
    for r in correlations(vectors, column, dims).toLocalIterator():
        m[r.i, r.j] = m[r.j, r.i] = r["corr"] if r.i != r.j else 1.0
    stats = vectors.agg(*(f(F.col(column)[i].cast("double")).alias(f"{n}{i}") for i in range(dims) for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    values, axes = np.linalg.eigh(m)
    values, axes = values[::-1], axes[:, ::-1]
    keep = int(np.searchsorted(np.cumsum(values) / values.sum(), share - 1e-12) + 1)
    axes = (axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(dims)]))[:, :keep]
    centre, scale = (np.array([stats[f"{n}{i}"] for i in range(dims)], float) for n in "ms")
    names = [f"pc{k}" for k in range(keep)]
    rows = vectors.select("vec_id", column).where(F.col(column).isNotNull())
    return rows.mapInArrow(partial(_project, column=column, centre=centre, axes=axes / scale[:, None], names=names), "vec_id long, " + ", ".join(f"{n} double" for n in names))
