"""Importance measures and bootstraps: against hand computations and on data whose answer is known."""

import numpy as np
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tidemark.operators import crossval, importance, weights

NAMES = ["I_0", "N_0"]


@pytest.fixture(scope="module")
def made(spark):
    from tidemark.session import staged

    rows = importance.synthetic_samples(spark, 300, 1, 0, 1)
    rows = staged(crossval.positions(rows, ["t0", "sample"]), "samples")
    return rows, staged(crossval.purged_kfold(rows, 2, 0.0), "folds")


def test_synthetic_rows(made):
    rows = made[0].toPandas().sort_values("sample")
    days = rows.t0.to_numpy()
    assert (np.diff(days) > 0).all() and set((days + 3) % 7) == {0, 1, 2, 3, 4} and days[-1] == 19_720
    assert ((rows.I_0 > 0) == (rows.y == 1)).mean() > 0.85 and abs(rows.w.sum() - 1) < 1e-9


def test_shuffled_feature_loses_score(spark, made):
    for scoring in ("neg_log_loss", "accuracy"):
        got = {r.feature: r["mean"] for r in importance.mean_decrease_accuracy(*made, 2, NAMES, scoring, trees=3).collect()}
        assert got["I_0"] > 0.3 and got["I_0"] > 2 * abs(got["N_0"])  # three trees on 300 rows leave the noise some weight


def test_single_features_by_hand(spark, made):
    got = {r.feature: r for r in importance.single_feature(*made, 2, NAMES, trees=3).collect()}
    each = {f: [r.neg_log_loss for r in importance.cv_scores(*made, 2, [f], trees=3).collect()] for f in NAMES}
    for f in NAMES:
        assert abs(got[f].score - np.mean(each[f])) < 1e-9 and abs(got[f]["std"] - np.std(each[f]) / 2**0.5) < 1e-9
    assert abs(sum(abs(r["mean"]) for r in got.values()) - 1) < 1e-9 and got["I_0"].score > got["N_0"].score


def test_entry_and_kinds(spark, made):
    got = importance.feature_importance(spark, *made, 2, NAMES, "MDI", bags=3, trees=3)
    assert {r.feature for r in got.collect()} == set(NAMES) and 0.7 < got.first().oob <= 1 and 0.7 < got.first().oos <= 1
    kinds = {r.kind: r["mean"] for r in importance.importance_by_kind(got).collect()}
    assert kinds["I"] > kinds["N"]
    with pytest.raises(ValueError):
        importance.feature_importance(spark, *made, 2, NAMES, "other")


def test_standard_bootstrap_draws_as_many_as_events(spark):
    from tidemark.plans import catalog

    got = entry.queries()["standard_bootstrap"](spark, SMALL).toPandas()
    events = catalog._spans_all(spark, SMALL).toPandas()
    assert got.times.sum() == len(events) and (got.times >= 1).all()
    assert set(zip(got.symbol, got.t0, strict=True)) <= set(zip(events.symbol, events.t0, strict=True))
    assert 0.5 < len(got) / len(events) < 0.8  # about 1 - 1/e of them


def test_trials_and_random_spans(spark):
    rng = np.random.default_rng(1)
    a, b = weights.random_spans(rng, 50, 20, 5)
    assert (np.diff(a) > 0).all() and ((b - a >= 1) & (b - a < 5)).all() and a.max() < 20
    got = weights.uniqueness_trials(spark.range(400).selectExpr("id AS trial", "100 AS rows"), 10, 5).toPandas()
    assert len(got) == 400 and got.u_sequential.mean() > got.u_standard.mean()


def _slow_draws(starts, ends, rows, draws, rng):
    """The definition: all chances anew for every draw."""
    held, out = np.zeros(rows), []
    for _ in range(draws):
        chance = np.array([np.mean(1 / (1 + held[a : b + 1])) for a, b in zip(starts, ends, strict=True)])
        out.append(int(np.searchsorted(np.cumsum(chance) / chance.sum(), rng.random(), "right").clip(0, len(starts) - 1)))
        held[starts[out[-1]] : ends[out[-1]] + 1] += 1
    return out


@pytest.mark.parametrize("events, rows, longest", [(1, 1, 1), (40, 60, 9), (300, 90, 60), (200, 2000, 3)])
def test_sequential_draws_follow_the_definition(events, rows, longest):
    rng = np.random.default_rng(events)
    a = rng.integers(0, rows, events)
    b = np.minimum(a + rng.integers(0, longest, events), rows - 1)
    b[0] = rows - 1 if events > 1 else b[0]  # one that overlaps very many
    got = weights.draw_sequential(a, b, rows, 400, np.random.default_rng(9))
    assert got.tolist() == _slow_draws(a, b, rows, 400, np.random.default_rng(9))


def test_a_hundred_thousand_events_in_one_group():
    import time

    rng = np.random.default_rng(1)
    a = rng.integers(0, 300_000, 100_000)
    b = np.minimum(a + rng.integers(0, 12, len(a)), 299_999)
    began = time.process_time()
    got = weights.draw_sequential(a, b, 300_000, len(a), rng)
    assert time.process_time() - began < 120 and got.min() >= 0 and got.max() < len(a)
    assert weights.uniqueness_of(a, b, 300_000, got) > weights.uniqueness_of(a, b, 300_000, rng.integers(0, len(a), len(a)))


def test_standard_draws_range_over_all_events(spark):
    """Positions 0 to n - 1 of a symbol's events, on whatever day: draws reach both ends, and none is lost."""
    from tidemark.sources.tapes import DAY

    rows = spark.createDataFrame([(s, i * DAY // 3, i) for s, n in (("a", 900), ("b", 7)) for i in range(n)], "symbol string, t0 long, t1 long")
    got = weights.standard_draws(rows).toPandas()
    for s, n in (("a", 900), ("b", 7)):
        own = got[got.symbol == s]
        assert own.times.sum() == n and own.t1.between(0, n - 1).all() and own.t1.is_unique
    own = got[got.symbol == "a"]
    assert 0.57 < len(own) / 900 < 0.69 and own.t1.max() > 880 and own.t1.min() < 20


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 1000, 4097])
def test_permuted_positions_are_a_bijection(spark, n):
    from pyspark.sql import functions as F

    from tidemark.functions.stats import permuted_position

    rows = spark.range(n).select("id", permuted_position(F.col("id"), n, 5, "f").alias("a"), permuted_position(F.col("id"), n, 6, "f").alias("b")).toPandas()
    for c in "ab":
        assert sorted(rows[c]) == list(range(n))
    if n >= 50:
        assert (rows.a != rows.b).mean() > 0.9 and (rows.a == rows.id).mean() < 0.1 and abs(np.corrcoef(rows.id, rows.a)[0, 1]) < 0.35


def test_every_feature_is_shuffled_alone(spark):
    from pyspark.sql import functions as F

    rows = spark.range(500).select("id", F.col("id").alias("pos"), (F.col("id") * 2.0).alias("f"), (F.col("id") * 3.0).alias("g"))
    got = importance.every_permuted(rows, ["f", "g"], 500, 1).toPandas()
    assert len(got) == 1500
    plain, f, g = got[got.feature.isna()], got[got.feature == "f"], got[got.feature == "g"]
    assert (plain.f == plain.id * 2).all() and (plain.g == plain.id * 3).all()
    assert (f.g == f.id * 3).all() and sorted(f.f) == sorted(plain.f) and (f.f == f.id * 2).mean() < 0.05
    assert (g.f == g.id * 2).all() and sorted(g.g) == sorted(plain.g) and (g.g == g.id * 3).mean() < 0.05


def test_any_classifier_in_cross_validation(spark, made):
    got = importance.cv_scores(*made, 2, NAMES, fit=importance.logistic, penalty=0.001).collect()
    assert len(got) == 2 and min(r.accuracy for r in got) > 0.8
    lost = {r.feature: r["mean"] for r in importance.mean_decrease_accuracy(*made, 2, NAMES, fit=importance.logistic).collect()}
    assert lost["I_0"] > 5 * abs(lost["N_0"])


def test_correlations_far_from_zero_and_components(spark):
    """Entries with a large common offset, over several tasks, against NumPy; then the components themselves."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5)) @ rng.normal(size=(5, 5)) + 1e7
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(5)
    want = np.corrcoef(x.T)
    for r in importance.correlations(rows, "v", 5).collect():
        assert abs(r["corr"] - want[r.i, r.j]) < 1e-6
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values, axes = np.linalg.eigh(want)
    axes = axes[:, ::-1] * np.sign(axes[:, ::-1][np.abs(axes[:, ::-1]).argmax(0), np.arange(5)])
    got = importance.principal_components(rows, "v", 5, 0.9).toPandas().sort_values("vec_id")
    keep = got.shape[1] - 1
    assert keep == int(np.searchsorted(np.cumsum(values[::-1]) / values.sum(), 0.9) + 1)
    assert np.allclose(got[[f"pc{k}" for k in range(keep)]].to_numpy(), (z @ axes)[:, :keep], atol=1e-5)
