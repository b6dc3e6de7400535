"""Loop oracles, golden values and properties of the operators."""

import numpy as np
import pandas as pd
import pytest

from tests.conftest import SMALL
from tidemark.operators import bars, crossval, fracdiff, importance, labels, series, weights
from tidemark.sources import trades
from tidemark.sources.tapes import DAY, tape_events


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


TAPE = "symbol string, trade_id long, us long, price long, qty long, dollar long"


def test_whole_bars_golden(spark):
    t = frame(spark, [("a", i, i, 1, v, v) for i, v in enumerate([4, 4, 4, 8])], TAPE)
    got = [(r.bar_index, r.dollar) for r in bars.value_bars_whole(t, "dollar", 10).orderBy("bar_index").collect()]
    assert got == [(0, 8), (2, 8)]


def test_split_bars_golden(spark):
    t = frame(spark, [("a", 1, 7, 1, 25, 25)], TAPE)
    got = bars.value_bars_split(t, "dollar", 10).orderBy("bar_id").collect()
    assert [(r.value, r.us) for r in got] == [(10, 7), (10, 7), (5, 7)]


def test_split_bars_against_loop(spark):
    t = tape_events(spark, SMALL)
    size = 200_000
    want = {}
    for s, rows in t.toPandas().sort_values(["us", "trade_id"]).groupby("symbol"):
        filled, k = 0, 0
        for r in rows.itertuples():
            left = r.dollar
            while left > 0:
                take = min(left, size - filled)
                b = want.setdefault((s, k), [r.price, r.price, r.price, r.price, 0])
                b[1], b[2], b[3], b[4] = max(b[1], r.price), min(b[2], r.price), r.price, b[4] + take
                filled, left = filled + take, left - take
                if filled == size:
                    filled, k = 0, k + 1
    want = {k: tuple(v) for k, v in want.items() if v[4] * 2 >= size}
    got = {(r.symbol, r.bar_id): (r.open, r.high, r.low, r.close, r.value) for r in bars.value_bars_split(t, "dollar", size).collect()}
    assert got == want


def test_adaptive_bars_against_loop(spark):
    t = tape_events(spark, SMALL)
    policy = dict(rolling_days=3, smoothing=0.3, change=0.25)
    want = {}
    for s, rows in t.toPandas().sort_values(["us", "trade_id"]).groupby("symbol"):
        rows["day"] = rows.us // DAY
        totals, target, open_target, filled, k = [], 0, None, 0, 0
        for _, day in rows.groupby("day"):
            raw = (np.mean(totals[-3:]) if totals else float(day.dollar.sum())) / 12
            new = raw if target == 0 else min(target * 1.25, max(target * 0.75, 0.7 * target + 0.3 * raw))
            target = max(1, int(np.floor(new + 0.5)))
            totals.append(int(day.dollar.sum()))
            if filled == 0:
                open_target = target
            for r in day.itertuples():
                left = r.dollar
                while left > 0:
                    take = min(left, open_target - filled)
                    b = want.setdefault((s, k), [0, open_target])
                    b[0] += take
                    filled, left = filled + take, left - take
                    if filled == open_target:
                        filled, k, open_target = 0, k + 1, target
    want = {k: tuple(v) for k, v in want.items() if v[0] * 2 >= v[1]}
    got = {(r.symbol, r.bar_id): (r.value, r.target) for r in bars.adaptive_bars(t, "dollar", 12, **policy).collect()}
    assert got == want


def test_bars_keep_value_and_order(spark):
    t = tape_events(spark, SMALL)
    b = bars.time_bars(t, "1h").toPandas()
    assert b.dollar.sum() == t.agg({"dollar": "sum"}).first()[0]
    assert ((b.low <= b.open) & (b.low <= b.close) & (b.high >= b.open) & (b.high >= b.close)).all()


def test_frequency():
    assert [DAY / bars.parse_frequency(f) for f in ("1d", "1h", "15m", "4h")] == [1, 24, 96, 6]
    for bad in ("0h", "3w", ""):
        with pytest.raises(ValueError):
            bars.parse_frequency(bad)


def test_seven_day_origins(spark):
    t = frame(spark, [("a", i, i * DAY + 5, 1, 1, 1) for i in range(2)], TAPE)
    assert bars.time_bars(t, "7d", "per_day").count() == 2
    assert bars.time_bars(t, "7d").count() == 1


def test_ewm_matches_pandas(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    rows = frame(spark, [("a", i, 1, float(v)) for i, v in enumerate(x)], "symbol string, us long, price long, ret double")
    got = series.ewm_std(rows, "ret", 20).orderBy("us").toPandas()["vol"].to_numpy(float)
    want = pd.Series(x).ewm(span=20).std().to_numpy()
    assert np.isnan(got[0])
    assert np.allclose(got[1:], want[1:])


def test_cusum_missing_move_resets(spark):
    x = [0.0, 0.6, None, 0.6, 1.2, 1.8]
    rows = frame(spark, [("a", i, 1, v, 1.0) for i, v in enumerate(x)], "symbol string, us long, price long, x double, h double")
    assert [r.us for r in series.cusum(rows, "x", "h").orderBy("us").collect()] == [5]


def test_uniqueness_golden(spark):
    events = frame(spark, [("a", 0, 2), ("a", 2, 3), ("a", 4, 5)], "symbol string, t0 long, t1 long")
    rows = frame(spark, [("a", i, 1) for i in range(6)], "symbol string, us long, price long")
    c = weights.concurrency(events, rows)
    assert [r.c for r in c.orderBy("us").collect()] == [1, 1, 2, 1, 1, 1]
    u = [r.tw for r in weights.average_uniqueness(events, c).orderBy("t0").collect()]
    assert np.allclose(u, [5 / 6, 3 / 4, 1])
    m = [r.u for r in weights.matrix_uniqueness(weights.indicator(events, rows, 2)).orderBy("t0").collect()]
    assert np.allclose(m, [5 / 6, 3 / 4, 1])


def test_decay_bounds():
    with pytest.raises(ValueError):
        weights.time_decay(None, -1)


def test_sequential_bootstrap_is_more_unique():
    rng = np.random.default_rng(1)
    means = []
    for _ in range(60):
        a = rng.integers(0, 60, 20)
        b = np.minimum(a + rng.integers(1, 8, 20), 59)
        means.append((weights.uniqueness_of(a, b, 60, weights.draw_sequential(a, b, 60, 20, rng)), weights.uniqueness_of(a, b, 60, rng.integers(0, 20, 20))))
    assert np.mean([s for s, _ in means]) > np.mean([u for _, u in means])


def test_fractional_weights():
    assert fracdiff.ffd_weights(0.0, 0.01) == [1.0]
    assert fracdiff.ffd_weights(1.0, 0.01) == [1.0, -1.0]


def test_ffd_identity_and_difference(spark):
    rows = frame(spark, [("a", i, float(i * i)) for i in range(30)], "symbol string, us long, x double")
    same = [r.fd for r in fracdiff.ffd(rows, "x", 0.0, 0.01).orderBy("us").collect()]
    assert same == [float(i * i) for i in range(30)]
    step = [r.fd for r in fracdiff.ffd(rows, "x", 1.0, 0.01).orderBy("us").collect()]
    assert step == [float(2 * i - 1) for i in range(1, 30)]


def test_adf_tables(spark):
    from pyspark.sql import functions as F

    rows = frame(spark, [(-2.86, 10_000.0), (-3.0, 50.0), (-1.0, 50.0), (0.5, 50.0), (3.0, 50.0), (-20.0, 50.0)], "stat double, n double")
    got = rows.select(fracdiff.p_value(F.col("stat")).alias("p"), fracdiff.critical_5(F.col("n")).alias("c")).collect()
    assert abs(got[0].c + 2.862) < 1e-3 and abs(got[1].c + 2.9217) < 1e-3  # published finite-sample values
    assert abs(got[0].p - 0.05) < 2e-3
    # published p-values of the same surface: -3.0 gives 0.0349, -1.0 gives 0.7532, 0.5 gives 0.9849
    assert [round(r.p, 3) for r in got[1:4]] == [0.035, 0.753, 0.985] and [r.p for r in got[4:]] == [1.0, 0.0]


def test_expanding_by_brute_force(spark):
    rng = np.random.default_rng(0)
    x = {"a": rng.normal(size=230), "b": rng.normal(size=90)}
    rows = [(s, i, None if i in (5, 80) else float(v)) for s, xs in x.items() for i, v in enumerate(xs)]
    got = {(r.symbol, r.us): r.fd for r in fracdiff.fracdiff_expanding(frame(spark, rows, "symbol string, us long, x double"), "x", 0.4, 0.1).collect()}
    want = {}
    for s, xs in x.items():
        xs = pd.Series([v for k, i, v in rows if k == s]).ffill().to_numpy(float)
        w = np.array(fracdiff.weights(0.4, len(xs)))
        skip = fracdiff.skipped(0.4, len(xs), 0.1)
        lost = np.cumsum(np.abs(w[::-1])) / np.abs(w).sum()
        assert skip == (lost > 0.1).sum()
        want |= {(s, i): float(np.dot(w[: i + 1], xs[i::-1])) for i in range(skip, len(xs)) if i not in (5, 80)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("cells", [64, 1 << 20])
@pytest.mark.parametrize("d", [0.3, 1.0])
def test_expanding_over_many_blocks(spark, monkeypatch, cells, d):
    """Series of many blocks and of less than one, frequencies in one group and in many."""
    monkeypatch.setattr(fracdiff, "_EXPANDING_BLOCK", 16)
    monkeypatch.setattr(fracdiff, "_EXPANDING_CELLS", cells)
    rng = np.random.default_rng(1)
    x = {"a": rng.normal(size=333) + 9, "b": rng.normal(size=5), "c": rng.normal(size=32)}
    rows = [(s, i, float(v)) for s, xs in x.items() for i, v in enumerate(xs)]
    got = {(r.symbol, r.us): r.fd for r in fracdiff.fracdiff_expanding(frame(spark, rows, "symbol string, us long, x double"), "x", d, 0.2).collect()}
    want = {}
    for s, xs in x.items():
        w = np.array(fracdiff.weights(d, len(xs)))
        want |= {(s, i): float(np.dot(w[: i + 1], xs[i::-1])) for i in range(fracdiff.skipped(d, len(xs), 0.2), len(xs))}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-10
    assert fracdiff.fracdiff_expanding(frame(spark, rows, "symbol string, us long, x double").limit(0), "x", d, 0.2).count() == 0


@pytest.mark.parametrize("d", [0.0, 0.4, 1.0, 1.6])
def test_skipped_rows_in_stretches(d):
    for n in (1, 7, 100, 257):
        size = np.abs(fracdiff.weights(d, n))[::-1]
        for threshold in (0.01, 0.3):
            want = int((np.cumsum(size) / size.sum() > threshold).sum())
            assert fracdiff.skipped(d, n, threshold) == want == fracdiff.skipped(d, n, threshold, 16)


@pytest.mark.parametrize("settings", [{}, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}, {"spark.sql.adaptive.enabled": "false"}])
def test_positions_are_a_permutation(spark, settings):
    before = {k: spark.conf.get(k, None) for k in [*settings, "spark.sql.shuffle.partitions"]}
    try:
        for k, v in {**settings, "spark.sql.shuffle.partitions": "64"}.items():
            spark.conf.set(k, v)
        rows = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
        got = crossval.positions(rows, ["l_shipdate", "l_orderkey", "l_linenumber"])
        n = rows.count()
        low, high, count, kinds, pairs = got.selectExpr("min(pos)", "max(pos)", "count(*)", "count(DISTINCT pos)", "count(DISTINCT l_orderkey, l_linenumber)").first()
        assert (low, high, count, kinds) == (0, n - 1, n, n) and pairs == rows.select("l_orderkey", "l_linenumber").distinct().count()
        # numbers follow the order
        assert got.selectExpr("l_shipdate", "lag(l_shipdate) OVER (PARTITION BY pos div 5000 ORDER BY pos) AS before").where("before > l_shipdate").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_permuted_keeps_every_row(spark):
    rows = spark.range(50_000).selectExpr("id AS sample", "id * 2 AS f", "id * 3 AS g")
    got = importance.permuted(rows, "f", 1)
    assert got.count() == 50_000 and got.select("f").distinct().count() == 50_000
    assert 0 < got.where("f = sample * 2").count() < 100 and got.where("g <> sample * 3").count() == 0


def test_running_figures_in_two_levels(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.running import blocked, running, unblocked
    import tidemark.operators.running as module

    rng = np.random.default_rng(3)
    rows = [(s, int(t), None if rng.random() < 0.4 else int(rng.integers(0, 50))) for s in "ab" for t in sorted(rng.choice(40 * DAY, 200, replace=False).tolist())]
    data = pd.DataFrame(rows, columns=["symbol", "us", "v"]).sort_values(["symbol", "us"])
    got = running(frame(spark, rows, "symbol string, us long, v long"), ["us"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}).toPandas().sort_values(["symbol", "us"])
    by = data.groupby("symbol").v
    for name, want in (("s", by.transform(lambda x: x.fillna(0).cumsum())), ("m", by.transform(lambda x: x.cummax().ffill())), ("l", by.transform(lambda x: x.ffill()))):
        assert np.allclose(got[name].fillna(0).to_numpy(float), want.fillna(0).to_numpy(float)), name
    before = running(frame(spark, rows, "symbol string, us long, v long"), ["us"], {"l": ("last", F.col("v"))}, before=True).toPandas().sort_values(["symbol", "us"])
    assert np.allclose(before.l.fillna(-1).to_numpy(float), data.groupby("symbol").v.transform(lambda x: x.ffill().shift()).fillna(-1).to_numpy(float))
    size, module.BLOCK_ROWS = module.BLOCK_ROWS, 16
    try:
        rows_, w = blocked(frame(spark, rows, "symbol string, us long, v long"), 3)
        lagged = unblocked(rows_.withColumn("x", F.lag("us", 3).over(w)), 3).toPandas().sort_values(["symbol", "us"])
        assert len(lagged) == len(data) and np.allclose(lagged.x.fillna(0).to_numpy(float), data.groupby("symbol").us.shift(3).fillna(0).to_numpy(float))
    finally:
        module.BLOCK_ROWS = size


def test_purge_by_running_maximum(spark):
    rng = np.random.default_rng(5)
    spans = lambda n: [(i, int(a), int(a + rng.integers(0, 3 * DAY))) for i, a in enumerate(rng.integers(0, 60 * DAY, n))]
    train, tests = spans(300), spans(12)
    got = {r.sample for r in crossval.purge_train(frame(spark, train, "sample long, t0 long, t1 long"), frame(spark, tests, "sample long, t0 long, t1 long")).collect()}
    assert got == {i for i, a, b in train if not any(a <= y and b >= x for _, x, y in tests)} and 0 < len(got) < 300


def test_no_training_row_meets_its_test_span(spark):
    rows = crossval.positions(frame(spark, [(i, i * 10, i * 10 + 25) for i in range(50)], "sample long, t0 long, t1 long"), ["t0"])
    roles = crossval.purged_kfold(rows, 4, 0.04).join(rows, "sample").toPandas()
    for _, part in roles.groupby("fold"):
        test, train = part[part.role == "test"], part[part.role == "train"]
        assert not ((train.t0 <= test.t1.max()) & (train.t1 >= test.t0.min())).any()
    assert sorted(roles[roles.role == "test"]["sample"]) == list(range(50))


def test_barriers_and_meta_label(spark):
    s = frame(spark, [("a", i, p) for i, p in enumerate([100, 101, 99, 95, 110])], "symbol string, us long, price long")
    e = frame(spark, [("a", 0, 100, 4, 0.02, 1), ("a", 1, 101, None, 0.5, -1)], "symbol string, t0 long, p0 long, vertical long, target double, side int")
    t = labels.triple_barrier(e, s, 1.0, 1.0, 2)
    got = {r.t0: (r.sl, r.pt, r.t1) for r in t.collect()}
    assert got == {0: (3, 4, 3), 1: (None, None, None)}
    m = labels.label(labels.triple_barrier(frame(spark, [("a", 0, 100, 2, 0.5, -1)], e.schema), s, 1.0, 1.0, 2), s, meta=True).first()
    assert abs(m.ret - 0.01) < 1e-12 and m.bin == 1


def test_rare_label(spark):
    rows = frame(spark, [(b,) for b in [1] * 48 + [-1] * 48 + [0] * 4], "bin int")
    assert {r.bin for r in labels.drop_rare(rows).collect()} == {1, -1}


def test_raw_files(spark, tmp_path):
    import zipfile

    line = "7,10.5,2,,1704067200000,true,true\n7,11,2,22,1704067201000,true,true\nx,1,1,1,1,true,true\n"
    (tmp_path / "T-2024-01-01.csv").write_text(line)
    with zipfile.ZipFile(tmp_path / "T-2024-01-02.zip", "w") as z:
        z.writestr("T-2024-01-02.csv", "8,3,4,12,1704153600000,true,true\n")
    got = trades.clean_trades(trades.read_raw(spark, str(tmp_path)), "T").orderBy("trade_id").collect()
    assert [(r.trade_id, r.price, r.dollar, r.us) for r in got] == [(7, 11.0, 22.0, 1704067201000000), (8, 3.0, 12.0, 1704153600000000)]
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no csv or zip files"):
        trades.read_raw(spark, str(tmp_path / "none")).collect()


def test_coverage(spark):
    days = trades.calendar(spark, "2024-01-01", "2024-01-03")
    files = frame(spark, [("2024-01-01", 5), ("2024-01-02", 0)], "d string, bytes long").selectExpr("to_date(d) AS day", "bytes")
    assert [r.status for r in trades.coverage(days, files).orderBy("day").collect()] == ["complete", "empty", "missing"]


def test_stream_equals_batch_over_batches(spark, tmp_path):
    from tidemark.streaming import bars as streams

    t = spark.read.parquet(f"{SMALL}/events.parquet").orderBy("ts").toPandas()
    for k in range(3):
        spark.createDataFrame(t.iloc[k * 333 : (k + 1) * 333 if k < 2 else None]).selectExpr("event_id", "CAST(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # micro-batches follow modification time, so each file is one step forward
    stream = lambda: streams.trade_stream(spark, str(tmp_path / "in"), 1)
    got = streams._drained(spark, streams.value_bars(stream(), {"dollar": ("dollar", 300_000)}), "append", ["kind", "symbol", "bar_index"]).where("value * 2 >= threshold").toPandas()
    whole = bars.value_bars_whole(tape_events(spark, SMALL), "dollar", 300_000).toPandas()
    key = ["symbol", "bar_index"]
    assert got.sort_values(key)[[*key, "open", "close", "dollar"]].values.tolist() == whole.sort_values(key)[[*key, "open", "close", "dollar"]].values.tolist()

    hits = streams._drained(spark, streams.cusum_events(stream(), 2.5), "append", ["symbol", "us"]).toPandas()
    rows = tape_events(spark, SMALL).selectExpr("symbol", "us", "price", "ln(price) AS x", "2.5D AS h")
    want = series.cusum(rows, "x", "h").toPandas()
    assert hits.sort_values(["symbol", "us"])[["symbol", "us", "direction"]].values.tolist() == want.sort_values(["symbol", "us"])[["symbol", "us", "direction"]].values.tolist()

    with pytest.raises(Exception, match="comes in parts or late"):  # files that cut days
        streams._drained(spark, streams.adaptive_bars(stream(), "dollar", 12), "append", ["symbol", "bar_id"])


def test_adaptive_stream_by_days(spark, tmp_path):
    from tidemark.streaming import bars as streams

    t = spark.read.parquet(f"{SMALL}/events.parquet").toPandas().sort_values("ts")
    for _, part in t.groupby(t.ts.dt.date.astype(str).str[:9]):  # ten days or fewer to a file
        spark.createDataFrame(part).selectExpr("event_id", "CAST(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.trade_stream(spark, str(tmp_path / "in"), 1)
    got = streams._drained(spark, streams.adaptive_bars(stream, "dollar", 12), "append", ["symbol", "bar_id"]).where("value * 2 >= target").toPandas()
    want = bars.adaptive_bars(tape_events(spark, SMALL), "dollar", 12).toPandas()
    key = ["symbol", "bar_id"]
    assert got.sort_values(key)[[*key, "us", "open", "close", "target", "value"]].values.tolist() == want.sort_values(key)[[*key, "us", "open", "close", "target", "value"]].values.tolist()


def test_out_of_order_batches_raise(spark, tmp_path):
    from tidemark.streaming import bars as streams

    t = spark.read.parquet(f"{SMALL}/events.parquet").toPandas().sort_values("ts")
    for part in (t.iloc[500:], t.iloc[:500]):
        spark.createDataFrame(part).selectExpr("event_id", "CAST(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.trade_stream(spark, str(tmp_path / "in"), 1)
    with pytest.raises(Exception, match="come after"):
        streams._drained(spark, streams.value_bars(stream, {"dollar": ("dollar", 300_000)}), "append", ["kind", "symbol", "bar_index"])


def test_raw_round_trip_and_coverage(spark, tmp_path):
    folder = f"file://{tmp_path}/raw"
    tape = frame(spark, [("x", 1, 5_000_000, 10, 2, 20), ("x", 2, DAY + 7_000_000, 11, 1, 11), ("y", 1, 9_000_000, 3, 1, 3)], "symbol string, trade_id long, us long, price long, qty long, dollar long")
    assert trades.write_raw(tape, folder).count() == 3
    from pyspark.sql import functions as F

    raw = trades.read_raw(spark, folder)
    back = trades.clean_trades(raw, trades.symbol_of(F.col("path"))).collect()
    assert sorted((r.symbol, r.trade_id, r.us, r.price, r.dollar) for r in back) == [("x", 1, 5_000_000, 10.0, 20.0), ("x", 2, DAY + 7_000_000, 11.0, 11.0), ("y", 1, 9_000_000, 3.0, 3.0)]
    assert sorted((r.symbol, str(r.day), r.dollar, r.qty) for r in trades.day_totals(raw).collect()) == [("x", "1970-01-01", 20.0, 2.0), ("x", "1970-01-02", 11.0, 1.0), ("y", "1970-01-01", 3.0, 1.0)]
    (tmp_path / "raw" / "x-trades-1970-01-03.zip.tmp").write_text("half")
    files = trades.list_files(spark, folder)
    days = trades.calendar(spark, "1970-01-01", "1970-01-04")
    covered = trades.coverage(days, files, -10)
    assert [r.status for r in covered.orderBy("day").collect()] == ["complete", "complete", "stale", "missing"]
    assert [str(r.day) for r in trades.missing_days(covered).collect()] == ["1970-01-03", "1970-01-04"]
    assert trades.remove_stale(spark, folder, 3600) == 0 and trades.remove_stale(spark, folder, -10) == 1
    (tmp_path / "bad").mkdir()
    for k, line in enumerate(["1,2,3\n", "1,2,3,4,5,true,true,extra\n"]):
        (tmp_path / "bad" / f"T-2024-01-0{k + 1}.csv").write_text(line)
        with pytest.raises(Exception, match="columns"):
            trades.read_raw(spark, str(tmp_path / "bad" / f"T-2024-01-0{k + 1}.csv")).collect()
    where = spark.range(1).select(trades.url_of(F.lit("https://host/data"), F.lit("spot"), F.lit("X"), F.lit("2024-01-01")).alias("u")).first().u
    assert where == "https://host/data/spot/daily/trades/X/X-trades-2024-01-01.zip"


def test_events_of_columns(spark):
    from tidemark.sources import tables

    rows = frame(spark, [("1970-01-01 00:00:00.000007", 7)], "s string, n long").selectExpr("CAST(s AS timestamp) AS ts", "n")
    assert tables.events_of(rows, "ts", "timestamp").first().us == 7
    assert tables.events_of(rows, "n", "index").first().event_idx == 7 and tables.events_of(rows, "n", "pseudo_datetimeindex").first().event_idx == 7
    assert tables.events_of(rows, "ts", "pseudo_datetimeindex").first().event_idx == 7000
    outs = frame(spark, [("a", DAY)], "symbol string, us long")
    assert tables.start_of_run(None, outs).first().start_us == 2 * DAY and tables.start_of_run(5, outs).first().start_us == 5


def test_folds_of_an_event_list_by_brute_force(spark):
    rng = np.random.default_rng(6)
    t0 = np.sort(rng.integers(0, 500, 90))
    t1 = t0 + rng.integers(1, 40, 90)
    rows = frame(spark, [(i, i, int(a), int(b)) for i, (a, b) in enumerate(zip(t0, t1, strict=True))], "sample long, pos long, t0 long, t1 long")
    got = {(r.fold, r.sample): r.role for r in crossval.purged_folds_of_events(rows, 4, 0.05).collect()}
    want = {}
    for fold, test in enumerate(np.array_split(np.arange(90), 4)):
        after = np.searchsorted(t0, t1[test].max()) + int(90 * 0.05)
        for i in range(90):
            if i in test:
                want[fold, i] = "test"
            elif (i < test[0] and t1[i] <= t0[test[0]]) or (i > test[-1] and i >= after):
                want[fold, i] = "train"
    assert got == want


def test_outer_alignment_and_thresholds(spark):
    a, b = frame(spark, [("a", 1, 5.0)], "symbol string, t0 long, x double"), frame(spark, [("a", 1, 7), ("a", 2, 8)], "symbol string, t0 long, y long")
    assert sorted(tuple(r) for r in labels.side_by_side(a, b).collect()) == [("a", 1, 5.0, 7), ("a", 2, None, 8)]
    vol = frame(spark, [("a", 1, 0.1), ("a", 2, 0.3), ("a", 3, None)], "symbol string, us long, vol double")
    assert abs(labels.cusum_threshold(vol, "vol", "last", 2.0).first().h - 0.6) < 1e-12 and abs(labels.cusum_threshold(vol, "vol").first().h - 0.2) < 1e-12
    with pytest.raises(Exception, match="no usable threshold"):
        labels.cusum_threshold(vol, "vol", "mean", 0.0).collect()
    assert labels.usable(frame(spark, [(0.1,), (0.2,), (None,)], "target double"), 0.1).count() == 1


def test_tables_by_extension(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.feather

    from tidemark.sources import tables

    data = pa.table({"a": [1, 2], "b": ["x", "y"]})
    pyarrow.feather.write_feather(data, str(tmp_path / "t.feather"), compression="uncompressed")
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string")
    tables.write_bars(rows, str(tmp_path / "t.parquet"), "b")
    tables.write_small(rows, str(tmp_path / "t.csv"))
    for kind in ("feather", "parquet", "csv"):
        assert sorted((r.a, r.b) for r in tables.read_table(spark, str(tmp_path / f"t.{kind}")).collect()) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        tables.read_table(spark, "t.json")


def test_event_lists_and_ranges(spark):
    from tidemark.sources import tables

    assert [r.event_idx for r in tables.parse_events(spark, "3, 17,20").collect()] == [3, 17, 20]
    with pytest.raises(ValueError):
        tables.parse_events(spark, "3,x")
    s = frame(spark, [("a", 10 * i, i) for i in range(5)], "symbol string, us long, price long")
    assert [r.us for r in tables.map_events(s, tables.parse_events(spark, "1,4,9")).orderBy("us").collect()] == [10, 40]
    assert tables.look_back(1000, months=2) == (940, 1000) and tables.look_back(1000, years=1) == (635, 1000)
    days = frame(spark, [(None,), (1,), (2,), (3,)], "day long")
    assert [r.day for r in tables.in_days(days, 2, None).orderBy("day").collect()] == [2, 3]
    assert tables.next_start(frame(spark, [("a", DAY + 5)], "symbol string, us long"), "last_input_day_end").first().start_us == 2 * DAY - 1_000_000


def _as_of_by_hand(left, right, by, lt, rt, forward, strict, tolerance):
    out = []
    for a in left:
        best = None
        for b in right:
            if a[by] is None or a[lt] is None or b[rt] is None or a[by] != b[by]:
                continue
            gap = b[rt] - a[lt] if forward else a[lt] - b[rt]
            if gap < 0 or (strict and gap == 0) or (tolerance is not None and gap > tolerance):
                continue
            rank = (-gap, tuple(-x for x in b["v"]) if forward else b["v"])
            best = max(best, (rank, b), key=lambda x: x[0]) if best else (rank, b)
        out.append((a["id"], best[1][rt] if best else None, best[1]["v"] if best else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tolerance", [None, DAY])
def test_as_of_join_by_brute_force(spark, forward, strict, tolerance):
    """Several keys, ties on both sides, repeated rows, nulls in times and keys, names that clash."""
    from tidemark.operators.asof import as_of_join

    rng = np.random.default_rng(4)
    when = lambda: int(rng.integers(-3, 12)) * (DAY // 2)
    left = [{"id": i, "k": "ab"[i % 2], "t": when()} for i in range(60)] + [{"id": 100, "k": None, "t": 5}, {"id": 101, "k": "a", "t": None}, {"id": 102, "k": "lonely", "t": 5}, {"id": 0, "k": "a", "t": 0}]
    right = [{"k": "ab"[i % 2], "u": when(), "v": (int(rng.integers(0, 3)), i)} for i in range(40)] + [{"k": "a", "u": None, "v": (9, 900)}, {"k": None, "u": 5, "v": (9, 901)}]
    a = frame(spark, [(r["id"], r["k"], r["t"]) for r in left], "_at long, k string, t long")
    b = frame(spark, [(r["k"], r["u"], *r["v"]) for r in right], "k string, u long, tie long, x long")
    got = as_of_join(a, b, "t", "u", ["k"], ["tie", "x"], forward, strict, tolerance, tie="tie", time_out="found")
    assert got.columns == ["_at", "k", "t", "found", "tie", "x"]
    rows = sorted(((r["_at"], r.found, None if r.x is None else (r.tie, r.x)) for r in got.collect()), key=repr)
    assert rows == _as_of_by_hand(left, right, "k", "t", "u", forward, strict, tolerance)
    inner = as_of_join(a, b, "t", "u", ["k"], ["x"], forward, strict, tolerance, inner=True)
    assert inner.count() == sum(r[1] is not None for r in rows)
    assert as_of_join(a.limit(0), b, "t", "u", ["k"], ["x"]).count() == 0
    assert as_of_join(a, b.limit(0), "t", "u", ["k"], ["x"]).where("x IS NULL").count() == len(left)


def test_events_between_bars(spark):
    """Bars at 0, 10, ..., 90 and events whose ends are no bar times: the next price labels them, and the bars between count."""
    s = frame(spark, [("a", 10 * i, 100 + i) for i in range(10)], "symbol string, us long, price long")
    e = frame(spark, [("a", 10, 25, 101, 1), ("a", 10, 25, 101, 1), ("a", 12, 18, 101, -1), ("a", 85, 95, 108, 1), ("a", 40, None, 104, 1)], "symbol string, t0 long, t1 long, p0 long, side int")
    got = sorted((r.t0, r.t1, None if r.ret is None else round(r.ret, 6), r.bin) for r in labels.label(e, s).collect())
    assert got == sorted([(10, 25, round(103 / 101 - 1, 6), 1), (10, 25, round(103 / 101 - 1, 6), 1), (12, 18, round(-(102 / 101 - 1), 6), -1), (85, 95, None, None)], key=lambda x: x[0])
    c = weights.concurrency(e, s)
    assert [r.c for r in c.orderBy("us").collect()] == [0, 2, 2, 0, 1, 1, 1, 1, 1, 2]
    u = {(r.t0, r.t1): r.tw for r in weights.average_uniqueness(e, c).collect()}
    assert u[10, 25] == 0.5 and u[12, 18] is None and u[85, 95] == 0.5 and abs(u[40, None] - 5.5 / 6) < 1e-12
    w = weights.return_weights(e, c, s).collect()
    assert len(w) == 5 and abs(sum(r.w for r in w) - 5) < 1e-9
    raw = {(r.t0, r.t1): r.raw for r in w}
    assert abs(raw[10, 25] - np.log(102 / 100) / 2) < 1e-12 and raw[12, 18] == 0


@pytest.mark.parametrize("kind", ["some", "days", "lead"])
def test_ewm_over_missing_values(spark, kind):
    """Rows without a value age the weights, in a day and over days, as the usual definition has it."""
    rng = np.random.default_rng(8)
    n = 400
    x = rng.normal(size=n) + 50
    us = np.sort(rng.choice(12 * DAY, n, replace=False))
    gone = rng.random(n) < 0.3 if kind == "some" else np.isin(us // DAY, [2, 3, 7]) if kind == "days" else us < 3 * DAY
    x[gone] = np.nan
    rows = frame(spark, [("a", int(t), 1, None if np.isnan(v) else float(v)) for t, v in zip(us, x, strict=True)], "symbol string, us long, price long, ret double")
    got = series.ewm_std(rows, "ret", 15).orderBy("us").toPandas()["vol"].to_numpy(float)
    want = pd.Series(x).ewm(span=15).std().to_numpy()
    assert np.allclose(got, want, equal_nan=True, atol=1e-9) and np.isfinite(got).sum() > 100


def test_scans_of_a_chain_do_not_multiply(spark):
    """Figures on figures read their source once: the plan that is left has few scans and exchanges."""
    from tidemark.plans import catalog

    for name, scans, exchanges in (("daily_vol", 2, 10), ("lag_features", 2, 10), ("min_d_corr", 4, 20), ("ffd", 2, 10), ("concurrency", 2, 10)):
        plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= scans and plan.count("Exchange ") <= exchanges, (name, plan.count("FileScan"), plan.count("Exchange "))


def test_scratch_deletes_what_was_staged(spark):
    from tidemark import session

    with session.scratch(spark):
        one = session.staged(spark.range(5), "one")
        assert one.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(one._staged).count()


@pytest.mark.parametrize("kind", [{"bars_per_day": 7}, {"threshold": 90_000}, {"threshold": 4_000_000}])
def test_incremental_bars_in_any_cuts(spark, tmp_path, kind):
    """Runs over uneven ranges, a symbol that comes late and one that pauses, reruns of one day and of several: always the bars of one run."""
    from pyspark.sql import functions as F

    from tidemark.operators import incremental
    from tidemark.sources import days as store

    tape = tape_events(spark, SMALL).where("NOT (symbol = 'view' AND us < 1704800000000000) AND NOT (symbol = 'click' AND us BETWEEN 1705000000000000 AND 1705600000000000)").withColumn("_d", F.floor(F.col("us") / DAY))
    whole = bars.adaptive_bars(tape.drop("_d"), "dollar", 7) if "bars_per_day" in kind else bars.value_bars_split(tape.drop("_d"), "dollar", kind["threshold"])
    key = lambda rows: sorted(tuple(round(x, 3) if isinstance(x, float) else x for x in r) for r in rows.select("symbol", "bar_id", "us", "open", "high", "low", "close", "volume", "dollar", "target", "value").collect())
    first, last = tape.agg(F.min("_d"), F.max("_d")).first()
    root = f"file://{tmp_path}/bars"
    run = lambda a, b: incremental.build_days(spark, root, tape.where(F.col("_d").between(a, b)).drop("_d"), "dollar", **kind)
    for a, b in ((first, first), (first + 1, first + 9), (first + 10, last), (last - 3, last)):
        version = run(a, b)
    assert version == 4 and incremental.next_day(spark, root) == last + 1
    assert key(incremental.read_bars(spark, root)) == key(whole)
    assert run(last + 5, last + 6) == 4  # no trades, no version
    run(first + 5, first + 6)  # days after these are no longer there
    assert incremental.next_day(spark, root) == first + 7
    part = tape.where(F.col("_d") <= first + 6).drop("_d")
    assert key(incremental.read_bars(spark, root)) == key(bars.adaptive_bars(part, "dollar", 7) if "bars_per_day" in kind else bars.value_bars_split(part, "dollar", kind["threshold"]))
    with pytest.raises(store.Conflict):
        store.commit(spark, root, 5, {})


def test_incremental_runs_are_all_or_nothing(spark, tmp_path, monkeypatch):
    """A run that fails before its commit shows nothing, whatever it has written."""
    from tidemark.operators import incremental
    from tidemark.sources import days as store

    root, tape = f"file://{tmp_path}/bars", tape_events(spark, SMALL)
    assert incremental.next_day(spark, root) is None and incremental.read_bars(spark, root).count() == 0
    monkeypatch.setattr(store, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        incremental.build_days(spark, root, tape, "dollar", threshold=90_000)
    assert incremental.read_bars(spark, root).count() == 0 and store.committed(spark, root) == (0, {})
    with pytest.raises(ValueError):
        incremental.build_days(spark, root, tape, "dollar")


def _daily_folder(spark, tmp_path, days=6):
    folder = f"file://{tmp_path}/raw"
    tape = frame(spark, [(s, 10 * d + k, d * DAY + k * 1000, 100 + k, 1, 100 + k) for s in ("x", "y") for d in range(days) for k in range(5)], TAPE)
    trades.write_raw(tape, folder).collect()
    return folder


def test_only_files_of_the_days_are_opened(spark, tmp_path):
    """Files that a condition leaves out may be broken: nobody opens them.  What cannot be pushed is left to Spark."""
    folder = _daily_folder(spark, tmp_path)
    for name in ("x-trades-1970-01-01.zip", "y-trades-1970-01-06.zip"):
        (tmp_path / "raw" / name).write_bytes(b"no archive")
    raw = trades.read_raw(spark, folder)
    with pytest.raises(Exception):
        raw.count()
    some = raw.where("day >= DATE'1970-01-02' AND day < DATE'1970-01-05' AND symbol = 'x' AND length(price) = 3")
    assert some.rdd.getNumPartitions() == 3 and some.count() == 15
    assert raw.where("day IN (DATE'1970-01-03', DATE'1970-01-09')").count() == 10
    assert raw.where("day = DATE'1980-01-01'").count() == 0
    assert raw.where("day > DATE'1970-01-01' AND day <> DATE'1970-01-06'").where("symbol = 'y'").rdd.getNumPartitions() == 5  # <> is not pushed, so the broken file is planned


def test_limit_is_by_name(spark, tmp_path):
    raw = trades.read_raw(spark, _daily_folder(spark, tmp_path), limit_files=2)
    assert sorted({(r.symbol, str(r.day)) for r in raw.collect()}) == [("x", "1970-01-01"), ("x", "1970-01-02")]


def test_days_as_a_stream(spark, tmp_path):
    """Days come in order, a few to a batch; a query that starts again goes on where it was, with files that came since."""
    folder = _daily_folder(spark, tmp_path, 5)
    seen: list[list[str]] = []

    def note(batch, _):
        seen.append(sorted({str(r.day) for r in batch.select("day").distinct().collect()}))

    def run(**options):
        rows = spark.readStream.format("daily_trades").options(**options).load(folder)
        query = rows.writeStream.foreachBatch(note).option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    trades.raw_stream(spark, folder)
    run(daysPerBatch=2, progress=f"{tmp_path}/progress")
    assert [d for d in seen if d] == [["1970-01-01", "1970-01-02"], ["1970-01-03", "1970-01-04"], ["1970-01-05"]]
    seen.clear()
    trades.write_raw(frame(spark, [("x", d, d * DAY, 1, 1, 1) for d in (5, 6, 7)], TAPE), folder).collect()
    run(daysPerBatch=2, progress=f"{tmp_path}/progress")
    # the last batch before the stop may not have been noted, so the first one after it may be short
    assert [x for d in seen for x in d] == ["1970-01-06", "1970-01-07", "1970-01-08"] and max(map(len, seen)) <= 2


def _wild(kind, n, rng):
    """Series on which chunks of a CUSUM do and do not settle."""
    if kind == "noise":
        return rng.normal(size=n).cumsum()
    if kind == "trend":  # far below the threshold for long: the sum never comes back to zero
        return np.arange(n) * 0.01
    if kind == "saw":
        return np.abs((np.arange(n) % 37) - 18) * 0.31
    x = rng.normal(size=n).cumsum() * 3
    x[rng.random(n) < 0.02] = np.nan
    return x


@pytest.mark.parametrize("rounds", [0, 1, 6])
@pytest.mark.parametrize("first", [False, True])
def test_cusum_in_chunks_equals_the_kernel(spark, monkeypatch, rounds, first):
    """Many chunks to a symbol, thresholds that change by row, sums that never settle: the same events as one run in order."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(series, "CHUNK_ROWS", 16)
    monkeypatch.setattr(series, "ROUNDS", rounds)
    rows, want = [], []
    for kind in ("noise", "trend", "saw", "gaps"):
        x, h = _wild(kind, 230, rng), rng.choice([0.8, 1.5, 4.0], 230)
        rows += [(kind, i * 7, i, None if np.isnan(v) else float(v), float(t)) for i, (v, t) in enumerate(zip(x, h, strict=True))]
        _, hits = series.walk((0.0, 0.0, float("nan")), x.tolist(), h.tolist(), first)
        want += [(kind, i * 7, side) for i, side in hits]
    got = series.cusum(frame(spark, rows, "symbol string, us long, price long, x double, h double"), "x", "h", positive_first=first)
    assert sorted((r.symbol, r.us, r.direction) for r in got.collect()) == sorted(want) and len(want) > 100


def test_one_symbol_is_many_tasks(spark, monkeypatch):
    """The chunks of one symbol run in more than one task."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(series, "CHUNK_ROWS", 50)
    moves = spark.range(1000).select(F.lit("a").alias("symbol"), F.floor(F.col("id") / 50).cast("long").alias("chunk"), F.col("id").alias("us"), F.lit(1).cast("long").alias("price"), F.lit(1.0).alias("d"), F.lit(5.0).alias("h"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        runs = series._first_runs(moves, False).withColumn("task", F.spark_partition_id())
        assert runs.select("task").distinct().count() > 1 and runs.where("direction = 0").count() == 20
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_split_bars_in_sql(spark):
    """The table function against the closed form, and what it refuses."""
    from pyspark.sql import functions as F

    from tidemark.functions import tables as functions

    functions.register(spark)
    odd = tape_events(spark, SMALL).withColumn("dollar", F.when(F.col("trade_id") % 50 == 0, 0).when(F.col("trade_id") % 51 == 0, None).otherwise(F.col("dollar"))).withColumn("more", F.lit("x"))
    odd.createOrReplaceTempView("odd_tape")
    key = lambda rows: sorted(tuple(round(x, 3) if isinstance(x, float) else x for x in r) for r in rows.select("symbol", "bar_id", "us", "open", "high", "low", "close", "volume", "dollar", "target", "value").collect())
    for size in (7_000, 150_000):
        assert key(spark.sql(f"SELECT * FROM split_bars(TABLE(odd_tape), 'dollar', {size})")) == key(bars.value_bars_split(odd.drop("more"), "dollar", size))
    assert spark.sql("SELECT * FROM split_bars(TABLE(SELECT * FROM odd_tape WHERE false), 'qty', 5)").count() == 0
    for bad in ("TABLE(odd_tape), 'price', 5", "TABLE(odd_tape), 'qty', 0", "TABLE(SELECT 1 AS symbol), 'qty', 5"):
        with pytest.raises(Exception, match="the (value|threshold|first argument) is"):
            spark.sql(f"SELECT * FROM split_bars({bad})").collect()


def test_operators_on_empty_tables(spark):
    """Nothing in, nothing out: no operator fails on an empty table."""
    from tidemark.operators import diagnostics

    t = tape_events(spark, SMALL).limit(0)
    s = frame(spark, [], "symbol string, us long, price long, x double, h double, ret double")
    e = frame(spark, [], "symbol string, t0 long, t1 long, p0 long, vertical long, target double, side int, bin int, tw double")
    samples = frame(spark, [], "sample long, pos long, t0 long, t1 long")
    made = [
        bars.time_bars(t, "7d"), bars.value_bars_whole(t, "dollar", 10), bars.value_bars_split(t, "dollar", 10), bars.dynamic_thresholds(t, "dollar", 5), bars.adaptive_bars(t, "dollar", 5), bars.daily_totals(t),
        diagnostics.thresholds_by_count(t, "1h"), diagnostics.log_returns(s.withColumnRenamed("price", "close"), ["symbol"], ["us"]), diagnostics.rolling_deviation(s, "price", 5),
        labels.returns_over(s), series.ewm_std(s, "ret", 10), series.cusum(s, "x", "h"), labels.moving_side(s, 2, 5), labels.triple_barrier(e, s, 1.0, 1.0, DAY), labels.label(e, s), labels.drop_rare(e), labels.event_mapping(s, 3),
        weights.concurrency(e, s), weights.average_uniqueness(e, weights.concurrency(e, s)), weights.return_weights(e, weights.concurrency(e, s), s), weights.time_decay(e, 0.5), weights.standard_draws(e), weights.bootstrap(e, s, ["symbol"]),
        fracdiff.ffd(s, "x", 0.4, 0.01), fracdiff.min_d_table(s, "x", [0.0, 0.5], 0.1), fracdiff.lag_features(s, "x", 3), fracdiff.adf_moments(s, "x", ["symbol"]), fracdiff.resample_last(s, "price", DAY),
        crossval.purged_kfold(samples, 3, 0.01), crossval.purged_folds_of_events(samples, 3, 0.01), crossval.embargo_times(samples, 0.01), crossval.purge_train(samples, samples),
    ]
    for k, rows in enumerate(made):
        assert rows.count() == 0, k
