"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

_T = """t AS (SELECT event_type AS symbol, event_id AS trade_id, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) + 1 AS price, event_id % 7 + 1 AS qty,
  (CAST(round(value * 100) AS BIGINT) + 1) * (event_id % 7 + 1) AS dollar FROM events)"""
_O = """t AS (SELECT o_orderpriority AS symbol, o_orderkey AS trade_id, epoch_us(o_orderdate) AS us, CAST(round(o_totalprice * 100) AS BIGINT) AS price, 1 AS qty,
  CAST(round(o_totalprice * 100) AS BIGINT) AS dollar FROM orders)"""
_S = "s AS (SELECT event_type AS symbol, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) + 1 AS price FROM events)"
_OHLC = "first(price ORDER BY us, trade_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY us, trade_id) AS close"
_SUMS = "CAST(sum(qty) AS BIGINT) AS volume, CAST(sum(dollar) AS BIGINT) AS dollar"


def _whole(tape: str, value: str, size: int) -> str:
    return f"""{tape}, c AS (SELECT *, CAST(sum({value}) OVER (PARTITION BY symbol ORDER BY us, trade_id ROWS UNBOUNDED PRECEDING) AS BIGINT) // {size} AS bar_index FROM t),
b AS (SELECT symbol, bar_index, max(us) AS us, {_OHLC}, {_SUMS}, sum({value}) AS v FROM c GROUP BY symbol, bar_index HAVING sum({value}) * 2 >= {size})"""


_BAR = "symbol, bar_index, us, open, high, low, close, volume, dollar"
_PIECES = f"""symbol, bar_id, max(us) AS us, {_OHLC}, round(sum(qty * (take / size)), 6) AS volume, round(sum(dollar * (take / size)), 4) AS dollar,
  CAST(max(bar_target) AS BIGINT) AS target, CAST(sum(take) AS BIGINT) AS value"""


def _split(value: str, size: int) -> str:
    return f"""{_T}, c AS (SELECT *, CAST(sum({value}) OVER (PARTITION BY symbol ORDER BY us, trade_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c1, {value} AS size FROM t WHERE {value} > 0),
e AS (SELECT *, unnest(range((c1 - size) // {size}, (c1 - 1) // {size} + 1)) AS bar_id FROM c),
p AS (SELECT *, least(c1, (bar_id + 1) * {size}) - greatest(c1 - size, bar_id * {size}) AS take, {size} AS bar_target FROM e),
b AS (SELECT {_PIECES} FROM p GROUP BY symbol, bar_id HAVING sum(take) * 2 >= {size})"""


RAW_BARS = f"""WITH {_T}, r AS (SELECT symbol, trade_id, us // 1000 * 1000 AS us, price::DOUBLE AS price, qty::DOUBLE AS qty, dollar::DOUBLE AS dollar FROM t)
SELECT symbol, us // {{hour}} * {{hour}} AS bar_us, {_OHLC}, sum(qty) AS volume, sum(dollar) AS dollar FROM r GROUP BY symbol, us // {{hour}} * {{hour}}"""


def build(k: dict) -> dict[str, str]:
    """All oracles; ``k`` has the queries' parameters."""
    hour, day, volume, dollar, order = (k[x] for x in ("hour", "day", "volume", "dollar", "order"))
    span = 3 * hour
    returns = f"{_whole(_O, 'dollar', order)}, l AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar_index) AS before FROM b), r AS (SELECT symbol, bar_index, us, ln(close / before) AS r FROM l WHERE before IS NOT NULL)"
    week = f"us // {day} - (us // {day} + 3) % 7"
    totals = f"d AS (SELECT symbol, us // {day} AS day, CAST(sum(dollar) AS BIGINT) AS dollar, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS trades FROM t GROUP BY ALL)"

    def by_frequency(stat: str) -> str:
        return f"""WITH {_T}, {totals}, m AS (SELECT symbol, {stat}(dollar) AS x, {stat}(qty) AS y FROM d GROUP BY symbol),
f(freq, n) AS (VALUES ('1d', 1.0::DOUBLE), ('4h', 6.0), ('1h', 24.0), ('15m', 96.0))
SELECT symbol, freq, n AS bars_per_day, round(x, 6) AS daily_dollar, round(y, 6) AS daily_qty, round(x / n, 6) AS dollar_per_bar, round(y / n, 6) AS qty_per_bar FROM m, f"""

    def time_bars(start: str) -> str:
        return f"WITH {_T}, b AS (SELECT *, {start} AS bar_us FROM t) SELECT symbol, bar_us, {_OHLC}, {_SUMS} FROM b GROUP BY symbol, bar_us"

    fold = f"""q AS (SELECT symbol, us // {day} AS day, CAST(sum(dollar) AS BIGINT) AS total FROM t WHERE dollar > 0 GROUP BY ALL),
q2 AS (SELECT *, row_number() OVER w AS i, (CASE WHEN row_number() OVER w = 1 THEN CAST(total AS DOUBLE) ELSE avg(total) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END) / 12 AS raw FROM q WINDOW w AS (PARTITION BY symbol ORDER BY day)),
tg AS (SELECT symbol, i, CAST(greatest(1, floor(raw + 0.5)) AS BIGINT) AS target FROM q2 WHERE i = 1
  UNION ALL SELECT q2.symbol, q2.i, CAST(greatest(1, floor(least(tg.target * 1.25::DOUBLE, greatest(tg.target * 0.75::DOUBLE, 0.7::DOUBLE * tg.target + 0.3::DOUBLE * raw)) + 0.5)) AS BIGINT) FROM tg JOIN q2 ON q2.symbol = tg.symbol AND q2.i = tg.i + 1),
z AS (SELECT q2.symbol, q2.i, day, total, target FROM q2 JOIN tg ON tg.symbol = q2.symbol AND tg.i = q2.i),
st AS (SELECT symbol, i, day, total, target, 0::BIGINT AS head_target, 0::BIGINT AS head_need, 0::BIGINT AS first_bar, target AS open_target, total % target AS filled, total // target AS next_bar FROM z WHERE i = 1
  UNION ALL SELECT symbol, i, day, total, target, CASE WHEN f > 0 THEN o ELSE 0 END, need, n,
    CASE WHEN total < need THEN o ELSE target END, CASE WHEN total < need THEN f + total ELSE (total - need) % target END,
    n + CASE WHEN total < need THEN 0 ELSE (f > 0)::BIGINT + (total - need) // target END
  FROM (SELECT z.*, st.filled AS f, st.open_target AS o, st.next_bar AS n, CASE WHEN st.filled > 0 THEN st.open_target - st.filled ELSE 0 END AS need FROM st JOIN z ON z.symbol = st.symbol AND z.i = st.i + 1))"""

    keep = repr(1 - 2 / 101)

    def ewm(ret: str) -> str:
        return f"""{_S}, x AS (SELECT a.symbol, a.us, a.price, {ret} AS ret FROM s a ASOF JOIN s b ON a.symbol = b.symbol AND a.us - {day} > b.us),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY us) AS i FROM x),
e AS (SELECT symbol, i, us, price, ret, 1::DOUBLE AS w, 1::DOUBLE AS w2, ret AS m, 0::DOUBLE AS s FROM n WHERE i = 1
  UNION ALL SELECT n.symbol, n.i, n.us, n.price, n.ret, {keep} * e.w + 1, {keep} * {keep} * e.w2 + 1, e.m + (n.ret - e.m) / ({keep} * e.w + 1), {keep} * e.s + (n.ret - e.m) * (n.ret - (e.m + (n.ret - e.m) / ({keep} * e.w + 1)))
  FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1),
v AS MATERIALIZED (SELECT symbol, us, price, ret, i, CASE WHEN w - w2 / w > 1e-12 THEN sqrt(s / (w - w2 / w)) END AS vol FROM e)"""

    vol = ewm("a.price / b.price - 1")
    walk = """k AS (SELECT symbol, i, us, price, x, h, 0::DOUBLE AS up, 0::DOUBLE AS dn, 0 AS direction FROM g WHERE i = 1
  UNION ALL SELECT symbol, i, us, price, x, h, CASE WHEN {up} THEN 0 ELSE u END, CASE WHEN {dn} THEN 0 ELSE d END, CASE WHEN {dn} THEN -1 WHEN {up} THEN 1 ELSE 0 END
  FROM (SELECT g.*, greatest(0, k.up + {move}) AS u, least(0, k.dn + {move}) AS d FROM k JOIN g ON g.symbol = k.symbol AND g.i = k.i + 1))"""
    cusum = f"{vol}, g AS MATERIALIZED (SELECT v.symbol, i, us, price, ln(price) AS x, 0.25 * avg(vol) OVER (PARTITION BY symbol) AS h FROM v), " + walk.format(up="(NOT d < -h) AND u > h", dn="d < -h", move="(g.x - k.x)")
    side = """sd AS (SELECT symbol, us, CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN CASE WHEN sum(price) OVER (w ROWS 4 PRECEDING) / 5 > sum(price) OVER (w ROWS 19 PRECEDING) / 20 THEN 1 ELSE -1 END END AS side FROM s WINDOW w AS (PARTITION BY symbol ORDER BY us))"""
    after = f"af AS (SELECT a.symbol, a.us, b.us AS t1 FROM s a ASOF LEFT JOIN s b ON a.symbol = b.symbol AND a.us + {span} <= b.us)"

    def touched(sign: str, stop: float, profit: float, where: str) -> str:
        return f"""{cusum}, {side}, {after},
ev AS MATERIALIZED (SELECT k.symbol, k.us AS t0, k.price AS p0, af.t1 AS vertical, v.vol * 0.1::DOUBLE AS target, {sign} AS side FROM k JOIN v ON v.symbol = k.symbol AND v.us = k.us JOIN af ON af.symbol = k.symbol AND af.us = k.us JOIN sd ON sd.symbol = k.symbol AND sd.us = k.us WHERE direction <> 0 AND vol > 0 {where}),
ls AS (SELECT symbol, max(us) AS last FROM s GROUP BY symbol),
hit AS (SELECT ev.symbol, t0, min(CASE WHEN (price / p0 - 1) * side < -{stop}::DOUBLE * target THEN us END) AS sl, min(CASE WHEN (price / p0 - 1) * side > {profit}::DOUBLE * target THEN us END) AS pt
  FROM ev JOIN ls ON ls.symbol = ev.symbol JOIN s ON s.symbol = ev.symbol AND s.us BETWEEN t0 AND coalesce(vertical, last) GROUP BY ev.symbol, t0),
tb AS MATERIALIZED (SELECT ev.*, sl, pt, least(vertical, sl, pt) AS t1 FROM ev JOIN hit ON hit.symbol = ev.symbol AND hit.t0 = ev.t0)"""

    plain = touched("1", 1.0, 1.0, "")
    meta = touched("sd.side", 2.0, 1.0, "AND sd.side IS NOT NULL")
    labelled = "lb AS MATERIALIZED (SELECT tb.*, (s.price / p0 - 1) * side AS ret, {} AS bin FROM tb JOIN s ON s.symbol = tb.symbol AND s.us = tb.t1)"
    lab = f"{plain}, {labelled.format('CAST(sign((s.price / p0 - 1) * side) AS INTEGER)')}"
    mlab = f"{meta}, {labelled.format('CASE WHEN (s.price / p0 - 1) * side > 0 THEN 1 ELSE 0 END')}"
    spans = f"{plain}, rn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY us) AS n FROM s), sp AS MATERIALIZED (SELECT symbol, t0, t1 FROM tb)"
    counts = f"{spans}, cc AS MATERIALIZED (SELECT rn.symbol, rn.us, rn.n, rn.price, count(t0) AS c FROM rn JOIN ls ON ls.symbol = rn.symbol LEFT JOIN sp ON sp.symbol = rn.symbol AND rn.us BETWEEN t0 AND coalesce(t1, last) GROUP BY ALL)"
    unique = f"{counts}, un AS MATERIALIZED (SELECT sp.symbol, t0, sp.t1, sum(CASE WHEN c > 0 THEN 1 / c END) / count(*) AS tw FROM sp JOIN ls ON ls.symbol = sp.symbol JOIN cc ON cc.symbol = sp.symbol AND cc.us BETWEEN t0 AND coalesce(t1, last) GROUP BY ALL)"
    logs = f"{_S}, lx AS (SELECT symbol, us, ln(price) AS x FROM s)"

    def dot(ws: list[float], rows: str, out: str = "fd") -> str:
        terms = " + ".join(f"({w!r}::DOUBLE) * " + (f"lag(x, {i}) OVER w" if i else "x") for i, w in enumerate(ws))
        return f"SELECT * FROM (SELECT symbol, us, x, {terms} AS {out} FROM {rows} WINDOW w AS (PARTITION BY symbol ORDER BY us)) WHERE {out} IS NOT NULL"

    fd = f"{logs}, fd AS ({dot(k['ffd'], 'lx')})"

    def adf(rows: str, value: str, by: str) -> str:
        return f"""a1 AS (SELECT {by}, us, {value} AS x, lag({value}) OVER (PARTITION BY {by} ORDER BY us) AS l FROM {rows}), a2 AS (SELECT *, x - l AS y FROM a1), a3 AS (SELECT *, lag(y) OVER (PARTITION BY {by} ORDER BY us) AS z FROM a2),
a4 AS (SELECT {by}, count(*)::DOUBLE AS n, var_pop(l) AS ll, var_pop(z) AS zz, var_pop(y) AS yy, covar_pop(l, z) AS lz, covar_pop(l, y) AS ly, covar_pop(z, y) AS zy FROM a3 WHERE z IS NOT NULL GROUP BY {by}),
a5 AS (SELECT *, ll * zz - lz * lz AS det FROM a4), a6 AS (SELECT *, (ly * zz - zy * lz) / det AS gamma, (zy * ll - ly * lz) / det AS delta FROM a5),
ad AS (SELECT {by}, n::BIGINT AS nobs, gamma, gamma / sqrt(greatest(0, yy - gamma * ly - delta * zy) * n / (n - 3) * zz / det / n) AS stat, 1 AS lags, -2.86154::DOUBLE - 2.8903::DOUBLE / n - 4.234::DOUBLE / n ** 2 - 40.04::DOUBLE / n ** 3 AS crit5 FROM a6 WHERE n > 3),
ap AS (SELECT *, (CASE WHEN stat <= -1.61 THEN 2.1659::DOUBLE + 1.4412::DOUBLE * stat + 0.038269::DOUBLE * stat ** 2 ELSE 1.7339::DOUBLE + 0.93202::DOUBLE * stat - 0.12745::DOUBLE * stat ** 2 - 0.010368::DOUBLE * stat ** 3 END) / sqrt(2) AS zed FROM ad),
aq AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(zed)) AS tt FROM ap),
ar AS (SELECT *, (0.254829592::DOUBLE * tt - 0.284496736::DOUBLE * tt ** 2 + 1.421413741::DOUBLE * tt ** 3 - 1.453152027::DOUBLE * tt ** 4 + 1.061405429::DOUBLE * tt ** 5) * exp(-zed * zed) / 2 AS tail FROM aq),
az AS (SELECT * EXCLUDE (zed, tt, tail), CASE WHEN stat >= 2.74 THEN 1.0::DOUBLE WHEN stat <= -18.83 THEN 0.0::DOUBLE WHEN zed < 0 THEN tail ELSE 1 - tail END AS p FROM ar)"""

    grid = ", ".join(f"g{i} AS ({dot(ws, 'lx')})" for i, ws in enumerate(k["grid"].values()))
    stacked = "gd AS (" + " UNION ALL ".join(f"SELECT {d!r}::DOUBLE AS d, * FROM g{i}" for i, d in enumerate(k["grid"])) + ")"
    table = f"{logs}, {grid}, {stacked}, {adf('gd', 'fd', 'symbol, d')}, md AS (SELECT az.*, c.corr, c.n AS rows FROM az JOIN (SELECT symbol, d, corr(x, fd) AS corr, count(*) AS n FROM gd GROUP BY symbol, d) c ON c.symbol = az.symbol AND c.d = az.d WHERE c.n >= 20)"
    # weights of the expanding difference by their number, as long as the longest series; a series drops what its own oldest weights leave out
    expanding = f"""{logs}, h AS MATERIALIZED (SELECT symbol, us, x, row_number() OVER (PARTITION BY symbol ORDER BY us) - 1 AS n FROM lx), hn AS (SELECT symbol, count(*) AS m FROM h GROUP BY symbol),
wr AS (SELECT i, CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE -({k['d']!r}::DOUBLE - i + 1) / i END AS r FROM range((SELECT max(m) FROM hn)) u(i)), wt AS MATERIALIZED (SELECT i, product(r) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS w FROM wr),
wc AS (SELECT symbol, i, sum(abs(w)) OVER (PARTITION BY symbol ORDER BY i DESC ROWS UNBOUNDED PRECEDING) / sum(abs(w)) OVER (PARTITION BY symbol) AS lost FROM wt JOIN hn ON i < m), ws AS (SELECT symbol, count(*) AS skip FROM wc WHERE lost > {k['threshold']!r}::DOUBLE GROUP BY symbol)"""
    samples = f"sm AS (SELECT event_id AS sample, epoch_us(ts) AS t0, epoch_us(ts) + {hour} * (1 + event_id % 5) AS t1, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events)"

    n_lags = k["lags"]
    lag = lambda c, i: f"lag({c}, {i}) OVER w" if i else c
    columns = [*((f"fd_lag{i}", lag("fd", i)) for i in range(n_lags)), *((f"fd_ret_lag{i}", lag("dd", i)) for i in range(n_lags - 1))]
    lagged = f"fm AS (SELECT *, fd - lag(fd) OVER (PARTITION BY symbol ORDER BY us) AS dd FROM fd), lf AS (SELECT symbol, us, {', '.join(f'round({e}, 6) AS {n}' for n, e in columns)} FROM fm WINDOW w AS (PARTITION BY symbol ORDER BY us))"
    known = " AND ".join(f"{n} IS NOT NULL" for n, _ in columns)

    def kfold(end: str) -> str:
        return f"""WITH {samples}, fo AS (SELECT *, CAST(CASE WHEN pos < (n % 3) * (n // 3 + 1) THEN pos // (n // 3 + 1) ELSE n % 3 + (pos - (n % 3) * (n // 3 + 1)) // (n // 3) END AS INTEGER) AS fold FROM sm),
bo AS (SELECT fold, min(pos) AS lo, max(pos) AS hi, min(t0) AS a, {end} AS b FROM fo GROUP BY fold)
SELECT fold, sample, role FROM (SELECT bo.fold, sample, CASE WHEN pos BETWEEN lo AND hi THEN 'test' WHEN NOT (t0 <= b AND t1 >= a) AND NOT (pos > hi AND pos <= hi + CAST(floor(n * 0.01::DOUBLE) AS BIGINT)) THEN 'train' END AS role FROM sm, bo) WHERE role IS NOT NULL"""

    binomial = " + ".join(f"{c} * pow(p, {i}) * pow(1 - p, {11 - i})" for i, c in enumerate(k["comb"][:6]))
    taus = []
    for r in ("rx", "ry"):
        ww = f"(1 / (1 + a.{r}) + 1 / (1 + b.{r}))"
        taus.append(f"sum({ww} * sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum({ww} * abs(sign(a.x - b.x))) * sum({ww} * abs(sign(a.y - b.y))))")
    pairs = "pr AS (SELECT i, j, embedding[i + 1]::DOUBLE AS a, embedding[j + 1]::DOUBLE AS b FROM embeddings, range(64) u(i), range(64) w(j) WHERE i <= j)"
    normal = "exp(-pow((lo + (bin + 0.5::DOUBLE) * (hi - lo) / 100 - mean) / std, 2) / 2) / (std * sqrt(2 * pi()))"

    out = {
        "time_bars_1h": time_bars(f"us // {hour} * {hour}"),
        "time_bars_7d_start_day": time_bars(f"us - (us - min(us // {day} * {day}) OVER (PARTITION BY symbol)) % {7 * day}"),
        "time_bars_7d_per_day": time_bars(f"us // {day} * {day}"),
        "value_bars_whole_volume": f"WITH {_whole(_T, 'qty', volume)} SELECT {_BAR} FROM b",
        "value_bars_whole_dollar": f"WITH {_whole(_T, 'dollar', dollar)} SELECT {_BAR} FROM b",
        "value_bars_split_dollar": f"WITH {_split('dollar', dollar)} SELECT * FROM b",
        "value_bars_split_volume": f"WITH {_split('qty', volume)} SELECT * FROM b",
        "bar_merge": time_bars(f"us // {hour} * {hour}"),
        "bar_repair_avg": f"WITH {_split('dollar', 20_000)} SELECT symbol, us, avg(open) AS open, avg(high) AS high, avg(low) AS low, avg(close) AS close, avg(value) AS value FROM b GROUP BY symbol, us",
        "dedupe_keep_last": "SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) AS us, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1",
        "dynamic_threshold_log": f"WITH RECURSIVE {_T}, {fold} SELECT symbol, day, total, target, head_target, head_need, first_bar FROM st",
        "adaptive_bars": f"""WITH RECURSIVE {_T}, {fold},
c AS (SELECT t.*, us // {day} AS d, dollar AS size, CAST(sum(dollar) OVER (PARTITION BY symbol, us // {day} ORDER BY us, trade_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c1 FROM t WHERE dollar > 0),
e AS (SELECT c.*, st.target, head_target, head_need, first_bar, unnest(range(CASE WHEN c1 - size < head_need THEN -1 ELSE (c1 - size - head_need) // st.target END, CASE WHEN c1 - 1 < head_need THEN 0 ELSE (c1 - 1 - head_need) // st.target + 1 END)) AS slot FROM c JOIN st ON st.symbol = c.symbol AND st.day = c.d),
p AS (SELECT * EXCLUDE (target), CASE WHEN slot < 0 THEN head_target ELSE target END AS bar_target, first_bar + slot + (head_need > 0)::BIGINT AS bar_id,
  least(c1, CASE WHEN slot < 0 THEN head_need ELSE head_need + (slot + 1) * target END) - greatest(c1 - size, CASE WHEN slot < 0 THEN 0 ELSE head_need + slot * target END) AS take FROM e),
b AS (SELECT {_PIECES} FROM p GROUP BY symbol, bar_id) SELECT * FROM b WHERE value * 2 >= target""",
        "daily_totals": f"WITH {_T}, {totals} SELECT * FROM d",
        "threshold_from_freq": by_frequency("median"),
        "threshold_from_freq_mean": by_frequency("avg"),
        "threshold_from_counts": f"WITH {_T}, b AS (SELECT symbol, us // {day} AS day, us % {day} // {hour} AS bar, sum(dollar) AS dollar, sum(qty) AS qty FROM t GROUP BY ALL), c AS (SELECT symbol, count(*) AS n, CAST(sum(dollar) AS BIGINT) AS dollar, CAST(sum(qty) AS BIGINT) AS qty, max(day) - min(day) + 1 AS days FROM b GROUP BY symbol) SELECT symbol, '1h' AS freq, n AS time_bars, dollar, qty, round(dollar / n, 6) AS dollar_per_bar, round(qty / n, 6) AS qty_per_bar, round(n / days, 6) AS bars_per_day FROM c",
        "log_returns": f"WITH {returns} SELECT symbol, bar_index, round(r, 9) AS r FROM r",
        "weekly_bar_count": f"WITH {_whole(_O, 'dollar', order)} SELECT symbol, {week} AS week, count(*) AS bars FROM b GROUP BY symbol, {week}",
        "monthly_variance": f"WITH {returns} SELECT symbol, strftime(make_timestamp(us), '%Y-%m') AS month, count(*) AS n, round(var_samp(r), 6) AS variance FROM r GROUP BY ALL",
        "serial_corr": f"WITH {returns}, p AS (SELECT *, lag(r) OVER (PARTITION BY symbol ORDER BY bar_index) AS b FROM r) SELECT symbol, count(*) AS n, round(corr(r, b), 6) AS corr FROM p WHERE b IS NOT NULL GROUP BY symbol",
        "jarque_bera": f"WITH {returns}, m AS (SELECT symbol, avg(r) AS mu FROM r GROUP BY symbol), z AS (SELECT r.symbol, count(*) AS n, avg(pow(r - mu, 2)) AS m2, avg(pow(r - mu, 3)) AS m3, avg(pow(r - mu, 4)) AS m4 FROM r JOIN m ON m.symbol = r.symbol GROUP BY r.symbol), y AS (SELECT symbol, n, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS kurt FROM z), j AS (SELECT *, n / 6 * (skew * skew + kurt * kurt / 4) AS jb FROM y) SELECT symbol, n, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(jb, 6) AS jb, round(exp(-jb / 2), 6) AS p FROM j",
        "series_describe": f"WITH {returns} SELECT symbol, count(*) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(min(r), 6) AS least, round(quantile_cont(r, 0.25), 6) AS q25, round(quantile_cont(r, 0.5), 6) AS q50, round(quantile_cont(r, 0.75), 6) AS q75, round(max(r), 6) AS most FROM r GROUP BY symbol",
        "return_histogram": f"WITH {returns}, q AS (SELECT symbol, min(r) AS lo, max(r) AS hi, avg(r) AS mean, stddev_samp(r) AS std, count(*) AS n FROM r GROUP BY symbol), h AS (SELECT q.symbol, CAST(least(99, floor((r - lo) / ((hi - lo) / 100))) AS INTEGER) AS bin, count(*) AS c FROM r JOIN q ON q.symbol = r.symbol GROUP BY ALL), g AS (SELECT q.*, CAST(u.bin AS INTEGER) AS bin FROM q, range(100) u(bin)) SELECT g.symbol, g.bin, coalesce(c, 0) AS rows, round(coalesce(c, 0) / (n * ((hi - lo) / 100)), 5) AS density, round({normal.replace('bin', 'g.bin')}, 5) AS normal FROM g LEFT JOIN h ON h.symbol = g.symbol AND h.bin = g.bin",
        "bar_kind_counts": f"WITH {_T}, k AS (SELECT 'time' AS kind, symbol, us // {hour} * {hour} AS us FROM t GROUP BY ALL UNION ALL SELECT 'volume', symbol, us FROM (WITH {_whole(_T, 'qty', volume)} SELECT * FROM b) UNION ALL SELECT 'dollar', symbol, us FROM (WITH {_whole(_T, 'dollar', dollar)} SELECT * FROM b)) SELECT kind, symbol, {week} AS week, count(*) AS bars FROM k GROUP BY kind, symbol, {week}",
        "coverage_scan": f"WITH {_O}, h AS (SELECT us // {day} AS day, count(*) AS rows FROM t GROUP BY 1), c AS (SELECT unnest(range(min(day), max(day) + 1)) AS day FROM h) SELECT c.day, h.rows, CASE WHEN h.rows IS NULL THEN 'missing' ELSE 'complete' END AS status FROM c LEFT JOIN h ON h.day = c.day",
        "incremental_start": f"WITH {_T} SELECT symbol, (max(us // {hour} * {hour}) // {day} + 1) * {day} AS start_us FROM t GROUP BY symbol",
        "run_metadata": f"WITH {_T}, b AS (SELECT DISTINCT symbol, us // {hour} * {hour} AS us FROM t) SELECT '1h' AS frequency, {dollar} AS dollar_per_bar, min(us) AS first_us, max(us) AS last_us, count(*) AS rows FROM b",
        "day_range_totals": f"WITH {_T}, {totals} SELECT * FROM d WHERE day >= (SELECT max(day) FROM d) - 13",
        "event_membership": f"WITH RECURSIVE {cusum}, rn AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY us) - 1 AS event_idx, us, price FROM s) SELECT * FROM rn WHERE us IN (SELECT us FROM k WHERE direction <> 0)",
        "asof_prev_day": f"WITH {_S} SELECT a.symbol, a.us, a.price, b.price AS previous FROM s a ASOF JOIN s b ON a.symbol = b.symbol AND a.us - {day} > b.us",
        "daily_vol": f"WITH RECURSIVE {vol} SELECT symbol, us, price, round(ret, 6) AS ret, round(vol, 6) AS vol FROM v",
        "daily_vol_log": f"WITH RECURSIVE {ewm('ln(a.price / b.price)')} SELECT symbol, us, price, round(ret, 6) AS ret, round(vol, 6) AS vol FROM v",
        "rolling_std": f"WITH {_S}, c AS (SELECT *, price / lag(price) OVER (PARTITION BY symbol ORDER BY us) - 1 AS c FROM s) SELECT symbol, us, round(CASE WHEN count(c) OVER w = 100 THEN stddev_samp(c) OVER w END, 6) AS std FROM c WINDOW w AS (PARTITION BY symbol ORDER BY us ROWS 99 PRECEDING)",
        "rolling_side": f"WITH {_S}, {side} SELECT * FROM sd",
        "cusum_events": f"WITH RECURSIVE {cusum} SELECT symbol, us, price, direction FROM k WHERE direction <> 0",
        "cusum_positional": f"WITH RECURSIVE {_S}, g AS MATERIALIZED (SELECT symbol, us, price, row_number() OVER w AS i, coalesce(ln(price / lag(price) OVER w), 0) AS x, 2.5::DOUBLE AS h FROM s WINDOW w AS (PARTITION BY symbol ORDER BY us)), " + walk.format(up="u > h", dn="d < -h AND NOT u > h", move="g.x") + " SELECT symbol, us, price, direction FROM k WHERE direction <> 0",
        "vertical_barrier": f"WITH {_S}, {after} SELECT * FROM af",
        "triple_barrier": f"WITH RECURSIVE {plain} SELECT symbol, t0, vertical, sl, pt, t1 FROM tb",
        "event_labels": f"WITH RECURSIVE {lab} SELECT symbol, t0, t1, round(ret, 9) AS ret, bin FROM lb",
        "meta_labels": f"WITH RECURSIVE {mlab} SELECT symbol, t0, t1, side, round(ret, 9) AS ret, bin FROM lb",
        "meta_metrics": f"WITH RECURSIVE {mlab} SELECT symbol, count(*) AS n, round(avg(bin), 6) AS executed, round(avg(ret), 6) AS mean_ret, round(avg(CASE WHEN bin = 1 THEN ret END), 6) AS mean_ret_executed FROM lb GROUP BY symbol",
        "drop_rare_labels": f"WITH RECURSIVE {lab}, c AS (SELECT bin, count(*) AS c FROM lb GROUP BY bin), ra AS (SELECT bin FROM c WHERE (SELECT count(*) FROM c) > 2 AND c <= 0.05 * (SELECT sum(c) FROM c) ORDER BY c, bin LIMIT 1) SELECT symbol, t0, bin FROM lb WHERE bin NOT IN (SELECT bin FROM ra)",
        "label_counts": f"WITH RECURSIVE {lab} SELECT bin, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lb GROUP BY bin",
        "event_mapping": f"WITH {_S}, rn AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY us) - 1 AS event_idx, us, price FROM s) SELECT * FROM rn WHERE event_idx % 50 = 0",
        "concurrency": f"WITH RECURSIVE {counts} SELECT symbol, us, c FROM cc",
        "avg_uniqueness": f"WITH RECURSIVE {unique} SELECT symbol, t0, t1, round(tw, 6) AS tw FROM un",
        "return_weights": f"WITH RECURSIVE {unique}, lr AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY symbol ORDER BY us)) AS r FROM cc), rw AS (SELECT sp.symbol, t0, abs(coalesce(sum(CASE WHEN c > 0 THEN r / c END), 0)) AS raw FROM sp JOIN ls ON ls.symbol = sp.symbol JOIN lr ON lr.symbol = sp.symbol AND lr.us BETWEEN t0 AND coalesce(t1, last) GROUP BY ALL), ww AS (SELECT symbol, t0, raw * count(*) OVER w / sum(raw) OVER w AS w FROM rw WINDOW w AS (PARTITION BY symbol)) SELECT un.symbol, un.t0, round(ww.w, 6) AS w FROM un JOIN ww ON ww.symbol = un.symbol AND ww.t0 = un.t0",
        "time_decay": f"WITH RECURSIVE {unique} SELECT symbol, t0, round(greatest(0, 1 - 0.5 / tt * tt + 0.5 / tt * cu), 6) AS decay FROM (SELECT *, sum(tw) OVER (PARTITION BY symbol ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS cu, sum(tw) OVER (PARTITION BY symbol) AS tt FROM un)",
        "time_decay_cut": f"WITH RECURSIVE {unique} SELECT symbol, t0, round(greatest(0, 1 - 1 / (0.75 * tt) * tt + 1 / (0.75 * tt) * cu), 6) AS decay FROM (SELECT *, sum(tw) OVER (PARTITION BY symbol ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS cu, sum(tw) OVER (PARTITION BY symbol) AS tt FROM un)",
        "matrix_uniqueness": f"WITH RECURSIVE {spans}, ce AS MATERIALIZED (SELECT sp.symbol, t0, s.us FROM sp JOIN s ON s.symbol = sp.symbol AND s.us BETWEEN t0 AND t1 WHERE t1 IS NOT NULL), h AS (SELECT symbol, us, count(*) AS c FROM ce GROUP BY ALL) SELECT ce.symbol, t0, count(*) AS rows, round(avg(1 / c), 6) AS u FROM ce JOIN h ON h.symbol = ce.symbol AND h.us = ce.us GROUP BY ALL",
        "ffd": f"WITH {fd} SELECT symbol, us, round(fd, 6) AS fd FROM fd",
        "fracdiff_expanding": f"WITH {expanding} SELECT a.symbol, a.us, round(sum(b.x * w), 6) AS fd FROM h a JOIN ws ON ws.symbol = a.symbol JOIN h b ON b.symbol = a.symbol AND b.n <= a.n JOIN wt ON i = a.n - b.n WHERE a.n >= skip GROUP BY a.symbol, a.us",
        "ffill": f"WITH {_S} SELECT symbol, us, last_value(CASE WHEN price % 3 = 0 THEN price END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY us ROWS UNBOUNDED PRECEDING) AS filled FROM s",
        "resample_last": f"WITH {_S} SELECT symbol, us // {day} * {day} AS bucket, last(price ORDER BY us) AS price, count(*) AS rows FROM s GROUP BY symbol, us // {day} * {day}",
        "adf_moments": f"WITH {logs}, {adf('lx', 'x', 'symbol')} SELECT symbol, nobs, round(gamma, 5) AS gamma, round(stat, 5) AS stat, lags, round(crit5, 5) AS crit5, round(p, 5) AS p FROM az",
        "min_d_corr": f"WITH {table} SELECT symbol, d, nobs, round(stat, 5) AS stat, round(p, 5) AS p, lags, round(crit5, 5) AS crit5, round(corr, 5) AS corr, rows FROM md",
        "pick_d": f"WITH {table} SELECT symbol, coalesce(min(CASE WHEN p < 0.05 THEN d END), max(d)) AS d FROM md GROUP BY symbol",
        "lag_features": f"WITH {fd}, {lagged} SELECT * FROM lf",
        "event_features": f"WITH RECURSIVE {plain}, lx AS (SELECT symbol, us, ln(price) AS x FROM s), fd AS ({dot(k['ffd'], 'lx')}), {lagged} SELECT lf.* RENAME (us AS t0) FROM lf JOIN tb ON tb.symbol = lf.symbol AND tb.t0 = lf.us WHERE {known}",
        "aligned_samples": f"WITH RECURSIVE {unique}, lr AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY symbol ORDER BY us)) AS r FROM cc), rw AS (SELECT sp.symbol, t0, abs(coalesce(sum(CASE WHEN c > 0 THEN r / c END), 0)) AS raw FROM sp JOIN ls ON ls.symbol = sp.symbol JOIN lr ON lr.symbol = sp.symbol AND lr.us BETWEEN t0 AND coalesce(t1, last) GROUP BY ALL), ww AS (SELECT symbol, t0, raw * count(*) OVER w / sum(raw) OVER w AS w FROM rw WINDOW w AS (PARTITION BY symbol)), {labelled.format('CAST(sign((s.price / p0 - 1) * side) AS INTEGER)')}, c AS (SELECT bin, count(*) AS c FROM lb GROUP BY bin), ra AS (SELECT bin FROM c WHERE (SELECT count(*) FROM c) > 2 AND c <= 0.05 * (SELECT sum(c) FROM c) ORDER BY c, bin LIMIT 1) SELECT lb.symbol, lb.t0, lb.t1, (bin > 0)::DOUBLE AS y, round(un.tw, 6) AS tw, round(ww.w, 6) AS w FROM lb JOIN un ON un.symbol = lb.symbol AND un.t0 = lb.t0 JOIN ww ON ww.symbol = lb.symbol AND ww.t0 = lb.t0 WHERE bin NOT IN (SELECT bin FROM ra)",
        "series_alignment": f"WITH RECURSIVE {vol}, {after} SELECT coalesce(v.symbol, af.symbol) AS symbol, coalesce(v.us, af.us) AS t0, round(vol, 6) AS vol, t1 FROM v FULL OUTER JOIN af ON v.symbol = af.symbol AND v.us = af.us",
        "touch_times": f"WITH RECURSIVE {plain} SELECT symbol, t0 AS us FROM tb UNION SELECT symbol, t1 FROM tb WHERE t1 IS NOT NULL",
        "back_to_back": f"WITH RECURSIVE {plain} SELECT symbol, t0 AS us FROM tb INTERSECT SELECT symbol, t1 FROM tb",
        "suggested_thresholds": f"WITH {_T}, {totals} SELECT symbol, round(greatest(median(dollar) / 12, 1000000), 6) AS dollar_per_bar, round(greatest(median(qty) / 12, 30), 6) AS qty_per_bar FROM d GROUP BY symbol",
        "first_bars": f"{time_bars(f'us // {hour} * {hour}')} ORDER BY bar_us, symbol LIMIT 100",
        "largest_bars": f"{time_bars(f'us // {hour} * {hour}')} ORDER BY dollar DESC, symbol, bar_us LIMIT 10",
        "cusum_last_vol": f"WITH RECURSIVE {vol}, g AS MATERIALIZED (SELECT v.symbol, i, us, price, ln(price) AS x, 0.5 * last_value(vol IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS h FROM v), " + walk.format(up="(NOT d < -h) AND u > h", dn="d < -h", move="(g.x - k.x)") + " SELECT symbol, us, price, direction FROM k WHERE direction <> 0",
        "bar_diagnostics": f"""WITH {_T}, k AS (SELECT 'time' AS kind, symbol, us // {hour} * {hour} AS us, last(price ORDER BY t.us, trade_id) AS close FROM t GROUP BY symbol, t.us // {hour} * {hour} UNION ALL SELECT 'volume', symbol, us, close FROM (WITH {_whole(_T, 'qty', volume)} SELECT * FROM b) UNION ALL SELECT 'dollar', symbol, us, close FROM (WITH {_whole(_T, 'dollar', dollar)} SELECT * FROM b)),
wk AS (SELECT kind, symbol, avg(n) AS weekly_bars FROM (SELECT kind, symbol, {week} AS week, count(*) AS n FROM k GROUP BY ALL) GROUP BY kind, symbol),
r0 AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY kind, symbol ORDER BY us)) AS r FROM k), rr AS (SELECT *, lag(r) OVER (PARTITION BY kind, symbol ORDER BY us) AS b FROM r0 WHERE r IS NOT NULL),
mv AS (SELECT kind, symbol, avg(v) AS monthly_variance FROM (SELECT kind, symbol, strftime(make_timestamp(us), '%Y-%m') AS month, var_samp(r) AS v FROM rr GROUP BY ALL) GROUP BY kind, symbol),
mu AS (SELECT *, avg(r) OVER (PARTITION BY kind, symbol) AS mu FROM rr), mo AS (SELECT kind, symbol, count(*) AS n, corr(r, b) AS corr, avg(pow(r - mu, 2)) AS m2, avg(pow(r - mu, 3)) AS m3, avg(pow(r - mu, 4)) AS m4 FROM mu GROUP BY kind, symbol),
jb AS (SELECT kind, symbol, n, corr, n / 6 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM mo)
SELECT wk.kind, wk.symbol, round(weekly_bars, 5) AS weekly_bars, round(corr, 5) AS corr, round(monthly_variance, 5) AS monthly_variance, n, round(jb, 5) AS jb, round(exp(-jb / 2), 5) AS p FROM wk LEFT JOIN jb ON jb.kind = wk.kind AND jb.symbol = wk.symbol LEFT JOIN mv ON mv.kind = wk.kind AND mv.symbol = wk.symbol""",
        "purged_kfold_class": f"""WITH {samples}, fo AS (SELECT *, CAST(CASE WHEN pos < (n % 3) * (n // 3 + 1) THEN pos // (n // 3 + 1) ELSE n % 3 + (pos - (n % 3) * (n // 3 + 1)) // (n // 3) END AS INTEGER) AS fold FROM sm),
bo AS (SELECT fold, min(pos) AS lo, max(pos) AS hi, min(t0) AS a, max(t1) AS b FROM fo GROUP BY fold), re AS (SELECT bo.*, (SELECT count(*) FROM sm WHERE t0 < b) AS after FROM bo)
SELECT fold, sample, role FROM (SELECT re.fold, sample, CASE WHEN pos BETWEEN lo AND hi THEN 'test' WHEN pos < lo AND t1 <= a OR pos > hi AND pos >= after + CAST(floor(n * 0.01::DOUBLE) AS BIGINT) THEN 'train' END AS role FROM sm, re) WHERE role IS NOT NULL""",
        "purged_kfold": kfold("greatest(max(t0), max(t1))"),
        "purged_kfold_by_start": kfold("max(t0)"),
        "embargo_times": f"WITH {samples} SELECT a.sample, a.t0, coalesce(b.t0, (SELECT max(t0) FROM sm)) AS embargo FROM sm a LEFT JOIN sm b ON b.pos = a.pos + CAST(floor(a.n * 0.01::DOUBLE) AS BIGINT)",
        "purge_train_times": f"WITH {samples}, la AS (SELECT t0, t1 FROM sm WHERE pos >= 2 * (n // 3) + n % 3), ru AS (SELECT t0, max(t1) OVER (ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS latest FROM la) SELECT sample, t0, t1 FROM (SELECT sm.*, (SELECT max(t1) FROM la WHERE la.t0 <= sm.t1) AS latest FROM sm) WHERE latest IS NULL OR latest < t0",
        "pca_moments": f"WITH {pairs} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(corr(a, b), 5) AS corr FROM pr GROUP BY i, j",
        "weighted_rank_tau": f"WITH c AS (SELECT round(avg(c_acctbal), 4) AS x, count(*)::DOUBLE AS y FROM customer GROUP BY c_nationkey), r AS (SELECT *, row_number() OVER (ORDER BY x DESC, y DESC) - 1 AS rx, row_number() OVER (ORDER BY y DESC, x DESC) - 1 AS ry FROM c) SELECT round(({taus[0]} + {taus[1]}) / 2, 6) AS tau FROM r a JOIN r b ON a.rx < b.rx",
        "vote_accuracy": f"WITH q AS (SELECT o_orderpriority, avg((o_orderstatus = 'F')::DOUBLE) AS p FROM orders GROUP BY 1) SELECT o_orderpriority, round(p, 6) AS p, round(1 - ({binomial}), 6) AS accuracy FROM q",
        "stream_time_bars_1h": time_bars(f"us // {hour} * {hour}"),
        "stream_value_bars_dollar": f"WITH {_whole(_T, 'dollar', dollar)} SELECT {_BAR} FROM b",
        "stream_bar_kinds": f"SELECT 'volume' AS kind, {_BAR} FROM (WITH {_whole(_T, 'qty', volume)} SELECT * FROM b) UNION ALL SELECT 'dollar', {_BAR} FROM (WITH {_whole(_T, 'dollar', dollar)} SELECT * FROM b)",
        "stream_cusum_events": f"WITH RECURSIVE {_S}, g AS MATERIALIZED (SELECT symbol, us, price, row_number() OVER (PARTITION BY symbol ORDER BY us) AS i, ln(price) AS x, 2.5::DOUBLE AS h FROM s), " + walk.format(up="(NOT d < -h) AND u > h", dn="d < -h", move="(g.x - k.x)") + " SELECT symbol, us, price, direction FROM k WHERE direction <> 0",
    }
    acts = lambda kind, at: f"(SELECT user_id, event_id AS {kind}, epoch_us(ts) AS {at}_us FROM events WHERE event_type = '{kind}')"
    out["asof_join_backward"] = f"SELECT a.user_id, purchase, a_us AS us, CASE WHEN a_us - b_us <= {7 * day} THEN b_us END AS viewed, CASE WHEN a_us - b_us <= {7 * day} THEN view END AS view FROM {acts('purchase', 'a')} a ASOF LEFT JOIN {acts('view', 'b')} b ON a.user_id = b.user_id AND a.a_us > b.b_us"
    out["asof_join_forward"] = f"SELECT a.user_id, view, a_us AS us, b_us AS purchased, purchase FROM {acts('view', 'a')} a ASOF LEFT JOIN {acts('purchase', 'b')} b ON a.user_id = b.user_id AND a.a_us <= b.b_us"
    loose = f"{plain}, lo AS MATERIALIZED (SELECT symbol, t0, p0, side, least(t0 + {span + 17_000_000}, sl, pt) AS t1 FROM tb)"
    out["labels_between_bars"] = f"WITH RECURSIVE {loose} SELECT lo.symbol, t0, t1, round((s.price / p0 - 1) * side, 9) AS ret, CAST(sign((s.price / p0 - 1) * side) AS INTEGER) AS bin FROM lo ASOF LEFT JOIN s ON s.symbol = lo.symbol AND lo.t1 <= s.us"
    out["uniqueness_between_bars"] = f"""WITH RECURSIVE {loose}, sp AS MATERIALIZED (SELECT symbol, t0 + 1000000 AS t0, t1 FROM lo WHERE t1 >= t0 + 1000000),
lr AS MATERIALIZED (SELECT symbol, us, ln(price / lag(price) OVER (PARTITION BY symbol ORDER BY us)) AS r FROM s),
cc AS MATERIALIZED (SELECT lr.symbol, lr.us, lr.r, count(*) AS c FROM lr JOIN sp ON sp.symbol = lr.symbol AND lr.us BETWEEN sp.t0 AND sp.t1 GROUP BY lr.symbol, lr.us, lr.r),
ag AS (SELECT sp.symbol, sp.t0, sp.t1, avg(1 / c) AS tw, abs(coalesce(sum(r / c), 0)) AS raw FROM sp JOIN cc ON cc.symbol = sp.symbol AND cc.us BETWEEN sp.t0 AND sp.t1 GROUP BY sp.symbol, sp.t0, sp.t1)
SELECT sp.symbol, sp.t0, sp.t1, round(tw, 6) AS tw, round(coalesce(raw, 0), 6) AS raw FROM sp LEFT JOIN ag ON ag.symbol = sp.symbol AND ag.t0 = sp.t0 AND ag.t1 = sp.t1"""
    out["raw_day_totals"] = f"WITH {_T} SELECT symbol, us // {day} AS day, sum(dollar)::DOUBLE AS dollar, sum(qty)::DOUBLE AS qty FROM t WHERE us // {day} BETWEEN 19728 AND 19737 GROUP BY symbol, us // {day}"
    out["stream_zip_adaptive_bars"] = out["adaptive_bars"].replace("epoch_us(ts) AS us", "epoch_us(ts) // 1000 * 1000 AS us")  # files have milliseconds
    return {**out, "stream_adaptive_bars": out["adaptive_bars"], "incremental_adaptive_bars": out["adaptive_bars"], "incremental_split_bars": out["value_bars_split_dollar"], "sql_split_bars": out["value_bars_split_dollar"], "raw_file_bars": RAW_BARS.format(hour=hour)}
