"""Registered queries over the driver tables and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import contracts, finance
from .operators import adaptive, averages, oscillators, recursive, structure, swings, volatility  # noqa: F401  they register themselves
from .operators.spec import OFF_TIE, OPERATORS, apply, build, rounded, to_sql
from .plans import align, crosssection, evaluate, legs, statistics
from .sources.bars import EVENT_BARS_SQL, ORDER_BARS_SQL, event_bars, order_bars, resample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_HOURLY = EVENT_BARS_SQL.format(unit="hour")


def _operator_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(apply(event_bars(spark, sf_dir), [build(name)]))

    return run


for _name in OPERATORS:
    _op = build(_name)
    QUERIES[_name] = _operator_query(_name)
    if _op.has_sql:
        SQL[_name] = to_sql(_op, _HOURLY)


def _query(name: str, sql: str | None):
    def mark(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return fn

    return mark


def _r(expression: str) -> str:
    """The SQL side of rounded()."""
    return f"round(({expression})::DOUBLE + {OFF_TIE!r}, 6) + 0.0"


_B = f"WITH bars AS ({_HOURLY})"
_PW = "OVER (PARTITION BY series ORDER BY ts)"
_COMMON = f"{_B}, times AS (SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT series) = (SELECT count(DISTINCT series) FROM bars)), al AS (SELECT bars.* FROM bars JOIN times USING (ts))"


@_query("bars_hourly", f"{_B} SELECT series, ts, {_r('open')} AS open, {_r('high')} AS high, {_r('low')} AS low, {_r('close')} AS close, {_r('volume')} AS volume FROM bars")
def _bars_hourly(spark, sf_dir):
    return event_bars(spark, sf_dir)


@_query("bars_orders", f"WITH bars AS ({ORDER_BARS_SQL}) SELECT series, ts, {_r('open')} AS open, {_r('high')} AS high, {_r('low')} AS low, {_r('close')} AS close, {_r('volume')} AS volume FROM bars")
def _bars_orders(spark, sf_dir):
    return order_bars(spark, sf_dir)


@_query("resample_4h", f"{_B} SELECT series, to_timestamp(floor(epoch(ts) / 14400) * 14400)::TIMESTAMP AS ts, {_r('arg_min(open, ts)')} AS open, {_r('max(high)')} AS high, {_r('min(low)')} AS low, {_r('arg_max(close, ts)')} AS close, {_r('sum(volume)')} AS volume, count(*) AS n_bars FROM bars GROUP BY 1, 2")
def _resample(spark, sf_dir):
    return resample(event_bars(spark, sf_dir), 4 * 3600)


_PAIRS = f"{_B}, p AS (SELECT a.series AS a, b.series AS b, a.ts, a.close AS ca, b.close AS cb FROM bars a JOIN bars b USING (ts) WHERE a.series < b.series)"
_LOGS = f"{_PAIRS}, r AS (SELECT a, b, ts, ln(ca / lag(ca) OVER o) AS ra, ln(cb / lag(cb) OVER o) AS rb FROM p WINDOW o AS (PARTITION BY a, b ORDER BY ts)), s AS (SELECT a, b, ts, count(ra) OVER f AS n, regr_slope(ra, rb) OVER f AS b0, avg(ra) OVER f AS ma, avg(rb) OVER f AS mb, corr(ra, rb) OVER f AS c0 FROM r WINDOW f AS (PARTITION BY a, b ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), t AS (SELECT a, b, ts, CASE WHEN n >= 30 THEN b0 END AS beta, CASE WHEN n >= 30 THEN ma - b0 * mb END AS alpha, CASE WHEN n >= 30 THEN c0 END AS corr FROM s)"


@_query("pair_regression", f"{_LOGS} SELECT a, b, ts, {_r('beta')} AS beta, {_r('alpha')} AS alpha, {_r('corr')} AS corr, {_r('corr * corr')} AS r2 FROM t")
def _pair_regression(spark, sf_dir):
    return align.pair_regression(align.series_pairs(event_bars(spark, sf_dir)))


def _window_lists(source: str, length: int) -> str:
    """The last `length` pairs as lists, so that the check sums deviations from the window's means one by one."""
    frame = f"OVER (PARTITION BY a, b ORDER BY ts ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"l AS (SELECT a, b, ts, list(x) {frame} AS xs, list(y) {frame} AS ys FROM {source}), "
        f"m AS (SELECT *, list_avg(xs) AS mx, list_avg(ys) AS my FROM l WHERE len(xs) = {length}), "
        "d AS (SELECT *, list_sum(list_transform(range(1, len(xs) + 1), lambda i: (xs[i] - mx) * (ys[i] - my))) AS sxy, list_sum(list_transform(xs, lambda v: (v - mx) * (v - mx))) AS sxx, list_sum(list_transform(ys, lambda v: (v - my) * (v - my))) AS syy FROM m)"
    )


@_query(
    "rolling_beta",
    f"{_PAIRS}, q AS (SELECT a, b, ts, ca / lag(ca) OVER o - 1 AS x, cb / lag(cb) OVER o - 1 AS y FROM p WINDOW o AS (PARTITION BY a, b ORDER BY ts)), z AS (SELECT * FROM q WHERE x IS NOT NULL), {_window_lists('z', 60)} "
    f"SELECT a, b, ts, {_r('sxy / syy')} AS beta, {_r('mx - sxy / syy * my')} AS alpha, {_r('greatest(-1, least(1, sxy / sqrt(sxx * syy)))')} AS correlation, {_r('sxy * sxy / (sxx * syy)')} AS r_squared FROM d WHERE syy > 1e-14",
)
def _rolling_beta(spark, sf_dir):
    return align.rolling_beta(align.series_pairs(event_bars(spark, sf_dir)))


@_query(
    "correlation",
    f"{_PAIRS}, q AS (SELECT a, b, ts, ca / lag(ca) OVER o - 1 AS x, cb / lag(cb) OVER o - 1 AS y FROM p WINDOW o AS (PARTITION BY a, b ORDER BY ts)), z AS (SELECT * FROM q WHERE x IS NOT NULL), {_window_lists('z', 20)} "
    f"SELECT a, b, ts, {_r('greatest(-1, least(1, sxy / sqrt(sxx * syy)))')} AS value FROM d WHERE syy > 1e-14",
)
def _pair_correlation(spark, sf_dir):
    """Rolling correlation of simple returns of each pair of series."""
    return align.rolling_beta(align.series_pairs(event_bars(spark, sf_dir)), 20).select("a", "b", "ts", F.col("correlation").alias("value"))


@_query(
    "pair_spread",
    f"{_PAIRS}, z AS (SELECT a, b, ts, ca AS x, cb AS y FROM p), {_window_lists('z', 60)}, h AS (SELECT *, sxy / syy AS g FROM d WHERE syy > 1e-14), "
    "e AS (SELECT *, list_transform(range(1, 61), lambda i: xs[i] - g * ys[i]) AS spreads FROM h), f AS (SELECT *, spreads[60] AS spread, list_avg(spreads) AS mean_spread, list_stddev_pop(spreads) AS std_spread FROM e) "
    f"SELECT a, b, ts, {_r('CASE WHEN std_spread > 1e-14 THEN (spread - mean_spread) / std_spread ELSE 0 END')} AS z, {_r('g')} AS hedge_ratio, {_r('spread')} AS spread, {_r('mean_spread')} AS mean_spread, {_r('std_spread')} AS std_spread FROM f",
)
def _pair_spread(spark, sf_dir):
    return align.pair_spread(align.series_pairs(event_bars(spark, sf_dir)))


@_query("as_of_join", f"WITH bars AS ({_HOURLY}), e AS (SELECT event_type AS series, ts, event_id FROM events) SELECT e.event_id, e.series, e.ts, {_r('b.close')} AS close FROM e ASOF LEFT JOIN bars b ON e.series = b.series AND e.ts >= b.ts")
def _as_of(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("event_type").alias("series"), "ts")
    return align.as_of(events, event_bars(spark, sf_dir), "close")


@_query("correlation_matrix", f"{_COMMON}, r AS (SELECT series, ts, close / lag(close) {_PW} - 1 AS ret FROM al) SELECT a.series AS a, b.series AS b, {_r('corr(a.ret, b.ret)')} AS corr, count(*) AS n FROM r a JOIN r b USING (ts) WHERE a.series < b.series AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2")
def _correlation(spark, sf_dir):
    return align.correlation_matrix(event_bars(spark, sf_dir))


@_query("relative_strength", f"{_COMMON}, r AS (SELECT series, ts, close / lag(close, 20) {_PW} - 1 AS ret FROM al), q AS (SELECT * FROM r WHERE ret IS NOT NULL) SELECT series, ts, {_r('ret')} AS ret, rank() OVER (PARTITION BY ts ORDER BY ret DESC) AS place, {_r('percent_rank() OVER (PARTITION BY ts ORDER BY ret)')} AS share FROM q")
def _strength(spark, sf_dir):
    return crosssection.relative_strength(event_bars(spark, sf_dir))


@_query("market_breadth", f"{_B}, m AS (SELECT series, ts, close, avg(close) OVER (PARTITION BY series ORDER BY ts ROWS 19 PRECEDING) AS mean, lag(close) {_PW} AS pc, row_number() {_PW} AS i FROM bars), g AS (SELECT ts, count(*) AS members, sum((close > mean)::INT)::BIGINT AS above, sum((close > pc)::INT)::BIGINT AS advancing, sum((close < pc)::INT)::BIGINT AS declining FROM m WHERE i >= 20 GROUP BY ts) SELECT *, {_r('above / members')} AS share_above FROM g")
def _breadth(spark, sf_dir):
    return crosssection.market_breadth(event_bars(spark, sf_dir))


@_query("drawdown", f"{_B}, d AS (SELECT series, close, max(close) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM bars), e AS (SELECT series, (peak - close) / peak AS dd FROM d) SELECT series, {_r('max(dd)')} AS max_drawdown, {_r('avg(dd)')} AS mean_drawdown, sum((dd > 0)::INT)::BIGINT AS bars_under_water FROM e GROUP BY 1")
def _drawdown(spark, sf_dir):
    return crosssection.drawdown(event_bars(spark, sf_dir))


_SCALE = repr(252.0**0.5)


@_query("return_metrics", f"{_B}, r AS (SELECT series, ln(close / lag(close) {_PW}) AS r FROM bars), m AS (SELECT series, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS dev, sqrt(avg(least(r, 0) * least(r, 0))) AS down FROM r WHERE r IS NOT NULL GROUP BY 1) SELECT series, n, {_r('mean')} AS mean, {_r('dev')} AS dev, {_r('CASE WHEN dev <= 1e-12 THEN 0 ELSE mean / dev * ' + _SCALE + ' END')} AS sharpe, {_r('CASE WHEN down <= 1e-12 THEN 0 ELSE mean / down * ' + _SCALE + ' END')} AS sortino FROM m")
def _returns(spark, sf_dir):
    return crosssection.return_metrics(event_bars(spark, sf_dir))


@_query("value_at_risk", f"{_B}, r AS (SELECT series, close / lag(close) {_PW} - 1 AS r FROM bars), k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY r) AS k, count(*) OVER (PARTITION BY series) AS n FROM r WHERE r IS NOT NULL) SELECT series, {_r('greatest(0, -max(r))')} AS var, {_r('avg(greatest(0, -r))')} AS es, count(*) AS tail FROM k WHERE k <= greatest(1, least(n, ceil({1 - 0.95!r}::DOUBLE * n))) GROUP BY 1")
def _var(spark, sf_dir):
    return crosssection.value_at_risk(event_bars(spark, sf_dir))


@_query("seasonality_monthly", f"WITH bars AS ({ORDER_BARS_SQL}), r AS (SELECT series, month(ts)::INT AS month, close / lag(close) {_PW} - 1 AS r FROM bars) SELECT series, month, {_r('avg(r)')} AS mean, {_r('stddev_samp(r)')} AS dev, {_r('avg((r > 0)::INT)')} AS share_up, count(*) AS n FROM r WHERE r IS NOT NULL GROUP BY 1, 2")
def _season(spark, sf_dir):
    return crosssection.seasonality(order_bars(spark, sf_dir), F.month("ts"), "month")


@_query("price_stats", f"{_B} SELECT series, count(close) AS n, {_r('avg(close)')} AS mean, {_r('stddev_samp(close)')} AS dev, {_r('min(close)')} AS low, {_r('max(close)')} AS high, {_r('quantile_cont(close, 0.25)')} AS q1, {_r('quantile_cont(close, 0.5)')} AS median, {_r('quantile_cont(close, 0.75)')} AS q3 FROM bars GROUP BY 1")
def _stats(spark, sf_dir):
    return crosssection.price_stats(event_bars(spark, sf_dir))


@_query("longest_run", f"{_B}, u AS (SELECT series, ts, coalesce(close > lag(close) {_PW}, false) AS up FROM bars), g AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) {_PW} AS island FROM u), n AS (SELECT series, island, count(*) FILTER (WHERE up) AS n FROM g GROUP BY 1, 2) SELECT series, max(n)::BIGINT AS longest FROM n GROUP BY 1")
def _run(spark, sf_dir):
    return crosssection.longest_run(event_bars(spark, sf_dir))


_AHEAD = "OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
_A10 = _AHEAD.format(n=10)
_FWD = f"fwd AS (SELECT series, ts, CASE WHEN count(*) {_A10} = 10 THEN lead(close, 10) {_PW} / close - 1 END AS ret, CASE WHEN count(*) {_A10} = 10 THEN max(high) {_A10} / close - 1 END AS best, CASE WHEN count(*) {_A10} = 10 THEN min(low) {_A10} / close - 1 END AS worst FROM bars)"


@_query("forward_move", f"{_B}, {_FWD} SELECT series, ts, {_r('ret')} AS ret, {_r('best')} AS best, {_r('worst')} AS worst FROM fwd")
def _forward(spark, sf_dir):
    return evaluate.forward_move(event_bars(spark, sf_dir), 10)


_PASS = f"n AS (SELECT *, row_number() {_PW} AS i FROM bars), hit AS (SELECT a.series, a.i, min(b.i) AS at FROM n a JOIN n b ON a.series = b.series AND b.i BETWEEN a.i + 1 AND a.i + 10 WHERE b.high >= a.close * 1.5 OR b.low <= a.close * 0.5 GROUP BY 1, 2), pass AS (SELECT a.series, a.ts, CASE WHEN h.at IS NULL THEN 'none' WHEN b.low <= a.close * 0.5 THEN 'lower' ELSE 'upper' END AS side, (h.at - a.i)::BIGINT AS bars FROM n a LEFT JOIN hit h USING (series, i) LEFT JOIN n b ON b.series = a.series AND b.i = h.at)"


@_query("first_passage", f"{_B}, {_PASS} SELECT * FROM pass")
def _passage(spark, sf_dir):
    return evaluate.first_passage(event_bars(spark, sf_dir))


_Z2 = repr(1.96 * 1.96)


@_query(
    "passage_summary",
    f"{_B}, {_PASS}, g AS (SELECT series, count(*) AS n, sum((side = 'upper')::INT)::BIGINT AS upper, sum((side = 'lower')::INT)::BIGINT AS lower, avg(bars) AS mean_bars FROM pass GROUP BY 1), h AS (SELECT *, upper / n AS p FROM g) "
    f"SELECT series, n, upper, lower, {_r('mean_bars')} AS mean_bars, {_r('p')} AS share, {_r(f'((p + {_Z2} / (2 * n)) - 1.96 * sqrt(p * (1 - p) / n + {_Z2} / (4 * n * n))) / (1 + {_Z2} / n)')} AS share_low, {_r(f'((p + {_Z2} / (2 * n)) + 1.96 * sqrt(p * (1 - p) / n + {_Z2} / (4 * n * n))) / (1 + {_Z2} / n)')} AS share_high FROM h",
)
def _summary(spark, sf_dir):
    return evaluate.passage_summary(evaluate.first_passage(event_bars(spark, sf_dir)))


@_query(
    "signal_outcomes",
    f"{_B}, {_FWD}, m AS (SELECT series, ts, avg(close) OVER (PARTITION BY series ORDER BY ts ROWS 4 PRECEDING) - avg(close) OVER (PARTITION BY series ORDER BY ts ROWS 19 PRECEDING) AS gap, row_number() {_PW} AS i FROM bars), c AS (SELECT *, lag(gap) {_PW} AS before FROM m), s AS (SELECT series, ts, CASE WHEN before <= 0 AND gap > 0 THEN 1 WHEN before >= 0 AND gap < 0 THEN -1 END AS direction FROM c WHERE i > 20) "
    f"SELECT series, direction, count(*) AS n, {_r('avg((ret * direction > 0)::INT)')} AS hit_rate, {_r('avg(ret * direction)')} AS mean FROM s JOIN fwd USING (series, ts) WHERE direction IS NOT NULL AND ret IS NOT NULL GROUP BY 1, 2",
)
def _outcomes(spark, sf_dir):
    return evaluate.signal_outcomes(event_bars(spark, sf_dir))


@_query(
    "calibration",
    f"{_B}, s AS (SELECT (close - min(low) OVER f) / (max(high) OVER f - min(low) OVER f) AS p, row_number() OVER (PARTITION BY series ORDER BY ts) AS i, lead(close, 5) OVER (PARTITION BY series ORDER BY ts) > close AS rose FROM bars WINDOW f AS (PARTITION BY series ORDER BY ts ROWS 19 PRECEDING)) "
    f"SELECT least(floor(p * 5), 4)::INT AS bucket, count(*) AS n, {_r('avg(p)')} AS forecast, {_r('avg(rose::INT)')} AS rate, {_r('avg((p - rose::INT) * (p - rose::INT))')} AS brier FROM s WHERE i >= 20 AND rose IS NOT NULL GROUP BY 1",
)
def _calibration(spark, sf_dir):
    return evaluate.calibration(event_bars(spark, sf_dir))


@_query("phase_survival", None)
def _survival(spark, sf_dir):
    return evaluate.phase_survival(event_bars(spark, sf_dir))


@_query("forward_fill", None)
def _fill(spark, sf_dir):
    return align.forward_fill(event_bars(spark, sf_dir), 3600, 3)


@_query(
    "bond_values",
    "WITH b AS (SELECT p_partkey, 100.0::DOUBLE AS face, 0.01 + p_size / 1000 AS coupon, 0.02 + (p_partkey % 50) / 1000 AS y, 1 + p_size % 30 AS years FROM part), c AS (SELECT *, years * 2 AS n, face * coupon / 2 AS c, y / 2 AS h FROM b) "
    f"SELECT p_partkey, {_r('c * (1 - pow(1 + h, -n)) / h + face * pow(1 + h, -n)')} AS price, {_r('((1 + h) / h - (1 + h + n * (coupon / 2 - h)) / (coupon / 2 * (pow(1 + h, n) - 1) + h)) / 2')} AS duration FROM c",
)
def _bonds(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    face, coupon, y, years = F.lit(100.0), 0.01 + F.col("p_size") / 1000, 0.02 + (F.col("p_partkey") % 50) / 1000, 1 + F.col("p_size") % 30
    return part.select("p_partkey", finance.bond_price(face, coupon, y, years).alias("price"), finance.bond_duration(face, coupon, y, years).alias("duration"))


_TWENTY = f"{_B}, v AS (SELECT series, ts, list(close) OVER (PARTITION BY series ORDER BY ts ROWS 19 PRECEDING) AS xs FROM bars), f AS (SELECT * FROM v WHERE len(xs) = 20)"


@_query("rolling_quantiles", f"{_TWENTY} SELECT series, ts, {_r('list_aggregate(xs, $$quantile_cont$$, 0.25)')} AS lower, {_r('list_aggregate(xs, $$quantile_cont$$, 0.5)')} AS median, {_r('list_aggregate(xs, $$quantile_cont$$, 0.75)')} AS upper FROM f")
def _quantiles(spark, sf_dir):
    return statistics.rolling_quantiles(event_bars(spark, sf_dir))


@_query(
    "robust_band",
    f"{_TWENTY}, m AS (SELECT *, list_aggregate(xs, $$median$$) AS med FROM f), d AS (SELECT *, 1.4826::DOUBLE * list_aggregate(list_transform(xs, lambda x: abs(x - med)), $$median$$) AS dev FROM m) SELECT series, ts, {_r('med')} AS median, {_r('dev')} AS mad, {_r('med + 3 * dev')} AS upper, {_r('med - 3 * dev')} AS lower FROM d",
)
def _robust(spark, sf_dir):
    return statistics.robust_band(event_bars(spark, sf_dir))


@_query("nearest_rank", f"{_B}, l AS (SELECT series, list_sort(list(close)) AS xs FROM bars GROUP BY series) SELECT series, {_r('xs[round((len(xs) - 1) * 0.9)::INT + 1]')} AS value FROM l")
def _nearest(spark, sf_dir):
    return statistics.nearest_rank(event_bars(spark, sf_dir))


_RETURNS = f"{_B}, x AS (SELECT series, ts, close / lag(close) {_PW} - 1 AS x FROM bars), y AS (SELECT series, ts::DATE AS day, x, avg(x) OVER (PARTITION BY series) AS m, count(x) OVER (PARTITION BY series) AS n FROM x WHERE x IS NOT NULL)"


@_query(
    "block_mean",
    f"{_RETURNS}, g AS (SELECT series, day, any_value(m) AS m, any_value(n) AS n, sum(x - m) AS off FROM y GROUP BY series, day) SELECT series, {_r('any_value(m)')} AS mean, {_r('sqrt(sum(off * off)) / any_value(n) * sqrt(count(*) / (count(*) - 1))')} AS std_error, count(*) AS blocks FROM g GROUP BY series",
)
def _block_mean(spark, sf_dir):
    return statistics.block_mean(statistics.simple_returns(event_bars(spark, sf_dir)))


@_query(
    "block_difference",
    f"{_RETURNS}, g AS (SELECT series, day, any_value(m) AS m, sum(x - m) / any_value(n) AS off FROM y GROUP BY series, day), days AS (SELECT DISTINCT day FROM g), q AS (SELECT DISTINCT a.series AS a, b.series AS b, a.m - b.m AS difference FROM g a JOIN g b ON a.series < b.series), "
    f"j AS (SELECT q.*, coalesce(u.off, 0) - coalesce(v.off, 0) AS s FROM q CROSS JOIN days LEFT JOIN g u ON u.series = q.a AND u.day = days.day LEFT JOIN g v ON v.series = q.b AND v.day = days.day WHERE u.off IS NOT NULL OR v.off IS NOT NULL) SELECT a, b, {_r('any_value(difference)')} AS difference, {_r('sqrt(sum(s * s) * count(*) / (count(*) - 1))')} AS std_error FROM j GROUP BY a, b",
)
def _block_difference(spark, sf_dir):
    return statistics.block_difference(statistics.simple_returns(event_bars(spark, sf_dir)))


@_query("deflated_sharpe", None)
def _deflated(spark, sf_dir):
    return statistics.deflated_sharpe(statistics.simple_returns(event_bars(spark, sf_dir)))


def _trades(spark, sf_dir):
    """Crossing signals held for ten bars: series, ts, direction, r."""
    bars = event_bars(spark, sf_dir)
    joined = evaluate.cross_signals(bars).select("series", "ts", "direction").join(evaluate.forward_move(bars, 10), ["series", "ts"]).filter("ret is not null")
    return joined.select("series", "ts", "direction", (F.col("ret") * F.col("direction")).alias("r"))


_TRADES = f"{_B}, {_FWD}, m AS (SELECT series, ts, avg(close) OVER (PARTITION BY series ORDER BY ts ROWS 4 PRECEDING) - avg(close) OVER (PARTITION BY series ORDER BY ts ROWS 19 PRECEDING) AS gap, row_number() {_PW} AS i FROM bars), c AS (SELECT *, lag(gap) {_PW} AS before FROM m), s AS (SELECT series, ts, CASE WHEN before <= 0 AND gap > 0 THEN 1 WHEN before >= 0 AND gap < 0 THEN -1 END AS direction FROM c WHERE i > 20), tr AS (SELECT series, ts, direction, ret * direction AS r FROM s JOIN fwd USING (series, ts) WHERE direction IS NOT NULL AND ret IS NOT NULL)"


def _trade_sql(by: str) -> str:
    path = f"e AS (SELECT *, sum(r) OVER (PARTITION BY {by} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM tr), k AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY {by} ORDER BY ts ROWS UNBOUNDED PRECEDING)) - equity AS fall FROM e)"
    return f"{_TRADES}, {path} SELECT {by}, count(*) AS n, {_r('count(*) FILTER (r > 0) / count(*)')} AS win_rate, {_r('sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0)')} AS profit_factor, {_r('avg(r)')} AS expectancy, {_r('max(fall)')} AS max_drawdown FROM k GROUP BY {by}"


@_query("trade_stats", _trade_sql("series"))
def _trade_stats(spark, sf_dir):
    return statistics.trade_stats(_trades(spark, sf_dir), "series")


@_query("trade_cohorts", _trade_sql("series, direction"))
def _trade_cohorts(spark, sf_dir):
    return statistics.trade_stats(_trades(spark, sf_dir), "series", "direction")


@_query("outcome_stats", f"{_B}, {_FWD} SELECT series, count(*) AS closed, count(*) FILTER (ret > 0) AS wins, {_r('count(*) FILTER (ret > 0) / count(*)')} AS win_rate, {_r('avg(ret)')} AS mean, {_r('sum(ret)')} AS total FROM fwd GROUP BY series")
def _outcome_stats(spark, sf_dir):
    return statistics.outcome_stats(evaluate.forward_move(event_bars(spark, sf_dir), 10).select("series", F.col("ret").alias("x")), "series")


@_query(
    "band_coverage",
    f"{_B}, v AS (SELECT series, list(close) OVER o AS xs, lead(close) OVER (PARTITION BY series ORDER BY ts) AS after FROM bars WINDOW o AS (PARTITION BY series ORDER BY ts ROWS 19 PRECEDING)) SELECT series, count(*) AS n, {_r('avg((after BETWEEN list_aggregate(xs, $$quantile_cont$$, 0.1) AND list_aggregate(xs, $$quantile_cont$$, 0.9))::INT)')} AS share FROM v WHERE len(xs) = 20 AND after IS NOT NULL GROUP BY series",
)
def _coverage(spark, sf_dir):
    return statistics.band_coverage(event_bars(spark, sf_dir))


@_query("round_levels", f"{_B}, l AS (SELECT series, floor(arg_max(close, ts) / 10) * 10 AS base FROM bars GROUP BY series) SELECT series, {_r('base + 10 * unnest(range(-3, 5))')} AS level FROM l")
def _round_levels(spark, sf_dir):
    return statistics.round_levels(statistics.last_bars(event_bars(spark, sf_dir)))


@_query(
    "fibonacci_levels",
    f"{_B}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS k FROM bars), t AS (SELECT series, max(high) AS top, min(low) AS bottom FROM k WHERE k <= 50 GROUP BY series), a AS (SELECT t.*, (SELECT max(k) FROM k WHERE k.series = t.series AND k <= 50 AND high = top) AS ta, (SELECT min(k) FROM k WHERE k.series = t.series AND k <= 50 AND low = bottom) AS ba FROM t), e AS (SELECT *, unnest([0.236, 0.382, 0.5, 0.618, 0.786, 1.0, 1.272, 1.618]::DOUBLE[]) AS ratio FROM a) "
    f"SELECT series, {_r('ratio')} AS ratio, {_r('CASE WHEN ta < ba THEN top - (top - bottom) * ratio ELSE bottom + (top - bottom) * ratio END')} AS level FROM e",
)
def _fibonacci(spark, sf_dir):
    return statistics.fibonacci_levels(event_bars(spark, sf_dir))


@_query(
    "purged_split",
    f"{_TRADES}, n AS (SELECT series, ts, row_number() {_PW} - 1 AS first FROM bars), sp AS (SELECT series, ts, first, first + 10 AS last FROM tr JOIN n USING (series, ts)) SELECT series, ts, first, last, CASE WHEN first >= 400 THEN 'test' WHEN last >= 400 THEN 'purged' ELSE 'train' END AS part FROM sp WHERE first < 395 OR first BETWEEN 400 AND 599",
)
def _split(spark, sf_dir):
    place = event_bars(spark, sf_dir).select("series", "ts", (F.row_number().over(evaluate._ordered()) - 1).cast("long").alias("first"))
    spans = _trades(spark, sf_dir).join(place, ["series", "ts"]).select("series", "ts", "first", (F.col("first") + 10).alias("last"))
    return statistics.purged_split(spans, (0, 395), (400, 600), embargo=5)


@_query(
    "exposure",
    f"{_B}, r AS (SELECT *, ln(close / lag(close) {_PW}) AS r, greatest(high, lag(close) {_PW}) - least(low, lag(close) {_PW}) AS tr FROM bars), v AS (SELECT *, stddev_samp(r) OVER f AS vol, avg(tr) OVER f AS atr, lag(close, 10) OVER (PARTITION BY series ORDER BY ts) AS entry, row_number() OVER (PARTITION BY series ORDER BY ts) AS i FROM r WINDOW f AS (PARTITION BY series ORDER BY ts ROWS 19 PRECEDING)) "
    f"SELECT series, ts, {_r('CASE WHEN vol > 0 THEN least(0.2::DOUBLE / vol, 3) ELSE 1 END')} AS scale, {_r('CASE WHEN atr > 0 THEN abs(close - entry) / atr END')} AS distance, {_r('(close - entry - 5) / (entry + 0.5 * 5)')} AS period_return FROM v WHERE i > 20",
)
def _exposure(spark, sf_dir):
    """Exposure by volatility, distance from the close of ten bars before in true ranges, and a return with a cash flow of 5."""
    o, last = evaluate._ordered(), evaluate._ordered().rowsBetween(-19, 0)
    before = F.lag("close").over(o)
    r = event_bars(spark, sf_dir).withColumns({"r": F.log(F.col("close") / before), "tr": F.when(before.isNotNull(), F.greatest("high", before) - F.least("low", before)).otherwise(F.col("high") - F.col("low"))})
    v = r.withColumns({"vol": F.stddev_samp("r").over(last), "atr": F.avg("tr").over(last), "entry": F.lag("close", 10).over(o), "i": F.row_number().over(o)}).filter("i > 20")
    return v.select("series", "ts", finance.volatility_scale(F.col("vol"), 0.2, 3.0).alias("scale"), finance.range_distance(F.col("entry"), F.col("close"), F.col("atr")).alias("distance"), finance.period_return(F.col("entry"), F.col("close"), F.lit(5.0), 0.5).alias("period_return"))


@_query("option_values", None)
def _options(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_retailprice")
    call, put = finance.option_value(F.col("p_retailprice"), F.col("p_retailprice") * (0.8 + F.col("p_size") / 125), 0.03, 0.03, 0.1 + F.col("p_size") / 200, F.lit(0.5))
    return part.select("p_partkey", call.alias("call"), put.alias("put"))


@_query("trend_bundle", None)
def _bundle(spark, sf_dir):
    """Several operators over the same bars in one plan: shared exchange and sort, one grouped call for each fold stage."""
    return apply(event_bars(spark, sf_dir), [build(n) for n in ("sma", "bollinger", "macd", "rsi", "adx", "supertrend")])


_YF = {
    "act/360": "date_diff('day', {a}, {b}) / 360.0::DOUBLE",
    "act/365": "date_diff('day', {a}, {b}) / 365.0::DOUBLE",
    "30/360": "((year({b}) - year({a})) * 360 + (month({b}) - month({a})) * 30 + CASE WHEN day({b}) = 31 AND day({a}) >= 30 THEN 30 ELSE day({b}) END - least(day({a}), 30)) / 360.0::DOUBLE",
    "act/act": "list_sum(list_transform(range(year({a}), year({b}) + 1), lambda y: date_diff('day', greatest({a}, make_date(y, 1, 1)), least({b}, make_date(y + 1, 1, 1))) / date_diff('day', make_date(y, 1, 1), make_date(y + 1, 1, 1))))",
}


def _yf(a: str, b: str, convention: str) -> str:
    return _YF[convention].format(a=a, b=b)


@_query(
    "year_fractions",
    f"WITH d AS (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS a, l_shipdate::DATE + (l_partkey % 1500)::INT AS b FROM lineitem) SELECT l_orderkey, l_linenumber, {', '.join(f'{_r(_yf('a', 'b', c))} AS {n}' for c, n in zip(finance.DAY_COUNTS, ('act360', 'act365', 'thirty', 'actual'), strict=True))}, {_r('-(' + _yf('a', 'b', 'act/act') + ')')} AS turned FROM d",
)
def _year_fractions(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("a"), F.date_add(F.to_date("l_shipdate"), (F.col("l_partkey") % 1500).cast("int")).alias("b"))
    figures = [finance.year_fraction(a, b, c).alias(n) for c, n in zip(finance.DAY_COUNTS, ("act360", "act365", "thirty", "actual"), strict=True)]
    return d.select("l_orderkey", "l_linenumber", *figures, (finance.year_fraction(b, a, "act/act") + 0.0).alias("turned"))


@_query(
    "discount_factors",
    f"WITH p AS (SELECT p_partkey, -0.02 + p_size / 500 AS r, p_size / 4 AS t FROM part) SELECT p_partkey, {_r('exp(-r * t)')} AS continuous, {_r('pow(1 + r, -t)')} AS annual, {_r('pow(1 + r / 4, -4 * t)')} AS quarterly FROM p",
)
def _discounts(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    r, t = -0.02 + F.col("p_size") / 500, F.col("p_size") / 4
    return part.select("p_partkey", finance.discount_factor(r, t).alias("continuous"), finance.discount_factor(r, t, 1).alias("annual"), finance.discount_factor(r, t, 4).alias("quarterly"))


_NODES = [(0.5, 0.02), (1.0, 0.022), (2.0, 0.021), (5.0, 0.028), (10.0, 0.03)]
_NODE_SQL = "nodes AS (SELECT t AS t0, r AS r0, lead(t) OVER (ORDER BY t) AS t1, lead(r) OVER (ORDER BY t) AS r1 FROM (VALUES (0::DOUBLE, 0.02::DOUBLE), (0.5, 0.02), (1.0, 0.022), (2.0, 0.021), (5.0, 0.028), (10.0, 0.03), (100.0, 0.03)) v(t, r))"
_ZERO = "(SELECT r0 + ({t} - t0) / (t1 - t0) * (r1 - r0) FROM nodes WHERE t0 <= {t} AND {t} < t1)"


@_query(
    "yield_curve",
    f"WITH {_NODE_SQL}, p AS (SELECT p_partkey, (p_size / 4)::DOUBLE AS t FROM part), z AS (SELECT p_partkey, t, {_ZERO.format(t='p.t')} AS z, {_ZERO.format(t='(p.t + 1)')} AS z2 FROM p) SELECT p_partkey, {_r('z')} AS zero, {_r('exp(-z * t)')} AS factor, {_r('z2 * (t + 1) - z * t')} AS forward FROM z",
)
def _curve(spark, sf_dir):
    t = F.col("p_size") / 4
    zero = finance.zero_rate(t, _NODES)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", zero.alias("zero"), finance.discount_factor(zero, t).alias("factor"), finance.forward_rate(t, t + 1, _NODES).alias("forward"))


_OPEN = "dayofweek({d}) NOT IN (0, 6) AND {d} <> DATE '2022-03-31'"


def _rolled(day: str, sign: str) -> str:
    days = f"list_transform(range(0, 14), lambda k: ({day} {sign} k::INT)::DATE)"
    return f"list_filter({days}, lambda x: {_OPEN.format(d='x')})[1]"


def _modified(day: str) -> str:
    return f"CASE WHEN month({_rolled(day, '+')}) = month({day}) THEN {_rolled(day, '+')} ELSE {_rolled(day, '-')} END"


def _holidays():
    return F.array(F.lit("2022-03-31").cast("date"))


@_query("business_days", f"WITH d AS (SELECT p_partkey, DATE '2022-03-01' + (p_partkey % 365)::INT AS d FROM part) SELECT p_partkey, {_OPEN.format(d='d')} AS open, {_rolled('d', '+')} AS following, {_rolled('d', '-')} AS preceding, {_modified('d')} AS modified FROM d")
def _business(spark, sf_dir):
    d = F.date_add(F.lit("2022-03-01").cast("date"), (F.col("p_partkey") % 365).cast("int"))
    moves = [finance.adjust_day(d, c, _holidays()).alias(n) for c, n in (("following", "following"), ("preceding", "preceding"), ("modified_following", "modified"))]
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", finance.is_business_day(d, _holidays()).alias("open"), *moves)


def _bonds_of_parts(spark, sf_dir):
    """Bonds with odd first periods and month ends: p_partkey, issue, maturity, settlement, coupon, y.

    The table is narrow and the work on a row long, so rows are dealt over all cores however few row groups the file has.
    """
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    issue = F.date_add(F.lit("2019-03-31").cast("date"), (F.col("p_partkey") % 97).cast("int"))
    maturity = F.date_add(F.add_months(issue, 30 + F.col("p_size") % 40), (F.col("p_partkey") % 5).cast("int"))
    settlement = F.date_add(F.lit("2021-01-10").cast("date"), (F.col("p_partkey") % 200).cast("int"))
    return part.select("p_partkey", issue.alias("issue"), maturity.alias("maturity"), settlement.alias("settlement"), (0.01 + F.col("p_size") / 1000).alias("coupon"), (-0.01 + (F.col("p_partkey") % 70) / 1000).alias("y"))


_BONDS = (
    "WITH i AS (SELECT p_partkey, p_size, p_partkey AS k, DATE '2019-03-31' + (p_partkey % 97)::INT AS issue FROM part), b AS (SELECT p_partkey, issue, (issue + to_months(30 + p_size % 40))::DATE + (k % 5)::INT AS maturity, DATE '2021-01-10' + (k % 200)::INT AS settlement, 0.01 + p_size / 1000 AS coupon, -0.01 + (k % 70) / 1000 AS y FROM i), "
    "s AS (SELECT b.*, (maturity - to_months(6 * unnest(range(0, 20))::INT))::DATE AS raw FROM b), m AS (SELECT * EXCLUDE (raw), CASE WHEN last_day(maturity) = maturity THEN last_day(raw) ELSE raw END AS d FROM s), "
    "q AS (SELECT * FROM m WHERE d > issue UNION ALL SELECT *, issue AS d FROM b), "
)


@_query("coupon_schedule", f"{_BONDS} n AS (SELECT p_partkey, d, row_number() OVER (PARTITION BY p_partkey ORDER BY d) - 1 AS period FROM q) SELECT p_partkey, period, d AS boundary, {_modified('d')} AS payment FROM n")
def _schedule(spark, sf_dir):
    b = _bonds_of_parts(spark, sf_dir)
    rows = b.select("p_partkey", F.posexplode(finance.accrual_dates(F.col("issue"), F.col("maturity"), 2)).alias("period", "boundary"))
    return rows.select("p_partkey", F.col("period").cast("long").alias("period"), "boundary", finance.adjust_day(F.col("boundary"), "modified_following", _holidays()).alias("payment"))


def _valued_bonds(spark, sf_dir):
    """Those bonds with their flows, accrued interest and values at the yield y."""
    c = F.col
    b = _bonds_of_parts(spark, sf_dir).withColumn("accrual", finance.accrual_dates(c("issue"), c("maturity"), 2))
    b = b.withColumns({"flows": finance.bond_flows(c("accrual"), c("settlement"), F.lit(100.0), c("coupon"), "act/act", "modified_following", _holidays()), "accrued": finance.accrued_interest(c("accrual"), c("settlement"), F.lit(100.0), c("coupon"), "act/act")})
    return b.withColumn("v", finance.bond_values(c("flows"), c("accrued"), c("y"), 2))


@_query(
    "fixed_rate_bond",
    f"{_BONDS} n AS (SELECT *, lag(d) OVER (PARTITION BY p_partkey ORDER BY d) AS a FROM q), f AS (SELECT *, 100 * coupon * {_yf('a', 'd', 'act/act')} + CASE WHEN d = maturity THEN 100 ELSE 0 END AS amount, {_modified('d')} AS paid, CASE WHEN a <= settlement AND settlement < d THEN 100 * coupon * {_yf('a', 'settlement', 'act/act')} ELSE 0 END AS acc FROM n WHERE a IS NOT NULL), "
    f"t AS (SELECT *, CASE WHEN paid > settlement THEN {_yf('settlement', 'paid', 'act/act')} END AS tau FROM f), w AS (SELECT *, CASE WHEN tau IS NULL THEN 0 ELSE amount / pow(1 + y / 2, 2 * tau) END AS pv FROM t), "
    f"g AS (SELECT p_partkey, any_value(y) AS y, sum(pv) AS dirty, sum(tau * pv) AS weighted, sum(acc) AS accrued FROM w GROUP BY 1) SELECT p_partkey, {_r('dirty')} AS dirty, {_r('dirty - accrued')} AS clean, {_r('accrued')} AS accrued, {_r('weighted / dirty')} AS macaulay, {_r('weighted / dirty / (1 + y / 2)')} AS modified, {_r('weighted / (1 + y / 2) * 0.0001')} AS dv01 FROM g",
)
def _bond(spark, sf_dir):
    return _valued_bonds(spark, sf_dir).select("p_partkey", "v.dirty", "v.clean", "accrued", "v.macaulay", "v.modified", "v.dv01")


@_query("yield_to_maturity", f"SELECT p_partkey, {_r('-0.01 + (p_partkey % 70) / 1000')} AS ytm FROM part")
def _ytm(spark, sf_dir):
    """Yields found from the clean prices at known yields."""
    c = F.col
    return _valued_bonds(spark, sf_dir).select("p_partkey", finance.yield_to_maturity(c("flows"), c("accrued"), c("v.clean"), c("coupon"), 2).alias("ytm"))


def _normal(x: str) -> str:
    """The normal distribution by Simpson's rule from 0, for the check only."""
    return f"(0.5 + ({x}) / 2400 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 801), lambda j: CASE WHEN j IN (0, 800) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(({x}) * j / 800, 2) / 2))))"


def _option_inputs(spark, sf_dir):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", price.alias("s"), (price * (0.8 + size / 125)).alias("k"), (0.1 + size / 50).alias("t"), F.lit(0.03).alias("r"), F.lit(0.01).alias("q"), (0.1 + (F.col("p_partkey") % 40) / 100).alias("v"))


def _greeks_sql(call: bool, dividend: str, rho: str) -> str:
    """Greeks of calls, or of puts by parity."""
    turn = lambda of_call, less: of_call if call else f"{of_call} - ({less})"
    price = turn("s * dq * n1 - k * dr * n2", "s * dq - k * dr")
    theta = turn("-s * dq * dens * v / (2 * sqrt(t)) - r * k * dr * n2 + q * s * dq * n1", "q * s * dq - r * k * dr")
    shown = {"price": price, "delta": turn("dq * n1", "dq"), "gamma": "dq * dens / (s * v * sqrt(t))", "vega": "s * dq * sqrt(t) * dens", "theta": theta, "theta_daily": f"({theta}) / 365", "rho": rho.format(price=price), "time_value": f"greatest(({price}) - greatest({'s - k' if call else 'k - s'}, 0), 0)"}
    return (
        f"WITH o AS (SELECT p_partkey, p_retailprice AS s, p_retailprice * (0.8 + p_size / 125) AS k, 0.1 + p_size / 50 AS t, 0.03::DOUBLE AS r, {dividend}::DOUBLE AS q, 0.1 + (p_partkey % 40) / 100 AS v FROM part), d AS (SELECT *, (ln(s / k) + (r - q + v * v / 2) * t) / (v * sqrt(t)) AS d1, exp(-q * t) AS dq, exp(-r * t) AS dr FROM o), e AS (SELECT *, d1 - v * sqrt(t) AS d2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS dens FROM d), "
        f"g AS (SELECT *, {_normal('d1')} AS n1, {_normal('d2')} AS n2 FROM e) SELECT p_partkey, {', '.join(f'{_r(x)} AS {n}' for n, x in shown.items())} FROM g"
    )


_GREEKS = ("price", "delta", "gamma", "vega", "theta", "theta_daily", "rho", "time_value")


@_query("black_scholes_call", _greeks_sql(True, "0.01", "k * t * dr * n2"))
def _bs_call(spark, sf_dir):
    return finance.option_greeks(_option_inputs(spark, sf_dir), True, *[F.col(n) for n in "sktrqv"]).select("p_partkey", *_GREEKS)


@_query("black_scholes_put", _greeks_sql(False, "0.01", "k * t * dr * n2 - k * t * dr"))
def _bs_put(spark, sf_dir):
    return finance.option_greeks(_option_inputs(spark, sf_dir), False, *[F.col(n) for n in "sktrqv"]).select("p_partkey", *_GREEKS)


@_query("black_76", _greeks_sql(True, "0.03", "-t * ({price})"))
def _b76(spark, sf_dir):
    return finance.black_76(_option_inputs(spark, sf_dir), True, *[F.col(n) for n in "sktrv"]).select("p_partkey", *_GREEKS)


@_query("implied_volatility", f"SELECT p_partkey, {_r('0.25 + (p_partkey % 40) / 100')} AS of_call, {_r('0.25 + (p_partkey % 40) / 100')} AS of_put, {_r('0')} AS parity FROM part")
def _implied(spark, sf_dir):
    """Volatilities found from the prices at known ones, high enough for the prices to tell them to six digits."""
    s, k, t, r, q, v = (F.col(n) for n in "sktrqv")
    inputs = _option_inputs(spark, sf_dir).withColumn("v", F.col("v") + 0.15)
    both = finance.option_greeks(inputs, True, s, k, t, r, q, v).select("p_partkey", *"sktrqv", F.col("price").alias("c"))
    both = finance.option_greeks(both, False, s, k, t, r, q, v)
    solved = [finance.implied_volatility(call, F.col(n), s, k, t, r, q).alias(a) for call, n, a in ((True, "c", "of_call"), (False, "price", "of_put"))]
    return both.select("p_partkey", *solved, finance.parity_gap(F.col("c"), F.col("price"), s, k, t, r, q).alias("parity"))


@_query(
    "option_expiry",
    "WITH o AS (SELECT p_partkey, p_retailprice AS k, p_size / 2 AS m, unnest(range(0, 9)) AS step FROM part), u AS (SELECT *, k * (0.8 + 0.05 * step) AS u FROM o) "
    f"SELECT p_partkey, step, {_r('10 * (greatest(u - k, 0) - m)')} AS call_bought, {_r('10 * (m - greatest(k - u, 0))')} AS put_sold, {_r('k + m')} AS call_even, {_r('k - m')} AS put_even, {_r('NULL')} AS call_profit, {_r('10 * m')} AS call_loss, {_r('10 * m')} AS put_profit, {_r('10 * (k - m)')} AS put_loss FROM u",
)
def _expiry(spark, sf_dir):
    k, m, size = F.col("p_retailprice"), F.col("p_size") / 2, F.lit(10.0)
    points = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_retailprice", "p_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("step"))
    u = k * (0.8 + 0.05 * F.col("step"))
    shown = {f"{side}_{short}": c for side, call in (("call", True), ("put", False)) for short, c in zip(("even", "profit", "loss"), finance.expiry_profile(call, call, k, m, size).values(), strict=True)}
    return points.select("p_partkey", "step", finance.expiry_result(True, True, k, m, size, u).alias("call_bought"), finance.expiry_result(False, False, k, m, size, u).alias("put_sold"), *[c.alias(n) for n, c in shown.items()])


@_query(
    "contract_values",
    "WITH x AS (SELECT c_custkey, c_acctbal AS equity, r_name AS cur, CASE WHEN r_regionkey = 0 THEN 1.0::DOUBLE WHEN r_regionkey = 4 THEN NULL WHEN r_regionkey % 2 = 1 THEN 1 + r_regionkey / 10 ELSE 1 / (1 + r_regionkey / 10) END AS fx, 50 + c_custkey % 100 AS entry, 50 + c_custkey % 100 - 2.5 + c_custkey % 6 AS stop FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), "
    "w AS (SELECT *, equity > 0 AND fx IS NOT NULL AS ok, abs(entry - stop) * 5 * fx AS risk, entry * 5 * fx AS unit FROM x), z AS (SELECT *, equity * 0.02 / risk AS wanted, equity * 1.5 / unit AS levered FROM w), y AS (SELECT *, floor(least(wanted, levered, 2000 / unit) / 0.1::DOUBLE + 1e-12) * 0.1::DOUBLE AS whole FROM z), v AS (SELECT *, CASE WHEN whole + 1e-12 < 0.5 THEN 0 ELSE whole END AS size FROM y) "
    f"SELECT c_custkey, {_r('fx')} AS fx, {_r('3 * entry * 5 * fx')} AS notional, {_r('3 * risk')} AS at_stop, {_r('(stop - entry) * 3 * 5 * fx')} AS result, {_r('0.25 * 5 * fx')} AS tick, {_r('CASE WHEN ok THEN size END')} AS size, {_r('CASE WHEN ok THEN size * risk END')} AS risk_amount, CASE WHEN ok THEN wanted > levered END AS capped_by_leverage, CASE WHEN ok THEN least(wanted, levered) > 2000 / unit END AS capped_by_notional FROM v",
)
def _contracts(spark, sf_dir):
    """Positions in five currencies of which one is the account's, two are quoted against it, one turned round, and one not at all."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    region = read("region")
    at_home = region.filter("r_regionkey = 0").select(F.col("r_name").alias("home"))
    rates = region.filter("r_regionkey between 1 and 3").join(F.broadcast(at_home))
    turned = F.col("r_regionkey") % 2 == 0
    rates = rates.select(F.when(turned, F.col("home")).otherwise(F.col("r_name")).alias("base"), F.when(turned, F.col("r_name")).otherwise(F.col("home")).alias("quote"), (1 + F.col("r_regionkey") / 10).alias("rate"))
    held = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(F.broadcast(at_home))
    held = contracts.with_fx(held, rates, "r_name", "home")
    entry, fx, five, three = (50 + F.col("c_custkey") % 100).cast("double"), F.col("fx"), F.lit(5.0), F.lit(3.0)
    stop = entry - 2.5 + F.col("c_custkey") % 6
    sized = contracts.contract_size(F.col("c_acctbal"), 0.02, entry, stop, five, fx, 1.5, 2000.0, 0.1, 0.5)
    return held.select("c_custkey", "fx", contracts.notional_value(entry, three, five, fx).alias("notional"), contracts.stop_risk(entry, stop, three, five, fx).alias("at_stop"), contracts.profit(entry, stop, three, F.lit(True), five, fx).alias("result"), contracts.tick_value(F.lit(0.25), five, fx).alias("tick"), *[c.alias(n) for n, c in sized.items()])


_BAR_LISTS = "l AS (SELECT series, ts, close, list(low) OVER f AS lows, list(high) OVER f AS highs, list(close) OVER f AS closes FROM bars WINDOW f AS (PARTITION BY series ORDER BY ts ROWS {n} PRECEDING))"


@_query(
    "window_legs",
    f"{_B}, {_BAR_LISTS.format(n=29)}, e AS (SELECT *, list_position(lows, list_min(lows)) AS lo, 31 - list_position(list_reverse(highs), list_max(highs)) AS hi FROM l WHERE len(lows) = 30), g AS (SELECT *, hi > lo AS up, CASE WHEN hi > lo THEN lows[lo] ELSE highs[hi] END AS a, CASE WHEN hi > lo THEN highs[hi] ELSE lows[lo] END AS z FROM e), s AS (SELECT *, CASE WHEN z <> a THEN (z - close) / (z - a) END AS share FROM g) "
    f"SELECT series, ts, up, {_r('a')} AS leg_start, {_r('z')} AS leg_end, abs(hi - lo)::BIGINT AS leg_bars, {_r('share')} AS share, CASE WHEN share < 0 THEN 'extension' WHEN share < 0.618::DOUBLE THEN 'correction' WHEN share <= 1 THEN 'deep_correction' WHEN share > 1 THEN 'reversal' END AS zone FROM s",
)
def _window_legs(spark, sf_dir):
    return legs.window_legs(event_bars(spark, sf_dir), 30)


@_query(
    "path_efficiency",
    f"{_B}, {_BAR_LISTS.format(n=19)}, m AS (SELECT *, list_sum(list_transform(range(2, 21), lambda i: abs(closes[i] - closes[i - 1]))) AS path FROM l WHERE len(closes) = 20) SELECT series, ts, {_r('CASE WHEN path > 0 THEN abs(closes[20] - closes[1]) / path ELSE 0 END')} AS efficiency FROM m",
)
def _efficiency(spark, sf_dir):
    return legs.path_efficiency(event_bars(spark, sf_dir), 20)


@_query(
    "swing_sequences",
    f"{_B}, {_BAR_LISTS.format(n=6)}, p AS (SELECT series, ts, CASE WHEN len(highs) = 7 AND highs[4] > list_max(highs[1:3]) AND highs[4] > list_max(highs[5:7]) THEN highs[4] END AS ph, CASE WHEN len(lows) = 7 AND lows[4] < list_min(lows[1:3]) AND lows[4] < list_min(lows[5:7]) THEN lows[4] END AS pl FROM l), q AS (SELECT *, list(ph) FILTER (ph IS NOT NULL) OVER f AS hs, list(pl) FILTER (pl IS NOT NULL) OVER f AS ls FROM p WINDOW f AS (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)) "
    f"SELECT series, ts, {_r('ph')} AS ph, {_r('pl')} AS pl, CASE WHEN coalesce(len(hs), 0) < 2 OR coalesce(len(ls), 0) < 2 THEN 'unknown' WHEN hs[-1] > hs[-2] AND ls[-1] > ls[-2] THEN 'up' WHEN hs[-1] < hs[-2] AND ls[-1] < ls[-2] THEN 'down' ELSE 'mixed' END AS sequence FROM q",
)
def _sequences(spark, sf_dir):
    return legs.swing_sequences(event_bars(spark, sf_dir), 3)


from . import catalog_models  # noqa: E402,F401  its queries register themselves
