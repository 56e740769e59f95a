"""Queries on resampling, fitted models, setup outcomes and price zones, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import _B, _HOURLY, _query, _r
from .functions import curves
from .operators.spec import OFF_TIE, apply, build, to_sql
from .plans import alerts, align, divergence, evaluate, models, outcomes, patterns, pnf, profiles, resampling, sessions, shapes, zones
from .sources.bars import ORDER_BARS_SQL, event_bars, order_bars

_W = "(PARTITION BY series ORDER BY ts)"


# -- resampling and models ------------------------------------------------------------------------------------------------

_FORECASTS = (
    f"{_B}, q AS (SELECT series, ts, close, min(low) OVER f AS lo, max(high) OVER f AS hi, row_number() OVER {_W} AS i, lead(close, 5) OVER {_W} AS later FROM bars WINDOW f AS (PARTITION BY series ORDER BY ts ROWS 19 PRECEDING)), "
    "fc AS (SELECT series, ts, CASE WHEN hi > lo THEN (close - lo) / (hi - lo) ELSE 0.5 END AS p, later > close AS rose FROM q WHERE i >= 20 AND later IS NOT NULL)"
)


def _congruence(seed: int, add: int, draws: str) -> str:
    """Draws of the 64-bit linear congruence, k from 0."""
    return f"lcg AS (SELECT -1::BIGINT AS k, {seed + 1}::UHUGEINT AS x UNION ALL SELECT k + 1, (x * 6364136223846793005::UHUGEINT + {add}::UHUGEINT) % 18446744073709551616::UHUGEINT FROM lcg WHERE k + 1 < {draws})"


@_query("data_snooping", None)
def _snooping(spark, sf_dir):
    """Aligned returns of each series as rules; no SQL: one stream of draws decides 500 x n steps."""
    returns = align.aligned_returns(event_bars(spark, sf_dir))
    return resampling.data_snooping(resampling.numbered(returns.select(F.col("series").alias("rule"), "ts", F.col("ret").alias("value")), "rule"), 10.0, 500)


@_query(
    "brier_bootstrap",
    f"WITH RECURSIVE {_FORECASTS.removeprefix('WITH ')}, e AS (SELECT row_number() OVER (ORDER BY series, ts) - 1 AS pos, pow(p - rose::INT, 2) AS v, count(*) OVER () AS n FROM fc), "
    f"c AS (SELECT any_value(n) AS n, (any_value(n) + 99) // 100 AS each FROM e), {_congruence(7, 1, '40 * (SELECT each FROM c)')}, "
    "b AS (SELECT k // each AS path, (x % n::UHUGEINT)::BIGINT AS start, least(100, n - 100 * (k % each)) AS length, n FROM lcg, c WHERE k >= 0), "
    "d AS (SELECT path, n, (start + unnest(range(length))) % n AS pos FROM b), s AS (SELECT path, sum(v) / any_value(d.n) AS score FROM d JOIN e USING (pos) GROUP BY path), "
    "o AS (SELECT *, row_number() OVER (ORDER BY score) - 1 AS place FROM s) "
    f"SELECT {_r('avg(score)')} AS mean, {_r('max(score) FILTER (place = 2)')} AS p05, {_r('max(score) FILTER (place = 38)')} AS p95 FROM o",
)
def _brier(spark, sf_dir):
    """40 resamples of blocks of 100 forecasts, in the order of series and time."""
    rows = models.rank_forecasts(event_bars(spark, sf_dir)).select("series", "ts", "p", "rose")
    sizes = rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("series").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each series
    placed = resampling.numbered(rows, "series").join(sizes.select("series", before.alias("before")), "series")
    return resampling.brier_bootstrap(placed.select((F.col("pos") + F.col("before")).alias("pos"), "p", F.col("rose").alias("won")), 100, 40, 7)


@_query(
    "path_returns",
    f"WITH RECURSIVE {_B.removeprefix('WITH ')}, times AS (SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT series) = (SELECT count(DISTINCT series) FROM bars)), r AS (SELECT series AS asset, ts, close / lag(close) OVER {_W} - 1 AS v FROM bars JOIN times USING (ts)), "
    "x AS (SELECT asset, v, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY asset) AS n FROM r WHERE v IS NOT NULL), c AS (SELECT max(n) AS n FROM x), "
    f"{_congruence(11, 1442695040888963407, '25 * 6')}, b AS (SELECT k // 6 AS path, 10 * (k % 6) AS step, (x % n::UHUGEINT)::BIGINT AS start, least(10, 57 - 10 * (k % 6)) AS length, n FROM lcg, c WHERE k >= 0), "
    "d AS (SELECT path, step + unnest(range(length)) AS step, (start + unnest(range(length))) % n AS pos FROM b) "
    f"SELECT path, step, asset, {_r('v')} AS value FROM d JOIN x USING (pos)",
)
def _paths(spark, sf_dir):
    """25 joint paths of 57 steps in blocks of 10."""
    returns = align.aligned_returns(event_bars(spark, sf_dir))
    return resampling.path_returns(resampling.numbered(returns.select(F.col("series").alias("asset"), "ts", F.col("ret").alias("value")), "asset"), 10, 57, 25, 11)


@_query(
    "isotonic_calibration",
    f"{_FORECASTS}, g AS (SELECT round(p, 2) + 0.0 AS s, count(*) AS n, sum(rose::INT) AS w FROM fc GROUP BY 1), u AS (SELECT *, sum(n) OVER o AS cn, sum(w) OVER o AS cw FROM g WINDOW o AS (ORDER BY s)), "
    "m AS (SELECT a.s AS i, k.s AS k, (k.cw - a.cw + a.w) / (k.cn - a.cn + a.n) AS rate FROM u a JOIN u k ON k.s >= a.s), "
    "lowest AS (SELECT x.s, m.i, min(m.rate) AS least FROM u x JOIN m ON m.i <= x.s AND m.k >= x.s GROUP BY 1, 2), iso AS (SELECT s, max(least) AS value FROM lowest GROUP BY s) "
    f"SELECT series, ts, {_r('p')} AS p, {_r('value')} AS calibrated FROM fc JOIN iso ON round(p, 2) + 0.0 = s",
)
def _isotonic(spark, sf_dir):
    rows = models.rank_forecasts(event_bars(spark, sf_dir)).select("series", "ts", "p", F.round("p", 2).alias("score"), F.col("rose").alias("won"))
    return models.predict_isotonic(models.fit_isotonic(rows), rows).select("series", "ts", "p", "calibrated")


@_query("logistic_forecast", None)
def _logistic(spark, sf_dir):
    """Fitted probabilities of a rise; no SQL: Newton steps to convergence."""
    rows = models.rank_forecasts(event_bars(spark, sf_dir)).filter("trend IS NOT NULL")
    model = models.fit_logistic(rows, ["p", "trend", "activity"], "rose", 0.5)
    chance = models.logistic(model["weights"], model["intercept"]) if model else F.lit(None).cast("double")
    return rows.select("series", "ts", chance.alias("chance"))


# -- outcomes of setups ---------------------------------------------------------------------------------------------------

_SETUPS = (
    f"{_B}, g AS (SELECT series, ts, close, avg(close) OVER (PARTITION BY series ORDER BY ts ROWS 4 PRECEDING) - avg(close) OVER (PARTITION BY series ORDER BY ts ROWS 19 PRECEDING) AS gap, row_number() OVER {_W} AS j FROM bars), "
    f"h AS (SELECT *, lag(gap) OVER {_W} AS was FROM g), sg AS (SELECT series, ts, j AS start, close AS entry, CASE WHEN was <= 0 AND gap > 0 THEN 1 WHEN was >= 0 AND gap < 0 THEN -1 END AS dir FROM h WHERE j > 20), "
    f"st AS (SELECT *, row_number() OVER {_W} AS n FROM sg WHERE dir IS NOT NULL), su AS (SELECT series || ':' || n AS id, series, ts, start, dir, entry, entry * (1 + 0.2::DOUBLE * dir) AS target, entry * (1 - 0.1::DOUBLE * dir) AS stop, 3 + n % 40 AS most FROM st)"
)


@_query(
    "setup_outcomes",
    f"{_SETUPS}, nb AS (SELECT *, row_number() OVER {_W} AS j FROM bars), f AS (SELECT unnest(['stop_first', 'target_first', 'nearest_to_open']) AS fill), "
    "mt AS (SELECT su.*, nb.open AS o, nb.close AS c, nb.j, nb.j - start AS age, CASE WHEN dir = 1 THEN high - entry ELSE entry - low END AS fav, CASE WHEN dir = 1 THEN entry - low ELSE high - entry END AS adv, "
    "CASE WHEN dir = 1 THEN high >= target ELSE low <= target END AS ht, CASE WHEN dir = 1 THEN low <= stop ELSE high >= stop END AS hs, CASE WHEN dir = 1 THEN nb.open >= target ELSE nb.open <= target END AS ot, CASE WHEN dir = 1 THEN nb.open <= stop ELSE nb.open >= stop END AS os "
    "FROM su JOIN nb ON nb.series = su.series AND nb.j > start AND nb.j <= start + most), "
    "fi AS (SELECT id, min(j) FILTER (ht OR hs OR age >= most) AS done, max(j) AS last FROM mt GROUP BY id), ex AS (SELECT id, greatest(0, max(fav)) AS mfe, greatest(0, max(adv)) AS mae, max(age) AS bars FROM mt JOIN fi USING (id) WHERE j <= coalesce(done, last) GROUP BY id), "
    "en AS (SELECT mt.*, fill, CASE WHEN ot THEN true WHEN os THEN false WHEN ht AND hs THEN fill = 'target_first' OR fill = 'nearest_to_open' AND abs(o - target) < abs(o - stop) ELSE ht END AS win FROM mt JOIN fi ON fi.id = mt.id AND mt.j = done, f), "
    "re AS (SELECT id, fill, CASE WHEN win THEN 'win' WHEN hs THEN 'loss' ELSE 'expired' END AS outcome, CASE WHEN win THEN CASE WHEN ot THEN o ELSE target END WHEN hs THEN CASE WHEN os THEN o ELSE stop END ELSE c END AS price FROM en) "
    f"SELECT su.series, su.id, f.fill, CASE WHEN dir = 1 THEN 'buy' ELSE 'sell' END AS side, coalesce(outcome, 'active') AS outcome, {_r('price')} AS exit_price, {_r('dir * (price - entry) / greatest(abs(entry - stop), 1e-8)')} AS realized_r, coalesce(bars, 0)::BIGINT AS bars, {_r('coalesce(mfe, 0)')} AS mfe, {_r('coalesce(mae, 0)')} AS mae "
    "FROM su CROSS JOIN f LEFT JOIN ex USING (id) LEFT JOIN re ON re.id = su.id AND re.fill = f.fill",
)
def _outcomes(spark, sf_dir):
    """Crossings of two means as setups with their own horizons, under each rule for bars that span both levels."""
    bars = event_bars(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("series").orderBy("ts"))
    e, d = F.col("close"), F.col("direction")
    setups = evaluate.cross_signals(bars).select(
        F.concat_ws(":", "series", n.cast("string")).alias("id"), "series", "ts", F.when(d == 1, "buy").otherwise("sell").alias("side"), e.alias("entry"), (e * (1 + 0.2 * d)).alias("target"), (e * (1 - 0.1 * d)).alias("stop"),
        (3 + n % 40).alias("max_bars"), F.lit(1.0).alias("score"), F.lit(1.0).alias("agreement"),
    )
    each = [outcomes.resolve(setups, bars, fill).select("series", "id", F.lit(fill).alias("fill"), "side", "outcome", "exit_price", "realized_r", "bars", "mfe", "mae") for fill in outcomes.FILLS]
    return each[0].union(each[1]).union(each[2])


# -- price zones ----------------------------------------------------------------------------------------------------------

_RANGED = f"{_B}, rb AS (SELECT *, row_number() OVER {_W} AS i, lag(open) OVER {_W} AS po, lag(high) OVER {_W} AS ph, lag(low) OVER {_W} AS pl, lag(close) OVER {_W} AS pc FROM bars), ra AS (SELECT *, CASE WHEN i > 14 THEN avg(greatest(high - low, abs(high - pc), abs(low - pc))) OVER (PARTITION BY series ORDER BY ts ROWS 13 PRECEDING) END AS atr FROM rb)"


@_query(
    "order_block",
    f"{_RANGED}, z AS (SELECT series, i AS birth, CASE WHEN close > open AND pc < po THEN 1 WHEN close < open AND pc > po THEN -1 END AS side, ph AS top, pl AS bottom FROM ra WHERE abs(close - open) >= atr), "
    "zz AS (SELECT z.*, (SELECT min(b.i) FROM ra b WHERE b.series = z.series AND b.i > z.birth AND CASE WHEN side = 1 THEN b.close < bottom ELSE b.close > top END) AS death FROM z WHERE side IS NOT NULL), "
    "al AS (SELECT ra.series, ra.i, sum(side) AS value, max(struct_pack(birth := birth, top := top, bottom := bottom)) AS l, count(*) FILTER (birth = ra.i AND side = 1) AS bb, count(*) FILTER (birth = ra.i AND side = -1) AS bs, count(*) FILTER (birth < ra.i AND side = 1 AND low <= top) AS rb, count(*) FILTER (birth < ra.i AND side = -1 AND high >= bottom) AS rs "
    "FROM ra JOIN zz ON zz.series = ra.series AND ra.i >= birth AND (death IS NULL OR ra.i < death) GROUP BY 1, 2) "
    f"SELECT ra.series, ra.ts, CASE WHEN ra.i > 14 THEN coalesce(value, 0)::DOUBLE END AS value, {_r('l.top')} AS active_ob_top, {_r('l.bottom')} AS active_ob_bottom, ra.i - l.birth AS active_ob_duration, "
    "CASE WHEN ra.i > 14 THEN coalesce(bb, 0) END AS born_bullish, CASE WHEN ra.i > 14 THEN coalesce(bs, 0) END AS born_bearish, CASE WHEN ra.i > 14 THEN coalesce(al.rb, 0) END AS retest_bullish, CASE WHEN ra.i > 14 THEN coalesce(rs, 0) END AS retest_bearish FROM ra LEFT JOIN al USING (series, i)",
)
def _order_block(spark, sf_dir):
    return zones.order_blocks(event_bars(spark, sf_dir))


@_query("support_resistance", None)
def _support_resistance(spark, sf_dir):
    """No SQL: each level's fate hangs on the one kept before it."""
    return zones.support_resistance(event_bars(spark, sf_dir))


_PIVOT_ZONES = (
    f"{_B}, pz AS (SELECT series, ts, row_number() OVER {_W} AS i, lag(high, 5) OVER {_W} AS h, lag(low, 5) OVER {_W} AS l, max(high) OVER f AS hh, min(low) OVER f AS ll FROM bars WINDOW f AS (PARTITION BY series ORDER BY ts ROWS 10 PRECEDING)), "
    "zs AS (SELECT series || ':' || i || ':support' AS zone, series, ts, 'support' AS kind, l * 1.0025::DOUBLE AS top, l * 0.9975::DOUBLE AS bottom FROM pz WHERE i > 10 AND l = ll UNION ALL SELECT series || ':' || i || ':resistance', series, ts, 'resistance', h * 1.0025::DOUBLE, h * 0.9975::DOUBLE FROM pz WHERE i > 10 AND h = hh)"
)


@_query("zone_lifecycle", None)
def _zone_lifecycle(spark, sf_dir):
    """No SQL: a machine of five states; compared with a bar-by-bar version in the tests."""
    bars = event_bars(spark, sf_dir)
    return zones.lifecycle(zones.pivot_zones(bars), bars)


@_query(
    "zone_merge",
    f"{_PIVOT_ZONES}, c AS (SELECT *, coalesce((bottom > max(top) OVER (PARTITION BY series, kind ORDER BY bottom, top, zone ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.01::DOUBLE)::INT, 0) AS cut FROM zs), r AS (SELECT *, sum(cut) OVER (PARTITION BY series, kind ORDER BY bottom, top, zone ROWS UNBOUNDED PRECEDING) AS run FROM c) "
    f"SELECT series, kind, min(zone) AS merged, {_r('max(top)')} AS top, {_r('min(bottom)')} AS bottom, count(*) AS members, min(ts) AS first_ts FROM r GROUP BY series, kind, run",
)
def _zone_merge(spark, sf_dir):
    return zones.merge_zones(zones.pivot_zones(event_bars(spark, sf_dir)), 0.01)


# -- divergences ----------------------------------------------------------------------------------------------------------


def _divergence_sql(left: int, right: int, least: int, most: int, prior: int, by_price: bool, oscillator: str) -> str:
    """Pivots of either side, each with its last `prior` predecessors; the best pair of each. Oscillators count to DIGITS digits."""
    span = most - least
    sides = []
    for side, line, best, sign in (("low", "low", "min", "<"), ("high", "high", "max", ">")):
        src = line if by_price else "osc"
        sides.append(
            f"SELECT '{side}' AS side, series, ts AS confirmed_ts, lag(ts, {right}) OVER {_W} AS pivot_ts, i - {right} AS spot, lag({line}, {right}) OVER {_W} AS price, lag(osc, {right}) OVER {_W} AS o, i > {left + right} AND lag({src}, {right}) OVER {_W} {sign} {best}({src}) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN {left + right} PRECEDING AND {right + 1} PRECEDING) "
            f"AND lag({src}, {right}) OVER {_W} {sign} {best}({src}) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN {right - 1} PRECEDING AND CURRENT ROW) AS ok FROM live"
        )
    return (
        f"WITH bars AS ({_HOURLY}), ov AS ({to_sql(build(oscillator), _HOURLY, 13)}), live AS (SELECT bars.series, bars.ts, high, low, round(value - {OFF_TIE!r}, {divergence.DIGITS}) AS osc, row_number() OVER (PARTITION BY bars.series ORDER BY bars.ts) AS i FROM bars JOIN ov ON ov.series = bars.series AND ov.ts = bars.ts WHERE value IS NOT NULL), "
        f"n AS ({' UNION ALL '.join(sides)}), nn AS (SELECT *, row_number() OVER (PARTITION BY series, side ORDER BY spot) AS k FROM n WHERE ok), "
        "pr AS (SELECT b.*, a.pivot_ts AS previous_ts, a.price AS pp, a.o AS po, b.spot - a.spot AS gap, b.k - a.k AS back, CASE WHEN (b.price > a.price AND b.o < a.o) OR (b.price < a.price AND b.o > a.o) THEN CASE WHEN (b.side = 'low') = (b.price < a.price) THEN 'regular' ELSE 'hidden' END END AS kind "
        f"FROM nn b JOIN nn a ON a.series = b.series AND a.side = b.side AND a.k < b.k AND a.k >= b.k - {prior}), "
        f"q AS (SELECT *, 0.6::DOUBLE * least((abs(price - pp) / greatest(abs(pp), 1e-9) + abs(o - po) / greatest(abs(po), 1e-9)) / 2, 1.0) + 0.4::DOUBLE * (1 - least(abs(gap - {least + span / 2}::DOUBLE) / {max(span / 2, 1.0)}::DOUBLE, 1.0)) AS quality FROM pr WHERE kind IS NOT NULL AND gap BETWEEN {least} AND {most}), "
        "w AS (SELECT *, row_number() OVER (PARTITION BY series, side, spot ORDER BY quality DESC, back) AS place FROM q) "
        f"SELECT series, kind || CASE WHEN side = 'low' THEN '_bullish' ELSE '_bearish' END AS kind, previous_ts, pivot_ts, confirmed_ts, {_r('pp')} AS previous_price, {_r('price')} AS pivot_price, {_r('po')} AS previous_osc, {_r('o')} AS pivot_osc, gap AS bars_between, {_r('quality')} AS quality FROM w WHERE place = 1"
    )


def _divergence_query(name: str, oscillator: str, source: str, left: int, right: int, least: int, most: int, prior: int, sql: bool) -> None:
    @_query(name, _divergence_sql(left, right, least, most, prior, source == "price", oscillator) if sql else None)
    def run(spark, sf_dir):
        rows = divergence.with_oscillator(event_bars(spark, sf_dir), oscillator)
        return divergence.divergences(rows, left, right, least, most, prior, source)


for _name in divergence.OSCILLATORS:
    _divergence_query("pivot_divergence" if _name == "rsi" else f"{_name}_pivot_divergence", _name, "price", 7, 7, 10, 120, 5, build(_name).has_sql)
    _divergence_query("oscillator_pivot_divergence" if _name == "rsi" else f"{_name}_divergence", _name, "oscillator", 5, 5, 5, 60, 1, build(_name).has_sql)


@_query("divergence_bars", None)
def _divergence_bars(spark, sf_dir):
    """Every bar with the event it confirms; the events themselves have SQL above."""
    return divergence.divergence_bars(event_bars(spark, sf_dir))


# -- point and figure, sessions, alerts -----------------------------------------------------------------------------------

_BOXES = (
    f"WITH RECURSIVE {_B.removeprefix('WITH ')}, nb AS (SELECT series, row_number() OVER {_W} AS i, floor(close / 5 + 1e-9)::BIGINT AS up, ceil(close / 5 - 1e-9)::BIGINT AS down FROM bars), "
    "pf(series, i, side, col, top, bottom, a, z, changed) AS (SELECT series, i, 0, 0::BIGINT, 0::BIGINT, 0::BIGINT, up, down, 0 FROM nb WHERE i = 1 UNION ALL "
    "SELECT series, i, CASE WHEN act = 1 THEN CASE WHEN up > a THEN 1 ELSE -1 END WHEN act = 3 THEN -side ELSE side END, CASE WHEN act IN (1, 3) THEN col + 1 ELSE col END, "
    "CASE act WHEN 1 THEN CASE WHEN up > a THEN up ELSE z END WHEN 2 THEN CASE WHEN side = 1 THEN up ELSE top END WHEN 3 THEN CASE WHEN side = 1 THEN top - 1 ELSE up END ELSE top END, "
    "CASE act WHEN 1 THEN CASE WHEN up > a THEN a ELSE down END WHEN 2 THEN CASE WHEN side = 1 THEN bottom ELSE down END WHEN 3 THEN CASE WHEN side = 1 THEN down ELSE bottom + 1 END ELSE bottom END, "
    "CASE WHEN side = 0 AND act = 0 THEN greatest(a, up) ELSE a END, CASE WHEN side = 0 AND act = 0 THEN least(z, down) ELSE z END, (act > 0)::INT "
    "FROM (SELECT nb.series, nb.i, nb.up, nb.down, side, col, top, bottom, a, z, CASE WHEN side = 0 THEN CASE WHEN (nb.up > a) <> (nb.down < z) THEN 1 ELSE 0 END "
    "WHEN (side = 1 AND nb.up > top) OR (side = -1 AND nb.down < bottom) THEN 2 WHEN (side = 1 AND nb.down <= top - 3) OR (side = -1 AND nb.up >= bottom + 3) THEN 3 ELSE 0 END AS act FROM pf JOIN nb ON nb.series = pf.series AND nb.i = pf.i + 1)), "
    "ch AS (SELECT series, col AS nth, arg_max(side, i) AS direction, arg_max(top, i) AS top, arg_max(bottom, i) AS bottom, min(i) - 1 AS first_bar, max(i) - 1 AS last_bar FROM pf WHERE changed = 1 GROUP BY series, col)"
)


@_query("pnf_columns", f"{_BOXES} SELECT series, nth, direction, {_r('5 * top')} AS top, {_r('5 * bottom')} AS bottom, top - bottom + 1 AS boxes, first_bar, last_bar FROM ch")
def _pnf_columns(spark, sf_dir):
    return pnf.columns(event_bars(spark, sf_dir), 5.0)


@_query(
    "pnf_counts",
    f"{_BOXES}, w AS (SELECT series, nth AS first, nth + 4 AS last FROM ch), e AS (SELECT w.*, b.direction AS d, CASE WHEN b.direction < 0 THEN b.bottom ELSE b.top END AS line FROM w JOIN ch b ON b.series = w.series AND b.nth = w.last), "
    "s AS (SELECT e.series, e.first, e.last, d, line, count(*) AS n, count(*) FILTER (c.bottom <= line AND c.top >= line) AS m, CASE WHEN d < 0 THEN min(c.bottom) ELSE max(c.top) END AS x FROM e JOIN ch c ON c.series = e.series AND c.nth BETWEEN e.first AND e.last GROUP BY 1, 2, 3, 4, 5) "
    f"SELECT series, first, last, -d AS direction, {_r('5 * line')} AS count_line, {_r('5 * x')} AS extreme, n AS columns, m AS columns_on_line, {_r('15 * n')} AS effect, {_r('15 * m')} AS effect_on_line, {_r('5 * x - d * 15 * n')} AS target_from_extreme, {_r('5 * line - d * 15 * n')} AS target_from_line FROM s",
)
def _pnf_counts(spark, sf_dir):
    """Counts over every five columns of the chart."""
    chart = pnf.columns(event_bars(spark, sf_dir), 5.0)
    return pnf.horizontal_counts(chart, chart.select("series", F.col("nth").alias("first"), (F.col("nth") + 4).alias("last")), 5.0)


@_query(
    "trading_sessions",
    f"{_B}, l AS (SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS here FROM bars), s AS (SELECT *, CASE WHEN here::TIME >= TIME '18:00' THEN here::DATE WHEN here::TIME < TIME '03:00' THEN here::DATE - 1 END AS day FROM l), "
    f"o AS (SELECT *, timezone('UTC', timezone('America/New_York', day + INTERVAL 18 HOUR)) AS session FROM s), h AS (SELECT *, last_value(session IGNORE NULLS) OVER {_W[:-1]} ROWS UNBOUNDED PRECEDING) AS held FROM o), "
    f"g AS (SELECT *, lag(held) OVER {_W} AS was, coalesce(session IS NOT NULL AND ts >= session AND ts < session + INTERVAL 120 MINUTE, false) AS inside FROM h) "
    f"SELECT series, ts, session, session IS NOT NULL AS in_session, session IS NOT NULL AND (was IS NULL OR was <> held) AS new_session, inside AS in_opening, {_r('max(CASE WHEN inside THEN high END) OVER f')} AS opening_high, {_r('min(CASE WHEN inside THEN low END) OVER f')} AS opening_low, "
    f"{_r('CASE WHEN session IS NOT NULL AND sum(volume) OVER v > 0 THEN sum((high + low + close) / 3 * volume) OVER v / sum(volume) OVER v END')} AS vwap FROM g WINDOW f AS (PARTITION BY series, held ORDER BY ts ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY series, session ORDER BY ts ROWS UNBOUNDED PRECEDING)",
)
def _trading_sessions(spark, sf_dir):
    """Evening sessions of New York, over midnight and the change of its clocks, with opening range and mean price."""
    rows = sessions.with_sessions(event_bars(spark, sf_dir), "18:00", "03:00", "America/New_York", 120)
    return rows.select("series", "ts", "session", "in_session", "new_session", "in_opening", "opening_high", "opening_low").join(sessions.session_vwap(rows).drop("session"), ["series", "ts"])


@_query(
    "exchange_calendar",
    "WITH l AS (SELECT o_orderkey, o_orderdate + to_minutes(o_orderkey % 1440) AS ts FROM orders), h AS (SELECT *, timezone('Europe/Berlin', timezone('UTC', ts)) AS local_ts FROM l), d AS (SELECT *, month(local_ts) = 1 AND day(local_ts) = 1 AS is_holiday, day(local_ts) = 31 AS early, local_ts::TIME AS t FROM h) "
    "SELECT o_orderkey, ts, local_ts, is_holiday, NOT is_holiday AND CASE WHEN early THEN t >= TIME '09:00' AND t < TIME '12:00' ELSE (t >= TIME '09:00' AND t < TIME '13:00') OR (t >= TIME '14:00' AND t < TIME '17:30') END AS is_open FROM d",
)
def _exchange_calendar(spark, sf_dir):
    """Orders against a calendar of two segments in Berlin, closed on New Year's Day, closing early on every 31st."""
    ts = F.timestamp_add("MINUTE", (F.col("o_orderkey") % 1440).cast("int"), F.col("o_orderdate"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", ts.alias("ts"))
    days = rows.select(F.to_date(sessions.local_time(F.col("ts"), "Europe/Berlin")).alias("day")).distinct()
    holidays = days.filter((F.month("day") == 1) & (F.dayofmonth("day") == 1))
    early = days.filter(F.dayofmonth("day") == 31).withColumn("close", F.lit("12:00"))
    return sessions.with_calendar(rows, [("09:00", "13:00"), ("14:00", "17:30")], "Europe/Berlin", holidays, early)


@_query("alert_events", None)
def _alert_events(spark, sf_dir):
    """Every rule's events over the hourly bars; ids are a function of the event, so a rerun repeats them."""
    bars = event_bars(spark, sf_dir)
    tables = {
        "zone_rejection": apply(bars, [build("zone_rejection")]),
        "order_block": zones.order_blocks(bars),
        "divergence": divergence.divergence_bars(bars),
        "point_and_figure": apply(bars, [build("point_and_figure", box_size=5.0)]),
    }
    found = [alerts.events(rows, alerts.RULES[name], name, "1h") for name, rows in tables.items()]
    return alerts.unique(found[0].union(found[1]).union(found[2]).union(found[3]))


# -- calibration by chunks, curves and surfaces ---------------------------------------------------------------------------


@_query(
    "calibration_chunks",
    f"{_FORECASTS}, g AS (SELECT *, avg(rose::INT) OVER (PARTITION BY p) AS rate, row_number() OVER (ORDER BY p) - 1 AS k, count(*) OVER () AS n FROM fc) "
    f"SELECT k // ((n + 6) // 7) AS chunk, {_r('avg(p)')} AS forecast, {_r('avg(rate)')} AS win_rate, count(*) AS n FROM g GROUP BY 1",
)
def _calibration_chunks(spark, sf_dir):
    rows = models.rank_forecasts(event_bars(spark, sf_dir))
    return evaluate.calibration_chunks(rows.select("p", F.col("rose").alias("won")), 7)


@_query(
    "calibration_metrics",
    f"{_FORECASTS}, c AS (SELECT greatest(1e-15, least(1 - 1e-15, p)) AS q, p, rose::INT AS y FROM fc), b AS (SELECT least(floor(p * 10), 9) AS bin, sum(p) AS f, sum(y) AS y FROM c GROUP BY 1), "
    "m AS (SELECT avg(pow(q - y, 2)) AS brier, avg(pow(0.45::DOUBLE - y, 2)) AS base, avg(-ln(CASE WHEN y = 1 THEN q ELSE 1 - q END)) AS loss, count(*) AS n FROM c) "
    f"SELECT {_r('brier')} AS brier, {_r('base')} AS baseline_brier, {_r('1 - brier / base')} AS skill, {_r('loss')} AS log_loss, {_r('(SELECT sum(abs(f - y)) FROM b) / n')} AS ece, n FROM m",
)
def _calibration_metrics(spark, sf_dir):
    rows = models.rank_forecasts(event_bars(spark, sf_dir))
    return evaluate.calibration_metrics(rows.select("p", F.col("rose").alias("won")), 0.45)


_TENORS = (1, 2, 3, 5, 7, 10)


def _quotes(spark, sf_dir):
    """A curve for each supplier: half-year zero rates and par swaps of six tenors, paying once, twice or four times a year."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("curve"))
    base = 0.01 + F.col("curve") % 40 / 1000.0
    each = s.withColumn("years", F.explode(F.array(F.lit(0), *map(F.lit, _TENORS))))
    reference = F.to_date(F.lit("2024-01-31"))
    zero = F.col("years") == 0
    return each.select("curve", reference.alias("reference"), F.add_months(reference, F.when(zero, 6).otherwise(F.col("years") * 12 + F.col("curve").cast("int") % 3)).alias("maturity"), F.when(zero, "zero").otherwise("swap").alias("kind"), (base + F.col("years") * 0.001).alias("rate"), F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (F.col("curve") % 3 + 1).cast("int")).alias("frequency"), "years")


@_query("curve_bootstrap", f"SELECT s_suppkey AS curve, years, {_r('0.01 + (s_suppkey % 40) / 1000 + years * 0.001::DOUBLE')} AS par_rate FROM supplier, (SELECT unnest([1, 2, 3, 5, 7, 10]) AS years)")
def _curve_bootstrap(spark, sf_dir):
    """Every swap priced on the curve solved from it must give its quote back, which is what the SQL says."""
    quotes = _quotes(spark, sf_dir)
    solved = curves.bootstrap(quotes)
    swaps = quotes.filter("kind = 'swap'").join(solved, ["curve", "reference"])
    periods = curves.swap_periods(F.col("reference"), F.col("maturity"), F.col("frequency"), "act/365")
    return swaps.select("curve", F.col("years").cast("int").alias("years"), curves.par_rate(F.col("nodes"), periods).alias("par_rate"))


@_query(
    "volatility_lookup",
    "WITH g AS (SELECT n_nationkey AS k, t, strike, 0.15::DOUBLE + n_nationkey / 200 + 0.02::DOUBLE * t + pow((strike - 100) / 200, 2) AS vol FROM nation, (SELECT unnest([0.25, 0.5, 1.0, 2.0])::DOUBLE AS t), (SELECT unnest([60.0, 80.0, 100.0, 120.0, 150.0])::DOUBLE AS strike)), "
    "x AS (SELECT c_custkey, c_nationkey AS k, (c_custkey % 26)::DOUBLE / 10 AS t, (45 + c_custkey % 121)::DOUBLE AS s FROM customer), y AS (SELECT *, least(greatest(t, 0.25), 2) AS tt, least(greatest(s, 60), 150) AS ss FROM x), "
    "e AS (SELECT y.*, (SELECT max(t) FROM g WHERE g.t <= tt) AS t0, (SELECT min(t) FROM g WHERE g.t >= tt) AS t1, (SELECT max(strike) FROM g WHERE strike <= ss) AS s0, (SELECT min(strike) FROM g WHERE strike >= ss) AS s1 FROM y), "
    "w AS (SELECT e.*, CASE WHEN t1 > t0 THEN (tt - t0) / (t1 - t0) ELSE 0 END AS tw, CASE WHEN s1 > s0 THEN (ss - s0) / (s1 - s0) ELSE 0 END AS sw, a.vol AS v00, b.vol AS v01, c.vol AS v10, d.vol AS v11 FROM e JOIN g a ON a.k = e.k AND a.t = t0 AND a.strike = s0 JOIN g b ON b.k = e.k AND b.t = t0 AND b.strike = s1 JOIN g c ON c.k = e.k AND c.t = t1 AND c.strike = s0 JOIN g d ON d.k = e.k AND d.t = t1 AND d.strike = s1) "
    f"SELECT c_custkey, {_r('CASE WHEN t <= 2.25 AND s >= 51 AND s <= 159 THEN (1 - tw) * ((1 - sw) * v00 + sw * v01) + tw * ((1 - sw) * v10 + sw * v11) END')} AS volatility FROM w",
)
def _volatility_lookup(spark, sf_dir):
    """A surface for each nation, looked up by its customers inside and outside its validity."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    points = read("nation").withColumn("t", F.explode(F.array(*map(F.lit, (0.25, 0.5, 1.0, 2.0))))).withColumn("strike", F.explode(F.array(*map(F.lit, (60.0, 80.0, 100.0, 120.0, 150.0)))))
    vol = 0.15 + F.col("n_nationkey") / 200 + 0.02 * F.col("t") + F.pow((F.col("strike") - 100) / 200, 2)
    made = curves.surfaces(points.select(F.col("n_nationkey").alias("c_nationkey"), "t", "strike", vol.alias("vol")), ["c_nationkey"])
    found = read("customer").join(made, "c_nationkey")
    years, strike = (F.col("c_custkey") % 26).cast("double") / 10, (45 + F.col("c_custkey") % 121).cast("double")
    return found.select("c_custkey", curves.volatility_at(F.col("maturities"), F.col("strikes"), F.col("grid"), years, strike).alias("volatility"))


# -- swing nodes and ratio patterns ---------------------------------------------------------------------------------------

_MEAN_BARS = (
    f"raw AS ({ORDER_BARS_SQL}), bars AS (SELECT series, ts, round(avg(high) OVER f, 4) AS high, round(avg(low) OVER f, 4) AS low, round(avg(close) OVER f, 4) AS close FROM raw WINDOW f AS (PARTITION BY series ORDER BY ts ROWS 9 PRECEDING))"
)


def _mean_bars(spark, sf_dir):
    """Daily bars as means of ten, as single days jump too far for patterns of many legs."""
    last = Window.partitionBy("series").orderBy("ts").rowsBetween(-9, 0)
    return order_bars(spark, sf_dir).select("series", "ts", *[F.round(F.avg(c).over(last), 4).alias(c) for c in ("high", "low", "close")])


_SWING_NODES = (
    f"WITH RECURSIVE {_MEAN_BARS}, nb AS (SELECT series, ts, high, low, close, row_number() OVER {_W} AS i FROM bars), "
    f"pv AS (SELECT series, i AS found_at, ts AS found_ts, i - 3 AS spot, lag(ts, 3) OVER {_W} AS node_ts, CASE WHEN lag(high, 3) OVER {_W} >= max(high) OVER f THEN lag(high, 3) OVER {_W} END AS h, CASE WHEN lag(low, 3) OVER {_W} <= min(low) OVER f THEN lag(low, 3) OVER {_W} END AS l FROM nb WINDOW f AS (PARTITION BY series ORDER BY ts ROWS 6 PRECEDING)), "
    "pk AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY spot) AS k FROM pv WHERE spot > 3 AND (h IS NOT NULL OR l IS NOT NULL)), "
    # the running node before the k-th pivot's other side is looked at (mp, mat, mts), then after it
    "st AS (SELECT series, 0::BIGINT AS k, 0 AS side, NULL::DOUBLE AS p, NULL::BIGINT AS spot, NULL::TIMESTAMP AS node_ts, NULL::BIGINT AS turned, false AS fixes, NULL::DOUBLE AS mp, NULL::BIGINT AS mat, NULL::TIMESTAMP AS mts, NULL::BIGINT AS found_at, NULL::TIMESTAMP AS found_ts FROM (SELECT DISTINCT series FROM pk) UNION ALL "
    "SELECT series, k, CASE WHEN fixes THEN -side WHEN side <> 0 THEN side WHEN h IS NOT NULL AND l IS NOT NULL THEN 0 WHEN h IS NOT NULL THEN 1 ELSE -1 END, CASE WHEN fixes THEN other WHEN side <> 0 THEN mp WHEN h IS NULL OR l IS NULL THEN coalesce(h, l) END, "
    "CASE WHEN fixes OR side = 0 THEN pat ELSE mat END, CASE WHEN fixes OR side = 0 THEN pts ELSE mts END, CASE WHEN fixes THEN pat ELSE turned END, fixes, mp, mat, mts, found_at, found_ts "
    "FROM (SELECT *, side <> 0 AND other IS NOT NULL AND side * (mp - other) > 0 AND side * (mp - other) / abs(mp) >= 0.01::DOUBLE AND (turned IS NULL OR pat >= turned + 2) AS fixes "
    "FROM (SELECT s.series, pk.k, s.side, s.turned, h, l, pk.spot AS pat, pk.node_ts AS pts, pk.found_at, pk.found_ts, CASE s.side WHEN 1 THEN l WHEN -1 THEN h END AS other, "
    "CASE WHEN s.side = 1 AND h > p THEN h WHEN s.side = -1 AND l < p THEN l ELSE p END AS mp, CASE WHEN s.side = 1 AND h > p OR s.side = -1 AND l < p THEN pk.spot ELSE s.spot END AS mat, CASE WHEN s.side = 1 AND h > p OR s.side = -1 AND l < p THEN pk.node_ts ELSE s.node_ts END AS mts "
    "FROM st s JOIN pk ON pk.series = s.series AND pk.k = s.k + 1))), "
    "nd AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY k) AS nth, (-side)::INT AS side, mp AS price, mat AS spot, mts AS node_ts, found_at, found_ts FROM st WHERE fixes)"
)
_FIT = "VALUES " + ", ".join("(" + ", ".join([f"'{row[0]}'", *(f"{v!r}::DOUBLE" for v in row[1:])]) + ")" for row in patterns.HARMONIC_RATIOS)


def _harmonic_sql(complete: bool) -> str:
    back = 4 if complete else 3
    lags = ", ".join(f"lag(price, {back - k}) OVER n AS {p}" for k, p in enumerate("xabcd"[: back + 1]))
    shares = ["abs(b - a) / abs(a - x) AS b_share", "abs(c - b) / abs(b - a) AS c_share", "abs(d - a) / abs(a - x) AS d_share", "abs(d - c) / abs(c - b) AS cd_share"][: 4 if complete else 2]
    fits = " AND ".join(f"{n}_share >= {n}_min - 0.03::DOUBLE AND {n}_share <= {n}_max + 0.03::DOUBLE" for n in (("b", "c", "d", "cd") if complete else ("b", "c")))
    shown = ", ".join(f"{_r(c)} AS {c}" for c in [*"xabcd"[: back + 1], *[s.rpartition(" ")[2] for s in shares], "zone_low", "zone_high"])
    reached = "last_at" if complete else "(SELECT min(i) FROM nb WHERE nb.series = w.series AND i > last_at AND i <= coalesce(until, i) AND CASE WHEN bullish THEN low <= zone_high ELSE high >= zone_low END)"
    seen = "last_ts" if complete else "(SELECT ts FROM nb WHERE nb.series = y.series AND i = reached)"
    return (
        f"{_SWING_NODES}, q AS (SELECT series, lag(node_ts, {back}) OVER n AS x_ts, node_ts AS last_ts, spot AS last_at, found_at, found_ts, lead(found_at, 3) OVER n AS until, lag(side, {back}) OVER n = -1 AS bullish, {lags} FROM nd WINDOW n AS (PARTITION BY series ORDER BY nth)), "
        f"r AS (SELECT *, {', '.join(shares)} FROM q WHERE x <> a AND a <> b AND b <> c), t AS (SELECT * FROM r, ({_FIT}) AS ratio(pattern, b_min, b_max, c_min, c_max, d_min, d_max, cd_min, cd_max) WHERE {fits}), "
        "u AS (SELECT *, a - (d_min + d_max) / 2 * (a - x) AS e1, c - (cd_min + cd_max) / 2 * (c - b) AS e2, c + (b - a) AS e3, 0.005::DOUBLE * abs(a - x) AS thin FROM t), v AS (SELECT *, least(e1, e2, e3) AS lo, greatest(e1, e2, e3) AS hi FROM u), "
        "w AS (SELECT *, CASE WHEN hi - lo < thin THEN (hi + lo) / 2 - thin / 2 ELSE lo END AS zone_low, CASE WHEN hi - lo < thin THEN (hi + lo) / 2 + thin / 2 ELSE hi END AS zone_high FROM v), "
        f"y AS (SELECT *, {reached} AS reached FROM w), g AS (SELECT *, {seen} AS reached_ts, (SELECT arg_min(struct_pack(ts := ts, turned := (close > zone_high) = bullish), i) FROM nb WHERE nb.series = y.series AND i >= reached AND i > last_at AND i <= coalesce(until, i) "
        "AND CASE WHEN bullish THEN close < zone_low OR close > zone_high AND i > reached ELSE close > zone_high OR close < zone_low AND i > reached END) AS fate FROM y) "
        f"SELECT series, pattern, bullish, x_ts, last_ts, last_at, found_at, found_ts, until, {shown}, CASE WHEN fate.turned THEN 'confirmed' WHEN NOT fate.turned THEN 'invalidated' WHEN until IS NOT NULL THEN 'dropped' WHEN reached IS NOT NULL THEN 'complete' ELSE 'candidate' END AS state, reached_ts, CASE WHEN fate IS NOT NULL THEN greatest(fate.ts, found_ts) END AS decided_ts FROM g"
    )


@_query("swing_nodes", f"{_SWING_NODES} SELECT series, nth, side, {_r('price')} AS price, spot AS \"at\", node_ts, found_at, found_ts FROM nd")
def _swing_nodes(spark, sf_dir):
    return patterns.swing_nodes(_mean_bars(spark, sf_dir))


@_query("harmonic_patterns", _harmonic_sql(True))
def _harmonic_patterns(spark, sf_dir):
    """Five-point patterns of all series with their zones and fates."""
    return patterns.harmonic_patterns(_mean_bars(spark, sf_dir))


@_query("harmonic_projections", _harmonic_sql(False))
def _harmonic_projections(spark, sf_dir):
    """Patterns that lack their last point, the zone in which it is expected, and what became of them."""
    return patterns.harmonic_patterns(_mean_bars(spark, sf_dir), complete=False)


# -- chart shapes ---------------------------------------------------------------------------------------------------------


def _shape_sql() -> str:
    """Every shape between the nodes: `up` and `down` as price and slope at the last node's time."""
    lags = ", ".join(f"lag(price, {k}) OVER n AS p{k}, lag(epoch(node_ts), {k}) OVER n AS t{k}, lag(node_ts, {k}) OVER n AS n{k}, lag(nth, {k}) OVER n AS k{k}" for k in range(5))
    m = lambda i, j: f"((p{j} - p{i}) / (t{j} - t{i}))"
    at = lambda i, j, k: f"(p{i} + {m(i, j)} * (t{k} - t{i}))"
    near = lambda a, b, s: f"abs(p{a} - p{b}) <= 0.02::DOUBLE * abs(p{s})"
    fit = lambda a, b, s: f"greatest(0, 1 - abs(p{a} - p{b}) / (0.02::DOUBLE * abs(p{s})))"

    def shape(nodes, kind, holds, goodness, bias, up, down, goal=("NULL", "NULL")):
        """Lines are (price at t0, slope) in SQL."""
        lines = ", ".join(f"({c})::DOUBLE AS {n}" for n, c in zip(("up_p", "up_m", "down_p", "down_m", "goal_p", "goal_m"), (*up, *down, *goal)))
        return f"SELECT series, k0, k{nodes - 1} AS first_nth, n{nodes - 1} AS first_ts, n0, t0, last_at, found_at, found_ts, until, {kind} AS kind, {nodes} AS nodes, ({goodness})::DOUBLE AS fit, ({bias})::INT AS bias, {lines} FROM nl WHERE p{nodes - 1} IS NOT NULL AND {holds}"

    flat = lambda p: (f"p{p}" if isinstance(p, int) else p, "0")
    either = lambda high, low: tuple(f"CASE WHEN side = 1 THEN {h} ELSE {lo} END" for h, lo in zip(high, low))
    even, odd = (at(2, 0, 0), m(2, 0)), (at(3, 1, 0), m(3, 1))
    hi_s, lo_s = either((at(2, 0, 3), at(3, 1, 3)), (at(3, 1, 3), at(2, 0, 3)))
    (hi_e, hi_m), (lo_e, lo_m) = either(even, odd), either(odd, even)
    wide = f"SELECT *, {hi_s} AS hs, {lo_s} AS ls, {hi_e} AS he, {hi_m} AS hm, {lo_e} AS le, {lo_m} AS lm FROM nl WHERE p3 IS NOT NULL"
    kinds = (
        "CASE WHEN he - le > hs - ls THEN CASE WHEN abs(he - hs) / (hs - ls) >= 0.015 AND abs(le - ls) / (hs - ls) >= 0.015 AND hm > 0 AND lm < 0 THEN 'broadening' END WHEN he - le < hs - ls THEN CASE WHEN hm > 0 AND lm > 0 THEN 'rising_wedge' WHEN hm < 0 AND lm < 0 THEN 'falling_wedge' "
        "WHEN abs(he - hs) / (hs - ls) < 0.015 AND lm > 0 THEN 'ascending_triangle' WHEN abs(le - ls) / (hs - ls) < 0.015 AND hm < 0 THEN 'descending_triangle' WHEN hm <= 0 AND lm >= 0 THEN 'triangle' END END"
    )
    channels = shape(4, kinds, "hs > ls AND he > le", "1 - least(hs - ls, he - le) / greatest(hs - ls, he - le)", "0", ("he", "hm"), ("le", "lm")).replace("FROM nl", f"FROM ({wide})")
    steep, across = f"{m(3, 1)} - {m(4, 2)}", f"p0 - {at(4, 2, 0)}"
    waves = f"CASE WHEN side = 1 THEN p2 > p4 AND p1 < p4 AND p1 > p3 AND {steep} > 0 AND {across} > 0 ELSE p2 < p4 AND p1 > p4 AND p1 < p3 AND {steep} < 0 AND {across} < 0 END"
    apart = lambda k: f"(-side * ({at(3, 1, k)} - {at(4, 2, k)}))"
    gap = lambda k: f"(-side * ({at(3, 1, k)} - {at(2, 0, k)}))"
    flag = f"CASE WHEN side = 1 THEN p1 > p3 AND p0 > p2 AND greatest(p0, p2) - p3 <= (p4 - p3) / 2 ELSE p1 < p3 AND p0 < p2 AND p3 - least(p0, p2) <= (p3 - p4) / 2 END AND {gap(3)} > 0 AND {gap(0)} > 0 AND abs({gap(0)} - {gap(3)}) / {gap(3)} <= 0.25"
    parts = [channels]
    for side, name in ((1, ("double_top", "triple_top", "head_and_shoulders", "inverse_cup_and_handle")), (-1, ("double_bottom", "triple_bottom", "inverse_head_and_shoulders", "cup_and_handle"))):
        best, other, more = ("greatest", "least", ">") if side == 1 else ("least", "greatest", "<")
        lines = lambda neck, end: (end, neck) if side == 1 else (neck, end)  # noqa: E731,B023
        mine = f"side = {side} AND "
        parts += [
            shape(3, "'reversal_123'", f"{mine}p0 {more} p2", "least(1, abs(p0 - p2) / abs(p2))", str(side), *(((flat(0), flat(1))) if side == 1 else (flat(1), flat(0)))),
            shape(3, f"'{name[0]}'", f"{mine}{near(2, 0, 2)} AND NOT {near(2, 1, 2)}", fit(2, 0, 2), str(-side), *lines(flat(1), flat(f"{best}(p0, p2)"))),
            shape(5, f"'{name[1]}'", f"{mine}{near(4, 2, 4)} AND {near(4, 0, 4)} AND NOT {near(4, 3, 4)}", f"{fit(4, 2, 4)} * {fit(4, 0, 4)}", str(-side), *lines(flat(f"{other}(p1, p3)"), flat(f"{best}(p0, p2, p4)"))),
            shape(5, f"'{name[2]}'", f"{mine}p2 {more} p4 AND p2 {more} p0 AND {near(4, 0, 2)} AND {near(3, 1, 2)}", f"{fit(4, 0, 2)} * {fit(3, 1, 2)}", str(-side), *lines(odd, flat(2))),
            shape(4, f"'{name[3]}'", f"{mine}{near(3, 1, 3)} AND NOT {near(3, 2, 3)} AND NOT p0 {more} (p1 + p2) / 2 AND 2 * (t0 - t1) <= t1 - t3", fit(3, 1, 3), str(-side), *((flat(0), flat(1)) if side == 1 else (flat(1), flat(0)))),
            shape(5, "'wolfe_wave'", f"{mine}{waves}", f"greatest(0, least(1, 1 - {apart(0)} / greatest({apart(4)}, 1e-9)))", str(-side), flat(0), flat(0), (at(4, 1, 0), m(4, 1))),
            shape(5, "'flag'", f"{mine}{flag}", f"1 - abs({gap(0)} - {gap(3)}) / {gap(3)} / 0.25", str(-side), *((even, odd) if side == 1 else (odd, even))),
        ]
    return f"nl AS (SELECT series, side, spot AS last_at, found_at, found_ts, lead(found_at, 3) OVER n AS until, {lags} FROM nd WINDOW n AS (PARTITION BY series ORDER BY nth)), sh AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE kind IS NOT NULL)"


def _outcome_sql(shapes_of: str) -> str:
    """The first deciding bar by a scan of all bars from the last node to `until`."""
    x = "(epoch(nb.ts) - t0)"
    up, down, goal = (f"({n}_p + {n}_m * {x})" for n in ("up", "down", "goal"))
    rises, falls = f"(close > {up} AND coalesce(close <= {goal}, true))", f"(close < {down} AND coalesce(close >= {goal}, true))"
    won, lost = f"(bias >= 0 AND {rises} OR bias <= 0 AND {falls})", f"(bias > 0 AND close < {down} OR bias < 0 AND close > {up})"
    risen = f"(bias > 0 OR bias = 0 AND {rises})"
    return (
        f"dc AS (SELECT q.*, (SELECT arg_min(struct_pack(ts := nb.ts, won := {won}, bull := {risen}, lvl := CASE WHEN {risen} THEN {up} ELSE {down} END, goal := {goal}), nb.i) FROM nb WHERE nb.series = q.series AND nb.i > last_at AND nb.i <= coalesce(until, nb.i) AND ({won} OR {lost})) AS fate FROM {shapes_of} q) "
        "SELECT series, first_nth, k0 AS last_nth, first_ts, n0 AS last_ts, kind, nodes, " + _r("fit") + " AS fit, CASE WHEN fate.won THEN 'confirmed' WHEN NOT fate.won THEN 'invalidated' WHEN until IS NOT NULL THEN 'dropped' ELSE 'forming' END AS state, "
        "CASE WHEN fate.won THEN fate.bull WHEN bias <> 0 THEN bias > 0 END AS bullish, " + _r("CASE WHEN fate.won THEN fate.lvl END") + " AS level, " + _r("CASE WHEN fate.won THEN fate.goal END") + " AS goal_price, CASE WHEN fate IS NOT NULL THEN greatest(fate.ts, found_ts) END AS decided_ts FROM dc"
    )


_SHOWN = ("series", "first_nth", "last_nth", "first_ts", "last_ts", "kind", "nodes", "fit", "state", "bullish", "level", "goal_price", "decided_ts")


@_query("chart_patterns", f"{_SWING_NODES}, {_shape_sql()}, {_outcome_sql('sh')}")
def _chart_patterns(spark, sf_dir):
    """Every chart shape of every series with its outcome."""
    return shapes.chart_patterns(_mean_bars(spark, sf_dir)).select(*_SHOWN)


@_query(
    "chart_patterns_apart",
    f"{_SWING_NODES}, {_shape_sql()}, rk AS (SELECT series, kind, k0, first_nth, row_number() OVER (PARTITION BY series, kind ORDER BY fit DESC, k0) AS k FROM sh), "
    "ch AS (SELECT DISTINCT series, kind, 0::BIGINT AS k, []::STRUCT(a BIGINT, b BIGINT)[] AS kept FROM rk UNION ALL SELECT ch.series, ch.kind, rk.k, CASE WHEN len(list_filter(kept, lambda x: x.a <= rk.k0 AND rk.first_nth <= x.b)) = 0 THEN list_append(kept, {'a': first_nth, 'b': k0}) ELSE kept END FROM ch JOIN rk ON rk.series = ch.series AND rk.kind = ch.kind AND rk.k = ch.k + 1), "
    f"kp AS (SELECT series, kind, unnest(arg_max(kept, k)).b AS k0 FROM ch GROUP BY 1, 2), ap AS (SELECT sh.* FROM sh SEMI JOIN kp USING (series, kind, k0)), {_outcome_sql('ap')}",
)
def _chart_patterns_apart(spark, sf_dir):
    """Of shapes of one kind that share nodes, only the best."""
    return shapes.chart_patterns(_mean_bars(spark, sf_dir), apart=True).select(*_SHOWN)


@_query(
    "fitted_lines",
    f"{_SWING_NODES}, e AS (SELECT series, side, arg_min(struct_pack(t := node_ts, p := price), nth) AS a, arg_max(struct_pack(t := node_ts, p := price), nth) AS b, count(*) AS touches FROM nd GROUP BY 1, 2 HAVING count(*) > 1), f AS (SELECT *, (b.p - a.p) / (epoch(b.t) - epoch(a.t)) AS m FROM e) "
    "SELECT series, side, a.t AS first_ts, round(a.p + 1e-9, 3) AS first_price, b.t AS last_ts, round(b.p + 1e-9, 3) AS last_price, round(m * 86400 + 1e-9, 3) AS slope, touches, least(1, (touches - 2) / 4 + 0.5)::DOUBLE AS fit FROM f "
    "WHERE NOT EXISTS (SELECT 1 FROM nd WHERE nd.series = f.series AND nd.side = f.side AND nd.side * (price - (a.p + m * (epoch(node_ts) - epoch(a.t))) * (1 + nd.side * 0.8::DOUBLE)) > 0)",
)
def _fitted_lines(spark, sf_dir):
    """Lines over all highs and under all lows of a series; at 80 percent, as the prices jump by half."""
    cut = lambda c: F.round(F.col(c) + 1e-9, 3).alias(c)
    found = shapes.fitted_lines(patterns.swing_nodes(_mean_bars(spark, sf_dir)), 80.0).withColumn("slope", F.col("slope") * 86400)
    return found.select("series", "side", "first_ts", cut("first_price"), "last_ts", cut("last_price"), cut("slope"), "touches", "fit")


# -- profiles -------------------------------------------------------------------------------------------------------------


@_query(
    "money_flow_profile",
    f"WITH RECURSIVE {_B.removeprefix('WITH ')}, nb AS (SELECT *, row_number() OVER {_W} AS i, min(low) OVER f AS p, (max(high) OVER f - min(low) OVER f) / 25 AS s FROM bars WINDOW f AS (PARTITION BY series ORDER BY ts ROWS 199 PRECEDING)), "
    "x AS (SELECT a.series, a.i, a.p, a.s, r, CASE WHEN b.volume > 0 THEN b.volume ELSE 1 END * greatest(0, least(b.high, a.p + r * a.s + a.s) - greatest(b.low, a.p + r * a.s)) / (b.high - b.low) * (a.p + (r + 0.5::DOUBLE) * a.s) AS t, greatest(0, least(1, (b.close - b.low) / (b.high - b.low))) AS k "
    "FROM nb a JOIN nb b ON b.series = a.series AND b.i <= a.i AND b.i > a.i - 200 AND b.high > b.low, range(25) AS bin(r) WHERE a.i > 1 AND a.s > 0), "
    "y AS (SELECT series, i, r, sum(t) AS t, sum(t * k) AS b FROM x GROUP BY ALL), "
    "l AS (SELECT series, i, list(t ORDER BY r) AS t, max(struct_pack(t := t, r := r)).r AS poc, max(struct_pack(d := abs(2 * b - t), r := -r)).r * -1 AS tilted, sum(t) AS total, sum(b) AS b FROM y GROUP BY ALL HAVING max(t) > 0), "
    "va AS (SELECT series, i, t, total, poc AS lo, poc AS hi, t[poc + 1] AS held FROM l UNION ALL SELECT series, i, t, total, CASE WHEN dn >= up THEN lo - 1 ELSE lo END, CASE WHEN dn >= up THEN hi ELSE hi + 1 END, held + greatest(dn, up) "
    "FROM (SELECT *, CASE WHEN lo > 0 THEN t[lo] ELSE -1 END AS dn, CASE WHEN hi < 24 THEN t[hi + 2] ELSE -1 END AS up FROM va WHERE held < 0.7::DOUBLE * total) WHERE greatest(dn, up) >= 0), "
    "e AS (SELECT series, i, min(lo) AS lo, max(hi) AS hi FROM va GROUP BY ALL), "
    "m AS (SELECT nb.series, nb.ts, nb.i, close, p + (poc + 0.5::DOUBLE) * s AS value, p + (hi + 1) * s AS vah, p + lo * s AS val, p + (tilted + 0.5::DOUBLE) * s AS delta_poc, b / total * 100 AS bull_pct FROM nb LEFT JOIN l USING (series, i) LEFT JOIN e USING (series, i)), "
    "z AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN struct_pack(c := close, h := vah, l := val, b := bull_pct) END IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM m), "
    "u AS (SELECT *, CASE WHEN value IS NOT NULL THEN coalesce(w.c <= w.h AND close > vah, false) END AS ou, CASE WHEN value IS NOT NULL THEN coalesce(w.c >= w.l AND close < val, false) END AS un FROM z) "
    f"SELECT series, ts, {_r('value')} AS value, {_r('vah')} AS vah, {_r('val')} AS val, {_r('delta_poc')} AS delta_poc, {_r('bull_pct')} AS bull_pct, ou AS bull_value_area_break, un AS bear_value_area_break, "
    "CASE WHEN value IS NOT NULL THEN coalesce(w.b <= 50 AND bull_pct > 50, false) END AS bull_bias, CASE WHEN value IS NOT NULL THEN coalesce(w.b >= 50 AND bull_pct < 50, false) END AS bear_bias, "
    f"{_r('CASE WHEN ou THEN least(1, (close - vah) / (vah - val)) WHEN un THEN least(1, (val - close) / (vah - val)) END')} AS strength FROM u",
)
def _money_flow_profile(spark, sf_dir):
    return profiles.money_flow_profile(event_bars(spark, sf_dir))


_NODE_BINS = (
    f"WITH RECURSIVE {_B.removeprefix('WITH ')}, nb AS (SELECT *, row_number() OVER {_W} AS i, min(low) OVER f AS p, (max(high) OVER f - min(low) OVER f) / 30 AS s, max(high) OVER f - min(low) OVER f AS span, min(ts) OVER f AS from_ts, CASE WHEN volume > 0 THEN volume ELSE high - low END AS size, CASE WHEN volume > 0 AND high > low THEN least(1, greatest(0, (close - low) / (high - low))) ELSE 0.5 END AS bought FROM bars WINDOW f AS (PARTITION BY series ORDER BY ts ROWS 69 PRECEDING)), "
    "x AS (SELECT a.series, a.i, b.i AS j, b.size, b.bought, least(29, floor((b.low - a.p) / a.s))::BIGINT AS lo, least(29, floor((b.high - a.p) / a.s))::BIGINT AS hi FROM nb a JOIN nb b ON b.series = a.series AND b.i <= a.i AND b.i > a.i - 70 WHERE a.i >= 70 AND a.span >= 1e-8), "
    "y AS (SELECT series, i, r, coalesce(sum(size / (hi - lo + 1) ORDER BY j) FILTER (r >= lo AND r <= hi), 0) AS v, coalesce(sum(size / (hi - lo + 1) * (2 * bought - 1) ORDER BY j) FILTER (r >= lo AND r <= hi), 0) AS d FROM x, range(30) AS bin(r) GROUP BY ALL), "
    "l AS (SELECT series, i, list(v ORDER BY r) AS v, max(struct_pack(v := v, r := -r)).r * -1 AS poc, sum(v ORDER BY r) AS total, sum(d ORDER BY r) AS delta FROM y GROUP BY ALL), "
    "kc AS (SELECT series, i, r, v, total, CASE WHEN v >= total / 30 * 1.5 THEN 1 WHEN v <= total / 30 * 0.5 THEN -1 ELSE 0 END AS c FROM y JOIN (SELECT series, i, total FROM l) USING (series, i)), "
    "ki AS (SELECT *, sum(turn) OVER (PARTITION BY series, i ORDER BY r) AS run FROM (SELECT *, CASE WHEN c = lag(c) OVER (PARTITION BY series, i ORDER BY r) THEN 0 ELSE 1 END AS turn FROM kc)), "
    "zn AS (SELECT series, i, c, min(r) AS a, max(r) + 1 AS b, sum(v) / any_value(total) AS strength FROM ki WHERE c <> 0 GROUP BY series, i, c, run)"
)


@_query(
    "extended_volume_profile",
    f"{_NODE_BINS}, va AS (SELECT series, i, v, total, poc AS lo, poc AS hi, v[poc + 1] AS held FROM l UNION ALL SELECT series, i, v, total, CASE WHEN up >= dn THEN lo ELSE lo - 1 END, CASE WHEN up >= dn THEN hi + 1 ELSE hi END, held + greatest(dn, up) "
    "FROM (SELECT *, CASE WHEN lo > 0 THEN v[lo] ELSE -1 END AS dn, CASE WHEN hi < 29 THEN v[hi + 2] ELSE -1 END AS up FROM va WHERE held < 0.7::DOUBLE * total) WHERE greatest(dn, up) >= 0), "
    "e AS (SELECT series, i, min(lo) AS lo, max(hi) AS hi FROM va GROUP BY ALL), zc AS (SELECT series, i, count(*) FILTER (c = 1) AS high_zones, count(*) FILTER (c = -1) AS low_zones FROM zn GROUP BY ALL) "
    f"SELECT series, ts, {_r('p + (poc + 0.5::DOUBLE) * s')} AS value, {_r('p + (hi + 1) * s')} AS vah, {_r('p + lo * s')} AS val, CASE WHEN poc IS NOT NULL THEN from_ts END AS from_ts, {_r('delta')} AS delta, CASE WHEN poc IS NOT NULL THEN coalesce(high_zones, 0) END AS high_zones, CASE WHEN poc IS NOT NULL THEN coalesce(low_zones, 0) END AS low_zones "
    "FROM nb LEFT JOIN l USING (series, i) LEFT JOIN e USING (series, i) LEFT JOIN zc USING (series, i)",
)
def _extended_volume_profile(spark, sf_dir):
    found = profiles.extended_profile(event_bars(spark, sf_dir))
    zones_of = lambda kind: F.when(F.col("zones").isNotNull(), F.size(F.filter("zones", lambda z: z["kind"] == kind))).cast("long")
    return found.select("series", "ts", "value", "vah", "val", "from_ts", F.aggregate("deltas", F.lit(0.0), lambda a, x: a + x).alias("delta"), zones_of("hvn_zone").alias("high_zones"), zones_of("lvn_zone").alias("low_zones"))


@_query(
    "volume_node_zones",
    f"{_NODE_BINS} SELECT series, ts, from_ts, CASE WHEN c = 1 THEN 'hvn_zone' ELSE 'lvn_zone' END AS kind, {_r('p + a * s')} AS bottom, {_r('p + b * s')} AS top, {_r('strength')} AS strength FROM zn JOIN nb USING (series, i)",
)
def _volume_node_zones(spark, sf_dir):
    """Runs of bins with much or little volume, for each bar's window."""
    each = profiles.extended_profile(event_bars(spark, sf_dir)).select("series", "ts", "from_ts", F.explode_outer("zones").alias("z")).filter("z IS NOT NULL")
    return each.select("series", "ts", "from_ts", "z.*")


_BIN_LIVES = (
    f"{_B}, gr AS (SELECT series, ts, row_number() OVER {_W} AS j, floor(low)::BIGINT AS lo, floor(high)::BIGINT AS hi, (CASE WHEN volume > 0 THEN volume ELSE high - low END) / (floor(high) - floor(low) + 1) AS each FROM bars), "
    "tc AS (SELECT series, ts, j, each, unnest(range(lo, hi + 1)) AS bin FROM gr)"
)
_PERSISTENT = (
    f"{_BIN_LIVES}, wb AS (SELECT a.series, a.j AS i, b.bin, count(*) AS touches, sum(b.each ORDER BY b.j) AS v, max(b.ts) AS last_ts FROM gr a JOIN tc b ON b.series = a.series AND b.j <= a.j AND b.j > a.j - 70 WHERE a.j >= 70 GROUP BY 1, 2, 3), "
    "md AS (SELECT series, i, median(v / touches) AS m FROM wb GROUP BY 1, 2), th AS (SELECT series, i, any_value(m) + 2.5 * 1.482602218505602::DOUBLE * median(abs(v / touches - m)) AS least, max(struct_pack(v := v, b := -bin)).b * -1 AS poc, count(*) AS n FROM wb JOIN md USING (series, i) GROUP BY 1, 2)"
)


@_query(
    "persistent_volume_profile",
    f"{_PERSISTENT}, ab AS (SELECT series, i, count(*) AS n_absorbing FROM wb JOIN th USING (series, i) WHERE v / touches > least GROUP BY 1, 2) SELECT th.series, ts, {_r('poc + 0.5::DOUBLE')} AS value, n AS n_bins, {_r('least')} AS threshold, coalesce(n_absorbing, 0) AS n_absorbing FROM th JOIN gr ON gr.series = th.series AND gr.j = i LEFT JOIN ab ON ab.series = th.series AND ab.i = th.i",
)
def _persistent_volume_profile(spark, sf_dir):
    found = profiles.persistent_profile(event_bars(spark, sf_dir))
    return found.select("series", "ts", "value", "n_bins", "threshold", F.aggregate("absorbing", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1).alias("n_absorbing"))


_LIVES = "lv AS (SELECT *, sum(CASE WHEN j - before <= 70 THEN 0 ELSE 1 END) OVER (PARTITION BY series, bin ORDER BY j) AS life FROM (SELECT *, lag(j) OVER (PARTITION BY series, bin ORDER BY j) AS before FROM tc)), lf AS (SELECT series, bin, life, min(ts) AS born_ts, max(ts) AS last_ts, max(j) AS last_j, count(*) AS touches, sum(each) AS volume FROM lv GROUP BY 1, 2, 3)"


@_query(
    "price_bin_lives",
    f"{_BIN_LIVES}, {_LIVES} SELECT lf.series, bin, bin::DOUBLE AS bottom, bin + 1.0::DOUBLE AS top, born_ts, last_ts, touches, {_r('volume')} AS volume, gr.ts AS expired_ts FROM lf LEFT JOIN gr ON gr.series = lf.series AND gr.j = last_j + 70",
)
def _price_bin_lives(spark, sf_dir):
    """Bins of one unit of price from their first touch until no bar of the last 70 touches them."""
    return profiles.bin_lives(event_bars(spark, sf_dir))


@_query(
    "absorption_zones",
    f"{_PERSISTENT}, {_LIVES} SELECT wb.series, gr.ts, wb.bin::DOUBLE AS bottom, wb.bin + 1.0::DOUBLE AS top, {_r('least(v / wb.touches, 1)')} AS strength, wb.touches, lf.born_ts AS from_ts, wb.last_ts FROM wb JOIN th USING (series, i) JOIN gr ON gr.series = wb.series AND gr.j = wb.i JOIN lv ON lv.series = wb.series AND lv.bin = wb.bin AND lv.ts = wb.last_ts JOIN lf ON lf.series = lv.series AND lf.bin = lv.bin AND lf.life = lv.life WHERE v / wb.touches > th.least",
)
def _absorption_zones(spark, sf_dir):
    """Bins whose volume for each touch stands out, bar by bar."""
    bars = event_bars(spark, sf_dir)
    found = profiles.absorption_zones(profiles.persistent_profile(bars), profiles.bin_lives(bars))
    return found.withColumn("touches", F.col("touches").cast("long"))
