"""Market structure, candle shapes, day levels, and composites of other operators."""

from __future__ import annotations

from .averages import op
from .oscillators import _gains, ratio
from .spec import CUM, Fold, P, operator, since, w
from .volatility import adx

DAY = "PARTITION BY series, day"
DAY_RUN = f"{DAY} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@operator("fvg", "smc")
def liquidity_fvg():
    """A gap between a bar and the one two before: 1 above it, -1 below it."""
    return op(
        [
            {"h2": f"lag(high, 2) {P}", "l2": f"lag(low, 2) {P}"},
            {"value": "CASE WHEN low > h2 THEN 1.0 WHEN high < l2 THEN -1.0 ELSE 0.0 END", "gap_size": "CASE WHEN low > h2 THEN low - h2 WHEN high < l2 THEN l2 - high ELSE 0.0 END"},
        ],
        ["value", "gap_size"],
    )


@operator()
def narrow_range(period=7):
    return op(
        [
            {"r": "high - low", "ph": f"lag(high, 1) {P}", "pl": f"lag(low, 1) {P}"},
            {"least": f"min(r) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN {period - 1} PRECEDING AND 1 PRECEDING)"},
            {"value": since("CASE WHEN r < least THEN 1.0 ELSE 0.0 END", period), "inside": since("CASE WHEN high <= ph AND low >= pl THEN 1.0 ELSE 0.0 END", period)},
        ],
        ["value", "inside"],
        period,
    )


def _pivots(left: int, right: int) -> list[dict]:
    """Strict pivots of the bar `right` rows back, known only now."""
    before = f"OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN {left + right} PRECEDING AND {right + 1} PRECEDING)"
    after = f"OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN {right - 1} PRECEDING AND CURRENT ROW)"
    return [
        {"ch": f"lag(high, {right}) {P}", "cl": f"lag(low, {right}) {P}", "bh": f"max(high) {before}", "bl": f"min(low) {before}", "ah": f"max(high) {after}", "al": f"min(low) {after}"},
        {"pivot_high": since("CASE WHEN ch > bh AND ch > ah THEN ch END", left + right + 1), "pivot_low": since("CASE WHEN cl < bl AND cl < al THEN cl END", left + right + 1)},
    ]


@operator()
def pivot_points(left_bars=5, right_bars=5):
    """Highs and lows that stand out of their neighbours, on the bar that confirms them."""
    return op(_pivots(left_bars, right_bars), ["pivot_high", "pivot_low"], left_bars + right_bars + 1)


@operator()
def williams_fractals(span=2):
    """Levels of the last confirmed up and down fractals; NULL until both exist."""
    return op(
        [
            *_pivots(span, span),
            {"up_run": f"count(pivot_high) {CUM}", "down_run": f"count(pivot_low) {CUM}"},
            {"up_held": "max(pivot_high) OVER (PARTITION BY series, up_run)", "down_held": "max(pivot_low) OVER (PARTITION BY series, down_run)"},
            {"value": "CASE WHEN up_run > 0 AND down_run > 0 THEN up_held END", "down_level": "CASE WHEN up_run > 0 AND down_run > 0 THEN down_held END"},
        ],
        ["value", "down_level"],
        2 * span + 1,
    )


def _last_day() -> list[dict]:
    """po, ph, pl, pq: open, high, low and close of the last completed day, or of the running one on the first day."""
    first = "CASE WHEN i = first_i THEN lag({}, 1) " + P + " END"
    return [
        {"day": "date_trunc('day', ts)"},
        {"first_i": f"min(i) OVER ({DAY})", "d_open": f"min_by(open, i) OVER ({DAY})", "d_high": f"max(high) OVER ({DAY})", "d_low": f"min(low) OVER ({DAY})", "d_close": f"max_by(close, i) OVER ({DAY})", "r_high": f"max(high) OVER ({DAY_RUN})", "r_low": f"min(low) OVER ({DAY_RUN})"},
        {f"f_{c}": first.format(f"d_{c}") for c in ("open", "high", "low", "close")},
        {
            "po": f"coalesce(max(f_open) OVER ({DAY}), d_open)",
            "ph": f"coalesce(max(f_high) OVER ({DAY}), r_high)",
            "pl": f"coalesce(max(f_low) OVER ({DAY}), r_low)",
            "pq": f"coalesce(max(f_close) OVER ({DAY}), close)",
            "known": f"max(f_close) OVER ({DAY})",
        },
    ]


def _levels(first: dict, second: dict) -> object:
    return op([*_last_day(), first, second], [*first, *second])


@operator("multi_pivots")
def pivot_sets():
    """Floor pivots of the last completed UTC day."""
    return _levels({"p": "(ph + pl + pq) / 3"}, {"r1": "2 * p - pl", "s1": "2 * p - ph", "r2": "p + (ph - pl)", "s2": "p - (ph - pl)", "r3": "ph + 2 * (p - pl)", "s3": "pl - 2 * (ph - p)"})


@operator()
def pivot_sets_fibonacci():
    return _levels({"p": "(ph + pl + pq) / 3"}, {f"{side}{k}": f"p {sign} {x} * (ph - pl)" for side, sign in (("r", "+"), ("s", "-")) for k, x in ((1, 0.382), (2, 0.618), (3, 1.0))})


@operator()
def pivot_sets_camarilla():
    return _levels({"p": "(ph + pl + pq) / 3"}, {f"{side}{k}": f"pq {sign} (ph - pl) * 1.1 / {d}" for side, sign in (("r", "+"), ("s", "-")) for k, d in ((1, 12), (2, 6), (3, 4), (4, 2))})


@operator()
def pivot_sets_woodie():
    return _levels({"p": "(ph + pl + 2 * pq) / 4"}, {"r1": "2 * p - pl", "s1": "2 * p - ph", "r2": "p + (ph - pl)", "s2": "p - (ph - pl)"})


@operator()
def pivot_sets_demark():
    return _levels({"x": "CASE WHEN pq < po THEN ph + 2 * pl + pq WHEN pq > po THEN 2 * ph + pl + pq ELSE ph + pl + 2 * pq END"}, {"p": "x / 4", "r1": "x / 2 - pl", "s1": "x / 2 - ph"})


@operator()
def pivot_sets_cpr():
    return _levels({"p": "(ph + pl + pq) / 3"}, {"tc": "greatest(2 * p - (ph + pl) / 2, (ph + pl) / 2)", "bc": "least(2 * p - (ph + pl) / 2, (ph + pl) / 2)"})


@operator()
def period_midpoint():
    """The middle of the last completed day, held through the next."""
    return op([*_last_day(), {"value": "CASE WHEN known IS NOT NULL THEN (ph + pl) / 2 END", "new_period": "CASE WHEN i = first_i THEN 1.0 ELSE 0.0 END"}], ["value", "new_period"], 2)


@operator()
def opening_range(orb_duration_mins=30):
    """High and low of each UTC day's first minutes; the running ones while they last."""
    inside = f"hour(ts) * 60 + minute(ts) < {orb_duration_mins}"
    return op(
        [
            {"day": "date_trunc('day', ts)", "in_orb": f"CASE WHEN {inside} THEN 1.0 ELSE 0.0 END"},
            {"oh": "CASE WHEN in_orb > 0 THEN high END", "ol": "CASE WHEN in_orb > 0 THEN low END", "first_i": f"min(i) OVER ({DAY})"},
            {"orb_high": f"max(oh) OVER ({DAY_RUN})", "orb_low": f"min(ol) OVER ({DAY_RUN})", "new_session": "CASE WHEN i = first_i THEN 1.0 ELSE 0.0 END", "in_orb_window": "in_orb"},
        ],
        ["orb_high", "orb_low", "in_orb_window", "new_session"],
    )


@operator("ha")
def heikin_ashi():
    """Averaged candles: the open is the mean of the last averaged open and close."""
    return op(
        [
            {"ha_close": "(open + high + low + close) / 4"},
            {"x": f"coalesce(lag(ha_close, 1) {P}, (open + close) / 2)"},
            {"ha_open": Fold("alpha_ema", "x", (0.5,))},
            {"ha_high": "greatest(high, ha_open, ha_close)", "ha_low": "least(low, ha_open, ha_close)"},
        ],
        ["ha_open", "ha_high", "ha_low", "ha_close"],
    )


def _pressure(n: int) -> list[dict]:
    return [
        {"location": "CASE WHEN high > low THEN 2 * (close - low) / greatest(high - low, 1e-8) - 1 ELSE 0.0 END", "wick_balance": "(least(open, close) - low - high + greatest(open, close)) / greatest(high - low, 1e-8)"},
        {"raw_pressure": "100 * (0.6 * location + 0.4 * wick_balance)"},
        {"smooth_pressure": Fold("ema", "raw_pressure", (n,))},
    ]


@operator("pressure")
def buy_sell_pressure(period=14):
    """Where closes and wicks lie in their bars, smoothed."""
    return op([*_pressure(period), {"value": since("least(100.0, greatest(-100.0, smooth_pressure))", period)}], ["value", "location", "wick_balance"], period)


@operator()
def trend_quality(period=14):
    """Direction of the mean times efficiency, trend strength and participation, -100 to 100."""
    n = period
    trend = adx(n, n)
    return op(
        [
            *[{("adx_value" if c == "value" else c): e for c, e in s.items()} for s in trend.stages],
            {"mean": Fold("ema", "close", (n,)), },
            {"slope": f"mean - lag(mean, 1) {P}", "step": "abs(close - pc)", "share": ratio("volume", f"avg(volume) {w(n)}", "0.0")},
            {"efficiency": ratio(f"abs(close - lag(close, {n}) {P})", f"sum(step) {w(n)}", "0.0")},
            {"direction": f"CASE WHEN adx_value IS NULL OR lag(adx_value, 1) {P} IS NULL THEN 0.0 WHEN slope > 0 THEN 1.0 WHEN slope < 0 THEN -1.0 ELSE 0.0 END", "strength": "least(adx_value / 50, 1.0)", "participation": "least(greatest(share / 2, 0.2), 1.0)"},
            {"value": since("100 * direction * efficiency * strength * participation", 2 * n)},
        ],
        ["value"],
        2 * n,
    )


@operator("price_location")
def price_place(atr_len=14, ema_len=20, range_len=50):
    """How far the close stands from its mean in ATRs, and where in its range."""
    return op(
        [
            {"mean": Fold("ema", "close", (ema_len,)), "atr": Fold("rma", "tr", (atr_len,))},
            {"hh": f"max(high) {w(range_len)}", "ll": f"min(low) {w(range_len)}"},
            {"value": since(ratio("close - mean", "atr", "0.0"), max(atr_len, ema_len)), "range_position": since(ratio("close - ll", "hh - ll", "0.5"), range_len)},
        ],
        ["value", "range_position"],
        range_len,
    )


@operator("regime")
def classify_regime():
    """1 rising trend, -1 falling trend, 0 consolidation, 2 transition: ADX over 20 with a 20-bar slope and side, else ATR share."""
    trend = adx(14, 14)
    return op(
        [
            *[{("adx_value" if c == "value" else c): e for c, e in s.items()} for s in trend.stages],
            {"atr": Fold("rma", "tr", (14,))},
            {"mean": f"avg(close) {w(20)}"},
            {"slope": f"mean / lag(mean, 1) {P} - 1"},
            {
                "value": since(
                    "CASE WHEN adx_value > 20 AND slope > 0.001 AND close > mean THEN 1.0 WHEN adx_value > 20 AND slope < -0.001 AND close < mean THEN -1.0 "
                    "WHEN adx_value > 20 THEN 2.0 WHEN adx_value IS NULL THEN NULL WHEN atr / close > 0.02 THEN 2.0 ELSE 0.0 END",
                    21,
                )
            },
        ],
        ["value"],
        28,
    )


#: Shape flags of one to three candles: body, shadow and range shares of the bar, and its neighbours.
CANDLES = {
    "doji": "body <= 0.1 * r",
    "marubozu": "body >= 0.9 * r AND r > 0",
    "hammer": "r > 0 AND low_wick >= 2 * body AND high_wick <= 0.1 * r AND body > 0",
    "shooting_star": "r > 0 AND high_wick >= 2 * body AND low_wick <= 0.1 * r AND body > 0",
    "bullish_engulfing": "close > open AND c1 < o1 AND close >= o1 AND open <= c1",
    "bearish_engulfing": "close < open AND c1 > o1 AND close <= o1 AND open >= c1",
    "bullish_harami": "c1 < o1 AND close > open AND open >= c1 AND close <= o1",
    "bearish_harami": "c1 > o1 AND close < open AND open <= c1 AND close >= o1",
    "piercing_line": "c1 < o1 AND close > open AND open < l1 AND close > (o1 + c1) / 2 AND close < o1",
    "dark_cloud_cover": "c1 > o1 AND close < open AND open > h1 AND close < (o1 + c1) / 2 AND close > o1",
    "three_white_soldiers": "close > open AND c1 > o1 AND c2 > o2 AND close > c1 AND c1 > c2",
    "three_black_crows": "close < open AND c1 < o1 AND c2 < o2 AND close < c1 AND c1 < c2",
    "morning_star": "c2 < o2 AND abs(c1 - o1) <= 0.3 * abs(c2 - o2) AND close > open AND close > (o2 + c2) / 2",
    "evening_star": "c2 > o2 AND abs(c1 - o1) <= 0.3 * abs(c2 - o2) AND close < open AND close < (o2 + c2) / 2",
    "inside_bar": "high <= h1 AND low >= l1",
    "outside_bar": "high > h1 AND low < l1",
}


@operator()
def candle_patterns():
    """One flag for each shape, and their count."""
    lags = {f"{c[0]}{k}": f"lag({c}, {k}) {P}" for c in ("open", "high", "low", "close") for k in (1, 2)}
    flags = {c: f"CASE WHEN {e} THEN 1.0 ELSE 0.0 END" for c, e in CANDLES.items()}
    return op(
        [
            {**lags, "body": "abs(close - open)", "r": "high - low", "high_wick": "high - greatest(open, close)", "low_wick": "least(open, close) - low"},
            flags,
            {"pattern_count": " + ".join(CANDLES)},
        ],
        [*CANDLES, "pattern_count"],
    )


@operator()
def connors_rsi(rsi_len=3, streak_len=2, rank_len=100):
    """Mean of a short RSI of closes, one of the streak length, and the half-tie percent rank of the last return."""
    first = rank_len + 2
    rank = " + ".join(f"CASE WHEN lag(ret, {k}) {P} < ret THEN 1.0 WHEN lag(ret, {k}) {P} = ret THEN 0.5 ELSE 0.0 END" for k in range(1, rank_len + 1))
    up = [{f"{c}1": (Fold(e.kernel, e.source + "1", e.args) if isinstance(e, Fold) else e.replace("ru", "ru1").replace("rd", "rd1")) for c, e in s.items()} for s in _gains(rsi_len)]
    move = [
        {"u2": "CASE WHEN i > 1 THEN greatest(streak - past, 0.0) END", "d2": "CASE WHEN i > 1 THEN greatest(past - streak, 0.0) END"},
        {"ru2": Fold("rma", "u2", (streak_len,)), "rd2": Fold("rma", "d2", (streak_len,))},
        {"raw2": "CASE WHEN ru2 IS NULL THEN NULL WHEN ru2 = 0 AND rd2 = 0 THEN 50.0 WHEN rd2 = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1 + ru2 / rd2) END"},
    ]
    return op(
        [
            *up,
            {"sign": "CASE WHEN close > pc THEN 1 WHEN close < pc THEN -1 ELSE 0 END", "ret": "close / pc - 1"},
            {"turn": f"CASE WHEN sign = 0 OR sign <> coalesce(lag(sign, 1) {P}, 0) THEN 1 ELSE 0 END"},
            {"island": f"sum(turn) {CUM}"},
            {"streak": "CASE WHEN sign = 0 THEN 0.0 ELSE 1.0 * sign * count(*) OVER (PARTITION BY series, island ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END"},
            {"past": f"lag(streak, 1) {P}"},
            *move,
            {"place": since(f"100 * ({rank}) / {rank_len}", first)},
            {"value": since("(raw1 + raw2 + place) / 3", first)},
        ],
        ["value"],
        first,
    )
