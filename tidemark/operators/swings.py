"""Swings, breaks and trailing lines: pivots by window expressions, their states by one fold each."""

from __future__ import annotations

from .averages import op
from .spec import CUM, Fold, P, operator, since, w


def _rows(first: int, last: int) -> str:
    """The window from `first` to `last` rows back."""
    return f"OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN {first} PRECEDING AND {f'{last} PRECEDING' if last else 'CURRENT ROW'})"


def pivots(left: int, right: int, strict: bool) -> dict[str, str]:
    """ph and pl: the high or low of `right` bars ago where it tops (undercuts) all of `left` bars before to `right` after."""
    out = {}
    for name, price, best, sign in (("ph", "high", "max", ">"), ("pl", "low", "min", "<")):
        there = f"lag({price}, {right}) {P}"
        sides = [f"{there} {sign}{'' if strict else '='} {best}({price}) {_rows(left + right, right + 1)}", f"{there} {sign}{'' if strict else '='} {best}({price}) {_rows(right - 1, 0)}"]
        out[name] = f"CASE WHEN i > {left + right} AND {' AND '.join(sides)} THEN {there} END"
    return out


@operator()
def zigzag(depth=12, deviation_pct=5.0):
    first = 2 * depth + 1
    legs = ("zigzag_legs", "ph,pl", (deviation_pct,))
    return op(
        [pivots(depth, depth, False), {"price": Fold(*legs, 0), "side": Fold(*legs, 1)}, {"value": since("price", first), "direction": since("side", first)}],
        ["value", "direction"],
        first,
    )


@operator("pivots")
def pivots_structure(left_bars=5, right_bars=5, score_window=10):
    first = left_bars + right_bars + 1
    return op(
        [pivots(left_bars, right_bars, True), {"score": Fold("pivot_score", "ph,pl", (score_window,), 0)}, {"value": since("score", first), "pivot_high": "ph", "pivot_low": "pl"}],
        ["value", "pivot_high", "pivot_low"],
        first,
    )


def _breaks(length: int, strict: bool):
    first = 2 * length + 1
    state = ("structure_breaks", "close,ph,pl", ())
    return op(
        [pivots(length, length, strict), {"event": Fold(*state, 0), "side": Fold(*state, 1), "level": Fold(*state, 2)}, {"value": since("event", first), "trend": since("side", first), "broken_level": since("level", first)}],
        ["value", "trend", "broken_level"],
        first,
    )


@operator()
def bos_choch(pivot_len=5):
    return _breaks(pivot_len, False)


@operator("bos", "choch")
def market_structure_breaks(lookback=5):
    return _breaks(lookback, True)


@operator("sweeps")
def liquidity_sweeps(pivot_len=5, tolerance_pct=0.2):
    first = 2 * pivot_len + 1
    state = ("level_sweeps", "high,low,close,ph,pl", (tolerance_pct, 20))
    return op(
        [pivots(pivot_len, pivot_len, False), {"sweep": Fold(*state, 0), "eqh": Fold(*state, 1), "eql": Fold(*state, 2)}, {"value": since("sweep", first), "eqh_count": since("eqh", first), "eql_count": since("eql", first)}],
        ["value", "eqh_count", "eql_count"],
        first,
    )


@operator()
def schaff_trend_cycle(fast=23, slow=50, cycle=10, factor=0.5):
    first = max(slow, 2 * cycle - 1)
    return op(
        [
            {"f": Fold("ema", "close", (fast,)), "s": Fold("ema", "close", (slow,))},
            {"macd": "f - s"},
            {"low1": since(f"min(macd) {w(cycle)}", cycle), "high1": f"max(macd) {w(cycle)}"},
            {"pf": Fold("smoothed_place", "macd,low1,high1,s", (factor, 1e-12, 50.0), 0)},
            {"low2": since(f"min(pf) {w(cycle)}", 2 * cycle - 1), "high2": f"max(pf) {w(cycle)}", "unit": "CASE WHEN pf IS NOT NULL THEN 1.0 END"},
            {"stc": Fold("smoothed_place", "pf,low2,high2,unit", (factor, 1e-10, float("nan")), 0)},
            {"value": since("stc", first)},
        ],
        warmup=first,
    )


@operator()
def ott(length=2, percent=1.4, cmo_len=9):
    return op(
        [
            {"u": "coalesce(greatest(close - pc, 0.0), 0.0)", "d": "coalesce(greatest(pc - close, 0.0), 0.0)"},
            {"su": f"sum(u) {w(cmo_len)}", "sd": f"sum(d) {w(cmo_len)}"},
            {"weight": f"CASE WHEN su + sd = 0 THEN 0.0 ELSE {2 / (length + 1)!r} * abs(su - sd) / nullif(su + sd, 0) END"},
            {"v": Fold("weighted_mean", "close,weight", (), 0)},
            {"stop_": Fold("trailing_percent", "v", (percent, "stop")), "side": Fold("trailing_percent", "v", (percent, "direction"))},
            {"var": f"CASE WHEN stop_ IS NOT NULL AND i > {cmo_len} THEN v END"},
            {"stop": "CASE WHEN var IS NOT NULL THEN stop_ END", "direction": "CASE WHEN var IS NOT NULL THEN side END"},
            {"value": f"CASE WHEN var > stop THEN stop * {(200 + percent) / 200!r} ELSE stop * {(200 - percent) / 200!r} END"},
        ],
        ["value", "var", "stop", "direction"],
        cmo_len + 1,
    )


@operator()
def halftrend(amplitude=2, deviation=2.0, atr_len=100):
    ready = max(amplitude, 2)
    state = ("half_trend", "high,low,close,top,bottom,mh,ml", ())
    return op(
        [
            {"top": since(f"max(high) {w(amplitude)}", ready), "bottom": since(f"min(low) {w(amplitude)}", ready), "mh": f"avg(high) {w(amplitude)}", "ml": f"avg(low) {w(amplitude)}"},
            {"line": Fold(*state, 0), "side": Fold(*state, 1), "atr": Fold("rma", "tr", (atr_len,))},
            {"value": since("line", atr_len), "trend": f"CASE WHEN i >= {atr_len} AND line IS NOT NULL THEN side END", "atr_high": since(f"line + {deviation / 2!r} * atr", atr_len), "atr_low": since(f"line - {deviation / 2!r} * atr", atr_len)},
        ],
        ["value", "trend", "atr_high", "atr_low"],
        atr_len,
    )


@operator()
def setup_countdown():
    """Bars in a row that close above (below) the close of four bars before, counted from a turn; the countdown after nine."""
    return op(
        [
            {"c4": f"lag(close, 4) {P}"},
            {"side": "CASE WHEN c4 IS NULL THEN NULL WHEN close > c4 THEN 1 WHEN close < c4 THEN -1 ELSE 0 END"},
            {"before": f"lag(side, 1) {P}"},
            {"begin": "CASE WHEN side = before THEN 0 ELSE 1 END"},
            {"island": f"sum(begin) {CUM}"},
            {"length": "count(*) OVER (PARTITION BY series, island ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "from_turn": "max(CASE WHEN begin = 1 AND before = -side THEN 1 ELSE 0 END) OVER (PARTITION BY series, island ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"},
            {"value": since("CASE WHEN from_turn = 1 THEN side * length ELSE 0.0 END", 6), "high2": f"lag(high, 2) {P}", "low2": f"lag(low, 2) {P}"},
            {"countdown": Fold("countdown", "value,high,low,close,high2,low2", (), 0)},
        ],
        ["value", "countdown"],
        6,
    )


@operator("chfr")
def adaptive_chandelier(length=30, atr_mult=4.5, body_filter_atr=0.8, danger_dist_atr=0.35, warn_dist_atr=0.75):
    n = length
    state = ("filtered_stops", "open,close,a,b,atr,m", (body_filter_atr, danger_dist_atr, warn_dist_atr))
    lines = ("value", "long_stop", "short_stop", "dist_atr", "risk_state")
    return op(
        [
            {"hh": f"max(close) {w(n)}", "ll": f"min(close) {w(n)}"},
            {"atr": Fold("rma", "tr", (n,)), "m": Fold("ema", "close", (5,))},
            {"a": f"hh - {atr_mult!r} * atr", "b": f"ll + {atr_mult!r} * atr"},
            {c: Fold(*state, k) for k, c in enumerate(lines)},
        ],
        list(lines),
        n,
    )


@operator()
def fvg_fill(max_zones=20):
    lines = ("value", "created", "filled", "open_bullish", "open_bearish")
    return op([{c: Fold("open_gaps", "high,low", (max_zones,), k) for k, c in enumerate(lines)}], list(lines))


@operator()
def threshold_zigzag(length=14, multiple=3.0):
    turns = ("threshold_turns", "close,high,low,distance", ())
    return op(
        [{"distance": since(f"{float(multiple)} * avg(tr) {w(length)}", length)}, {"direction": Fold(*turns, 0), "pivot": Fold(*turns, 1), "age": Fold(*turns, 2)}],
        ["direction", "pivot", "age"],
        1,
    )


@operator()
def zone_rejection(pivot_len=5, atr_len=14, tolerance_atr=0.25, max_width_atr=2.0, min_touches=2):
    zones = ("rejected_zones", "high,low,close,ph,pl,atr_before", (tolerance_atr, max_width_atr, min_touches, 40))
    names = ("event", "spike", "force", "count")
    return op(
        [
            {**pivots(pivot_len, pivot_len, True), "atr": Fold("rma", "tr", (atr_len,))},
            {"atr_before": f"lag(atr, 1) {P}"},
            {c: Fold(*zones, k) for k, c in enumerate(names)},
            {"value": since("event", atr_len), "wick": "spike", "strength": since("force", atr_len), "zones": since("count", atr_len)},
        ],
        ["value", "wick", "strength", "zones"],
        atr_len,
    )


@operator("pnf")
def point_and_figure(box_size=1.0, reversal=3, method=0.0):
    """`method` 0 reads closes, 1 highs and lows."""
    boxes = ("box_columns", "high,low" if method else "close,close", (box_size, reversal))
    names = ("column", "value", "top", "bottom", "boxes", "changed", "opened")
    return op([{c: Fold(*boxes, k) for k, c in enumerate(names)}], ["value", *(n for n in names if n != "value")], 1)
