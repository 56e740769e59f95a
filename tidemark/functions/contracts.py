"""Contract values as Spark columns: sizes, risks and results in account currency.

`multiplier` is the value of one price unit for one contract, `fx` the rate from the price's currency to the account's.
Results are null where a price, rate or multiplier is not positive, or the pair of currencies has no rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _positive(value: Column, *inputs: Column) -> Column:
    ok = F.lit(True)
    for i in inputs:
        ok = ok & (i > 0)
    return F.when(ok, value)


def notional_value(price: Column, quantity: Column, multiplier: Column, fx: Column) -> Column:
    return _positive(F.when(quantity >= 0, quantity * price * multiplier * fx), price, multiplier, fx)


def stop_risk(entry: Column, stop: Column, quantity: Column, multiplier: Column, fx: Column) -> Column:
    """What a position loses at its stop."""
    return _positive(F.when(quantity >= 0, quantity * F.abs(entry - stop) * multiplier * fx), entry, stop, multiplier, fx)


def profit(entry: Column, exit_: Column, quantity: Column, long: Column, multiplier: Column, fx: Column) -> Column:
    """Result of a closed position; `long` is boolean."""
    return _positive(F.when(quantity >= 0, F.when(long, exit_ - entry).otherwise(entry - exit_) * quantity * multiplier * fx), entry, exit_, multiplier, fx)


def tick_value(tick: Column, multiplier: Column, fx: Column) -> Column:
    return _positive(tick * multiplier * fx, tick, multiplier, fx)


def round_down(quantity: Column, step: float, least: float) -> Column:
    """Whole steps of a quantity, 0 below the least one. A hair below a step counts as the step."""
    whole = F.floor(quantity / step + 1e-12) * F.lit(step)
    return F.when((quantity <= 0) | (whole + 1e-12 < least), 0.0).otherwise(whole)


def contract_size(equity: Column, risk_share: float, entry: Column, stop: Column, multiplier: Column, fx: Column, max_leverage: float | None = None, max_notional: float | None = None, step: float = 1.0, least: float = 1.0) -> dict[str, Column]:
    """size, risk_amount and which caps held: the risk share of equity at the stop, under leverage and notional, in whole steps."""
    unit_risk, unit = F.abs(entry - stop) * multiplier * fx, entry * multiplier * fx
    wanted = F.when(unit_risk > 0, equity * risk_share / unit_risk).otherwise(0.0)
    levered = wanted if max_leverage is None else F.least(wanted, equity * max_leverage / unit)
    capped = levered if max_notional is None else F.least(levered, F.lit(max_notional) / unit)
    size = round_down(capped, step, least)
    valid = lambda value: _positive(value, equity, entry, stop, multiplier, fx)
    return {"size": valid(size), "risk_amount": valid(size * unit_risk), "capped_by_leverage": valid(wanted > levered), "capped_by_notional": valid(levered > capped)}


def with_fx(frame: DataFrame, rates: DataFrame, source: str, target: str, name: str = "fx") -> DataFrame:
    """Adds the rate between the currencies in two columns from `rates` (base, quote, rate).

    A pair may be quoted either way round, a direct quote goes first; equal currencies need none, and other pairs get null:
    there are no cross rates. The table of rates has one row for each pair of currencies, so the join is left to Catalyst.
    """
    good = rates.filter("rate > 0 and base <> quote").select("base", "quote", "rate")
    both = good.select("base", "quote", "rate", F.lit(0).alias("turned")).unionByName(good.select(F.col("quote").alias("base"), F.col("base").alias("quote"), (1 / F.col("rate")).alias("rate"), F.lit(1).alias("turned")))
    one = both.groupBy(F.col("base").alias(source), F.col("quote").alias(target)).agg(F.min_by("rate", F.struct("turned", "rate")).alias("_rate"))
    return frame.join(one, [source, target], "left").withColumn(name, F.when(F.col(source) == F.col(target), 1.0).otherwise(F.col("_rate"))).drop("_rate")
