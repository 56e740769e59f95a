"""Operators as data: stages of window expressions and folds, run by Spark, rendered as SQL for the check.

An expression stage is a set of columns in the common part of Spark SQL and DuckDB SQL. A fold stage is a set of columns
made by ordered recurrences of infinite memory, which Spark runs as one grouped Arrow function over each series. All
windows share one partitioning and order, so expressions need one exchange and one sort however many columns they make;
each further grouped call whose result windows or folds read again costs one more.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, states

P = "OVER (PARTITION BY series ORDER BY ts)"
CUM = "OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def w(n: int) -> str:
    """The window of the last n rows."""
    return f"OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def since(expression: str, first: int) -> str:
    """NULL before row `first` of the series."""
    return f"CASE WHEN i >= {first} THEN {expression} END"


@dataclass(frozen=True)
class Fold:
    """A recurrence over a column: the kernel's name, its input and parameters."""

    kernel: str
    source: str
    args: tuple = ()
    #: Which of the kernel's lines, where it returns several; they are made once for all columns that differ in this only.
    line: int | None = None


@dataclass
class Operator:
    name: str
    stages: list[dict[str, str | Fold]]
    outputs: list[str]
    params: dict = field(default_factory=dict)
    warmup: int = 1
    #: Whether values are small enough to compare after rounding to fixed digits.
    comparable: bool = True

    @property
    def has_sql(self) -> bool:
        return self.comparable and all(not isinstance(c, Fold) or c.kernel in kernels.SQL for s in self.stages for c in s.values())


BASE = {
    "i": f"row_number() {P}",
    "pc": f"lag(close, 1) {P}",
    "tp": "(high + low + close) / 3",
    "hl2": "(high + low) / 2",
}
BASE2 = {"tr": "CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END"}

OPERATORS: dict[str, Callable[..., Operator]] = {}
ALIASES: dict[str, str] = {}


def operator(*aliases: str):
    def mark(fn):
        OPERATORS[fn.__name__.rstrip("_")] = fn
        for a in aliases:
            ALIASES[a] = fn.__name__.rstrip("_")
        return fn

    return mark


def build(name: str, **params) -> Operator:
    """The operator of that name or alias; unknown parameters and counts below 1 raise."""
    key = ALIASES.get(name.lower(), name.lower())
    if key not in OPERATORS:
        raise KeyError(f"no operator {name!r}")
    known = OPERATORS[key].__defaults__ or ()
    names = OPERATORS[key].__code__.co_varnames[: OPERATORS[key].__code__.co_argcount]
    for k, v in params.items():
        if k not in names:
            raise ValueError(f"{key} has no parameter {k!r}")
        if isinstance(known[names.index(k)], int) and (int(v) != v or v < 1):
            raise ValueError(f"{key}.{k} must be a count of at least 1")
    op = OPERATORS[key](**params)
    op.name, op.params = key, dict(zip(names, known, strict=False)) | params
    return op


def run_fold(frame: DataFrame, folds: dict[str, Fold]) -> DataFrame:
    """All folds of a stage in one grouped call; rows come back with the new columns."""
    columns = frame.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)

    def each(pdf):
        pdf = pdf.sort_values("ts", kind="stable")
        made: dict[tuple, list] = {}
        for name, fold in folds.items():
            inputs = lambda f=fold: [pdf[c].to_numpy("float64") for c in f.source.split(",")]
            if fold.line is None:
                pdf[name] = kernels.KERNELS[fold.kernel](*inputs(), *fold.args)
                continue
            key = (fold.kernel, fold.source, str(fold.args))
            if key not in made:
                made[key] = states.KERNELS[fold.kernel](*inputs(), *fold.args)
            pdf[name] = made[key][fold.line]
        return pdf

    return frame.groupBy("series").applyInPandas(each, f"{fields}, {', '.join(f'`{n}` double' for n in folds)}").select(*columns, *folds)


def apply(bars: DataFrame, ops: list[Operator], keep: list[str] | None = None) -> DataFrame:
    """Add the outputs of several operators to bars.

    Columns are put into as few rounds as their dependencies allow, over all operators: a round is some projections of
    window expressions and then one grouped call with every fold that they feed, folds of folds included. With one operator
    its outputs keep their names; with several they are prefixed by the operator's name.
    """
    frame = bars
    for stage in (BASE, BASE2):
        frame = frame.select("*", *[F.expr(_spark(e)).alias(k) for k, e in stage.items()])
    prefix = lambda op, c: c if len(ops) == 1 else f"{op.name}__{c}"
    for steps, folds in _rounds(ops, prefix):
        for step in steps:
            frame = frame.select("*", *[F.expr(_spark(e)).alias(k) for k, e in step.items()])
        if folds:
            frame = run_fold(frame, folds)
    outputs = [(c if len(ops) == 1 else f"{op.name}_{c}", prefix(op, c)) for op in ops for c in op.outputs]
    keep = keep or ["series", "ts"]
    return frame.select(*keep, *[F.col(c).cast("double").alias(name) for name, c in outputs])


def _rounds(ops: list[Operator], prefix: Callable[[Operator, str], str]) -> list[tuple[list[dict[str, str]], dict[str, Fold]]]:
    """Rounds of (projections one after another, folds in order), each column in the earliest round that it can be in."""
    rounds: list[tuple[dict[int, dict[str, str]], dict[str, Fold]]] = []
    for op in ops:
        place: dict[str, int] = {}  # the round in which a column is there for expressions
        folded: dict[str, int] = {}  # and for other folds
        for depth, stage in enumerate(op.stages):
            known = set(place)
            for c, e in stage.items():
                isfold = isinstance(e, Fold)
                used = known.intersection(e.source.split(",") if isfold else re.findall(r"[A-Za-z_]\w*", e))
                at = max([(folded if isfold else place)[u] for u in used], default=0)
                while len(rounds) <= at:
                    rounds.append(({}, {}))
                if isfold:
                    source = ",".join(prefix(op, s) if s in known else s for s in e.source.split(","))
                    rounds[at][1][prefix(op, c)] = Fold(e.kernel, source, e.args, e.line)
                    place[c], folded[c] = at + 1, at
                else:
                    rounds[at][0].setdefault(depth, {})[prefix(op, c)] = _renamed(e, {u: prefix(op, u) for u in used})
                    place[c] = folded[c] = at
    return [([steps[d] for d in sorted(steps)], folds) for steps, folds in rounds]


def _spark(expression: str) -> str:
    """The Spark form: literals with a point are doubles, rows are structs."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1D", expression).replace("ROWOF(", "struct(")


def _renamed(expression: str, names: dict[str, str]) -> str:
    return re.sub(r"[A-Za-z_]\w*", lambda m: names.get(m[0], m[0]), expression) if names else expression


#: Added before rounding, so that values that lie on a tie (prices in cents often do) round alike whatever their last bits.
OFF_TIE = 1.37e-8


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros, for comparison."""
    return frame.select(*[(F.round(F.col(f.name) + F.lit(OFF_TIE), digits) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in frame.schema])


def to_sql(op: Operator, bars_sql: str, digits: int = 6) -> str:
    """DuckDB SQL of an operator over bars."""
    ctes, last = [f"bars AS ({bars_sql})"], "bars"
    for k, stage in enumerate([BASE, BASE2, *op.stages]):
        columns = ", ".join(f"{kernels.SQL[e.kernel](e.source, *e.args) if isinstance(e, Fold) else e.replace('ROWOF(', 'row(')} AS {c}" for c, e in stage.items())
        ctes.append(f"s{k} AS (SELECT *, {columns} FROM {last})")
        last = f"s{k}"
    outputs = ", ".join(f"round(({c})::DOUBLE + {OFF_TIE!r}, {digits}) + 0.0 AS {c}" for c in op.outputs)
    return f"WITH {', '.join(ctes)} SELECT series, ts, {outputs} FROM {last}"
