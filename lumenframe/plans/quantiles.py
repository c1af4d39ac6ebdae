"""Exact quantiles that never gather a column in one task.

One rank sketch per column (KLL, mergeable) proposes a bracket of values around every wanted rank. One pass then counts, for all
brackets of all columns together, the rows below and inside, and brackets that turn out wide are narrowed by sketches of their
own. A last pass interpolates inside the brackets. All passes are map-side aggregates without a shuffle of rows; what a task
merges is a sketch or the few values inside a bracket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.columns import col
from lumenframe.plans.onepass import one_row
from lumenframe.plans.spread import spread

BRACKET_ROWS = 100_000  # rows in a bracket that are read exactly
SKETCH = 4_096  # size parameter of a sketch
SLACK = 0.002  # normalised rank that a bracket leaves on each side, more than the sketch's usual error
ACCURACY = 10_000


@dataclass
class Bracket:
    """Values that hold the order statistics ``floor(at)`` and ``ceil(at)`` (from 0) of a column."""

    column: str
    at: float
    rows: int  # inside
    below: int = 0
    low: float | None = None
    high: float | None = None
    slack: float = SLACK
    stuck: bool = False

    @property
    def settled(self) -> bool:
        return self.low is not None and self.low == self.high

    def inside(self) -> Column:
        v = col(self.column).cast("double")
        ok = v.isNotNull() & ~F.isnan(v)
        if self.low is not None:
            ok = ok & (v >= F.lit(self.low))
        if self.high is not None:
            ok = ok & (v <= F.lit(self.high))
        return F.when(ok, v)

    def ranks(self) -> list[float]:
        here = (self.at - self.below + 0.5) / self.rows
        return [max(0.0, here - self.slack), min(1.0, here + self.slack)]

    def shrink(self, low: float, high: float, under: int, upto: int) -> None:
        """``under`` rows of the column lie below ``low``, ``upto`` at or below ``high``."""
        if not (math.floor(self.at) >= under and math.ceil(self.at) < upto):
            self.slack *= 4  # the sketch missed
        elif (self.low, self.high) == (low, high):
            self.stuck = True  # few different values fill it, and it is read as it is
        else:
            self.low, self.high, self.rows, self.below, self.slack = low, high, upto - under, under, SLACK


def _sketched(values: Column, ranks: list[float]) -> Column:
    sketch = F.kll_sketch_agg_double(values, F.lit(SKETCH))
    return F.when(F.count(values) > 0, F.kll_sketch_get_quantile_double(sketch, F.array(*map(F.lit, ranks))))


def _narrow(df: DataFrame, brackets: list[Bracket], guesses: list[Sequence[float]]) -> None:
    """Count at the guessed ends of all brackets in one pass."""
    ends = {(b.column, cut) for b, pair in zip(brackets, guesses, strict=True) for cut in pair}
    tally = {}
    for c, cut in ends:
        v = col(c).cast("double")
        tally[(c, cut, "lt")], tally[(c, cut, "le")] = F.count_if(v < F.lit(cut)), F.count_if(v <= F.lit(cut))
    seen = one_row(df, tally)
    for b, (low, high) in zip(brackets, guesses, strict=True):
        b.shrink(low, high, seen[(b.column, low, "lt")], seen[(b.column, high, "le")])


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of each column over its non-null values; NaN is the largest value."""
    cols = list(dict.fromkeys(cols))
    if not cols:
        return {}
    df = spread(df.select(*[col(c) for c in cols]))
    real = {c: F.when(~F.isnan(col(c).cast("double")), col(c).cast("double")) for c in cols}
    ranks = [r for p in probs for r in (max(0.0, p - SLACK), min(1.0, p + SLACK))]
    facts = one_row(
        df, {("n", c): F.count(col(c)) for c in cols} | {("real", c): F.count(real[c]) for c in cols} | {("q", c): _sketched(real[c], ranks) for c in cols}
    )
    result: dict[str, list[float | None]] = {c: [None if not facts[("n", c)] else math.nan] * len(probs) for c in cols}
    wanted: dict[tuple[str, int], Bracket] = {}
    for c in cols:
        for i, p in enumerate(probs):
            at = (facts[("n", c)] - 1) * p
            if facts[("n", c)] and math.ceil(at) < facts[("real", c)]:
                wanted[(c, i)] = Bracket(c, at, facts[("real", c)])
    first = {k: b for k, b in wanted.items() if b.rows > BRACKET_ROWS}
    if first:
        _narrow(df, list(first.values()), [facts[("q", c)][2 * i : 2 * i + 2] for c, i in first])
    while wide := [b for b in wanted.values() if b.rows > BRACKET_ROWS and not b.settled and not b.stuck]:
        guesses = one_row(df, {i: _sketched(b.inside(), b.ranks()) for i, b in enumerate(wide)})
        _narrow(df, wide, [guesses[i] for i in range(len(wide))])
    rest = {k: b for k, b in wanted.items() if not b.settled}
    share = {k: (b.at - b.below) / max(1, b.rows - 1) for k, b in rest.items()}
    found = one_row(df, {k: F.percentile(b.inside(), F.lit(min(1.0, share[k]))) for k, b in rest.items()})
    for (c, i), b in wanted.items():
        result[c][i] = b.low if b.settled else found[(c, i)]
    return result


def approx_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY
) -> dict[str, list[float | None]]:
    """One sketch pass; rank error at most 1/accuracy."""
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    row = one_row(df, {c: F.percentile_approx(col(c).cast("double"), wanted, F.lit(accuracy)) for c in cols})
    return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in cols}


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], exact: bool = True):
    return exact_quantiles(df, cols, probs) if exact else approx_quantiles(df, cols, probs)
