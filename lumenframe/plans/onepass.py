"""One aggregate over all columns, read back either as a driver row or as a long table.

A statistic that feeds a projection (a mean, a fence, a minimum) is computed in a single
aggregate whatever the number of columns. Its one result row becomes literals in the next
projection, so the second pass has no join at all and fences can be pushed to the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.columns import classify_columns, col


def one_row(df: DataFrame, stats: Mapping[str, Column]) -> dict:
    """Run a global aggregate and return its single row as a dict."""
    if not stats:
        return {}
    names = list(stats)
    row = df.agg(*[stats[n].alias(f"s{i}") for i, n in enumerate(names)]).first()
    return {n: row[i] for i, n in enumerate(names)}


def long_aggregate(
    df: DataFrame,
    cols: Sequence[str],
    stats: Mapping[str, object],
    label: str = "column",
    by: Sequence[str] = (),
) -> DataFrame:
    """``stats`` maps an output name to ``f(column_name) -> aggregate``; result: one row per column."""
    wide = [f(c).alias(f"s{i}_{j}") for i, c in enumerate(cols) for j, f in enumerate(stats.values())]
    rows = [
        F.struct(
            F.lit(c).alias(label),
            *[F.col(f"s{i}_{j}").alias(name) for j, name in enumerate(stats)],
        )
        for i, c in enumerate(cols)
    ]
    summary = df.groupBy(*by).agg(*wide) if by else df.agg(*wide)
    return summary.select(*by, F.inline(F.array(*rows)))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, number, n): the distinct values of each column; ``number`` orders numeric columns as numbers.

    Every column is counted by itself in its own type: it is read alone, counts combine map-side, and only distinct values
    are shuffled and written as text.
    """
    numeric, types = set(classify_columns(df)["numeric"]), dict(df.dtypes)
    parts = []
    for c in cols:
        v = col(c) + F.lit(0.0).cast(types[c]) if types[c] in ("double", "float") else col(c)  # -0.0 becomes 0.0
        if types[c].startswith("map<") or "map<" in types[c]:
            v = v.cast("string")
        counted = df.select(v.alias("_v")).groupBy("_v").agg(F.count(F.lit(1)).alias("n"))
        number = F.col("_v").cast("double") if c in numeric else F.lit(None).cast("double")
        parts.append(counted.select(F.lit(c).alias("column"), F.col("_v").cast("string").alias("value"), number.alias("number"), "n"))
    return reduce(DataFrame.unionAll, parts)


def smallest_values(df: DataFrame, cols: Sequence[str], k: int) -> dict[str, list[str]]:
    """The k smallest distinct values of each column as text, one bounded aggregate of all columns per place."""
    found: dict[str, list[str]] = {c: [] for c in cols}
    above = {c: F.lit(True) for c in cols}
    for _ in range(k):
        row = one_row(df, {(c, n): f(F.min(F.when(above[c], col(c)))) for c in cols for n, f in (("v", lambda m: m), ("s", lambda m: m.cast("string")))})
        for c in cols:
            if row[(c, "v")] is None:
                above[c] = F.lit(False)
            else:
                found[c].append(row[(c, "s")])
                above[c] = col(c) > F.lit(row[(c, "v")])
    return found
