"""Anomaly flags per cell or per row, with summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.columns import col, numeric_columns
from lumenframe.operators.clean import iqr_fences
from lumenframe.plans.onepass import long_aggregate, one_row
from lumenframe.plans.ordering import over_series
from lumenframe.plans.quantiles import exact_quantiles
from lumenframe.plans.spread import spread
from lumenframe.plans.storage import materialize


def _rules(df: DataFrame, method: str, cols, threshold, exact=True) -> dict[str, tuple[Column, float | None, float | None]]:
    """Per column: flag expression and the two numbers that define it (fences, or mean and std)."""
    if method == "iqr":
        k = 1.5 if threshold is None else threshold
        fences = iqr_fences(df, cols, k, exact)
        return {
            c: (F.coalesce((col(c) < F.lit(lo)) | (col(c) > F.lit(hi)), F.lit(False)), lo, hi)
            for c, (lo, hi) in fences.items()
        }
    if method == "zscore":
        limit = 3.0 if threshold is None else threshold
        s = one_row(df, {(c, n): f(col(c)) for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_samp))})
        out = {}
        for c in cols:
            mean, std = s[(c, "mean")], s[(c, "std")]
            flag = F.lit(False) if not std else F.abs((col(c) - F.lit(mean)) / F.lit(std)) > F.lit(float(limit))
            out[c] = (F.coalesce(flag, F.lit(False)), mean, std)
        return out
    raise ValueError(f"unknown method {method!r}")


def anomalies(
    df: DataFrame, method: str = "iqr", cols=None, threshold=None, contamination: float = 0.05, key=None
) -> DataFrame:
    """The table with one boolean ``col_anomaly`` per column (``anomaly`` for the isolation forest)."""
    cols = numeric_columns(df, cols)
    if method == "isolation_forest":
        return isolation_forest(df, cols, contamination, key)
    rules = _rules(df, method, cols, threshold)
    return df.select("*", *[flag.alias(f"{c}_anomaly") for c, (flag, _, _) in rules.items()])


def anomaly_summary(df: DataFrame, method: str = "iqr", cols=None, threshold=None) -> DataFrame:
    """Per column with anomalies: count, percent of all rows (2 dp) and the two defining numbers."""
    cols = numeric_columns(df, cols)
    rules = _rules(df, method, cols, threshold)
    names = ("lower", "upper") if method == "iqr" else ("mean", "std")
    counts = long_aggregate(
        df,
        cols,
        {
            "anomalies": lambda c: F.count_if(rules[c][0]),
            "_rows": lambda c: F.count(F.lit(1)),
            names[0]: lambda c: F.max(F.lit(rules[c][1]).cast("double")),
            names[1]: lambda c: F.max(F.lit(rules[c][2]).cast("double")),
        },
    )
    return counts.filter(F.col("anomalies") > 0).select(
        "column", "anomalies", F.round(100.0 * F.col("anomalies") / F.col("_rows"), 2).alias("percent"), *names
    )


def anomaly_total(df: DataFrame, method: str = "iqr", cols=None, threshold=None) -> DataFrame:
    """Flagged cells in the whole table."""
    return anomaly_summary(df, method, cols, threshold).agg(F.coalesce(F.sum("anomalies"), F.lit(0)).alias("flagged_cells"))


def anomalies_moving_average(
    df: DataFrame, ts, value: str, window: int = 7, k: float = 2.0, key=None, **sizes
) -> DataFrame:
    """Rows outside rolling mean ± k rolling standard deviations of the last ``window`` rows."""

    def build(w):
        frame = w.rowsBetween(-(window - 1), 0)
        full = F.count(col(value)).over(frame) == window
        return {
            "moving_avg": F.when(full, F.avg(col(value)).over(frame)),
            "moving_std": F.when(full, F.stddev_samp(col(value)).over(frame)),
        }

    out = over_series(df, ts, key, build, window - 1, **sizes)
    upper, lower = F.col("moving_avg") + k * F.col("moving_std"), F.col("moving_avg") - k * F.col("moving_std")
    return out.withColumn("anomaly", F.coalesce((col(value) > upper) | (col(value) < lower), F.lit(False)))


# ---- isolation forest ----------------------------------------------------------------------

TREES, TREE_ROWS = 100, 256


def _grow(rows: np.ndarray, rng: np.random.Generator, depth: int, limit: int, nodes: list) -> int:
    at = len(nodes)
    nodes.append(None)
    spread = np.flatnonzero(rows.min(0) < rows.max(0)) if len(rows) > 1 else []
    if depth >= limit or len(spread) == 0:
        nodes[at] = (0, 0.0, depth + _expected_path(len(rows)), at, at)  # a leaf leads to itself
        return at
    f = int(rng.choice(spread))
    cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
    left = rows[:, f] < cut
    a = _grow(rows[left], rng, depth + 1, limit, nodes)
    b = _grow(rows[~left], rng, depth + 1, limit, nodes)
    nodes[at] = (f, cut, 0.0, a, b)
    return at


def _expected_path(n: int) -> float:
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _drawn_trees(keys: list, n: int, trees: int, tree_rows: int, seed: int):
    """The trees whose sample a row may be in, each with about twice the chance that fills it.

    A hash of the row gives the gaps between its trees (geometric), so most rows of a large table cost one hash.
    """
    share = 2.0 * tree_rows / n
    if share >= 1:
        return F.sequence(F.lit(0), F.lit(trees - 1))

    def gap(k):
        u = (F.pmod(F.xxhash64(F.lit(seed), k, *keys), F.lit(1 << 52)) + F.lit(1)) / F.lit(float(1 << 52))
        return F.least(F.floor(F.log(u) / F.lit(float(np.log1p(-share)))), F.lit(trees)).cast("int")

    def step(found, k):
        last = F.element_at(found, -1)
        return F.when(last >= trees, found).otherwise(F.concat(found, F.array(last + 1 + gap(k))))

    more = F.aggregate(F.sequence(F.lit(1), F.lit(trees)), F.array(gap(F.lit(0))), step)
    return F.when(gap(F.lit(0)) < trees, F.filter(more, lambda t: t < trees))


def isolation_forest(
    df: DataFrame, cols=None, contamination: float = 0.05, key=None, seed: int = 42, trees: int = TREES, tree_rows: int = TREE_ROWS
) -> DataFrame:
    """Adds ``score`` and ``anomaly``; the share ``contamination`` with the highest scores is flagged.

    Each of ``trees`` trees has its own sample of ``tree_rows`` rows, drawn by a hash of ``key`` from all complete rows,
    and is grown by a task of its own. What reaches the driver are the trees, at most ``2 * trees * tree_rows`` nodes.
    Scores are written down once and then read for the cut and the result.
    """
    cols = numeric_columns(df, cols)
    keys = [key] if isinstance(key, str) else list(key or cols)
    known = df.dropna("any", subset=cols)
    n = known.count()
    if not n:
        return df.select("*", F.lit(None).cast("double").alias("score"), F.lit(False).alias("anomaly"))
    size = min(tree_rows, n)
    depth = int(np.ceil(np.log2(max(size, 2))))
    values = F.array(*[col(c).cast("double") for c in cols])
    picked = spread(known).select(F.explode(_drawn_trees([col(k) for k in keys], n, trees, tree_rows, seed)).alias("tree"), values.alias("x"), F.xxhash64(F.lit(seed + 1), *[col(k) for k in keys]).alias("h"))
    first = Window.partitionBy("tree").orderBy("h", "x")
    drawn = picked.withColumn("r", F.row_number().over(first)).where(F.col("r") <= tree_rows).select("tree", "x")

    def grown(part: pd.DataFrame) -> pd.DataFrame:
        tree, nodes = int(part["tree"].iloc[0]), []
        rows = np.stack(part["x"])
        _grow(rows[np.lexsort(rows.T[::-1])], np.random.default_rng([seed, tree]), 0, depth, nodes)
        return pd.DataFrame({"tree": [tree], "nodes": [np.array(nodes, dtype=float).ravel().tolist()]})

    forest = []
    for r in drawn.groupBy("tree").applyInPandas(grown, "tree int, nodes array<double>").orderBy("tree").collect():
        feature, cut, length, left, right = np.array(r["nodes"]).reshape(-1, 5).T
        forest.append((feature.astype(int), cut, length, left.astype(int), right.astype(int)))
    scale = _expected_path(size) or 1.0

    starts = np.cumsum([0, *(len(t[0]) for t in forest)])[:-1]  # the nodes of all trees as one list
    feature, cut, length = (np.concatenate([t[i] for t in forest]) for i in (0, 1, 2))
    left, right = (np.concatenate([t[i] + at for t, at in zip(forest, starts, strict=True)]) for i in (3, 4))

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        values, out = x.to_numpy(dtype=float), np.empty(len(x))
        for low in range(0, len(values), 1000):
            part = values[low : low + 1000]
            rows, at = np.arange(len(part))[:, None], np.repeat(starts[None, :], len(part), axis=0)
            for _ in range(depth):
                at = np.where(part[rows, feature[at]] < cut[at], left[at], right[at])
            out[low : low + 1000] = length[at].sum(axis=1)
        return pd.Series(np.where(np.isnan(values).any(axis=1), np.nan, np.exp2(-out / len(forest) / scale)))

    complete = F.lit(True)
    for c in cols:
        complete = complete & col(c).isNotNull()
    scored = materialize(spread(df).withColumn("score", F.when(complete, score(F.struct(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])))))
    cut = exact_quantiles(scored, ["score"], [1 - contamination])["score"][0]
    return scored.withColumn("anomaly", F.coalesce(F.col("score") > F.lit(cut), F.lit(False)))
