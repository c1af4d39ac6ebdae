"""The numbers behind charts, computed over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.columns import col, numeric_columns, unit_draw
from lumenframe.functions.distributions import normal_score
from lumenframe.operators.clean import iqr_fences
from lumenframe.plans.joins import lookup, match
from lumenframe.plans.onepass import long_aggregate, one_row
from lumenframe.plans.ordering import with_position
from lumenframe.plans.quantiles import quantiles
from lumenframe.plans.storage import materialize


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed: (bin, low, high, n)."""
    v = col(column).cast("double")
    s = one_row(df, {"lo": F.min(v), "hi": F.max(v)})
    lo, hi = s["lo"], s["hi"]
    if lo is None:
        lo, hi = 0.0, 1.0
    width = (hi - lo) / bins or 1.0
    place = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(v.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "bin", (F.lit(lo) + F.col("bin") * width).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"), "n"
    )


def kde(df: DataFrame, column: str, points: int = 100, bins: int = 50) -> DataFrame:
    """Gaussian density (Scott bandwidth) at equally spaced points, scaled to counts per histogram bin.

    Equal values are merged first; each distinct value then meets all grid points map-side, so only
    one partial sum per point and task is shuffled.
    """
    v = col(column).cast("double")
    s = one_row(df, {"n": F.count(v), "lo": F.min(v), "hi": F.max(v), "sd": F.stddev_samp(v)})
    n, lo, hi = s["n"], s["lo"] or 0.0, s["hi"] or 0.0
    h = (s["sd"] or 0.0) * (n or 1) ** -0.2 or 1.0
    step = (hi - lo) / (points - 1)
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    values = df.filter(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("w"))
    spread = values.select("v", "w", grid.alias("point"))
    u = (F.col("v") - (F.lit(lo) + F.col("point") * step)) / h
    mass = spread.groupBy("point").agg(F.sum(F.col("w") * F.exp(-0.5 * u * u)).alias("mass"))
    factor = (hi - lo) / bins / (h * math.sqrt(2 * math.pi))
    return mass.select("point", (F.lit(lo) + F.col("point") * step).alias("x"), (F.col("mass") * factor).alias("y"))


def qq_points(df: DataFrame, column: str, step: int | None = None) -> DataFrame:
    """Every ordered value (``value``) with its median position (``position``, Filliben) and normal quantile (``theoretical``).

    ``step`` thins the points for drawing: every step-th one, and both ends always.
    """
    known = df.filter(col(column).isNotNull()).select(col(column).cast("double").alias("value"))
    placed = with_position(known, "value", name="i")
    n = known.count()
    i = F.col("i") + 1
    if step:
        placed = placed.filter((F.col("i") % step == 0) | (i == n))
    ends = 0.5 ** (1.0 / max(n, 1))
    p = F.when(i == n, F.lit(ends)).when(i == 1, F.lit(1 - ends)).otherwise((i - 0.3175) / F.lit(n + 0.365))
    return placed.select(normal_score(p).alias("theoretical"), "value", p.alias("position"))


def box_stats(df: DataFrame, cols=None, exact: bool = True) -> DataFrame:
    """Minimum, quartiles, maximum, mean, and whiskers (extreme values inside 1.5 IQR)."""
    cols = numeric_columns(df, cols)
    q = quantiles(df, cols, [0.25, 0.5, 0.75], exact)
    fences = {c: (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) if q1 is not None else (None, None) for c, (q1, _, q3) in q.items()}
    literal = lambda x: F.max(F.lit(x).cast("double"))
    inside = lambda c: F.when((col(c) >= F.lit(fences[c][0])) & (col(c) <= F.lit(fences[c][1])), col(c).cast("double"))
    return long_aggregate(
        df,
        cols,
        {
            "min": lambda c: F.min(col(c)).cast("double"),
            "q1": lambda c: literal(q[c][0]),
            "median": lambda c: literal(q[c][1]),
            "q3": lambda c: literal(q[c][2]),
            "max": lambda c: F.max(col(c)).cast("double"),
            "mean": lambda c: F.avg(col(c)),
            "whisker_low": lambda c: F.min(inside(c)),
            "whisker_high": lambda c: F.max(inside(c)),
        },
    )


def stratified_sample(df: DataFrame, column: str, n: int, key, seed: int = 42) -> DataFrame:
    """About ``n`` rows, each category in proportion to its size: floor(n / total x size) rows.

    Rows are drawn in the order of a hash of the key that every engine has, so the sample repeats. The hash is uniform,
    so only rows below a bound some deviations above a category's share are ranked; should a category have fewer of them
    than it needs (keys that repeat share a hash), all rows are.
    """
    keys = [key] if isinstance(key, str) else list(key)
    total = df.count()
    if total <= n:
        return df
    draw, take = unit_draw(keys, seed), F.floor(F.col("_size") * F.lit(n / total))
    sizes = df.groupBy(col(column)).agg(F.count(F.lit(1)).alias("_size")).withColumn("_take", take)
    bound = (F.col("_take") + 8 * F.sqrt("_take") + 8) / F.col("_size")
    share = materialize(sizes.where("_take > 0").select(col(column), "_take", bound.alias("_bound")))
    held = match(df, share, [column])
    drawn = materialize(held.where(draw < F.col("_bound")).drop("_bound"))
    found = drawn.groupBy(col(column)).agg(F.count(F.lit(1)).alias("_found"))
    if not match(share, found, [column], "left").where(F.coalesce("_found", F.lit(0)) < F.col("_take")).isEmpty():
        drawn = held.drop("_bound")
    ranked = with_position(drawn, [draw, *keys], column, "_rank")
    return ranked.filter(F.col("_rank") < F.col("_take")).drop("_rank", "_take")


def quarter_slice(df: DataFrame, key, part: str) -> DataFrame:
    """Rows of quarter A-D in key order; D also takes the remainder."""
    n = df.count()
    size, at = n // 4, "ABCD".index(part)
    stop = (at + 1) * size if at < 3 else n
    placed = with_position(df, key, name="_at")
    return placed.filter((F.col("_at") >= at * size) & (F.col("_at") < stop)).drop("_at")


def radar_means(df: DataFrame, cols=None) -> DataFrame:
    """Column means, min-max scaled across the columns."""
    cols = numeric_columns(df, cols)
    means = long_aggregate(df, cols, {"mean": lambda c: F.avg(col(c))}, label="feature")
    w = Window.partitionBy(F.lit(0))  # one row per column
    lo, hi = F.min("mean").over(w), F.max("mean").over(w)
    return means.select("feature", ((F.col("mean") - lo) / F.when(hi != lo, hi - lo).otherwise(1.0)).alias("value"))


def hierarchy_counts(df: DataFrame, path) -> DataFrame:
    """Count of every path prefix with its share of the parent (sunburst, treemap)."""
    path = list(path)
    known = df.dropna("any", subset=path)
    levels = known.rollup(*[col(c) for c in path]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid"))
    depth = sum((1 - F.shiftright(F.col("_gid"), len(path) - 1 - i).bitwiseAND(F.lit(1)) for i in range(len(path))), F.lit(0))
    nodes = levels.withColumn("level", depth.cast("int"))
    parents = nodes.select(*[col(c).alias(f"_p{i}") for i, c in enumerate(path)], F.col("level").alias("_level"), F.col("n").alias("_parent_n"))
    match = parents["_level"] == nodes["level"] - 1
    for i, c in enumerate(path):
        match = match & parents[f"_p{i}"].eqNullSafe(F.when(nodes["level"] > i + 1, nodes[c]))
    return nodes.join(parents, match, "left").select(
        *path, "level", "n", F.coalesce(F.col("n") / F.col("_parent_n"), F.lit(1.0)).alias("share_of_parent")
    )


def bubble_scale(df: DataFrame, column: str) -> DataFrame:
    """``bubble_size``: absolute value scaled to [10, 60], 20 for a constant column; null counts as 0."""
    v = F.abs(F.coalesce(col(column).cast("double"), F.lit(0.0)))
    s = one_row(df, {"lo": F.min(v), "hi": F.max(v)})
    lo, hi = s["lo"], s["hi"]
    size = F.lit(20.0) if lo is None or lo == hi else F.lit(10.0) + (v - F.lit(lo)) * 50.0 / F.lit(hi - lo)
    return df.withColumn("bubble_size", size)


def colour_scale(df: DataFrame, column: str) -> DataFrame:
    """``red`` and ``green`` in 0-255. Numbers: up to 1 times 255; outside 0-255 min-max scaled; else as they are.
    Categories: their rank in sorted order, scaled."""
    if column in numeric_columns(df):
        v = col(column).cast("double")
        s = one_row(df, {"lo": F.min(v), "hi": F.max(v)})
        lo, hi = s["lo"], s["hi"]
        if hi is None or hi <= 1.0 and lo >= 0:
            red = v * 255
        elif lo < 0 or hi > 255:
            red = (v - F.lit(lo)) / F.lit((hi - lo) or 1.0) * 255
        else:
            red = v
        out = df.withColumn("red", F.floor(red).cast("int"))
    else:
        values = df.filter(col(column).isNotNull()).select(col(column).alias("_value")).distinct()
        codes = with_position(values, "_value", name="_code")
        top = codes.agg(F.max("_code")).first()[0] or 0
        out = lookup(df, codes.withColumnRenamed("_value", column), [column], "left").withColumn(
            "red", F.floor(F.col("_code") / F.lit(float(top or 1)) * 255).cast("int")
        ).drop("_code")
    return out.withColumn("green", F.lit(255) - F.col("red"))


def heatmap_grid(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    return df.groupBy(col(x), col(y)).agg(F.avg(col(z)).alias("z"))


def share_of_total(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values with their share of the shown total (pie)."""
    counts = df.filter(col(column).isNotNull()).groupBy(col(column)).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), col(column)).limit(k)
    return top.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def xy_aggregate(df: DataFrame, x: str, y: str, color: str | None = None, how: str = "sum") -> DataFrame:
    """Series for bar, line or scatter charts, one value per x (and colour group)."""
    groups = [col(x)] + ([col(color)] if color else [])
    return df.groupBy(*groups).agg(getattr(F, how)(col(y)).alias(y))
