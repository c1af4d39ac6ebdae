"""Series operators on (key…, ts, value); order is always explicit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.columns import col
from lumenframe.functions.distributions import normal_cdf
from lumenframe.operators.clean import as_timestamp
from lumenframe.plans.joins import lookup, match
from lumenframe.plans.onepass import one_row
from lumenframe.plans.ordering import as_list, nearest_known, over_series, with_position
from lumenframe.plans.quantiles import exact_quantiles
from lumenframe.plans.storage import materialize

ORDER = ["ts", "value"]  # equal times are put in order of value, so results do not depend on task order


def val() -> Column:
    return F.col("value")


def at() -> Column:
    return F.col("ts")


def prepare_series(df: DataFrame, ts: str, value: str, key=None) -> DataFrame:
    """(key…, ts, value) without rows whose time does not parse."""
    keys = as_list(key)
    out = df.select(*[col(k) for k in keys], as_timestamp(df, ts).alias("ts"), col(value).cast("double").alias("value"))
    return out.filter(at().isNotNull())


def attach(df: DataFrame, stats: DataFrame, key=None) -> DataFrame:
    """Columns of a per-series aggregate on every row: literals for one series, a join on key for many."""
    keys = as_list(key)
    names = [c for c in stats.columns if c not in keys]
    if not keys:
        row = stats.first()
        types = {f.name: f.dataType for f in stats.schema.fields}
        return df.select("*", *[F.lit(row[n]).cast(types[n]).alias(n) for n in names])
    return lookup(df, stats, keys)


def series_overview(s: DataFrame, key=None) -> DataFrame:
    return s.groupBy(*as_list(key)).agg(
        F.count(F.lit(1)).alias("points"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count_if(val().isNull()).alias("missing"),
    )


# ---- calendar ------------------------------------------------------------------------------

_PERIODS = {"D": ("day", "1 day"), "W": ("week", "7 days"), "M": ("month", "1 month"), "Q": ("quarter", "3 months"), "Y": ("year", "1 year")}


def _period_end(start: Column, freq: str) -> Column:
    """Label of a period: the day itself, the closing Sunday, or the last day of the month, quarter or year."""
    if freq == "D":
        return start
    if freq == "W":
        return F.date_add(start, 6)
    return F.last_day(F.add_months(start, {"M": 0, "Q": 2, "Y": 11}[freq]))


def resample(s: DataFrame, freq: str, key=None) -> DataFrame:
    """Mean per period; periods without rows appear with a null value."""
    keys = as_list(key)
    unit, step = _PERIODS[freq]
    start = F.to_date(at()) if freq == "D" else F.trunc(at(), unit)
    means = s.groupBy(*[col(k) for k in keys], start.alias("_start")).agg(F.avg(val()).alias("value"))
    span = means.groupBy(*[col(k) for k in keys]).agg(F.min("_start").alias("_a"), F.max("_start").alias("_b"))
    calendar = span.filter(F.col("_a").isNotNull()).select(
        *keys, F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {step}"))).alias("_start")
    )
    label = _period_end(F.col("_start"), freq).cast("timestamp_ntz")
    return match(calendar, means, [*keys, "_start"], "left").select(*[col(k) for k in keys], label.alias("ts"), "value")


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    t = col(ts)
    return df.select(
        "*",
        F.year(t).alias("year"),
        F.month(t).alias("month"),
        F.dayofmonth(t).alias("day"),
        F.weekday(t).alias("weekday"),
        F.dayofyear(t).alias("day_of_year"),
        F.quarter(t).alias("quarter"),
        (F.weekday(t) >= 5).alias("weekend"),
    )


def monthly_average(s: DataFrame, key=None) -> DataFrame:
    return s.groupBy(*as_list(key), F.month(at()).alias("month")).agg(F.avg(val()).alias("value"))


def future_calendar(s: DataFrame, n: int, key=None) -> DataFrame:
    """The next n times: month, quarter or year ends if all times are such ends, else the modal gap."""
    keys = as_list(key)
    gaps = over_series(s.select(*keys, "ts"), "ts", keys, lambda w: {"_prev": F.lag(at()).over(w)}, 1)
    days = F.datediff(at(), F.col("_prev"))
    micros = F.expr("timestampdiff(MICROSECOND, _prev, ts)")
    grouped = gaps.groupBy(*[col(k) for k in keys])
    facts = grouped.agg(
        F.max(at()).alias("_last"),
        F.bool_and(F.to_date(at()) == F.last_day(at())).alias("_ends"),
        F.min(days).alias("_lo"),
        F.max(days).alias("_hi"),
    )
    counts = gaps.filter(F.col("_prev").isNotNull()).groupBy(*[col(k) for k in keys], micros.alias("_gap")).count()
    best = Window.partitionBy(*([col(k) for k in keys] or [F.lit(0)])).orderBy(F.desc("count"), "_gap")
    modal = counts.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(*keys, "_gap")
    months = (
        F.when(F.col("_ends") & F.col("_lo").between(28, 31) & F.col("_hi").between(28, 31), 1)
        .when(F.col("_ends") & F.col("_lo").between(90, 92) & F.col("_hi").between(90, 92), 3)
        .when(F.col("_ends") & F.col("_lo").between(365, 366) & F.col("_hi").between(365, 366), 12)
    )
    base = attach(facts, modal, keys)
    steps = base.select(*keys, "_last", "_gap", months.alias("_months"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    by_month = F.last_day(F.add_months(F.to_date("_last"), F.col("_months") * F.col("step"))).cast("timestamp_ntz")
    by_gap = F.expr("timestampadd(MICROSECOND, _gap * step, _last)")
    return steps.select(*keys, "step", F.when(F.col("_months").isNotNull(), by_month).otherwise(by_gap).alias("ts"))


# ---- gaps ----------------------------------------------------------------------------------

def fill(s: DataFrame, how: str, key=None, **sizes) -> DataFrame:
    """``forward``, ``backward``, ``linear`` (by position; a trailing gap takes the last value, a leading
    gap stays), ``mean`` or ``median``."""
    keys = as_list(key)
    if how in ("forward", "backward"):
        side = "back" if how == "forward" else "on"
        out = nearest_known(s, ORDER, keys, {"_near": val()}, {"_near": side}, **sizes)
        return out.withColumn("value", F.col("_near")).drop("_near")
    if how == "linear":
        placed = with_position(s, ORDER, keys, "_p", **sizes)
        point = F.when(val().isNotNull(), F.struct(F.col("_p").alias("p"), val().alias("v")))
        out = nearest_known(placed, "_p", keys, {"_b": point, "_a": point}, {"_b": "back", "_a": "on"}, **sizes)
        b, a = F.col("_b"), F.col("_a")
        blend = b["v"] + (a["v"] - b["v"]) * (F.col("_p") - b["p"]) / (a["p"] - b["p"])
        return out.withColumn(
            "value", F.when(val().isNotNull(), val()).when(b.isNotNull() & a.isNotNull(), blend).otherwise(b["v"])
        ).drop("_p", "_b", "_a")
    if how == "mean":
        stat = s.groupBy(*keys).agg(F.avg(val()).alias("_fill"))
    elif how == "median":
        stat = series_median(s, keys, **sizes)
    else:
        raise ValueError(f"unknown way to fill: {how!r}")
    return attach(s, stat, keys).withColumn("value", F.coalesce(val(), F.col("_fill"))).drop("_fill")


def series_median(s: DataFrame, key=None, **sizes) -> DataFrame:
    """(key…, _fill): exact median per series from positions in value order, so a hot key is not one task."""
    keys = as_list(key)
    known = s.filter(val().isNotNull())
    if not keys:
        middle = exact_quantiles(known, ["value"], [0.5])["value"][0]
        return s.sparkSession.range(1).select(F.lit(middle).cast("double").alias("_fill"))
    n = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = attach(with_position(known.select(*keys, "value"), "value", keys, "_i", **sizes), n, keys)
    middle = placed.filter((F.col("_i") * 2 >= F.col("_n") - 2) & (F.col("_i") * 2 <= F.col("_n")))
    exact = middle.filter((F.col("_i") == F.floor((F.col("_n") - 1) / 2)) | (F.col("_i") == F.floor(F.col("_n") / 2)))
    # every series has at least one known value here; series without one get no fill
    medians = exact.groupBy(*keys).agg(F.avg(val()).alias("_fill"))
    return match(s.select(*keys).distinct(), medians, keys, "left")


# ---- windows -------------------------------------------------------------------------------

def rolling_stats(s: DataFrame, window: int, key=None, **sizes) -> DataFrame:
    """Mean, std, min and max of the last ``window`` rows; null until that many known values are there."""

    def build(w):
        frame = w.rowsBetween(-(window - 1), 0)
        full = F.count(val()).over(frame) == window
        return {
            f"rolling_{n}": F.when(full, f(val()).over(frame))
            for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
        }

    return over_series(s, ORDER, key, build, window - 1, **sizes)


def rolling_bands(s: DataFrame, window: int, key=None, **sizes) -> DataFrame:
    out = rolling_stats(s, window, key, **sizes)
    mean, std = F.col("rolling_mean"), F.col("rolling_std")
    return out.select(*s.columns, "rolling_mean", (mean + std).alias("upper"), (mean - std).alias("lower"))


def diff(s: DataFrame, k: int = 1, key=None, **sizes) -> DataFrame:
    """value - value k rows before."""
    return over_series(s, ORDER, key, lambda w: {"diff": val() - F.lag(val(), k).over(w)}, k, **sizes)


def lag_features(s: DataFrame, n: int, key=None, **sizes) -> DataFrame:
    return over_series(s, ORDER, key, lambda w: {f"lag_{k}": F.lag(val(), k).over(w) for k in range(1, n + 1)}, n, **sizes)


# ---- autocorrelation -----------------------------------------------------------------------

def acf(s: DataFrame, lags: int = 40, key=None, **sizes) -> DataFrame:
    """Autocorrelation at lags 0…n over the known values: (key…, lag, acf)."""
    keys = as_list(key)
    known = s.filter(val().isNotNull())
    means = known.groupBy(*keys).agg(F.avg(val()).alias("_m"))
    centred = attach(known, means, keys).select(*keys, "ts", (val() - F.col("_m")).alias("value"))
    lagged = lag_features(centred, lags, keys, **sizes)
    sums = lagged.groupBy(*keys).agg(
        F.sum(val() * val()).alias("s0"), *[F.sum(val() * F.col(f"lag_{k}")).alias(f"s{k}") for k in range(1, lags + 1)]
    )
    rows = [
        F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"s{k}"), F.col("s0")).alias("acf")) for k in range(lags + 1)
    ]
    return sums.select(*keys, F.inline(F.array(*rows))).filter(F.col("acf").isNotNull())


def pacf(s: DataFrame, lags: int = 40, key=None, **sizes) -> DataFrame:
    """Partial autocorrelation by Durbin-Levinson on the autocorrelations (at most lags + 1 rows a series)."""
    keys = as_list(key)
    rho = acf(s, lags, keys, **sizes)
    schema = T.StructType([*[rho.schema[k] for k in keys], T.StructField("lag", T.IntegerType()), T.StructField("pacf", T.DoubleType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        r = pdf["acf"].to_numpy()
        out, phi, spread = [1.0], np.zeros(0), 1.0
        for k in range(1, len(r)):
            a = (r[k] - phi @ r[k - 1 : 0 : -1]) / spread if spread > 0 else np.nan
            phi = np.append(phi - a * phi[::-1], a)
            spread *= 1.0 - a * a
            out.append(a)
        made = pdf[[*keys, "lag"]].copy()
        made["pacf"] = out
        return made

    return rho.groupBy(*keys).applyInPandas(solve, schema)


# ---- unit root -----------------------------------------------------------------------------

def gram(df: DataFrame, cols) -> np.ndarray:
    """Sum over rows of x xᵀ for x = (cols…, 1): one partial matrix per Arrow batch, summed by Spark."""
    size = len(cols) + 1

    def partial(batches):
        for pdf in batches:
            x = np.column_stack([pdf.to_numpy(dtype=float), np.ones(len(pdf))])
            g = x.T @ x
            yield pd.DataFrame({"i": np.arange(size * size), "g": g.ravel()})

    cells = df.select(*cols).mapInPandas(partial, "i int, g double").groupBy("i").agg(F.sum("g").alias("g"))
    out = np.zeros(size * size)
    for r in cells.collect():  # (columns + 1)² cells
        out[r["i"]] = r["g"]
    return out.reshape(size, size)


# MacKinnon's response surface for the unit-root t-statistic with a constant.
TAU_MIN, TAU_STAR, TAU_MAX = -18.83, -1.61, 2.74
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
TAU_CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}


def unit_root_p(t: float) -> float:
    if t > TAU_MAX:
        return 1.0
    if t < TAU_MIN:
        return 0.0
    c = TAU_SMALL if t <= TAU_STAR else TAU_LARGE
    return normal_cdf(sum(a * t**i for i, a in enumerate(c)))


def _least_squares(g: np.ndarray, y: int, x: list[int]):
    """(coefficients, residual sum, inverse) of column y on columns x from a Gram matrix."""
    a, b = g[np.ix_(x, x)], g[x, y]
    inv = np.linalg.pinv(a)
    beta = inv @ b
    return beta, max(float(g[y, y] - b @ beta), 0.0), inv


def adf_test(s: DataFrame, max_lag: int | None = None, **sizes) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, lag chosen by AIC, for one series.

    The design matrix stays in Spark; the driver sees only its Gram matrix.
    """
    known = s.filter(val().isNotNull())
    f = one_row(known, {"n": F.count(val()), "m": F.avg(val()), "sd": F.stddev_pop(val())})
    n = f["n"]
    limit = min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)
    limit = limit if max_lag is None else min(max_lag, limit)
    if limit < 0 or not f["sd"]:
        raise ValueError("the series is too short or constant")
    scaled = known.select("ts", ((val() - F.lit(f["m"])) / F.lit(f["sd"])).alias("value"))

    def build(w):
        lagged = [val()] + [F.lag(val(), k).over(w) for k in range(1, limit + 2)]
        made = {"dy": lagged[0] - lagged[1], "level": lagged[1]}
        made.update({f"d{k}": lagged[k] - lagged[k + 1] for k in range(1, limit + 1)})
        return made

    design = over_series(scaled, ORDER, None, build, limit + 1, **sizes)
    cols = ["dy", "level", *[f"d{k}" for k in range(1, limit + 1)]]
    g = gram(design.dropna("any", subset=cols), cols)
    rows = g[-1, -1]
    const = len(cols)

    def aic(p: int) -> float:
        _, ssr, _ = _least_squares(g, 0, [1, *range(2, 2 + p), const])
        return rows * (math.log(2 * math.pi * ssr / rows) + 1) + 2 * (p + 2)

    p = min(range(limit + 1), key=aic)
    used = cols[: 2 + p]
    g = gram(design.dropna("any", subset=used), used)
    rows = g[-1, -1]
    beta, ssr, inv = _least_squares(g, 0, [*range(1, 2 + p), len(used)])
    t = float(beta[0] / math.sqrt(ssr / (rows - p - 2) * inv[0, 0]))
    crit = {k: a + b / rows + c / rows**2 + d / rows**3 for k, (a, b, c, d) in TAU_CRITICAL.items()}
    p_value = unit_root_p(t)
    return s.sparkSession.range(1).select(
        F.lit(t).alias("statistic"),
        F.lit(p_value).alias("p"),
        F.lit(p).alias("lags"),
        F.lit(int(rows)).cast("long").alias("rows"),
        *[F.lit(float(v)).alias(f"critical_{k[:-1]}") for k, v in crit.items()],
        F.lit(p_value < 0.05).alias("stationary"),
    )


# ---- decomposition -------------------------------------------------------------------------

def seasonal_decompose(s: DataFrame, model: str = "additive", period: int = 12, key=None, **sizes) -> DataFrame:
    """(key…, ts, value, trend, seasonal, resid). A multiplicative model falls back to additive for a
    series with a value <= 0. The trend is a centred moving average, continued at both ends by the
    line through the nearest ``period`` trend points."""
    keys = as_list(key)
    known = s.filter(val().isNotNull()).select(*keys, "ts", "value")
    placed = materialize(with_position(known, ORDER, keys, "_p", **sizes))  # read by every step below
    half = period // 2

    def build(w):
        frame = w.rowsBetween(-half, half)
        total = F.sum(val()).over(frame)
        if period % 2 == 0:
            total = total - 0.5 * (F.lag(val(), half).over(w) + F.lead(val(), half).over(w))
        return {"_trend": F.when(F.count(val()).over(frame) == 2 * half + 1, total / period)}

    smooth = materialize(over_series(placed, "_p", keys, build, half, half, **sizes))
    shape = smooth.groupBy(*keys).agg(
        F.min(F.when(F.col("_trend").isNotNull(), F.col("_p"))).alias("_front"),
        F.max(F.when(F.col("_trend").isNotNull(), F.col("_p"))).alias("_back"),
        (F.lit(model == "multiplicative") & (F.min(val()) > 0)).alias("_mult"),
    )
    smooth = attach(smooth, shape, keys)
    p, front, back, trend = F.col("_p"), F.col("_front"), F.col("_back"), F.col("_trend")
    first = (p >= front) & (p < F.least(front + period, back))
    last = (p >= F.greatest(front, back - period)) & (p < back)
    near = lambda cond, c: F.when(cond, c.cast("double"))
    lines = smooth.groupBy(*keys).agg(
        F.regr_slope(near(first, trend), near(first, p)).alias("_fs"),
        F.regr_intercept(near(first, trend), near(first, p)).alias("_fi"),
        F.regr_slope(near(last, trend), near(last, p)).alias("_bs"),
        F.regr_intercept(near(last, trend), near(last, p)).alias("_bi"),
    )
    full = attach(smooth, lines, keys).withColumn(
        "trend",
        F.when(p < front, F.col("_fs") * p + F.col("_fi")).when(p > back, F.col("_bs") * p + F.col("_bi")).otherwise(trend),
    )
    t, mult = F.col("trend"), F.col("_mult")
    full = full.withColumn("_slot", p % period)
    slots = full.groupBy(*keys, "_slot").agg(F.avg(F.when(mult, F.try_divide(val(), t)).otherwise(val() - t)).alias("_avg"), F.first(mult).alias("_m"))
    level = F.avg("_avg").over(Window.partitionBy(*(keys or [F.lit(0)])))  # `period` rows per series
    slots = slots.withColumn("seasonal", F.when(F.col("_m"), F.col("_avg") / level).otherwise(F.col("_avg") - level))
    joined = attach(full, slots.select(*keys, "_slot", "seasonal"), [*keys, "_slot"])
    resid = F.when(mult, F.try_divide(val(), F.col("seasonal") * t)).otherwise(val() - F.col("seasonal") - t)
    return joined.select(*keys, "ts", "value", "trend", "seasonal", resid.alias("resid"))


# ---- thinning and splitting ----------------------------------------------------------------

def every_nth(s: DataFrame, step: int, order=ORDER, key=None, **sizes) -> DataFrame:
    """Every step-th row, of every series if ``key`` is given."""
    return with_position(s, order, as_list(key), name="_p", **sizes).filter(F.col("_p") % step == 0).drop("_p")


def train_test_by_time(s: DataFrame, test: float = 0.2, key=None, order=ORDER, **sizes) -> DataFrame:
    """Adds ``part``: the first floor(n x (1 - test)) rows of each series are 'train'."""
    keys = as_list(key)
    n = s.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    placed = attach(with_position(s, order, keys, "_p", **sizes), n, keys)
    train = F.col("_p") < F.floor(F.col("_n") * F.lit(1.0 - test))
    return placed.withColumn("part", F.when(train, "train").otherwise("test")).drop("_p", "_n")
