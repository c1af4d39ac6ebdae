"""Forecasts: (key…, ts, forecast) for the next periods of each series, and their errors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.columns import col
from lumenframe.operators import smoothing
from lumenframe.operators.arima import Order, arima_forecast
from lumenframe.operators.arima import ahead as arima_ahead
from lumenframe.operators.arima import fit as fit_arima
from lumenframe.operators.timeseries import ORDER, at, attach, future_calendar, val
from lumenframe.plans.joins import match
from lumenframe.plans.onepass import one_row
from lumenframe.plans.ordering import as_list
from lumenframe.plans.storage import materialize


def forecast(s: DataFrame, method: str, horizon: int, key=None, **params) -> DataFrame:
    """The series is read several times (size, calendar, model), so a derived one is written down first."""
    s = materialize(s)
    return {
        "naive": forecast_naive,
        "moving_average": forecast_moving_average,
        "holt_winters": forecast_holt_winters,
        "arima": forecast_arima,
        "seasonal_regression": forecast_seasonal_regression,
    }[method](s, horizon, key=key, **params)


def _on_calendar(s: DataFrame, level: DataFrame, horizon: int, key) -> DataFrame:
    keys = as_list(key)
    return attach(future_calendar(s, horizon, keys), level, keys).select(*keys, "ts", "forecast")


def forecast_naive(s: DataFrame, horizon: int, key=None) -> DataFrame:
    """The last known value, repeated."""
    last = s.filter(val().isNotNull()).groupBy(*as_list(key)).agg(F.max_by(val(), F.struct("ts", "value")).alias("forecast"))
    return _on_calendar(s, last, horizon, key)


def forecast_moving_average(s: DataFrame, horizon: int, key=None, window: int = 3) -> DataFrame:
    """The mean of the last ``window`` known values, repeated."""
    keys = as_list(key)
    known = s.filter(val().isNotNull())
    if keys:
        newest = Window.partitionBy(*[col(k) for k in keys]).orderBy(F.desc("ts"), F.desc("value"))
        tail = known.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= window)
    else:
        tail = known.orderBy(F.desc("ts"), F.desc("value")).limit(window)
    level = tail.groupBy(*keys).agg(F.avg(val()).alias("forecast"))
    return _on_calendar(s, level, horizon, key)


# ---- recursive models, fitted over chunks of a series -----------------------------------------

def _on_steps(s: DataFrame, made: DataFrame, horizon: int, key) -> DataFrame:
    keys = as_list(key)
    return match(future_calendar(s, horizon, keys), made, [*keys, "step"]).select(*[col(k) for k in keys], "ts", "forecast")


def holt_winters(y: np.ndarray, horizon: int, period: int = 12) -> np.ndarray:
    """Additive trend and season of one array; parameters from a coarse grid refined three times around its best point."""
    if len(y) < 2 * period:
        raise ValueError("needs two full periods")
    return smoothing.ahead(smoothing.fit(np.asarray(y, float) - np.mean(y), period), len(y), horizon, period) + np.mean(y)


def forecast_holt_winters(s: DataFrame, horizon: int, key=None, period: int = 12, size: int | None = None) -> DataFrame:
    """Additive Holt-Winters of series of any length; the mean for a series of less than two periods."""
    return _on_steps(s, smoothing.smooth_forecast(s.filter(val().isNotNull()), horizon, ORDER, key, period, size), horizon, key)


def arima(y: np.ndarray, horizon: int, order=(1, 1, 1), seasonal=(0, 0, 0), period: int = 12) -> np.ndarray:
    """Forecast of one array by ``lumenframe.operators.arima``."""
    model = Order(*order, *seasonal, period)
    beta = fit_arima(np.asarray(y, float), model)
    if beta is None:
        raise ValueError("too short")
    return arima_ahead(np.asarray(y, float), model, beta, horizon)


def forecast_arima(s: DataFrame, horizon: int, key=None, order=(1, 1, 1), seasonal=(0, 0, 0), period: int = 12, **options) -> DataFrame:
    """ARIMA, or SARIMA when ``seasonal`` is not (0, 0, 0), of series of any length; the mean if the fit fails."""
    made = arima_forecast(s.filter(val().isNotNull()), horizon, ORDER, key, Order(*order, *seasonal, period), **options)
    return _on_steps(s, made, horizon, key)


# ---- trend and seasons by regression ---------------------------------------------------------

YEARLY, WEEKLY = 10, 3  # Fourier pairs per season


def _season_columns(seconds, first: float, span: float) -> dict:
    made = {"_t": (seconds - F.lit(first)) / F.lit(span or 1.0)}
    for name, length, pairs in (("y", 365.25 * 86400, YEARLY), ("w", 7 * 86400.0, WEEKLY)):
        for k in range(1, pairs + 1):
            angle = seconds * F.lit(2 * math.pi * k / length)
            made[f"_{name}s{k}"], made[f"_{name}c{k}"] = F.sin(angle), F.cos(angle)
    return made


def forecast_seasonal_regression(s: DataFrame, horizon: int, key=None) -> DataFrame:
    """Linear trend plus yearly and weekly Fourier terms, fitted over the whole series by Spark ML."""
    if key:
        raise ValueError("one series at a time: filter by key first")
    known = s.filter(val().isNotNull())
    seconds = lambda: F.unix_micros(at().cast("timestamp")) / F.lit(1e6)
    f = one_row(known, {"a": F.min(seconds()), "b": F.max(seconds())})
    made = _season_columns(seconds(), f["a"], f["b"] - f["a"])
    design = known.select("ts", "value", *[c.alias(n) for n, c in made.items()])
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=list(made), outputCol="_x"),
            LinearRegression(featuresCol="_x", labelCol="value", predictionCol="forecast", regParam=1e-4),
        ]
    ).fit(design)
    ahead = future_calendar(known, horizon).select("ts")
    return model.transform(ahead.select("ts", *[c.alias(n) for n, c in made.items()])).select("ts", "forecast")


# ---- bands and errors ------------------------------------------------------------------------

def forecast_band(forecasts: DataFrame, share: float = 0.1) -> DataFrame:
    """Placeholder band of ± ``share`` around the forecast."""
    f = F.col("forecast")
    return forecasts.select("*", (f * (1 + share)).alias("upper"), (f * (1 - share)).alias("lower"))


def forecast_metrics(forecasts: DataFrame, actual: DataFrame, key=None) -> DataFrame:
    """MAE, RMSE and MAPE (percent) where forecast and actual share a time."""
    keys = as_list(key)
    pairs = match(forecasts.select(*keys, "ts", "forecast"), actual.select(*keys, "ts", "value"), [*keys, "ts"])
    error = val() - F.col("forecast")
    return pairs.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(error, val()))) * 100).alias("mape"),
        F.count(F.lit(1)).alias("points"),
    )
