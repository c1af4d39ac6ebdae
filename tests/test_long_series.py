"""Holt-Winters and ARIMA over chunks: equal to plain loops on whole series, and the product of the polynomials."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import arima as ar
from lumenframe.operators import forecast as fc
from lumenframe.operators import smoothing as sm
from lumenframe.plans import chunks as ch


def frame(spark, groups):
    rows = [(k, i, float(v)) for k, y in groups.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k string, i int, value double").repartition(5)
    return df.select("k", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, i)").alias("ts"), "value")


def smooth_plainly(y, period, a, b, g):
    state = sm.first_state(y, period)
    level, trend, season, sse = state[1], state[2], state[3:].copy(), 0.0
    for t, v in enumerate(y):
        e = v - level - trend - season[t % period]
        sse += e * e
        level, trend = level + trend + a * e, trend + a * b * e
        season[t % period] += g * (1 - a) * e
    return sse, np.concatenate([[1, level, trend], season])


def seasonal_series(n, period, seed):
    rng = np.random.default_rng(seed)
    return 50 + 0.1 * np.arange(n) + 8 * np.sin(np.arange(n) * 2 * np.pi / period) + rng.normal(size=n).cumsum() * 0.3 + rng.normal(size=n)


def test_chunks_compose_to_the_whole_series():
    y, period, params = seasonal_series(140, 7, 0), 7, sm.grid([0.5, 0.4, 0.3], 0.3)
    cuts = [0, 28, 70, 77, 140]
    parts = [sm.run(y[a:b], period, params, np.eye(10) if a else sm.first_state(y, period)[:, None]) for a, b in zip(cuts, cuts[1:], strict=False)]
    for folded in (sm.compose(parts), sm.compose([sm.compose(parts[:2]), sm.compose(parts[2:])])):
        for i, p in enumerate(params):
            sse, state = smooth_plainly(y, period, *p)
            assert folded[1][i, 0, 0] == pytest.approx(sse) and folded[0][i, :, 0] == pytest.approx(state)


def test_smoothing_is_the_best_of_its_grid():
    y, centre = seasonal_series(90, 7, 1), sm.CENTRE
    for width in sm.WIDTHS:
        tried = [(smooth_plainly(y, 7, *p)[0], i) for i, p in enumerate(sm.grid(centre, width))]
        best = sm.grid(centre, width)[min(tried)[1]]
        centre = best
    assert sm.fit(y, 7) == pytest.approx(smooth_plainly(y, 7, *best)[1])


def test_holt_winters_over_chunks_equals_one_array(spark, monkeypatch):
    monkeypatch.setattr(ch, "FAN", 3)
    groups = {"a": seasonal_series(400, 7, 2), "b": seasonal_series(95, 7, 3), "short": np.arange(9.0), None: seasonal_series(230, 7, 4)}
    got = fc.forecast_holt_winters(frame(spark, groups), 9, "k", 7, size=28).orderBy("ts").collect()
    for k, y in groups.items():
        want = fc.holt_winters(y, 9, 7) if len(y) > 14 else np.full(9, y.mean())
        assert [r.forecast for r in got if r.k == k] == pytest.approx(want.tolist(), rel=1e-7)
    alone = frame(spark, {"a": groups["a"]}).drop("k")
    assert [r.forecast for r in fc.forecast_holt_winters(alone, 9, period=7, size=28).orderBy("ts").collect()] == pytest.approx(fc.holt_winters(groups["a"], 9, 7).tolist(), rel=1e-7)


def simulate(order, beta, n, seed):
    """A series of the model by its recursion, step by step."""
    rng = np.random.default_rng(seed)
    c, phi, sphi, theta, stheta = order.parts(np.asarray(beta, float))
    a, m = np.convolve(phi, sphi), np.convolve(theta, stheta)
    x, e = np.zeros(n + 200), rng.normal(size=n + 200)
    for t in range(len(x)):
        x[t] = c + e[t] - sum(a[k] * x[t - k] for k in range(1, min(t, len(a) - 1) + 1)) + sum(m[k] * e[t - k] for k in range(1, min(t, len(m) - 1) + 1))
    return x[200:]


def plain_innovations(x, order, beta):
    c, phi, sphi, theta, stheta = order.parts(beta)
    a, m = np.convolve(phi, sphi), np.convolve(theta, stheta)
    e = np.zeros(len(x))
    for t in range(order.ar_top, len(x)):
        e[t] = sum(a[k] * x[t - k] for k in range(len(a))) - c - sum(m[k] * e[t - k] for k in range(1, min(t, len(m) - 1) + 1))
    return e


MODELS = [
    (ar.Order(1, 0, 0), [0.5, 0.7]),
    (ar.Order(2, 0, 1), [0.1, 0.5, 0.2, 0.4]),
    (ar.Order(0, 0, 1, 0, 0, 1, 4), [0.0, 0.5, 0.3]),
    (ar.Order(1, 0, 1, 1, 0, 1, 6), [0.2, 0.6, 0.5, 0.3, 0.4]),
]


@pytest.mark.parametrize(("order", "beta"), MODELS)
def test_innovations_and_their_derivatives(order, beta):
    beta = np.array(beta)
    x = simulate(order, beta, 300, 1)
    got = ar.innovations(x, order, beta)
    assert got[:, 0] == pytest.approx(plain_innovations(x, order, beta), abs=1e-9)
    for i in range(order.size):
        step = np.zeros(order.size)
        step[i] = 1e-6
        slope = (plain_innovations(x, order, beta + step) - plain_innovations(x, order, beta - step)) / 2e-6
        assert got[:, 1 + i] == pytest.approx(slope, abs=1e-5)


@pytest.mark.parametrize(("order", "beta"), MODELS)
def test_fits_find_the_least_squares(order, beta):
    x = simulate(order, beta, 3000, 2)
    found = ar.fit(x, order)
    assert found == pytest.approx(beta, abs=0.12)
    least = (plain_innovations(x, order, found) ** 2).sum()
    rng = np.random.default_rng(3)
    assert all((plain_innovations(x, order, found + rng.normal(size=order.size) * s) ** 2).sum() >= least * (1 - 1e-9) for s in (1e-4, 1e-3, 1e-2) for _ in range(10))


def test_product_lags_have_products_as_coefficients():
    order = ar.Order(1, 0, 0, 1, 0, 0, 12)
    c, phi, sphi, _, _ = order.parts(np.array([0.3, 0.7, 0.6]))
    assert np.convolve(phi, sphi)[[1, 12, 13]] == pytest.approx([-0.7, -0.6, 0.42]) and c == 0.3


def test_differences_are_undone():
    t = np.arange(60.0)
    y = 3 + 2 * t + np.tile([0, 5, -4, 1], 15)
    order = ar.Order(0, 1, 0, 0, 1, 0, 4)
    assert ar.ahead(y, order, ar.fit(y, order), 6) == pytest.approx(3 + 2 * np.arange(60, 66) + np.tile([0, 5, -4, 1], 2)[:6])


@pytest.mark.parametrize("model", [((1, 0, 1), (0, 0, 0), 12), ((1, 1, 1), (1, 0, 0), 5), ((0, 1, 1), (0, 1, 1), 4)])
def test_arima_over_chunks_equals_one_array(spark, monkeypatch, model):
    monkeypatch.setattr(ch, "FAN", 3)
    order = ar.Order(*model[0], *model[1], model[2])
    rng = np.random.default_rng(5)
    x = simulate(ar.Order(1, 0, 1, 0, 0, 1, 4), [0.2, 0.6, 0.3, 0.3], 1500, 6)
    x = x.cumsum() if order.d else x
    for t in range(order.period, len(x) if order.sd else 0):
        x[t] += x[t - order.period]
    groups = {"a": x, "b": rng.normal(size=300).cumsum(), "short": np.arange(5.0)}
    got = fc.forecast_arima(frame(spark, groups), 5, "k", *model, size=300, burn=250).orderBy("ts").collect()
    for k, y in groups.items():
        beta = ar.fit(y, order)
        want = np.full(5, y.mean()) if beta is None else ar.ahead(y, order, beta, 5)
        assert [r.forecast for r in got if r.k == k] == pytest.approx(want.tolist(), rel=1e-5, abs=1e-5)


def test_a_constant_series_has_a_constant_forecast(spark):
    got = fc.forecast_arima(frame(spark, {"a": np.full(60, 4.0)}), 3, "k").collect()
    assert [r.forecast for r in got] == pytest.approx([4.0] * 3)
