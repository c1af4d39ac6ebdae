"""Time-series and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.catalog.inputs import rounded
from lumenframe.catalog.registry import query
from lumenframe.operators import forecast as fc
from lumenframe.operators import timeseries as ts


def events(t):
    """One long irregular series with null cells."""
    return ts.prepare_series(
        t.events.select("ts", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value")), "ts", "value"
    )


def by_type(t):
    return ts.prepare_series(t.events, "ts", "value", "event_type")


def monthly(t):
    """Orders per day, resampled to months."""
    return ts.resample(ts.prepare_series(t.orders, "o_orderdate", "o_totalprice"), "M")


EV = "ev AS (SELECT ts, CASE WHEN event_id % 9 <> 0 THEN value END AS value FROM events)"
MO = "mo AS (SELECT CAST(last_day(o_orderdate) AS TIMESTAMP) AS ts, avg(o_totalprice) AS value FROM orders GROUP BY 1)"

_DAY = "CASE WHEN c_custkey % 5 = 0 THEN 'soon' ELSE concat('2024-0', CAST(1 + c_custkey % 9 AS STRING), '-1', CAST(c_custkey % 10 AS STRING)) END"
query("ts1_prepare_series", f"SELECT * FROM (SELECT TRY_CAST({_DAY} AS TIMESTAMP) AS ts, c_acctbal AS value FROM customer) WHERE ts IS NOT NULL")(
    lambda t: ts.prepare_series(t.customer.selectExpr("c_acctbal", f"{_DAY} AS day"), "day", "c_acctbal")
)
query("ts2_series_overview", f"WITH {EV} SELECT count(*) AS points, min(ts) AS first_ts, max(ts) AS last_ts, count(*) - count(value) AS missing FROM ev")(
    lambda t: ts.series_overview(events(t))
)
_LABEL = {
    "D": "CAST(o_orderdate AS DATE)", "W": "CAST(date_trunc('week', o_orderdate) AS DATE) + 6", "M": "last_day(o_orderdate)",
    "Q": "last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH)", "Y": "make_date(CAST(year(o_orderdate) AS BIGINT), 12, 31)",
}
_STEP = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", "M": "INTERVAL 1 MONTH", "Q": "INTERVAL 3 MONTH", "Y": "INTERVAL 1 YEAR"}
_UNIT = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}
_DIGITS = {"D": 6, "W": 7, "M": 6, "Q": 6, "Y": 6}  # averages of cents: chosen so that no mean ends on a half
for _f in "DW":
    query(f"ts3_resample_{_f.lower()}", f"""WITH o AS (SELECT CAST(date_trunc('{_UNIT[_f]}', o_orderdate) AS DATE) AS p, avg(o_totalprice) AS v FROM orders GROUP BY 1),
      c AS (SELECT CAST(unnest(generate_series(min(p), max(p), {_STEP[_f]})) AS DATE) AS o_orderdate FROM o)
      SELECT CAST({_LABEL[_f]} AS TIMESTAMP) AS ts, round(v, {_DIGITS[_f]}) AS value FROM c LEFT JOIN o ON p = o_orderdate""")(
        lambda t, _f=_f: rounded(ts.resample(ts.prepare_series(t.orders, "o_orderdate", "o_totalprice"), _f), _DIGITS[_f])
    )
for _f in "MQY":  # one sparse series per customer, so empty periods occur
    query(f"ts3_resample_{_f.lower()}", f"""WITH o AS (SELECT o_custkey, CAST(date_trunc('{_UNIT[_f]}', o_orderdate) AS DATE) AS p, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2),
      c AS (SELECT o_custkey, CAST(unnest(generate_series(min(p), max(p), {_STEP[_f]})) AS DATE) AS o_orderdate FROM o GROUP BY 1)
      SELECT c.o_custkey, CAST({_LABEL[_f]} AS TIMESTAMP) AS ts, round(v, {_DIGITS[_f]}) AS value FROM c LEFT JOIN o ON p = o_orderdate AND o.o_custkey = c.o_custkey""")(
        lambda t, _f=_f: rounded(ts.resample(ts.prepare_series(t.orders, "o_orderdate", "o_totalprice", "o_custkey"), _f, "o_custkey"), _DIGITS[_f])
    )
query("ts4_fill_forward", f"WITH {EV} SELECT ts, last_value(value IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM ev")(
    lambda t: ts.fill(events(t), "forward")
)
query("ts5_fill_backward", f"WITH {EV} SELECT ts, first_value(value IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM ev")(
    lambda t: ts.fill(events(t), "backward")
)
query("ts6_fill_linear", f"""WITH {EV}, n AS (SELECT *, row_number() OVER (ORDER BY ts) AS p FROM ev),
  b AS (SELECT ts, value, p, last_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER w AS bp, last_value(value IGNORE NULLS) OVER w AS bv,
        first_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER x AS ap, first_value(value IGNORE NULLS) OVER x AS av FROM n
        WINDOW w AS (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT ts, round(CASE WHEN value IS NOT NULL THEN value WHEN bv IS NOT NULL AND av IS NOT NULL THEN bv + (av - bv) * (p - bp) / (ap - bp) ELSE bv END, 6) AS value FROM b""")(
    lambda t: rounded(ts.fill(events(t), "linear"), 6)
)
query("ts7_fill_mean", f"WITH {EV} SELECT ts, round(coalesce(value, avg(value) OVER ()), 6) AS value FROM ev")(lambda t: rounded(ts.fill(events(t), "mean"), 6))
query("ts7_fill_median", f"WITH {EV} SELECT ts, coalesce(value, (SELECT median(value) FROM ev)) AS value FROM ev")(lambda t: ts.fill(events(t), "median"))
query("ts7_fill_median_by_key", "WITH ev AS (SELECT event_type, ts, CASE WHEN event_id % 9 <> 0 THEN value END AS value FROM events) SELECT event_type, ts, round(coalesce(value, median(value) OVER (PARTITION BY event_type)), 6) AS value FROM ev")(
    lambda t: rounded(ts.fill(ts.prepare_series(t.events.select("event_type", "ts", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value")), "ts", "value", "event_type"), "median", "event_type"), 6)
)
_ROLL = ", ".join(f"round(CASE WHEN count(value) OVER w = 5 THEN {f}(value) OVER w END, 6) AS rolling_{n}" for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
query("ts8_rolling_stats", f"WITH {EV} SELECT ts, value, {_ROLL} FROM ev WINDOW w AS (ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")(
    lambda t: rounded(ts.rolling_stats(events(t), 5), 6)
)
query("ts8_rolling_stats_by_key", f"SELECT event_type, ts, value, {_ROLL} FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")(
    lambda t: rounded(ts.rolling_stats(by_type(t), 5, "event_type"), 6)
)
query("ts9_rolling_bands", f"""WITH {EV}, r AS (SELECT ts, value, CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END AS m, stddev_samp(value) OVER w AS s FROM ev WINDOW w AS (ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
  SELECT ts, value, round(m, 6) AS rolling_mean, round(m + s, 6) AS upper, round(m - s, 6) AS lower FROM r""")(lambda t: rounded(ts.rolling_bands(events(t), 5), 6))
query("ts10_diff", f"WITH {EV} SELECT ts, value, round(value - lag(value, 2) OVER (ORDER BY ts), 6) AS diff FROM ev")(lambda t: rounded(ts.diff(events(t), 2), 6))
query("ts11_lag_features", f"WITH {EV} SELECT ts, value, lag(value, 1) OVER w AS lag_1, lag(value, 2) OVER w AS lag_2, lag(value, 3) OVER w AS lag_3 FROM ev WINDOW w AS (ORDER BY ts)")(
    lambda t: ts.lag_features(events(t), 3)
)
query("ts12_calendar_features", """SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
  CAST(dayofyear(ts) AS INTEGER) AS day_of_year, CAST(quarter(ts) AS INTEGER) AS quarter, isodow(ts) >= 6 AS weekend FROM events""")(
    lambda t: ts.calendar_features(t.events.select("event_id", "ts")).drop("ts")
)
query("ts13_monthly_average", "SELECT CAST(month(o_orderdate) AS INTEGER) AS month, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1")(
    lambda t: rounded(ts.monthly_average(ts.prepare_series(t.orders, "o_orderdate", "o_totalprice")))
)
_ACF = """WITH c AS (SELECT event_type, ts, value - avg(value) OVER (PARTITION BY event_type) AS x FROM events), l AS (SELECT event_type, ts, x, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM c),
  k AS (SELECT CAST(range AS INTEGER) AS lag FROM range(11)), s AS (SELECT event_type, sum(x * x) AS s0 FROM l GROUP BY 1)
  SELECT a.event_type, k.lag, round(sum(a.x * b.x) / any_value(s0), 8) AS acf FROM k JOIN l a ON true JOIN l b ON b.i = a.i - k.lag AND a.event_type = b.event_type JOIN s ON s.event_type = a.event_type GROUP BY 1, 2"""
query("ts14_acf", _ACF)(lambda t: rounded(ts.acf(by_type(t), 10, "event_type"), 8))
query("ts15_pacf")(lambda t: ts.pacf(by_type(t), 10, "event_type"))
query("ts15_pacf_two_lags", f"""WITH r AS ({_ACF.replace('range(11)', 'range(3)').replace('round(sum(a.x * b.x) / any_value(s0), 8)', 'sum(a.x * b.x) / any_value(s0)')}),
  p AS (SELECT event_type, max(acf) FILTER (lag = 1) AS r1, max(acf) FILTER (lag = 2) AS r2 FROM r GROUP BY 1)
  SELECT event_type, lag, round(CASE lag WHEN 0 THEN 1.0 WHEN 1 THEN r1 ELSE (r2 - r1 * r1) / (1 - r1 * r1) END, 8) AS pacf FROM r JOIN p USING (event_type)""")(lambda t: rounded(ts.pacf(by_type(t), 2, "event_type"), 8))
query("ts16_adf_no_lags", """WITH s AS (SELECT value, lag(value) OVER (ORDER BY ts, value) AS prev FROM events WHERE event_id % 9 <> 0), r AS (SELECT regr_slope(value - prev, prev) AS b, regr_sxx(value - prev, prev) AS sxx, regr_syy(value - prev, prev) AS syy, count(*) AS n FROM s WHERE prev IS NOT NULL)
  SELECT round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 6) AS statistic, CAST(0 AS INTEGER) AS lags, n AS rows FROM r""")(
    lambda t: ts.adf_test(events(t), max_lag=0).select(F.round("statistic", 6).alias("statistic"), "lags", "rows")
)
query("ts16_adf_test")(lambda t: ts.adf_test(events(t)))
query("ts17_seasonal_decompose", f"""WITH {MO}, n AS (SELECT ts, value, row_number() OVER (ORDER BY ts) - 1 AS p, count(*) OVER () AS n FROM mo),
  t0 AS (SELECT *, CASE WHEN p >= 6 AND p < n - 6 THEN (sum(value) OVER (ORDER BY p ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) - 0.5 * lag(value, 6) OVER (ORDER BY p) - 0.5 * lead(value, 6) OVER (ORDER BY p)) / 12 END AS tr FROM n),
  f AS (SELECT regr_slope(tr, p) AS fs, regr_intercept(tr, p) AS fi FROM t0 WHERE p >= 6 AND p < 18), b AS (SELECT regr_slope(tr, p) AS bs, regr_intercept(tr, p) AS bi FROM t0 WHERE p >= n - 7 - 12 AND p < n - 7),
  t1 AS (SELECT ts, value, p, CASE WHEN p < 6 THEN fs * p + fi WHEN p > n - 7 THEN bs * p + bi ELSE tr END AS trend FROM t0, f, b),
  a AS (SELECT p % 12 AS slot, avg(value - trend) AS avg FROM t1 GROUP BY 1), z AS (SELECT slot, avg - (SELECT avg(avg) FROM a) AS seasonal FROM a)
  SELECT ts, round(value, 6) AS value, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(value - trend - seasonal, 6) AS resid FROM t1 JOIN z ON p % 12 = slot""")(
    lambda t: rounded(ts.seasonal_decompose(monthly(t), "additive", 12), 6)
)
query("ts18_every_nth", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS p FROM events) WHERE p % 7 = 0")(
    lambda t: ts.every_nth(t.events, 7, order=["ts", "event_id"]).select("event_id")
)
query("ts19_train_test_by_time", "SELECT event_type, ts, value, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts) <= floor(count(*) OVER (PARTITION BY event_type) * 0.8) THEN 'train' ELSE 'test' END AS part FROM events")(
    lambda t: ts.train_test_by_time(by_type(t), 0.2, "event_type")
)
query("ts20_future_calendar", f"WITH {MO} SELECT CAST(last_day(CAST(date_trunc('month', (SELECT max(ts) FROM mo)) AS DATE) + to_months(CAST(range + 1 AS INTEGER))) AS TIMESTAMP) AS ts, CAST(range + 1 AS INTEGER) AS step FROM range(6)")(
    lambda t: ts.future_calendar(monthly(t), 6)
)
_AHEAD = "cal AS (SELECT CAST(last_day(CAST(date_trunc('month', (SELECT max(ts) FROM mo)) AS DATE) + to_months(CAST(range + 1 AS INTEGER))) AS TIMESTAMP) AS ts FROM range(6))"
query("fc1_forecast_naive", f"WITH {MO}, {_AHEAD} SELECT ts, round((SELECT max_by(value, ts) FROM mo), 4) AS forecast FROM cal")(
    lambda t: rounded(fc.forecast(monthly(t), "naive", 6))
)
query("fc2_forecast_moving_average", f"WITH {MO}, {_AHEAD} SELECT ts, round((SELECT avg(value) FROM (SELECT value FROM mo ORDER BY ts DESC LIMIT 3)), 4) AS forecast FROM cal")(
    lambda t: rounded(fc.forecast(monthly(t), "moving_average", 6, window=3))
)


def by_day(t):
    return ts.resample(by_type(t), "D", "event_type")


query("fc3_forecast_holt_winters")(lambda t: fc.forecast(by_day(t), "holt_winters", 7, "event_type", period=7))
query("fc4_forecast_arima")(lambda t: fc.forecast(monthly(t), "arima", 6, order=(1, 1, 1)))
query("fc4_forecast_ar1", f"""WITH {MO}, cal AS (SELECT CAST(range + 1 AS INTEGER) AS step, CAST(last_day(CAST(date_trunc('month', (SELECT max(ts) FROM mo)) AS DATE) + to_months(CAST(range + 1 AS INTEGER))) AS TIMESTAMP) AS ts FROM range(6)),
  l AS (SELECT value, lag(value) OVER (ORDER BY ts) AS prev FROM mo), m AS (SELECT regr_slope(value, prev) AS phi, regr_intercept(value, prev) AS c FROM l)
  SELECT ts, round(pow(phi, step) * (SELECT max_by(value, ts) FROM mo) + c * (1 - pow(phi, step)) / (1 - phi), 2) AS forecast FROM cal, m""")(
    lambda t: rounded(fc.forecast(monthly(t), "arima", 6, order=(1, 0, 0)), 2)
)
query("fc5_forecast_sarima")(lambda t: fc.forecast(monthly(t), "arima", 6, order=(1, 0, 0), seasonal=(1, 0, 0), period=12))
query("fc6_forecast_seasonal_regression")(lambda t: fc.forecast(ts.resample(ts.prepare_series(t.orders, "o_orderdate", "o_totalprice"), "D"), "seasonal_regression", 14))
query("fc7_forecast_band", f"WITH {MO}, {_AHEAD} SELECT ts, round((SELECT max_by(value, ts) FROM mo), 4) AS forecast, round((SELECT max_by(value, ts) FROM mo) * 1.1, 4) AS upper, round((SELECT max_by(value, ts) FROM mo) * 0.9, 4) AS lower FROM cal")(
    lambda t: rounded(fc.forecast_band(fc.forecast(monthly(t), "naive", 6)))
)


@query("fc8_forecast_metrics", f"""WITH {MO}, n AS (SELECT ts, value, row_number() OVER (ORDER BY ts) AS p, count(*) OVER () AS n FROM mo), tr AS (SELECT max_by(value, ts) AS f FROM n WHERE p <= floor(n * 0.8))
  SELECT round(avg(abs(value - f)), 4) AS mae, round(sqrt(avg((value - f) ** 2)), 4) AS rmse, round(avg(abs((value - f) / value)) * 100, 6) AS mape, count(*) AS points FROM n, tr WHERE p > floor(n * 0.8) AND p <= floor(n * 0.8) + 6""")
def _(t):
    parts = ts.train_test_by_time(monthly(t), 0.2)
    train, test = (parts.filter(F.col("part") == p).drop("part") for p in ("train", "test"))
    m = fc.forecast_metrics(fc.forecast(train, "naive", 6), test)
    return m.select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("mape", 6).alias("mape"), "points")
