"""Rules at the edges: empty and constant columns, ties, Unicode, nulls, small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import distributions as d
from lumenframe.operators import charts, clean, ml, profile, schema, sqltables, stats
from lumenframe.operators import forecast as fc
from lumenframe.operators import images as im
from lumenframe.operators import text as tx
from lumenframe.operators import timeseries as ts
from lumenframe.sources import readers, writers


def one(df):
    return df.collect()[0]


def test_fill_mode_takes_smallest_tie_as_number(spark):
    df = spark.createDataFrame([(10,), (9,), (10,), (9,), (None,)], "a int")
    assert sorted(r.a for r in clean.fill_missing(df, "mode").collect()) == [9, 9, 9, 10, 10]


def test_all_null_and_constant_columns(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 5.0)], "a double, b double")
    assert one(clean.scale(df, "standard")).b == 0.0
    assert one(clean.scale(df, "minmax")).b == 0.0
    assert one(clean.fill_missing(df, "mean")).a is None
    assert clean.remove_outliers_iqr(df, "b").count() == 2
    assert clean.remove_outliers_iqr(df, "a").count() == 0
    assert {r.column: r.missing for r in profile.missing_counts(df).collect()} == {"a": 2}
    assert profile.missing_correlation(df).count() == 0
    assert one(charts.bubble_scale(df, "b")).bubble_size == 20.0


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, s string")
    assert one(schema.is_structured(df)).structured is False
    assert profile.profile_columns(df).count() == 2
    assert charts.histogram(df, "a").count() == 0
    assert clean.merge_similar_categories(df, "s").count() == 0


def test_title_case_follows_any_non_letter(spark):
    df = spark.createDataFrame([("o'neil's big-café 3rd",)], "s string")
    assert one(clean.text_case(df, "title")).s == "o'neil's big-café 3rd".title()


def test_unicode_string_ops(spark):
    df = spark.createDataFrame([("  café! 12 naïve\t x  ",)], "s string")
    out = one(clean.string_ops(df, ["remove_special_chars", "remove_numbers", "remove_extra_spaces"])).s
    assert out == "café naïve x"


def test_tail_probabilities():
    # textbook values
    assert d.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert d.f_upper(4.96, 1, 10) == pytest.approx(0.05, abs=1e-3)
    assert d.chi2_upper(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert d.chi2_upper(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert d.normal_quantile(np.array([0.975, 0.5, 0.001]))[0] == pytest.approx(1.959964, abs=1e-6)


def test_t_test_on_known_numbers(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (4.0, None)], "a double, b double")
    r = one(stats.t_test(df, "a", "b"))
    a, b = np.array([1, 2, 3, 4.0]), np.array([2, 4, 6.0])
    sp = ((3 * a.var(ddof=1)) + 2 * b.var(ddof=1)) / 5
    assert r.t == pytest.approx((a.mean() - b.mean()) / math.sqrt(sp * (1 / 4 + 1 / 3)))
    assert 0 < r.p < 1


def test_chi_square_counts_empty_cells(spark):
    df = spark.createDataFrame([("a", "x")] * 3 + [("b", "y")] * 4 + [("c", "x")] * 2, "p string, q string")
    o = np.array([[3, 0], [0, 4], [2, 0]])
    e = o.sum(1)[:, None] * o.sum(0)[None, :] / o.sum()
    assert one(stats.chi_square(df, "p", "q")).chi2 == pytest.approx(((o - e) ** 2 / e).sum())


def test_colour_rules(spark):
    df = spark.createDataFrame([(0.0, 10, -5.0), (1.0, 200, 5.0)], "a double, b int, c double")
    assert [r.red for r in charts.colour_scale(df, "a").orderBy("a").collect()] == [0, 255]
    assert [r.red for r in charts.colour_scale(df, "b").orderBy("b").collect()] == [10, 200]
    assert [r.red for r in charts.colour_scale(df, "c").orderBy("c").collect()] == [0, 255]


def test_statements_split_outside_quotes():
    assert sqltables.split_statements("select ';' as a; -- no; split\n select 2;;") == ["select ';' as a", "-- no; split\n select 2"]


def test_update_keeps_rows_where_condition_is_unknown(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, v int")
    assert {r.id: r.v for r in sqltables.update_where(df, "v > 1", {"v": "v + id"}).collect()} == {1: None, 2: 7}
    assert sqltables.delete_where(df, "v > 1").count() == 1


def test_join_keeps_names_apart(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, v int"), spark.createDataFrame([(1, 3)], "k int, v int")
    assert sqltables.join_tables(a, b, "k", "k").columns == ["k", "v", "k_right", "v_right"]


def series(spark, values, step="day"):
    pdf = pd.DataFrame({"i": range(len(values)), "value": [None if v is None else float(v) for v in values]})
    df = spark.createDataFrame(pdf, "i int, value double").withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return df.select(F.expr("timestampadd(DAY, i, timestamp_ntz'2024-01-01 00:00:00')").alias("ts"), "value")


def test_decomposition_adds_up_and_multiplicative_falls_back(spark):
    values = [10 + i * 0.5 + [0, 3, -3, 1][i % 4] for i in range(24)]
    out = ts.seasonal_decompose(series(spark, values), "additive", 4).toPandas()
    assert np.allclose(out["trend"] + out["seasonal"] + out["resid"], out["value"])
    assert abs(out["seasonal"].head(4).sum()) < 1e-9
    same = ts.seasonal_decompose(series(spark, [v - 12 for v in values]), "multiplicative", 4).toPandas()
    assert np.allclose(same["trend"] + same["seasonal"] + same["resid"], same["value"])
    product = ts.seasonal_decompose(series(spark, values), "multiplicative", 4).toPandas()
    assert np.allclose(product["trend"] * product["seasonal"] * product["resid"], product["value"])


def test_rolling_is_null_around_a_gap(spark):
    out = ts.rolling_stats(series(spark, [1, 2, None, 4, 5, 6]), 2).orderBy("ts").toPandas()["rolling_mean"]
    assert [None if math.isnan(v) else v for v in out] == [None, 1.5, None, None, 4.5, 5.5]


def test_acf_and_pacf_start_at_one(spark):
    s = series(spark, [math.sin(i / 2) for i in range(60)])
    a = {r.lag: r.acf for r in ts.acf(s, 3).collect()}
    p = {r.lag: r.pacf for r in ts.pacf(s, 3).collect()}
    assert a[0] == pytest.approx(1) and p[0] == pytest.approx(1) and p[1] == pytest.approx(a[1])
    assert p[2] == pytest.approx((a[2] - a[1] ** 2) / (1 - a[1] ** 2))


def test_unit_root_tells_walk_from_noise(spark):
    rng = np.random.default_rng(0)
    noise = rng.normal(size=200)
    assert one(ts.adf_test(series(spark, noise))).stationary
    assert not one(ts.adf_test(series(spark, noise.cumsum() + np.arange(200)))).stationary


def test_adf_without_lags_equals_plain_regression(spark):
    y = np.random.default_rng(2).normal(size=50).cumsum()
    dy, x = np.diff(y), np.column_stack([y[:-1], np.ones(49)])
    b, ssr, *_ = np.linalg.lstsq(x, dy, rcond=None)
    se = math.sqrt(ssr[0] / 47 * np.linalg.inv(x.T @ x)[0, 0])
    assert one(ts.adf_test(series(spark, y), max_lag=0)).statistic == pytest.approx(b[0] / se)


def test_forecasts_follow_a_clean_pattern(spark):
    season = [0, 5, -5, 2, -2, 3, -3]
    y = np.array([100 + i + season[i % 7] for i in range(70)], dtype=float)
    want = np.array([100 + i + season[i % 7] for i in range(70, 77)])
    assert np.abs(fc.holt_winters(y, 7, 7) - want).max() < 1.0
    assert np.abs(fc.arima(y, 7, (0, 1, 0), (1, 0, 0), 7) - want).max() < 1.5
    out = fc.forecast(series(spark, y), "seasonal_regression", 3).orderBy("ts").toPandas()
    assert len(out) == 3 and str(out["ts"].iloc[0]).startswith("2024-03-11")


def test_short_series_forecast_falls_back_to_the_mean(spark):
    out = fc.forecast(series(spark, [1, 2, 3]), "holt_winters", 2).toPandas()
    assert out["forecast"].tolist() == [2.0, 2.0]


def test_text_options(spark):
    df = spark.createDataFrame([("<p>The CAFÉ &amp; bar 😀 won't 42 re-open</p><script>x<y</script>",), (None,)], "t string")
    assert [r.t for r in tx.preprocess_text(df, "t").collect()] == ["café bar wont re-open", ""]


def test_sentiment_of_unknown_words_is_neutral(spark):
    df = spark.createDataFrame([("good good bad",), ("xyz",)], "t string")
    a, b = tx.sentiment(df, "t").collect()
    assert (a.sentiment, round(a.sentiment_score, 6)) == ("positive", round(1 / 3, 6))
    assert (b.sentiment, b.sentiment_score, b.confidence) == ("neutral", 0.0, 0.5)


def test_tfidf_rows_have_length_one(spark):
    df = spark.createDataFrame([(1, "red fox red"), (2, "red dog fox"), (3, "blue dog")], "id int, t string")
    w = tx.tfidf(df, "id", "t").toPandas()
    assert np.allclose((w.weight**2).groupby(w.id).sum(), 1)
    assert set(w.term) == {"red", "fox", "dog"}


def test_summary_keeps_text_order():
    from lumenframe.operators.summaries import split_sentences, summary

    text = "Cats like fish. Dogs like bones. Cats and dogs like fish. The moon is far. Fish fear cats."
    out = summary(split_sentences(text), 2)
    assert out and all(s.strip() in text for s in out.split(".") if s)
    assert summary(split_sentences("One only."), 3) == "One only."


def test_image_operators(spark):
    a, b = bytes([0, 10, 20] * 4), bytes([255, 10, 20] * 4)
    df = spark.createDataFrame(
        [(("a", 2, 2, 3, 16, bytearray(a)),), (("b", 2, 2, 3, 16, bytearray(b)),)],
        "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>",
    )
    s = {(r.origin, r.channel): r.mean for r in im.image_stats(df).collect()}
    assert s[("b", "blue")] == 255 and s[("a", "red")] == 20
    pair = spark.createDataFrame([("a", "b")], "a string, b string")
    assert one(im.image_pairs_mse(df, pair)).mse == pytest.approx(255**2 / 3)
    assert im.palette(df, 2).agg(F.sum("share")).first()[0] == pytest.approx(1)


def test_encodings_are_tried_in_turn(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("id,name\n1,café\n".encode("latin-1"))
    (tmp_path / "u.csv").write_bytes("id,name\n1,café\n".encode("utf-8"))
    for name in ("l.csv", "u.csv"):
        assert one(readers.read_csv_encoded(spark, str(tmp_path / name))).name == "café"


def test_nan_reads_as_null(spark, tmp_path):
    spark.createDataFrame([(float("nan"),), (1.0,)], "a double").write.parquet(str(tmp_path / "n.parquet"))
    assert readers.read_table(spark, str(tmp_path / "n.parquet")).filter("a is null").count() == 1


def test_history(spark, tmp_path):
    path = str(tmp_path / "h")
    for i in range(3):
        writers.append_history(spark, path, {"text": f"q{i}", "metrics": {"rows": i}})
    assert writers.latest_runs(spark.read.parquet(path), 2).count() == 2


def test_restructure_promotes_the_fullest_row(spark):
    df = spark.createDataFrame([(0, None, "junk", None), (1, "Name (full)", "Age", None), (2, "Ann", "", None)], "i int, a string, b string, c string")
    out = schema.restructure(df, "i")
    assert out.columns[:2] == ["i", "MISSING_VALUE"] or "Name_full" in out.columns


def test_one_hot_refuses_wide_columns(spark):
    with pytest.raises(ValueError):
        clean.one_hot(spark.range(5).select(F.col("id").cast("string").alias("s")), max_values=3)


def test_row_wise_operators_take_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "Hi @you #Tag!"), (2, "see http://x.y now")], "id int, t string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = clean.text_case(sqltables.delete_where(tx.clean_social(stream, "t"), "id > 5"), "upper", ["cleaned_text"])
    q = out.writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.cleaned_text for r in spark.table("cleaned").collect()) == ["HI TAG", "SEE NOW"]


def test_profile_counts_nulls_and_shows_values(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "s string")
    r = one(profile.profile_columns(df))
    assert (r.unique, r.missing, r.missing_pct, r.samples) == (2, 1, 25.0, "a, b")
    d_ = one(profile.describe_all(df))
    assert (d_["count"], d_["unique"], d_["top"], d_["freq"]) == (3, 2, "b", 2)


def test_multiclass_boosting_and_svm_fit(spark):
    pdf = pd.DataFrame({"id": range(90), "x": [i % 3 + (i % 7) / 10 for i in range(90)], "c": [str(i % 3) for i in range(90)]})
    df = spark.createDataFrame(pdf)
    for name in ("gradient_boosting", "svm"):
        m = ml.train(df, ["x"], "c", name, {"maxIter": 3})
        assert set(r.predicted for r in ml.predict(m, df).select("predicted").distinct().collect()) <= {"0", "1", "2"}


# --- results keep every row, whatever the size


def test_qq_points_keep_every_row_and_both_ends(spark):
    from lumenframe.operators.charts import qq_points

    df = spark.range(25_001).selectExpr("cast(id as double) as v")
    got = qq_points(df, "v")
    assert got.count() == 25_001 and got.agg({"value": "max"}).first()[0] == 25_000.0
    thin = sorted(r.value for r in qq_points(df, "v", step=1000).collect())
    assert thin[0] == 0.0 and thin[-1] == 25_000.0 and len(thin) == 26


def test_build_query_has_no_limit_of_its_own(spark):
    from lumenframe.operators.sqltables import build_query

    assert build_query({"t": spark.range(1500).toDF("x")}, {"table": "t", "columns": ["x"]}).count() == 1500


def test_every_nth_within_series(spark):
    from lumenframe.operators.timeseries import every_nth

    df = spark.createDataFrame([(k, i) for k in "ab" for i in range(10)], "k string, ts int")
    assert sorted(map(tuple, every_nth(df, 4, order=["ts"], key="k").collect())) == [(k, i) for k in "ab" for i in (0, 4, 8)]


def test_describe_all_of_dates_only(spark):
    from lumenframe.operators.profile import describe_all

    df = spark.sql("SELECT DATE '2024-01-01' AS d UNION ALL SELECT DATE '2024-01-01' UNION ALL SELECT NULL")
    assert [(r["column"], r["count"], r["unique"], r["top"], r["freq"]) for r in describe_all(df).collect()] == [("d", 2, 1, "2024-01-01", 2)]


def test_negative_zero_is_zero(spark):
    from lumenframe.operators.profile import profile_columns

    df = spark.sql("SELECT 0.0D AS v UNION ALL SELECT -0.0D")
    assert [r["unique"] for r in profile_columns(df).collect()] == [1]


def test_knn_votes_on_text_labels(spark):
    from lumenframe.operators.ml import knn

    rows = spark.createDataFrame([(i, float(i), "low" if i < 5 else "high") for i in range(10)], "id long, x double, label string")
    asked = spark.createDataFrame([(100, 0.4), (101, 8.6)], "id long, x double")
    assert dict(map(tuple, knn(rows, asked, ["x"], "label", "id", k=3).collect())) == {100: "low", 101: "high"}
    assert dict(map(tuple, knn(rows, asked, ["x"], "label", "id", k=3, tile=4, pivots=3).collect())) == {100: "low", 101: "high"}


def test_seasonal_models_use_the_product_lags():
    import numpy as np

    from lumenframe.operators.forecast import arima

    rng = np.random.default_rng(0)
    y = np.zeros(900)
    for t in range(13, 900):
        y[t] = 0.7 * y[t - 1] + 0.6 * y[t - 12] - 0.42 * y[t - 13] + rng.normal()
    got = arima(y, 1, (1, 0, 0), (1, 0, 0), 12)[0]
    assert abs(got - (0.7 * y[-1] + 0.6 * y[-12] - 0.42 * y[-13])) < 0.4


def test_package_functions_run_where_the_package_is_not(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from lumenframe.session import local_session
from lumenframe.operators.text import summarize
s = local_session(cores=2, app="elsewhere")
df = s.createDataFrame([(i, "One thing. Another thing here. A third thing here.") for i in range(3)], "id int, t string")
print("ROWS", len(summarize(df, "id", "t", 1).collect()))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS 3" in out.stdout, out.stderr[-2000:]


def test_text_clusters_are_those_of_unit_tfidf_vectors(spark):
    from lumenframe.operators.text import cluster_text, tfidf

    rows = spark.createDataFrame([(1, "apple pie apple"), (2, "apple pie"), (3, "rocket engine"), (4, "rocket engine fuel")], "id long, t string")
    got = cluster_text(rows, "id", "t", k=2).collect()
    by = {r.id: r.cluster for r in got}
    assert by[1] == by[2] != by[3] == by[4]
    want = {}
    for r in tfidf(rows, "id", "t", min_df=1, max_df=1.0, stopwords=()).collect():
        want.setdefault(r.id, []).append(r.weight)
    for r in got:
        assert sorted(r.features.values) == pytest.approx(sorted(want[r.id]))


def test_isolation_forest_flags_what_is_apart(spark):
    from lumenframe.operators.anomaly import isolation_forest

    rows = spark.range(3000).selectExpr("id", "cast(id % 50 as double) as a", "case when id < 5 then 900.0D + id else cast(id % 40 as double) end as b")
    got = isolation_forest(rows, ["a", "b"], contamination=0.02, key="id", tree_rows=128)
    assert {r.id for r in got.where("anomaly").collect()} >= {0, 1, 2, 3, 4}
    again = isolation_forest(rows.repartition(5), ["a", "b"], contamination=0.02, key="id", tree_rows=128)
    assert {(r.id, round(r.score, 9)) for r in got.collect()} == {(r.id, round(r.score, 9)) for r in again.collect()}
