"""The paths for data too large for one task agree with the plain ones, at chunk edges too."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import anomaly
from lumenframe.operators import ml
from lumenframe.operators import timeseries as ts
from lumenframe.plans import ordering, quantiles

BIG = {"window_rows": 0, "chunk_rows": 7}


def rows(df):
    return sorted(tuple("~" if v is None else (round(v, 9) if isinstance(v, float) else str(v)) for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(1)
    data = []
    for i in range(160):  # one key holds most of the rows, gaps everywhere
        key = "hot" if i % 4 else f"k{i % 3}"
        data.append((key, 1000 + i, None if rng.random() < 0.3 else rng.uniform(0, 9)))
    pdf = pd.DataFrame(data, columns=["key", "sec", "value"])
    return (
        spark.createDataFrame(pdf).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
        .select("key", F.timestamp_seconds("sec").cast("timestamp_ntz").alias("ts"), "value").repartition(5)
    )


@pytest.mark.parametrize("key", [None, "key"])
@pytest.mark.parametrize(
    "fn",
    [
        lambda s, k, **z: ts.rolling_stats(s, 3, k, **z),
        lambda s, k, **z: ts.rolling_stats(s, 9, k, **z),
        lambda s, k, **z: ts.lag_features(s, 4, k, **z),
        lambda s, k, **z: ts.diff(s, 2, k, **z),
        lambda s, k, **z: ts.fill(s, "forward", k, **z),
        lambda s, k, **z: ts.fill(s, "backward", k, **z),
        lambda s, k, **z: ts.fill(s, "linear", k, **z),
        lambda s, k, **z: ts.fill(s, "median", k, **z),
        lambda s, k, **z: ts.acf(s, 5, k, **z),
        lambda s, k, **z: ts.seasonal_decompose(s, "additive", 4, k, **z),
        lambda s, k, **z: ts.train_test_by_time(s, 0.2, k, **z),
        lambda s, k, **z: anomaly.anomalies_moving_average(s, ["ts", "value"], "value", 4, 1.5, k, **z),
    ],
)
def test_chunks_equal_plain_window(series, fn, key):
    s = series if key else series.drop("key")
    assert rows(fn(s, key, **BIG)) == rows(fn(s, key))


def test_position_is_dense_and_keyed(series):
    placed = ordering.with_position(series, ["ts", "value"], "key", **BIG)
    for part in placed.toPandas().groupby("key"):
        assert sorted(part[1]["pos"]) == list(range(len(part[1])))


def test_running_total(spark):
    df = spark.range(100).select(F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    big = ordering.running_total(df, "o", {"t": "v"}, **BIG)
    assert rows(big) == rows(ordering.running_total(df, "o", {"t": "v"}))


def test_narrowed_quantiles_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", 50)
    monkeypatch.setattr(quantiles, "SKETCH", 64)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=5000), "b": rng.integers(0, 4, 5000).astype(float), "c": np.where(rng.random(5000) < 0.4, 7.0, rng.random(5000))})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    got = quantiles.exact_quantiles(df, ["a", "b", "c"], probs)
    for c in pdf:
        assert np.allclose(got[c], np.quantile(pdf[c], probs), rtol=0, atol=1e-12)


def test_a_sketch_that_misses_is_asked_again(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", 20)
    monkeypatch.setattr(quantiles, "SKETCH", 8)
    monkeypatch.setattr(quantiles, "SLACK", 1e-6)
    x = np.random.default_rng(4).normal(size=3000)
    df = spark.createDataFrame(pd.DataFrame({"a": x}))
    assert np.allclose(quantiles.exact_quantiles(df, ["a"], [0.1, 0.5])["a"], np.quantile(x, [0.1, 0.5]), rtol=0, atol=1e-12)


def test_nan_is_the_largest_value(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (None,)], "a double")
    got = quantiles.exact_quantiles(df, ["a"], [0.0, 0.5, 1.0])["a"]
    assert got[:2] == [1.0, 2.5] and np.isnan(got[2])


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert quantiles.exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}
    assert quantiles.exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}


def test_auc_by_running_total_equals_pairs(spark):
    rng = random.Random(5)
    data = [(rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(300)]
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(data, "y int, s double")
    assert ml.roc_auc(df, "y", "s") == pytest.approx(want)
    assert ml.roc_auc(df, "y", "s", **BIG) == pytest.approx(want)


def test_shuffle_column_is_a_permutation(spark):
    df = spark.range(50).select("id", (F.col("id") * 2).alias("v"))
    for sizes in ({}, BIG):
        out = ml.shuffle_column(df, "v", "id", **sizes).toPandas()
        assert sorted(out["v"]) == list(range(0, 100, 2))
        assert (out["v"] != out["id"] * 2).any()


def test_equal_rows_are_split_over_partitions(spark):
    df = spark.range(400).select(F.when(F.col("id") < 300, 1).otherwise(F.col("id")).alias("v"))
    placed = ordering._placed(df, [F.col("v")], 8)
    assert placed.groupBy("_pid").count().agg(F.max("count")).first()[0] < 150
    pos = ordering.with_position(df, "v", **BIG).toPandas()["pos"]
    assert sorted(pos) == list(range(400))
