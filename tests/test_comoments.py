"""Pair sums by blocks against pandas, distinct values by column."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import profile, stats
from lumenframe.plans import chunks, onepass


def table(n=400, p=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) + 1e6
    x[rng.random((n, p)) < 0.2] = np.nan
    x[:, 3] = 7.5
    x[:, 4] = np.nan
    return pd.DataFrame(x, columns=[f"c{i}" for i in range(p)])


def frame(spark, pdf):
    return spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in pdf.to_numpy()], ", ".join(f"{c} double" for c in pdf)).repartition(20)


def test_correlations_equal_pandas(spark, monkeypatch):
    monkeypatch.setattr(chunks, "FAN", 3)
    pdf = table()
    want = pdf.corr()
    df = frame(spark, pdf)
    plain = {(r.a, r.b): r.r for r in stats.correlation_matrix(df, ["c0", "c1", "c2"]).collect()}
    monkeypatch.setattr(stats, "PLAIN_PAIRS", 0)
    assert {(r.a, r.b): r.r for r in stats.correlation_matrix(df, ["c0", "c1", "c2"]).collect()} == pytest.approx(plain)
    for r in stats.correlation_matrix(df).collect():
        if "c4" in (r.a, r.b):
            assert r.r is None
        elif "c3" in (r.a, r.b):
            assert np.isnan(r.r)
        else:
            assert r.r == pytest.approx(want.loc[r.a, r.b], abs=1e-9)


def test_null_correlations_equal_pandas(spark):
    pdf = table(seed=2)
    want = pdf.isna().astype(float).corr()
    got = {(r.a, r.b): r.r for r in profile.missing_correlation(frame(spark, pdf)).collect()}
    assert set(got) == {(a, b) for a in ("c0", "c1", "c2", "c5") for b in ("c0", "c1", "c2", "c5") if a < b}
    assert all(v == pytest.approx(want.loc[k], abs=1e-9) for k, v in got.items())


def test_five_hundred_columns(spark):
    wide = spark.range(200).select(*[(F.rand(i) if i % 50 else F.col("id") * (i + 1.0)).alias(f"c{i}") for i in range(500)])
    out = stats.correlation_matrix(wide)
    assert out.count() == 500 * 499 // 2 and out.where("a = 'c0' and b = 'c50'").first().r == pytest.approx(1.0)


def test_distinct_values_are_typed(spark):
    df = spark.createDataFrame([(1, -0.0, "b", [1]), (1, 0.0, "a", [1]), (None, 2.5, None, None), (10, float("nan"), "a", [2, 3]), (9, float("nan"), "", [1])], "i int, d double, s string, a array<int>")
    got = {(r.column, r.value): (r.number, r.n) for r in onepass.value_counts(df, ["i", "s"]).collect()}
    assert got == {("i", "1"): (1.0, 2), ("i", None): (None, 1), ("i", "10"): (10.0, 1), ("i", "9"): (9.0, 1), ("s", "a"): (None, 2), ("s", "b"): (None, 1), ("s", None): (None, 1), ("s", ""): (None, 1)}
    d = {(r.value, r.n) for r in onepass.value_counts(df, ["d"]).collect()}
    assert d == {("0.0", 2), ("2.5", 1), ("NaN", 2)}
    assert {(r.value, r.n) for r in onepass.value_counts(df, ["a"]).collect()} == {("[1]", 3), (None, 1), ("[2, 3]", 1)}


def test_samples_in_both_modes(spark):
    df = spark.createDataFrame([(i % 7, f"w{i % 3}", None) for i in range(50)], "i int, s string, e string")
    exact, quick = ({r.column: r.samples for r in profile.profile_columns(df, exact=e).collect()} for e in (True, False))
    assert exact == quick == {"i": "0, 1, 2, 3, 4", "s": "w0, w1, w2", "e": None}
