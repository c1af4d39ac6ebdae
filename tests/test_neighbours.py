"""The cell index against a sort of all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.catalog import ORACLES, QUERIES
from lumenframe.operators import neighbours as nb
from lumenframe.operators.ml import knn


def plain(train, queries, k, skip_self=False):
    """{query id: [training ids]} by (squared distance, id)."""
    out = {}
    for i, x in queries:
        near = sorted((float(((np.array(x) - np.array(y)) ** 2).sum()), j) for j, y, _ in train if not (skip_self and i == j))
        out[i] = [j for _, j in near[:k]]
    return out


def predictions(train, queries, k, problem, skip_self=False):
    labels, out = {j: c for j, _, c in train}, {}
    for i, near in plain(train, queries, k, skip_self).items():
        got = [labels[j] for j in near]
        out[i] = sum(got) / len(got) if problem == "regression" else min(set(got), key=lambda c: (-got.count(c), c))
    return out


def make(n, dims, seed, grid=False):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 4, (n, dims)) if grid else np.concatenate([rng.normal(c, 0.3, (n // 3 + 1, dims)) for c in (0, 2, 7)])[:n]
    return [(i, [float(v) for v in x], float(rng.integers(0, 3))) for i, x in zip(rng.permutation(n).tolist(), points, strict=True)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, x array<double>, c double").repartition(3)


@pytest.mark.parametrize("problem", ["classification", "regression"])
@pytest.mark.parametrize(("dims", "grid", "pivots", "tile"), [(1, False, None, 7), (3, False, 12, 5), (2, True, 9, 4), (6, False, 40, 1000), (2, False, 1, 50)])
def test_neighbours_equal_a_sort_of_all_distances(spark, problem, dims, grid, pivots, tile):
    rows = make(150, dims, dims, grid)
    df = frame(spark, rows)
    got = {r.id: r.prediction for r in knn(df, df, "x", "c", "id", 4, problem, skip_self=True, tile=tile, pivots=pivots).collect()}
    assert got == pytest.approx(predictions(rows, [(i, x) for i, x, _ in rows], 4, problem, True))


def test_other_queries_and_fewer_points_than_asked_for(spark):
    rows, asked = make(5, 2, 1), [(100 + i, x) for i, x, _ in make(40, 2, 2)]
    got = knn(frame(spark, rows), spark.createDataFrame(asked, "id long, x array<double>"), "x", "c", "id", 9, "regression").collect()
    assert {r.id: r.prediction for r in got} == pytest.approx(predictions(rows, asked, 9, "regression"))


def test_equal_points_cost_no_pairs(spark, monkeypatch):
    rows = [(i, [1.0, 2.0], float(i % 2)) for i in range(3000)] + [(5000 + i, [float(i), 0.0], 1.0) for i in range(50)]
    df = frame(spark, rows)
    seen = []
    monkeypatch.setattr(nb, "nearest", lambda train, queries, keep, tile, pivots, real=nb.nearest: seen.append((train.count(), queries.count())) or real(train, queries, keep, tile, pivots))
    got = {r.id: r.prediction for r in knn(df, df, "x", "c", "id", 3, "regression", skip_self=True).collect()}
    assert seen == [(51, 51)] and len(got) == 3050
    assert got[0] == pytest.approx((1 + 0 + 1) / 3) and got[2999] == pytest.approx((0 + 1 + 0) / 3)  # ids 1 2 3 and 0 1 2


def test_far_cells_are_not_compared(spark, monkeypatch):
    rows = [(i, [float(i % 40) * 100 + (i // 40) * 0.01], 0.0) for i in range(2000)]
    df = frame(spark, rows).select("id", "x")
    pairs = []
    monkeypatch.setattr(nb, "_compared", lambda p, keep, real=nb._compared: pairs.append(p.select(F.sum(F.size("q_id") * F.size("t_id"))).first()[0] or 0) or real(p, keep))
    assert nb.nearest(df, df, 3, pivots=44).count() == 6000
    assert sum(pairs) < 2000 * 2000 / 8


def test_few_queries_share_tiles_and_few_candidates_leave_them(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 24)], 0.0) for i in range(2000)]
    df = frame(spark, rows).select("id", "x")
    reached, made = [], []
    monkeypatch.setattr(nb, "_reached", lambda *a, real=nb._reached: reached.append(real(*a).count()) or real(*a))
    monkeypatch.setattr(nb, "_compared", lambda p, keep, real=nb._compared: made.append(real(p, keep).count()) or real(p, keep))
    asked = df.where("id % 20 = 0")
    got = nb.nearest(df, asked, 3, tile=200, pivots=30).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("d", "tid"))).alias("near")).collect()
    assert {r.qid: [n.tid for n in r.near] for r in got} == plain(rows, [(i, x) for i, x, _ in rows if i % 20 == 0], 3)
    assert reached[0] <= 30 * 2  # one tile would do; a tile for each cell's queries makes hundreds of rows
    assert made[1] < 100 * 30 * 3 / 4  # not three from each of the cells


def test_missing_features_are_left_out(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 0.0), (2, None, 2.0, 0.0), (3, float("nan"), 1.0, 1.0), (4, 1.5, 2.0, 1.0)], "id long, a double, b double, c double")
    got = {r.id: r.prediction for r in knn(df, df, ["a", "b"], "c", "id", 1, skip_self=True).collect()}
    assert got == {1: 1.0, 4: 0.0}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, x array<double>, c double")
    some = frame(spark, make(10, 2, 0))
    assert knn(none, some, "x", "c", "id").collect() == [] and knn(some, none, "x", "c", "id").collect() == []


@pytest.mark.parametrize(("name", "problem"), [("ml11_knn", "classification"), ("ml11_knn_regression", "regression")])
def test_every_row_asks(spark, tmp_path, name, problem):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in x], int(c)) for i, x, c in zip(range(95, 315), rng.normal(0, 1, (220, 4)).round(3), rng.integers(0, 4, 220), strict=True)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r.prediction for r in QUERIES[name](spark, str(tmp_path)).collect()}
    exact = [(i, [float(np.float32(v)) for v in x], c) for i, x, c in rows]
    assert got == pytest.approx(predictions(exact, [(i, x) for i, x, _ in exact], 5, problem, True))
    assert "%" not in ORACLES[name]


@pytest.mark.parametrize("scale", [1e-20, 1.0, 1e6, 1e20])
def test_close_points_far_from_zero_and_ties(spark, scale):
    rng = np.random.default_rng(9)
    points = [[float(v) * scale for v in x] for x in [*(rng.normal(0, 1, (150, 3)) * 1e-3 + 7), *np.eye(3), *np.eye(3) * 2, *rng.integers(0, 3, (60, 3))]]
    points = [list(x) for x in dict.fromkeys(map(tuple, points))]
    rows = [(i, x, 0.0) for i, x in zip(rng.permutation(len(points)).tolist(), points, strict=True)]
    df = frame(spark, rows).select("id", "x")
    got = nb.nearest(df, df, 4, tile=20, pivots=9).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("d", "tid"))).alias("near")).collect()
    assert {r.qid: [n.tid for n in r.near] for r in got} == plain(rows, [(i, x) for i, x, _ in rows], 4)


def test_points_of_other_cells_are_not_shuffled_with_their_queries(spark):
    df = frame(spark, make(300, 3, 5)).select("id", "x")
    plan = nb.nearest(df, df, 4, pivots=12)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct array_contains" in plan
