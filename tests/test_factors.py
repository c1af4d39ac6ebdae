"""Non-negative factorisation against a dense version, and its loss over all cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import factors
from lumenframe.operators import text as tx


def dense(x, h, iterations, tolerance):
    """The same alternation on whole matrices, each small problem solved by trying all sets of positive coordinates."""
    from itertools import combinations

    def solve(gram, b):
        best, at = 0.0, np.zeros(len(b))
        for n in range(1, len(b) + 1):
            for s in map(list, combinations(range(len(b)), n)):
                part = np.linalg.lstsq(gram[np.ix_(s, s)], b[s], rcond=None)[0]
                if (part >= 0).all():
                    full = np.zeros(len(b))
                    full[s] = part
                    value = full @ gram @ full / 2 - b @ full
                    if value < best - 1e-15:
                        best, at = value, full
        return at

    before = np.inf
    for _ in range(iterations):
        w = np.array([solve(h @ h.T, h @ r) for r in x])
        h = np.array([solve(w.T @ w, w.T @ c) for c in x.T]).T
        loss = ((x - w @ h) ** 2).sum()
        if before - loss <= tolerance * (x * x).sum():
            break
        before = loss
    return w, h, loss


def table(spark, x):
    cells = [(int(i), f"c{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    return spark.createDataFrame(cells, "r long, c string, v double").repartition(3)


def start(spark, m, k, seed=42):
    names = spark.createDataFrame([(f"c{j:02d}",) for j in range(m)], "c string")
    rows = names.select("c", *[factors.start_value(F.col("c"), j, seed).alias(f"f{j}") for j in range(k)]).orderBy("c").collect()
    return np.array([r[1:] for r in rows]).T


def test_small_problems_are_solved():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(8, 4))
    gram, b = a.T @ a, rng.normal(size=(50, 4))
    x = factors.solve_nonnegative(gram, b)
    slope = x @ gram - b  # optimal: no slope where positive, no falling slope at zero
    assert (x >= 0).all() and np.abs(slope[x > 0]).max() < 1e-8 and slope[x == 0].min() > -1e-8


@pytest.mark.parametrize("k", [1, 3])
def test_equal_to_a_dense_factorisation(spark, k):
    rng = np.random.default_rng(k)
    x = (rng.random((30, 3)) @ rng.random((3, 12))) * (rng.random((30, 12)) < 0.6)
    w, h, loss = factors.nmf(table(spark, x), "r", "c", "v", k, iterations=6, tolerance=0)
    want_w, want_h, want_loss = dense(x, start(spark, 12, k), 6, 0)
    assert loss == pytest.approx(want_loss, rel=1e-6)
    assert np.array([r[1:] for r in w.orderBy("r").collect()]) == pytest.approx(want_w[x.any(axis=1)], abs=1e-4)
    assert np.array([r[1:] for r in h.orderBy("c").collect()]).T == pytest.approx(want_h, abs=1e-4)


def test_an_exact_product_is_found(spark):
    rng = np.random.default_rng(5)
    x = rng.random((40, 2)) @ rng.random((2, 10))
    _, _, loss = factors.nmf(table(spark, x), "r", "c", "v", 2, iterations=40, tolerance=0)
    assert loss < 1e-3 * (x * x).sum()


def test_no_cells(spark):
    w, h, loss = factors.nmf(table(spark, np.zeros((2, 2))), "r", "c", "v", 2)
    assert w.collect() == [] and h.collect() == [] and loss == 0.0


def test_topics_part_two_subjects(spark):
    texts = [(i, "apple pear plum fruit") if i % 2 else (i, "engine wheel brake motor") for i in range(12)] + [(99, ""), (98, None)]
    words, shares = tx.topics(spark.createDataFrame(texts, "id long, t string"), "id", "t", 2, "nmf", words_per_topic=4)
    by = {}
    for r in words.collect():
        by.setdefault(r.topic, set()).add(r.term)
    assert sorted(map(sorted, by.values())) == [["apple", "fruit", "pear", "plum"], ["brake", "engine", "motor", "wheel"]]
    main = {r.id: r.topic for r in tx.dominant_topic(shares, "id").collect()}
    assert len(main) == 12 and len({main[i] for i in range(0, 12, 2)}) == 1 and main[0] != main[1]


def test_cells_are_not_shuffled_to_meet_few_factors(spark, monkeypatch):
    plans, write = [], factors.materialize
    monkeypatch.setattr(factors, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    cells = spark.range(600).selectExpr("id % 40 AS r", "concat('c', id % 31) AS c", "1.0D + id % 7 AS v").dropDuplicates(["r", "c"])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = factors.nmf(cells, "r", "c", "v", 2, 3)
        assert sum("BroadcastHashJoin" in p for p in plans) >= 2 and not any("SortMergeJoin" in p for p in plans)
        monkeypatch.setattr(factors, "FEW", 0)
        many = factors.nmf(cells, "r", "c", "v", 2, 3)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert any("SortMergeJoin" in p for p in plans)
    for a, b, key in ((few[0], many[0], "r"), (few[1], many[1], "c")):
        a, b = ({r[key]: (r.f0, r.f1) for r in x.collect()} for x in (a, b))
        assert a.keys() == b.keys() and all(abs(x - y) < 1e-9 for k in a for x, y in zip(a[k], b[k], strict=True))


def test_more_factors_are_broadcast_block_by_block_and_old_ones_deleted(spark, monkeypatch):
    plans, made, gone = [], [], []
    monkeypatch.setattr(factors, "materialize", lambda df, real=factors.materialize: plans.append(df._jdf.queryExecution().executedPlan().toString()) or made.append(real(df)) or made[-1])
    monkeypatch.setattr(factors, "discard", lambda df, real=factors.discard: gone.append(df.inputFiles()) or real(df))
    cells = spark.range(600).selectExpr("id % 40 AS r", "concat('c', id % 31) AS c", "1.0D + id % 7 AS v").dropDuplicates(["r", "c"])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    few = factors.nmf(cells, "r", "c", "v", 2, 3, tolerance=0)
    assert len(gone) == 5  # h before the first iteration, then w and h of the first and the second
    del made[:], plans[:], gone[:]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(factors, "FEW", 15)  # three blocks of 31 and of 40
    try:
        many = factors.nmf(cells, "r", "c", "v", 2, 3, tolerance=0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sum("BroadcastHashJoin" in p for p in plans) >= 3 * 6 and not any("SortMergeJoin" in p for p in plans)
    assert len(gone) == 5 + 3 * 6 and len(made) - len(gone) == 3  # the cells and the last factors stay
    for a, b, key in ((few[0], many[0], "r"), (few[1], many[1], "c")):
        a, b = ({r[key]: (r.f0, r.f1) for r in x.collect()} for x in (a, b))
        assert a.keys() == b.keys() and all(abs(x - y) < 1e-9 for k in a for x, y in zip(a[k], b[k], strict=True))
