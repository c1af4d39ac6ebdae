"""Work that grows with the input: rows that are ranked, shuffled or held at once."""

import re

import numpy as np
from pyspark.sql import functions as F

from lumenframe.functions.columns import unit_draw
from lumenframe.operators import charts, images, ml
from lumenframe.operators import text as tx


def _sample(df, n):
    total = df.count()
    rows = df.withColumn("_d", unit_draw(["k"])).collect()
    expected = []
    for g in {r.g for r in rows}:
        mine = sorted((r for r in rows if r.g == g), key=lambda r: (r._d, r.k))
        expected += [(r.k, r.g) for r in mine[: int(len(mine) * (n / total))]]
    return sorted(expected, key=str)


def test_a_stratified_sample_ranks_few_rows(spark, monkeypatch):
    ranked, rank = [], charts.with_position
    monkeypatch.setattr(charts, "with_position", lambda df, *a, **kw: ranked.append(df.count()) or rank(df, *a, **kw))
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("g"), F.col("id") % 3)).alias("g"))
    got = charts.stratified_sample(rows, "g", 300, "k")
    assert got.columns == ["k", "g"] and sorted(map(tuple, got.collect()), key=str) == _sample(rows, 300)
    assert ranked[-1] < 1_000
    # one key on all rows: too few or all of them lie below the bound
    same = rows.withColumn("k", F.lit(5))
    assert charts.stratified_sample(same, "g", 300, "k").count() == 3 * 99 + 2


def test_terms_are_not_shuffled_by_text(spark):
    rows = spark.createDataFrame([(i, f"red blue word{i % 3} word{i % 2}") for i in range(12)] + [(None, "red blue"), (1, "red green"), (2, None)], "id long, text string")
    plan = tx.tfidf(rows, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(id", plan)) == 1 and "hashpartitioning(term" not in plan
    got = {(r.id, r.term): r.tf for r in tx.tfidf(rows, "id", "text", stopwords=(), max_df=1.0).collect()}
    assert got[1, "red"] == 2 and got[None, "blue"] == 1 and (1, "green") not in got


def test_ngrams_of_odd_tokens(spark):
    rows = spark.createDataFrame([("a-b- c--d -e- 1 2 3 a-b",), ("1 2 3",), ("x",), (None,), ("",)], "t string")
    got = {r.ngram: r.n for r in tx.top_ngrams(rows, "t", 2, 10, ()).collect()}
    assert got == {"a-b c--d": 1, "c--d e": 1, "e 1": 1, "3 a-b": 1}


def test_permuted_features_share_one_order(spark, monkeypatch):
    placed, place = [], ml.with_position
    monkeypatch.setattr(ml, "with_position", lambda *a, **kw: placed.append(1) or place(*a, **kw))
    rows = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z")).withColumn("y", 3 * F.col("x") + F.col("z"))
    model = ml.train(rows, ["x", "z"], "y", "linear", {}, "regression")
    got = {r.feature: r.importance for r in ml.permutation_importance(model, rows, ["x", "z"], "y", "id").collect()}
    assert len(placed) == 1
    for name in got:
        metrics = [ml.regression_metrics(ml.predict(model, d), "y", "prediction").first()["r2"] for d in (rows, ml.shuffle_column(rows, name, "id"))]
        assert abs(got[name] - (metrics[0] - metrics[1])) < 1e-9


def test_pictures_are_held_a_few_at_a_time(spark):
    rng = np.random.default_rng(1)
    made = [(f"p{i:03d}", rng.integers(0, 9, int(rng.integers(1, 5)) * 48).astype(np.uint8).tobytes()) for i in range(images.CHUNK * 2 + 3)]
    rows = spark.createDataFrame([((o, len(d) // 48, 16, 3, 16, bytearray(d)),) for o, d in made], "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>").coalesce(1)
    got = {(r.origin, r.channel, r.bin): r.n for r in images.image_histogram(rows).collect()}
    expected = {}
    for o, d in made:
        for c, name in enumerate(("blue", "green", "red")):
            values, n = np.unique(np.frombuffer(d, np.uint8)[c::3], return_counts=True)
            expected |= {(o, name, int(v)): int(k) for v, k in zip(values, n, strict=True)}
    assert got == expected
    assert max(len(p) for p in images._pictures(rows.select("image.*").toArrow().to_batches())) == images.CHUNK
    by_name = {r.origin: np.array(r.features.toArray()) for r in images.colour_features(rows).collect()}
    assert len(by_name) == len(made) and all(v[0] == 1.0 and v.sum() == 1.0 for v in by_name.values() if v[1:].sum() == 0)
    pairs = spark.createDataFrame([(made[0][0], made[0][0]), (made[1][0], made[2][0])], "a string, b string")
    assert {(r.a, r.b): r.mse for r in images.image_pairs_mse(rows, pairs).collect()}[made[0][0], made[0][0]] == 0.0
