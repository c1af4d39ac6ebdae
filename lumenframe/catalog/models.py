"""Machine-learning queries. Deterministic parts have a SQL twin; fitted models give rows only."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.catalog.inputs import GAPPY, gappy, rounded
from lumenframe.catalog.registry import query
from lumenframe.catalog.stats import scratch
from lumenframe.operators import ml

LX = ["l_quantity", "l_discount", "l_tax"]
LK = ["l_orderkey", "l_linenumber"]
EMB = [f"e{i}" for i in range(8)]


def priced(t):
    """Regression: price from quantity, discount and tax."""
    return t.lineitem.select(*LK, "l_extendedprice", *LX)


def flagged(t):
    """Classification: return flag (three classes)."""
    return t.lineitem.select(*LK, "l_returnflag", "l_extendedprice", *LX)


def judged(t):
    """Classification: document quality (two classes) from simple text measures."""
    d = t.documents.select("doc_id", F.length("text").cast("double").alias("chars"), F.regexp_count("text", F.lit(r"\n")).cast("double").alias("line_breaks"),
                           F.regexp_count("text", F.lit("[0-9]")).cast("double").alias("digits"))
    return d.join(t.labels, "doc_id")


def vectors(t):
    return t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)])


query("ml1_detect_problem", "SELECT 'l_linenumber' AS target, count(DISTINCT l_linenumber) AS distinct_values, CASE WHEN count(DISTINCT l_linenumber) < 20 THEN 'classification' ELSE 'regression' END AS problem FROM lineitem")(
    lambda t: ml.detect_problem(t.lineitem, "l_linenumber")
)
_TIERS = ("[['Highly Recommended', 'Logistic Regression'], ['Highly Recommended', 'Decision Tree'], ['Recommended', 'Random Forest'], ['Recommended', 'SVM'], ['Optional', 'KNN'], ['Optional', 'Naive Bayes']]",
          "[['Highly Recommended', 'Random Forest'], ['Highly Recommended', 'XGBoost'], ['Recommended', 'LightGBM'], ['Recommended', 'CatBoost'], ['Optional', 'SVM'], ['Optional', 'MLP']]",
          "[['Highly Recommended', 'LightGBM'], ['Highly Recommended', 'CatBoost'], ['Recommended', 'XGBoost'], ['Recommended', 'Random Forest'], ['Optional', 'SVM'], ['Optional', 'Logistic Regression']]")
query("ml2_recommend_models", f"""WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT sum(n) AS n, min(n) / sum(n) AS least FROM c),
  r AS (SELECT unnest(CASE WHEN n < 1000 THEN {_TIERS[0]} WHEN n < 100000 THEN {_TIERS[1]} ELSE {_TIERS[2]} END) AS p FROM s
        UNION ALL SELECT unnest(CASE WHEN least < 0.2 THEN [['Highly Recommended', 'Balanced Random Forest'], ['Recommended', 'Class Weighted Models']] ELSE [] END) FROM s)
  SELECT p[1] AS level, p[2] AS model FROM r""")(lambda t: ml.recommend_models(flagged(t), "l_returnflag"))
_U = "CAST(CAST('0x' || substr(md5(concat_ws('|', '42', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
query("ml3_split", f"""WITH s AS (SELECT CASE WHEN {_U} < 0.8 THEN 'train' ELSE 'test' END AS part, l_returnflag FROM lineitem)
  SELECT part, l_returnflag, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY part) AS DOUBLE), 8) AS share FROM s GROUP BY 1, 2""")(
    lambda t: rounded(ml.part_shares(ml.split(flagged(t), LK, 0.2), "l_returnflag"), 8)
)


@query("ml4_preprocess")
def _(t):
    d = gappy(t).drop("l_orderkey", "l_linenumber", "l_shipdate")
    return ml.preprocess(d, "l_returnflag", "classification").transform(d).select("l_returnflag", F.size(ml.vector_to_array("features")).alias("width")).groupBy("width").count()


@query("ml4_preprocess_target")
def _(t):
    d = gappy(t).drop("l_orderkey", "l_linenumber", "l_shipdate")
    m = ml.preprocess(d, "l_extendedprice", "regression").transform(d)
    return m.select(F.size(ml.vector_to_array("features")).alias("width")).groupBy("width").count()


query("ml4_count_encode", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey) AS l_suppkey FROM lineitem")(
    lambda t: ml.count_encode(t.lineitem.select(*LK, "l_suppkey"), "l_suppkey")
)
query("ml5_impute_mean", f"WITH {GAPPY} SELECT round(coalesce(l_quantity, avg(l_quantity) OVER ()), 6) AS l_quantity, round(coalesce(l_discount, avg(l_discount) OVER ()), 6) AS l_discount, l_extendedprice FROM gappy")(
    lambda t: rounded(ml.impute_mean(gappy(t), ["l_quantity", "l_discount"], "l_extendedprice"), 6)
)


def evaluate(t, data, features, target, key, model, problem, params=None, weight=None):
    parts = ml.split(data, key, 0.2)
    fit_on, judge_on = (parts.filter(F.col("part") == p) for p in ("train", "test"))
    if weight:
        fit_on = ml.with_class_weights(fit_on, target, weight)
    fitted = ml.train(fit_on, features, target, model, params, problem, weight)
    scored = fitted.transform(judge_on)
    if problem == "regression":
        return ml.regression_metrics(scored, ml.LABEL, "prediction")
    return ml.classification_metrics(scored, ml.LABEL, "prediction")


for _m in ("linear", "lasso", "ridge", "elastic_net"):
    query(f"ml6_{_m}")(lambda t, _m=_m: evaluate(t, priced(t), LX, "l_extendedprice", LK, _m, "regression"))
query("ml6_logistic_balanced")(lambda t: evaluate(t, flagged(t), LX, "l_returnflag", LK, "logistic", "classification", weight="w"))
query("ml7_decision_tree")(lambda t: evaluate(t, flagged(t), LX, "l_returnflag", LK, "decision_tree", "classification"))
query("ml7_decision_tree_regression")(lambda t: evaluate(t, priced(t), LX, "l_extendedprice", LK, "decision_tree", "regression"))
query("ml8_random_forest")(lambda t: evaluate(t, vectors(t), EMB, "label", "vec_id", "random_forest", "classification"))
query("ml9_gradient_boosting")(lambda t: evaluate(t, priced(t), LX, "l_extendedprice", LK, "gradient_boosting", "regression", {"maxIter": 10}))
query("ml9_gradient_boosting_classes")(lambda t: evaluate(t, judged(t), ["chars", "line_breaks", "digits"], "quality", "doc_id", "gradient_boosting", "classification", {"maxIter": 5}))
query("ml10_svm")(lambda t: evaluate(t, judged(t), ["chars", "line_breaks", "digits"], "quality", "doc_id", "svm", "classification", {"maxIter": 20}, weight="w"))
_D = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))"
query("ml11_knn", f"""WITH p AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D}, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
  v AS (SELECT vec_id, label, count(*) AS n FROM p WHERE r <= 5 GROUP BY 1, 2) SELECT vec_id, CAST(label AS DOUBLE) AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1""")(
    lambda t: ml.knn(t.embeddings, t.embeddings, "embedding", "label", "vec_id", 5, skip_self=True)
)
query("ml11_knn_regression", f"""WITH p AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D}, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
  SELECT vec_id, avg(label) AS prediction FROM p WHERE r <= 5 GROUP BY 1""")(
    lambda t: ml.knn(t.embeddings, t.embeddings, "embedding", "label", "vec_id", 5, "regression", skip_self=True, tile=100)
)
query("ml12_naive_bayes")(lambda t: evaluate(t, vectors(t), EMB, "label", "vec_id", "naive_bayes", "classification"))
query("ml13_neural_net")(lambda t: evaluate(t, vectors(t), EMB, "label", "vec_id", "neural_net", "classification", {"maxIter": 30}))
query("ml14_class_weights", "SELECT l_returnflag, count(*) AS n, round((SELECT count(*) FROM lineitem) / (3.0 * count(*)), 8)::DOUBLE AS weight FROM lineitem GROUP BY 1")(
    lambda t: rounded(ml.class_weights(t.lineitem, "l_returnflag"), 8)
)
query("ml15_cross_validate")(lambda t: ml.cross_validate(priced(t), LX, "l_extendedprice", "linear", LK, 3, problem="regression"))
query("ml16_grid_search")(lambda t: ml.grid_search(priced(t), LX, "l_extendedprice", "linear", LK)[0])
query("ml17_auto_ml")(lambda t: ml.auto_ml(priced(t), LX, "l_extendedprice", LK, seconds=8, families=["linear", "ridge", "decision_tree"])[0])
# Deterministic predictions from a rule over the whole table: metrics can be compared exactly.
_P = "p AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS p, l_quantity / 50 AS s FROM lineitem)"
query("ml18_classification_metrics", f"""WITH {_P}, c AS (SELECT y AS c, count(*) AS support, count(*) FILTER (p = y) AS tp, (SELECT count(*) FROM p q WHERE q.p = p.y) AS guessed FROM p GROUP BY y),
  m AS (SELECT support, tp, tp / guessed AS pr, tp / support AS rc FROM c), u AS (SELECT s, sum(y) AS pos, count(*) - sum(y) AS neg FROM p GROUP BY 1), a AS (SELECT pos, neg, sum(neg) OVER (ORDER BY s) AS upto FROM u)
  SELECT round(sum(tp) / sum(support), 8)::DOUBLE AS accuracy, round(sum(pr * support) / sum(support), 8)::DOUBLE AS precision, round(sum(rc * support) / sum(support), 8)::DOUBLE AS recall, round(sum(2 * pr * rc / (pr + rc) * support) / sum(support), 8)::DOUBLE AS f1,
  (SELECT round(sum(pos * (upto - neg / 2)) / (sum(pos) * sum(neg)), 8)::DOUBLE FROM a) AS auc FROM m""")(
    lambda t: rounded(ml.classification_metrics(
        t.lineitem.selectExpr("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y", "CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS p", "l_quantity / 50 AS s"), "y", "p", "s"), 8)
)
query("ml19_regression_metrics", """WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem), s AS (SELECT avg((y - p) ** 2) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS v, avg(y) AS m FROM p)
  SELECT round(1 - mse / v, 8) AS r2, round(mse, 2) AS mse, round(mae, 4) AS mae, round(sqrt(mse), 4) AS rmse, round(sqrt(mse) / m * 100, 6) AS rmse_pct, CASE WHEN 1 - mse / v > 0.85 THEN 'Excellent' WHEN 1 - mse / v > 0.7 THEN 'Good' ELSE 'Fair' END AS r2_grade, CASE WHEN mae < 0.1 * m THEN 'Low' ELSE 'Moderate' END AS mae_grade FROM s""")(
    lambda t: ml.regression_metrics(t.lineitem.selectExpr("l_extendedprice AS y", "l_quantity * 1500 AS p"), "y", "p").select(
        F.round("r2", 8).alias("r2"), F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("rmse_pct", 6).alias("rmse_pct"), "r2_grade", "mae_grade")
)
query("ml20_feature_importance")(lambda t: ml.feature_importance(ml.train(priced(t), LX, "l_extendedprice", "decision_tree", {}, "regression"), t.spark))
query("ml20_coefficients")(lambda t: ml.feature_importance(ml.train(priced(t), LX, "l_extendedprice", "linear", {}, "regression"), t.spark))
query("ml21_permutation_importance")(lambda t: ml.permutation_importance(ml.train(priced(t), LX, "l_extendedprice", "linear", {}, "regression"), priced(t), LX, "l_extendedprice", LK))
query("ml22_partial_dependence")(lambda t: ml.partial_dependence(ml.train(priced(t), LX, "l_extendedprice", "decision_tree", {}, "regression"), priced(t), "l_quantity"))
query("ml23_stack_models")(lambda t: ml.regression_metrics(ml.stack_models(priced(t), LX, "l_extendedprice", ["linear", "decision_tree"], LK, 2), "l_extendedprice", "prediction"))
query("ml24_actual_vs_predicted")(lambda t: ml.actual_vs_predicted(ml.train(priced(t), LX, "l_extendedprice", "linear", {}, "regression"), priced(t), "l_extendedprice", "l_quantity"))


# at the mean of its inputs a least-squares model predicts the mean of its target
@query("ml25_predict", "SELECT round(avg(l_quantity), 4) AS l_quantity, round(avg(l_discount), 4) AS l_discount, round(avg(l_tax), 4) AS l_tax, round(avg(l_extendedprice), 3) AS prediction FROM lineitem")
def _(t):
    path = scratch(t)
    ml.save_model(ml.train(priced(t), LX, "l_extendedprice", "linear", {}, "regression"), path)
    made = ml.predict(ml.load_model(path), ml.default_inputs(priced(t), LX))
    return made.select(*[F.round(c, 4).alias(c) for c in LX], F.round("prediction", 3).alias("prediction"))


# with one feature, least squares has a closed form in SQL
_OLS = "m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)"


def line(t):
    return ml.train(priced(t), ["l_quantity"], "l_extendedprice", "linear", {}, "regression")


query("ml6_linear_one_feature", f"""WITH {_OLS}, p AS (SELECT l_extendedprice AS y, a + b * l_quantity AS p FROM lineitem, m), s AS (SELECT avg((y - p) ** 2) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS v FROM p)
  SELECT round(1 - mse / v, 8) AS r2, round(mae, 4) AS mae, round(sqrt(mse), 4) AS rmse FROM s""")(
    lambda t: ml.regression_metrics(line(t).transform(priced(t)), ml.LABEL, "prediction").select(*[F.round(c, d).alias(c) for c, d in (("r2", 8), ("mae", 4), ("rmse", 4))])
)
# penalised slopes of one feature: soft threshold of the covariance over the variance and the squared part's weight
for _m, _cut, _square in (("ridge", "0", "1.0 / n"), ("lasso", "1.0", "0"), ("elastic_net", "0.5", "0.5")):
    query(f"ml6_{_m}_one_feature", f"""WITH s AS (SELECT covar_pop(l_extendedprice, l_quantity) AS c, var_pop(l_quantity) AS v, count(*) AS n FROM lineitem)
  SELECT round(sign(c) * greatest(abs(c) - {_cut}, 0) / (v + {_square}), 3) AS slope FROM s""")(
        lambda t, _m=_m: t.spark.createDataFrame(
            [(float(ml.train(priced(t), ["l_quantity"], "l_extendedprice", _m, {"tol": 1e-10, "maxIter": 500}, "regression").stages[-1].coefficients[0]),)], "slope double"
        ).select(F.round("slope", 3).alias("slope"))
    )
query("ml24_actual_vs_predicted_one_feature", f"WITH {_OLS} SELECT l_quantity, l_extendedprice AS actual, round(a + b * l_quantity, 4) AS predicted FROM lineitem, m")(
    lambda t: rounded(ml.actual_vs_predicted(line(t), priced(t), "l_extendedprice", "l_quantity"), 4)
)
query("ml22_partial_dependence_one_feature", f"""WITH {_OLS}, q AS (SELECT quantile_cont(l_quantity, 0.05) AS lo, quantile_cont(l_quantity, 0.95) AS hi FROM lineitem)
  SELECT round(lo + (hi - lo) * range / 19, 6) AS value, round(a + b * (lo + (hi - lo) * range / 19), 3) AS prediction FROM range(20), q, m""")(
    lambda t: ml.partial_dependence(line(t), priced(t), "l_quantity").select(F.round("value", 6).alias("value"), F.round("prediction", 3).alias("prediction"))
)
_FOLD = f"CAST(floor({_U} * 3) AS INTEGER)"
_FOLDS = f"""d AS (SELECT l_quantity AS x, l_extendedprice AS y, {_FOLD} AS fold FROM lineitem), f AS (SELECT unnest(range(3)) AS f),
  c AS (SELECT f, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sum(x * y) / sum(x * x) AS b0 FROM d JOIN f ON d.fold <> f.f GROUP BY 1)"""
query("ml15_cross_validate_one_feature", f"""WITH {_FOLDS}, e AS (SELECT f, 1 - avg((y - a - b * x) ** 2) / var_pop(y) AS r2, avg((y - a - b * x) ** 2) AS mse, avg(abs(y - a - b * x)) AS mae FROM d JOIN c ON d.fold = c.f GROUP BY 1),
  m AS (SELECT f, 'r2' AS metric, r2 AS v FROM e UNION ALL SELECT f, 'mae', mae FROM e UNION ALL SELECT f, 'rmse', sqrt(mse) FROM e)
  SELECT metric, round(max(v) FILTER (f = 0), 4) AS fold_0, round(max(v) FILTER (f = 1), 4) AS fold_1, round(max(v) FILTER (f = 2), 4) AS fold_2, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std FROM m GROUP BY 1""")(
    lambda t: rounded(ml.cross_validate(priced(t), ["l_quantity"], "l_extendedprice", "linear", LK, 3, problem="regression").where("metric <> 'mse'"), 4)
)
query("ml16_grid_search_one_feature", f"""WITH {_FOLDS}, e AS (SELECT f, avg((y - a - b * x) ** 2) AS with_, avg((y - b0 * x) ** 2) AS without FROM d JOIN c ON d.fold = c.f GROUP BY 1)
  SELECT 'fitIntercept=True' AS params, round(sqrt(avg(with_)), 4) AS rmse FROM e UNION ALL SELECT 'fitIntercept=False', round(sqrt(avg(without)), 4) FROM e""")(
    lambda t: ml.grid_search(priced(t), ["l_quantity"], "l_extendedprice", "linear", LK, grid={"fitIntercept": [True, False]})[0].select("params", F.round(F.sqrt("mse"), 4).alias("rmse"))
)
query("ml20_coefficients_one_feature", f"WITH {_OLS} SELECT 'l_quantity' AS feature, round(abs(b), 4) AS importance FROM m")(lambda t: rounded(ml.feature_importance(line(t), t.spark), 4))
query("ml12_naive_bayes_one_feature", """WITH d AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings), a AS (SELECT var_pop(x) AS v FROM d), s AS (SELECT label, avg(x) AS m, var_pop(x) + 1e-9 * any_value(a.v) AS v, count(*) AS n FROM d, a GROUP BY 1),
  p AS (SELECT d.vec_id, d.label, s.label AS guess, ln(n) - ln(v) / 2 - (x - m) ** 2 / (2 * v) AS score FROM d, s)
  SELECT vec_id, label, CAST(guess AS VARCHAR) AS predicted FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, guess) = 1""")(
    lambda t: ml.train(vectors(t), ["e0"], "label", "naive_bayes", {}, "classification").transform(vectors(t)).select("vec_id", "label", F.col("predicted").cast("string").alias("predicted"))
)
_READY = """g AS (SELECT l_extendedprice AS y, coalesce(l_quantity, (SELECT median(l_quantity) FROM gappy)) AS q, coalesce(l_discount, (SELECT median(l_discount) FROM gappy)) AS d,
  coalesce(l_returnflag, (SELECT l_returnflag FROM gappy WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS flag, l_linestatus AS status FROM gappy)"""
query("ml4_preprocess_values", f"""WITH {GAPPY}, {_READY} SELECT y, round((q - avg(q) OVER ()) / stddev_samp(q) OVER (), 6) AS quantity, round((d - avg(d) OVER ()) / stddev_samp(d) OVER (), 6) AS discount,
  round(avg(y) OVER (PARTITION BY flag), 4) AS flag, round(avg(y) OVER (PARTITION BY status), 4) AS status FROM g""")(lambda t: _prepared(t))


def _prepared(t):
    d = gappy(t).drop("l_orderkey", "l_linenumber", "l_shipdate")
    x = ml.vector_to_array("features")
    made = ml.preprocess(d, "l_extendedprice", "regression").transform(d)
    return made.select(F.col("l_extendedprice").alias("y"), *[F.round(x[i], k).alias(n) for i, (n, k) in enumerate((("quantity", 6), ("discount", 6), ("flag", 4), ("status", 4)))])
