"""Tabular machine learning on Spark ML: advice, preparation, models, search, metrics, explanation."""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import (
    IndexToString, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, TargetEncoder, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.columns import classify_columns, col, numeric_columns, unit_draw
from lumenframe.operators.clean import modes
from lumenframe.operators.neighbours import knn  # noqa: F401  part of this module's interface
from lumenframe.plans.joins import lookup, match
from lumenframe.plans.onepass import one_row
from lumenframe.plans.ordering import as_list, running_total, with_position
from lumenframe.plans.quantiles import exact_quantiles
from lumenframe.plans.spread import dealt
from lumenframe.plans.storage import materialize

LABEL = "_label"  # indexed or numeric target inside a pipeline

# ---- advice --------------------------------------------------------------------------------

CLASS_LIMIT = 20


def detect_problem(df: DataFrame, target: str) -> DataFrame:
    """One row: distinct values of the target, and classification (text, or fewer than 20) or regression."""
    text = not isinstance(df.schema[target].dataType, T.NumericType)
    return df.agg(F.count_distinct(col(target)).alias("distinct_values")).select(
        F.lit(target).alias("target"),
        "distinct_values",
        F.when(F.lit(text) | (F.col("distinct_values") < CLASS_LIMIT), "classification").otherwise("regression").alias("problem"),
    )


# Model advice by number of rows, as (levels of) model names.
_LEVELS = ("Highly Recommended", "Recommended", "Optional")
_ADVICE = {
    "classification": (
        (1_000, (["Logistic Regression", "Decision Tree"], ["Random Forest", "SVM"], ["KNN", "Naive Bayes"])),
        (100_000, (["Random Forest", "XGBoost"], ["LightGBM", "CatBoost"], ["SVM", "MLP"])),
        (None, (["LightGBM", "CatBoost"], ["XGBoost", "Random Forest"], ["SVM", "Logistic Regression"])),
    ),
    "regression": (
        (1_000, (["Linear Regression", "Decision Tree"], ["Random Forest", "Lasso"], ["Ridge", "ElasticNet"])),
        (100_000, (["Random Forest", "XGBoost"], ["LightGBM", "CatBoost"], ["SVM", "KNN"])),
        (None, (["LightGBM", "CatBoost"], ["XGBoost", "Random Forest"], ["Linear Regression", "Lasso"])),
    ),
}


def recommend_models(df: DataFrame, target: str) -> DataFrame:
    """(level, model) advice from row count, class shares and number of features."""
    problem = detect_problem(df, target).first()["problem"]
    rows = df.count()
    lists = next(lists for bound, lists in _ADVICE[problem] if bound is None or rows < bound)
    pairs = [(level, m) for level, ms in zip(_LEVELS, lists) for m in ms]
    if problem == "classification":
        smallest = df.filter(col(target).isNotNull()).groupBy(col(target)).count().agg(F.min("count"), F.sum("count")).first()
        if smallest[0] is not None and smallest[0] < 0.2 * smallest[1]:
            pairs += [(_LEVELS[0], "Balanced Random Forest"), (_LEVELS[1], "Class Weighted Models")]
    elif len(df.columns) - 1 < 20:
        pairs.append((_LEVELS[0], "Linear Regression"))
    rows_ = [F.struct(F.lit(level).alias("level"), F.lit(m).alias("model")) for level, m in dict.fromkeys(pairs)]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows_)))


# ---- split, weights, preparation -------------------------------------------------------------

def split(df: DataFrame, key, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``part``: 'train' or 'test' by the key alone, so it never changes between runs or executors."""
    return df.withColumn("part", F.when(unit_draw(key, seed) < 1.0 - test, "train").otherwise("test"))


def part_shares(df: DataFrame, target: str) -> DataFrame:
    """Share of each target value inside each part."""
    counts = df.groupBy("part", col(target)).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("part").agg(F.sum("n").alias("_all"))
    return match(counts, totals, ["part"]).select("part", target, "n", (F.col("n") / F.col("_all")).alias("share"))


def with_folds(df: DataFrame, key, folds: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.floor(unit_draw(key, seed) * folds).cast("int"))


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(target, n, weight): balanced weights n / (classes x n of the class)."""
    counts = df.filter(col(target).isNotNull()).groupBy(col(target)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return counts.withColumn("weight", F.lit(float(total["n"] or 0)) / (F.lit(float(total["k"] or 1)) * F.col("n")))


def with_class_weights(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    return lookup(df, class_weights(df, target).select(target, F.col("weight").alias(out)), [target])


def impute_mean(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Numeric features and target with nulls replaced by the mean; refuses unusable input."""
    cols = [*features, target]
    stats = one_row(df, {**{c: F.avg(col(c)) for c in cols}, "#": F.count(F.lit(1))})
    if stats["#"] < 10:
        raise ValueError("at least 10 rows are needed")
    empty = [c for c in cols if stats[c] is None]
    if empty:
        raise ValueError(f"no values in {empty}")
    return df.select(*[F.coalesce(col(c).cast("double"), F.lit(stats[c])).alias(c) for c in cols])


def preprocess(df: DataFrame, target: str, problem: str, encoding: str = "target") -> PipelineModel:
    """Fitted preparation ending in ``features``. Numbers: exact median, then standardised. Categories: mode, then
    one-hot (classification) or target encoding (regression; ``encoding='count'`` uses frequencies)."""
    numbers = [c for c in numeric_columns(df) if c != target]
    texts = [c for c in classify_columns(df)["categorical"] if c != target]
    stages: list = []
    if texts:
        best = modes(df, texts)
        quoted = {c: "'" + str(best.get(c, "")).replace("\\", "\\\\").replace("'", "\\'") + "'" for c in texts}
        filled = ", ".join(f"coalesce(CAST(`{c}` AS STRING), {quoted[c]}) AS `{c}_filled`" for c in texts)
        stages.append(SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"))
        stages.append(
            StringIndexer(inputCols=[f"{c}_filled" for c in texts], outputCols=[f"{c}_index" for c in texts], handleInvalid="keep")
        )
    ready = []
    if numbers:
        middle = {c: q[0] for c, q in exact_quantiles(df, numbers, [0.5]).items()}
        known = ", ".join(f"coalesce(CAST(`{c}` AS DOUBLE), {float(middle[c] or 0.0)!r}D) AS `{c}_known`" for c in numbers)
        stages += [
            SQLTransformer(statement=f"SELECT *, {known} FROM __THIS__"),
            VectorAssembler(inputCols=[f"{c}_known" for c in numbers], outputCol="numbers"),
            StandardScaler(inputCol="numbers", outputCol="numbers_scaled", withMean=True, withStd=True),
        ]
        ready.append("numbers_scaled")
    if texts:
        encoded = [f"{c}_code" for c in texts]
        indexed = [f"{c}_index" for c in texts]
        if problem == "classification":
            stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded, handleInvalid="keep", dropLast=False))
        elif encoding == "target":
            stages.append(TargetEncoder(inputCols=indexed, outputCols=encoded, labelCol=target, targetType="continuous"))
        else:
            raise ValueError("use count_encode before preprocess for frequency encoding")
        ready += encoded
    stages.append(VectorAssembler(inputCols=ready, outputCol="features"))
    return Pipeline(stages=stages).fit(df)


def count_encode(df: DataFrame, column: str) -> DataFrame:
    """The column replaced by how often its value occurs."""
    counts = df.groupBy(col(column)).agg(F.count(F.lit(1)).alias("_n"))
    joined = lookup(df, counts, [column])
    return joined.select(*[F.col("_n").alias(c) if c == column else col(c) for c in df.columns])


# ---- models --------------------------------------------------------------------------------

_TREES = {"seed": 42}
_MODELS = {
    ("linear", "regression"): (R.LinearRegression, {}),
    ("ridge", "regression"): (R.LinearRegression, {"alpha": 1.0}),
    ("lasso", "regression"): (R.LinearRegression, {"alpha": 1.0}),
    ("elastic_net", "regression"): (R.LinearRegression, {"alpha": 1.0, "l1_ratio": 0.5}),
    ("decision_tree", "regression"): (R.DecisionTreeRegressor, _TREES),
    ("random_forest", "regression"): (R.RandomForestRegressor, _TREES),
    ("gradient_boosting", "regression"): (R.GBTRegressor, _TREES),
    ("logistic", "classification"): (C.LogisticRegression, {}),
    ("decision_tree", "classification"): (C.DecisionTreeClassifier, _TREES),
    ("random_forest", "classification"): (C.RandomForestClassifier, _TREES),
    ("gradient_boosting", "classification"): (C.GBTClassifier, _TREES),
    ("svm", "classification"): (C.LinearSVC, {}),
    ("naive_bayes", "classification"): (C.NaiveBayes, {"modelType": "gaussian"}),
    ("neural_net", "classification"): (C.MultilayerPerceptronClassifier, {"seed": 42}),
}
_BINARY_ONLY = {"gradient_boosting", "svm"}
_NO_WEIGHT = {"neural_net"}


def model_names(problem: str) -> list[str]:
    return [n for n, p in _MODELS if p == problem]


def _estimator(model: str, problem: str, params: Mapping, classes: int, width: int, weight: str | None):
    cls, defaults = _MODELS[(model, problem)]
    options = {k: v for k, v in {**defaults, **params}.items() if k not in ("alpha", "l1_ratio")}
    if model == "neural_net":
        options["layers"] = [width, *options.pop("hidden", [16]), classes]
    est = cls(featuresCol="features", labelCol=LABEL, **options)
    if weight and model not in _NO_WEIGHT:
        est.setWeightCol(weight)
    if model in _BINARY_ONLY and problem == "classification" and classes > 2:
        outer = C.OneVsRest(classifier=est, featuresCol="features", labelCol=LABEL)
        return outer.setWeightCol(weight) if weight else outer
    return est


def _penalty(df: DataFrame, target: str, model: str, params: Mapping) -> dict:
    """Spark's parameters for the usual objectives on features as they are:

    ridge |y - Xb|^2 + alpha |b|^2; lasso |y - Xb|^2 / 2n + alpha |b|_1; elastic net with both, alpha l1_ratio |b|_1 and
    alpha (1 - l1_ratio) / 2 |b|^2. Spark divides the label, and with it the squared part's weight, by its deviation.
    """
    given = {**_MODELS[(model, "regression")][1], **params}
    alpha, ratio = given.pop("alpha"), given.pop("l1_ratio", 1.0 if model == "lasso" else 0.0)
    seen = df.agg(F.stddev_samp(col(target)).alias("sd"), F.count(col(target)).alias("n")).first()
    sd = seen["sd"] or 1.0
    squared = alpha * sd / max(seen["n"], 1) if model == "ridge" else alpha * (1 - ratio) * sd
    whole = alpha * ratio + squared
    return {**given, "regParam": whole, "elasticNetParam": alpha * ratio / whole if whole else 0.0, "standardization": False}


def train(
    df: DataFrame, features: Sequence[str], target: str, model: str, params: Mapping | None = None,
    problem: str | None = None, weight: str | None = None, early_stop: str | None = None,
) -> PipelineModel:
    """Fitted pipeline: assembled ``features``, indexed ``label``, model, and for classes ``predicted`` in the
    target's own values. ``early_stop`` names a boolean column that marks the validation rows of boosting."""
    problem = problem or detect_problem(df, target).first()["problem"]
    known = dealt(df.dropna("any", subset=[*features, target]))
    stages: list = [VectorAssembler(inputCols=list(features), outputCol="features")]
    if problem == "classification":
        indexer = StringIndexer(inputCol=target, outputCol=LABEL, stringOrderType="alphabetAsc").fit(known)
        classes = len(indexer.labels)
        stages.append(indexer)
    else:
        classes = 0
        stages.append(SQLTransformer(statement=f"SELECT *, CAST(`{target}` AS DOUBLE) AS {LABEL} FROM __THIS__"))
    params = _penalty(known, target, model, params or {}) if model in ("ridge", "lasso", "elastic_net") else params or {}
    est = _estimator(model, problem, params, classes, len(features), weight)
    if early_stop and model == "gradient_boosting" and not isinstance(est, C.OneVsRest):
        est.setValidationIndicatorCol(early_stop)
    stages.append(est)
    if problem == "classification":
        stages.append(IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels))
    return Pipeline(stages=stages).fit(known)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predictions for rows that may lack the target."""
    scorer = PipelineModel([s for s in model.stages if not _needs_label(s)])
    return scorer.transform(df)


def _needs_label(stage) -> bool:
    if isinstance(stage, SQLTransformer):
        return f"AS {LABEL} FROM" in stage.getStatement()
    return stage.hasParam("outputCol") and stage.isDefined("outputCol") and stage.getOrDefault("outputCol") == LABEL


def default_inputs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row with the mean of every feature, the starting point of a what-if prediction."""
    return df.agg(*[F.avg(col(c)).alias(c) for c in features])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def actual_vs_predicted(model: PipelineModel, df: DataFrame, target: str, order: str | None = None) -> DataFrame:
    out = predict(model, df)
    shown = F.col("predicted") if "predicted" in out.columns else F.col("prediction")
    rows = out.select(*([col(order)] if order and order != target else []), col(target).alias("actual"), shown.alias("predicted"))
    return rows.orderBy(col(order)) if order else rows


# ---- metrics -------------------------------------------------------------------------------

def classification_metrics(pred: DataFrame, label: str, prediction: str, score: str | None = None) -> DataFrame:
    """Accuracy, weighted precision, recall and F1 from confusion counts; ROC AUC from a score if given."""
    cells = pred.groupBy(col(label).alias("l"), col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)
    actual = cells.groupBy(F.col("l").alias("c")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    guessed = cells.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("guessed"))
    per = match(actual, guessed, ["c"], "left").select(
        "support", "tp",
        F.coalesce(F.try_divide("tp", F.coalesce("guessed", F.lit(0))), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)).alias("recall"),
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    weigh = lambda c: F.sum(c * F.col("support")) / F.sum("support")
    out = per.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        weigh(F.col("precision")).alias("precision"), weigh(F.col("recall")).alias("recall"), weigh(f1).alias("f1"),
    )
    if score:
        out = out.withColumn("auc", F.lit(roc_auc(pred, label, score)))
    return out


def roc_auc(pred: DataFrame, label: str, score: str, **sizes) -> float | None:
    """Rank-sum AUC of a 0/1 label; equal scores are merged first and count half."""
    pos = F.sum((col(label) == 1).cast("long"))
    by_score = pred.groupBy(col(score).alias("s")).agg(pos.alias("pos"), (F.count(F.lit(1)) - pos).alias("neg"))
    seen = running_total(by_score, "s", {"upto": "neg"}, **sizes)
    row = seen.agg(
        F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    ).first()
    return float(row["u"] / (row["p"] * row["n"])) if row["p"] and row["n"] else None


def regression_metrics(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """R², MSE, MAE, RMSE, RMSE in percent of the target mean, and their grades."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    s = pred.agg(
        F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("_var"), F.avg(y).alias("_mean")
    )
    r2 = 1 - F.try_divide(F.col("mse"), F.col("_var"))
    rmse = F.sqrt("mse")
    return s.select(
        r2.alias("r2"), "mse", "mae", rmse.alias("rmse"), (F.try_divide(rmse, F.col("_mean")) * 100).alias("rmse_pct"),
        F.when(r2 > 0.85, "Excellent").when(r2 > 0.7, "Good").otherwise("Fair").alias("r2_grade"),
        F.when(F.col("mae") < 0.1 * F.col("_mean"), "Low").otherwise("Moderate").alias("mae_grade"),
    )


def _metrics(model: PipelineModel, df: DataFrame, target: str, problem: str) -> dict[str, float]:
    scored = model.transform(df)
    if problem == "regression":
        row = regression_metrics(scored, LABEL, "prediction").first()
        return {k: row[k] for k in ("r2", "mse", "mae", "rmse")}
    row = classification_metrics(scored, LABEL, "prediction").first()
    out = {k: row[k] for k in ("accuracy", "f1", "precision", "recall")}
    two = len(model.stages[1].labels) == 2
    if two and "probability" in scored.columns:
        out["auc"] = roc_auc(scored.select(LABEL, vector_to_array("probability")[1].alias("score")), LABEL, "score")
    return out


# ---- validation and search -------------------------------------------------------------------

def _table(df: DataFrame, rows: list[dict]) -> DataFrame:
    """A short result list (one row per fold or trial) as a DataFrame."""
    return df.sparkSession.createDataFrame(pd.DataFrame(rows))


def cross_validate(
    df: DataFrame, features: Sequence[str], target: str, model: str, key, folds: int = 5, params: Mapping | None = None,
    problem: str | None = None, seed: int = 42,
) -> DataFrame:
    """(metric, fold…, mean, std) over k folds drawn from the key; std is the population form."""
    problem = problem or detect_problem(df, target).first()["problem"]
    cols = [*features, target]
    data = with_folds(df.dropna("any", subset=cols), key, folds, seed).select(*[col(c) for c in cols], "fold").persist()
    try:
        runs = []
        for f in range(folds):
            fitted = train(data.filter(F.col("fold") != f), features, target, model, params, problem)
            runs.append(_metrics(fitted, data.filter(F.col("fold") == f), target, problem))
    finally:
        data.unpersist()
    rows = []
    for name in runs[0]:
        values = [r[name] for r in runs]
        rows.append({"metric": name, **{f"fold_{i}": v for i, v in enumerate(values)}, "mean": float(np.mean(values)), "std": float(np.std(values))})
    return _table(df, rows)


# Search grids per model family.
GRIDS = {
    "linear": {"fitIntercept": [True, False]},
    "random_forest": {"featureSubsetStrategy": ["sqrt", "log2"], "minInstancesPerNode": [1, 3, 5]},
    "gradient_boosting": {"stepSize": [0.05, 0.1], "maxDepth": [3, 6], "subsamplingRate": [0.8, 1.0]},
    "decision_tree": {"maxDepth": [3, 6, 9]},
    "logistic": {"regParam": [0.0, 0.01, 0.1]},
}


def grid_search(
    df: DataFrame, features: Sequence[str], target: str, model: str, key, grid: Mapping | None = None, folds: int = 3,
    problem: str = "regression", parallelism: int = 4, seed: int = 42,
) -> tuple[DataFrame, PipelineModel]:
    """(leaderboard, best model): cross-validated MSE (regression) or F1 per parameter set."""
    est = _estimator(model, problem, {}, 2, len(features), None)
    builder = ParamGridBuilder()
    for name, values in (grid or GRIDS[model]).items():
        builder = builder.addGrid(est.getParam(name), values)
    maps = builder.build()
    stages: list = [VectorAssembler(inputCols=list(features), outputCol="features")]
    if problem == "regression":
        stages.append(SQLTransformer(statement=f"SELECT *, CAST(`{target}` AS DOUBLE) AS {LABEL} FROM __THIS__"))
        evaluator = RegressionEvaluator(metricName="mse", labelCol=LABEL)
    else:
        stages.append(StringIndexer(inputCol=target, outputCol=LABEL, stringOrderType="alphabetAsc"))
        evaluator = MulticlassClassificationEvaluator(metricName="f1", labelCol=LABEL)
    cols = [*features, target]
    data = materialize(with_folds(df.dropna("any", subset=cols), key, folds, seed).select(*[col(c) for c in cols], "fold"))  # read by every fold
    cv = CrossValidator(
        estimator=Pipeline(stages=[*stages, est]), estimatorParamMaps=maps, evaluator=evaluator, foldCol="fold",
        numFolds=folds, parallelism=parallelism,
    ).fit(data)
    rows = [
        {"params": ", ".join(f"{p.name}={v}" for p, v in m.items()), evaluator.getMetricName(): float(score)}
        for m, score in zip(maps, cv.avgMetrics)
    ]
    return _table(df, rows), cv.bestModel


def auto_ml(
    df: DataFrame, features: Sequence[str], target: str, key, seconds: float = 120, metric: str | None = None,
    problem: str | None = None, families: Sequence[str] | None = None, seed: int = 42, max_trials: int | None = None,
) -> tuple[DataFrame, PipelineModel]:
    """(leaderboard, best model): every family with its defaults first, then random parameter draws, until the
    time is used. Trials are judged on a hash-drawn 20 % of the rows."""
    problem = problem or detect_problem(df, target).first()["problem"]
    metric = metric or ("r2" if problem == "regression" else "accuracy")
    lower = metric in ("mse", "mae", "rmse")
    names = list(families or model_names(problem))
    data = split(df.dropna("any", subset=[*features, target]), key, 0.2, seed).persist()
    fit_on, judge_on = (data.filter(F.col("part") == p) for p in ("train", "test"))
    rng, end, rows, best = random.Random(seed), time.time() + seconds, [], None
    draws = itertools.chain(((n, {}) for n in names), ((n, None) for n in itertools.cycle([n for n in names if n in GRIDS] or names)))
    try:
        for trial, (name, params) in enumerate(draws):
            if rows and (time.time() >= end or (max_trials is not None and trial >= max_trials)):
                break
            if params is None:
                params = {k: rng.choice(v) for k, v in GRIDS.get(name, {}).items()}
            start = time.time()
            try:
                fitted = train(fit_on, features, target, name, params, problem)
            except Exception as e:  # noqa: BLE001 - a family that does not suit the data is one failed trial
                rows.append({"trial": trial, "model": name, "params": str(params), metric: float("nan"), "seconds": time.time() - start, "error": type(e).__name__})
                continue
            value = _metrics(fitted, judge_on, target, problem)[metric]
            rows.append({"trial": trial, "model": name, "params": str(params), metric: float(value), "seconds": time.time() - start, "error": ""})
            if best is None or (value < best[0] if lower else value > best[0]):
                best = (value, fitted)
    finally:
        data.unpersist()
    board = _table(df, rows)
    known = F.when(~F.isnan(metric), F.col(metric))
    return board.orderBy(known.asc_nulls_last() if lower else known.desc_nulls_last()), best[1] if best else None


# ---- explanation ---------------------------------------------------------------------------

def feature_importance(model: PipelineModel, spark, k: int = 10) -> DataFrame:
    """(feature, importance), largest first: tree importances, or absolute coefficients."""
    names = model.stages[0].getInputCols()
    core = next(s for s in model.stages if hasattr(s, "featureImportances") or hasattr(s, "coefficients") or hasattr(s, "coefficientMatrix"))
    if hasattr(core, "featureImportances"):
        values = core.featureImportances.toArray()
    else:
        try:
            values = np.abs(core.coefficients.toArray())
        except Exception:  # noqa: BLE001 - several classes have a matrix instead
            values = np.abs(core.coefficientMatrix.toArray()).mean(axis=0)
    rows = pd.DataFrame({"feature": names, "importance": values.astype(float)})
    return spark.createDataFrame(rows).orderBy(F.desc("importance"), "feature").limit(k)


def shuffle_column(df: DataFrame, column: str, key, seed: int = 42, **sizes) -> DataFrame:
    """The column's values dealt to other rows: each row takes the value of the next row in hash order."""
    return _with_next(df, [column], key, seed, **sizes).select(*[F.col("_next0").alias(c) if c == column else col(c) for c in df.columns])


def _with_next(df: DataFrame, columns: Sequence[str], key, seed: int = 42, **sizes) -> DataFrame:
    """Adds ``_next0``, … : the columns' values in the next row in hash order (after the last one the first)."""
    keys = as_list(key)
    placed = materialize(with_position(df, [F.xxhash64(F.lit(seed), *[col(k) for k in keys]), *keys], name="_p", **sizes))
    n = placed.count()
    moved = placed.select(F.pmod(F.col("_p") + 1, F.lit(n)).alias("_p"), *[col(c).alias(f"_next{i}") for i, c in enumerate(columns)])
    return match(placed, moved, ["_p"]).drop("_p")


def permutation_importance(
    model: PipelineModel, df: DataFrame, features: Sequence[str], target: str, key, problem: str = "regression", metric: str | None = None
) -> DataFrame:
    """(feature, importance): drop of R² or accuracy when one column is shuffled. All columns follow one order, found once."""
    metric = metric or ("r2" if problem == "regression" else "accuracy")
    base = _metrics(model, df, target, problem)[metric]
    dealt_out = materialize(_with_next(df, features, key))
    shuffled = lambda i: dealt_out.select(*[F.col(f"_next{i}").alias(c) if c == features[i] else col(c) for c in df.columns])
    rows = [{"feature": f, "importance": float(base - _metrics(model, shuffled(i), target, problem)[metric])} for i, f in enumerate(features)]
    return _table(df, rows).orderBy(F.desc("importance"))


def partial_dependence(model: PipelineModel, df: DataFrame, feature: str, grid: int = 20) -> DataFrame:
    """(value, prediction): mean prediction over all rows with the feature set to each grid value between its
    5th and 95th percentile. Every row meets the grid map-side; one partial mean per value is shuffled."""
    low, high = exact_quantiles(df, [feature], [0.05, 0.95])[feature]
    values = [low + (high - low) * i / (grid - 1) for i in range(grid)]
    spread = df.drop(feature).withColumn(feature, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return predict(model, spread).groupBy(col(feature).alias("value")).agg(F.avg("prediction").alias("prediction"))


def stack_models(
    df: DataFrame, features: Sequence[str], target: str, models: Sequence[str], key, folds: int = 3, problem: str = "regression", seed: int = 42
) -> DataFrame:
    """Rows with out-of-fold predictions ``m0…`` of the base models and ``prediction`` of the meta model (linear
    or logistic) fitted on them."""
    keys = as_list(key)
    cols = [*keys, *[c for c in features if c not in keys], *([target] if target not in keys else [])]
    data = with_folds(df.dropna("any", subset=[*features, target]).select(*[col(c) for c in cols]), key, folds, seed).persist()
    parts = []
    for f in range(folds):
        held = data.filter(F.col("fold") == f)
        for i, name in enumerate(models):
            fitted = train(data.filter(F.col("fold") != f), features, target, name, {}, problem)
            held = predict(fitted, held).select(*held.columns, F.col("prediction").alias(f"m{i}"))
        parts.append(held)
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    base = materialize(stacked.drop("fold"))
    data.unpersist()
    meta = train(base, [f"m{i}" for i in range(len(models))], target, "linear" if problem == "regression" else "logistic", {}, problem)
    return predict(meta, base).drop("features", "rawPrediction", "probability")
