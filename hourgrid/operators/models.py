"""Classifiers and regressions on model rows, and what their inputs are worth."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.sampling import hash_sample
from hourgrid.operators import forest
from hourgrid.operators.linear import category_levels
from hourgrid.operators.metrics import ranking_metrics

#: Rows that permutation importance looks at, at most; they are chosen by hash.
IMPORTANCE_ROWS = 20_000


def design_stages(categories: list[str], numbers: list[str], scale: bool = False, out: str = "x") -> list:
    """One-hot categories as seen in training (unseen values get the last slot, which is dropped, so all zero) and numbers,
    standardised on training rows if ``scale``."""
    stages: list = []
    if categories:
        stages += [StringIndexer(inputCols=categories, outputCols=[f"__i_{c}" for c in categories], handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=[f"__i_{c}" for c in categories], outputCols=[f"__h_{c}" for c in categories], dropLast=True)]
    stages += [VectorAssembler(inputCols=numbers, outputCol="__num", handleInvalid="keep")]
    if scale:
        stages += [StandardScaler(inputCol="__num", outputCol="__scaled", withMean=True)]
    return [*stages, VectorAssembler(inputCols=[*[f"__h_{c}" for c in categories], "__scaled" if scale else "__num"], outputCol=out)]


def design_matrix(train: DataFrame, *others: DataFrame, categories: list[str], numbers: list[str], scale: bool = False) -> list[DataFrame]:
    """``train`` and ``others`` with the vector ``x``, all by the statistics of ``train``."""
    fitted = Pipeline(stages=design_stages(categories, numbers, scale)).fit(train)
    return [fitted.transform(df) for df in (train, *others)]


def balanced_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight`` = n / (2 x rows of the class), so both classes weigh the same."""
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}  # two classes
    n = sum(counts.values())
    cases = [F.when(F.col(label) == y, F.lit(n / (2 * k))) for y, k in counts.items() if y is not None]
    return train.withColumn("weight", F.coalesce(*cases, F.lit(1.0)))


def fit_logistic(train: DataFrame, categories: list[str], numbers: list[str], label: str = "label", max_iter: int = 1000) -> PipelineModel:
    """Balanced logistic regression on scaled inputs; a unit penalty on the summed loss is
    1/n on the mean loss."""
    rows = balanced_weights(train, label).withColumn("__y", F.col(label).cast("double"))
    fit = LogisticRegression(featuresCol="x", labelCol="__y", weightCol="weight", maxIter=max_iter, regParam=1.0 / max(1, rows.count()), standardization=False)
    return Pipeline(stages=[*design_stages(categories, numbers, scale=True), fit]).fit(rows)


def fit_boosted(train: DataFrame, categories: list[str], numbers: list[str], label: str = "label", rounds: int = 300, depth: int = 6, rate: float = 0.05) -> PipelineModel:
    """Balanced boosted trees."""
    rows = balanced_weights(train, label).withColumn("__y", F.col(label).cast("double"))
    fit = GBTClassifier(featuresCol="x", labelCol="__y", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=42)
    return Pipeline(stages=[*design_stages(categories, numbers), fit]).fit(rows)


def classify(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``score``, the probability of label 1."""
    cols = [c for c in df.columns if c != "score"]
    return model.transform(df).select(*cols, vector_to_array("probability")[1].alias("score"))


def permutation_importance(df: DataFrame, columns: list[str], scorer: Callable[[DataFrame], DataFrame], keys: list[str], repeats: int = 3, max_rows: int = IMPORTANCE_ROWS) -> DataFrame:
    """(feature, importance): how much average precision falls when a column is shuffled, the
    mean over ``repeats``. The sample, at most ``max_rows`` rows in hash order, is scored once
    for all columns and repeats: shuffled values come from the row of another rank."""
    sample = hash_sample(df, max_rows, keys)
    ranks = [F.row_number().over(Window.orderBy(F.xxhash64(F.lit(i), *keys), *keys)).alias(f"__r{i}") for i in range(repeats + 1)]  # the sample only
    base = sample.select("*", *ranks)
    given = base.select(F.col("__r0").alias("__at"), F.struct(*columns).alias("__new"))
    shuffled = base.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("repeat"), F.col(f"__r{i}").alias("at")) for i in range(1, repeats + 1)])).alias("__s"))
    shuffled = shuffled.join(given, F.col("__s.at") == F.col("__at"))
    trials = shuffled.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in columns])))
    trials = trials.withColumns({c: F.when(F.col("feature") == c, F.col(f"__new.{c}")).otherwise(F.col(c)) for c in columns}).withColumn("repeat", F.col("__s.repeat"))
    by = ranking_metrics(scorer(trials.drop("__s", "__new", "__at")), by=("feature", "repeat"))
    whole = ranking_metrics(scorer(base)).select(F.col("average_precision").alias("__ap"), F.lit(1).alias("__k"))  # one row
    drops = by.withColumn("__k", F.lit(1)).join(F.broadcast(whole), "__k")
    return drops.groupBy("feature").agg(F.avg(F.col("__ap") - F.col("average_precision")).alias("importance"))


def top_features(df: DataFrame, value: str, n: int = 15, name: str = "feature") -> DataFrame:
    """The ``n`` features of largest magnitude; of equals the first by name."""
    return df.orderBy(F.desc(F.abs(value)), name).limit(n)


# -- regression ------------------------------------------------------------------------


def fit_linear(train: DataFrame, categories: list[str], numbers: list[str], target: str) -> PipelineModel:
    return Pipeline(stages=[*design_stages(categories, numbers, scale=True), LinearRegression(featuresCol="x", labelCol=target, solver="normal")]).fit(train)


def fit_forest(train: DataFrame, categories: list[str], numbers: list[str], target: str, trees: int = 300) -> forest.Forest:
    """Spark's own forest keeps a count per tree with each row, 1.2 KB a row for 300 trees, so this one is by histograms."""
    return forest.fit_forest(train, category_levels(train, categories), numbers, target, trees)


def input_names(model: PipelineModel, df: DataFrame) -> list[str]:
    """Names of the slots of ``x``."""
    attrs = model.transform(df.limit(1)).schema["x"].metadata["ml_attr"]["attrs"]
    return [a["name"] for a in sorted((a for kind in attrs.values() for a in kind), key=lambda a: a["idx"])]


def _errors(target: str, prediction: str) -> list[Column]:
    y, miss = F.col(target).cast("double"), F.col(target) - F.col(prediction)
    known = F.when(miss.isNotNull(), y)
    return [F.count(known), F.var_pop(known) * F.count(known), F.sum(miss * miss), F.sum(F.abs(miss))]


def _metrics(n: int, spread: float, square: float, absolute: float) -> tuple[float, float, float]:
    if not n:
        return (math.nan,) * 3
    return (1 - square / spread if spread > 0 else math.nan), absolute / n, math.sqrt(square / n)


def regression_metrics(predicted: DataFrame, target: str) -> DataFrame:
    """One row: R2, MAE and RMSE of column ``prediction``; rows without it or the target are left out, NaN if none are left."""
    return predicted.sparkSession.createDataFrame([_metrics(*predicted.agg(*_errors(target, "prediction")).first())], "r2 double, mae double, rmse double")


def coefficients(model: PipelineModel | forest.Forest, df: DataFrame) -> DataFrame:
    """(feature, value): coefficients of a linear model or importances of a forest."""
    if isinstance(model, forest.Forest):
        return df.sparkSession.createDataFrame(list(model.importances().items()), "feature string, value double")
    last = model.stages[-1]
    values = (last.coefficients if hasattr(last, "coefficients") else last.featureImportances).toArray()
    return df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(input_names(model, df), values, strict=True)], "feature string, value double")


def cv_r2(train: DataFrame, categories: list[str], numbers: list[str], target: str, keys: list[str], folds: int = 5) -> DataFrame:
    """(fold, r2) of a linear regression; a row's fold is a hash of its key, so it does not
    depend on the order of rows."""
    rows = train.withColumn("__fold", F.pmod(F.xxhash64(*keys), F.lit(folds)).cast("int"))
    line = LinearRegression(featuresCol="x", labelCol=target, solver="normal")
    cv = CrossValidator(estimator=Pipeline(stages=[*design_stages(categories, numbers, scale=True), line]), estimatorParamMaps=ParamGridBuilder().build(), evaluator=RegressionEvaluator(labelCol=target, metricName="r2"), numFolds=folds, foldCol="__fold", collectSubModels=True)
    subs = cv.fit(rows).subModels
    out = [(i, float(RegressionEvaluator(labelCol=target, metricName="r2").evaluate(subs[i][0].transform(rows.filter(F.col("__fold") == i))))) for i in range(folds)]
    return train.sparkSession.createDataFrame(out, "fold int, r2 double")


def compare_models(models: dict[str, PipelineModel | forest.Forest | Callable[[DataFrame], DataFrame]], test: DataFrame, target: str) -> DataFrame:
    """Metrics of several regressions side by side, as in :func:`regression_metrics`, from one scan. A model is fitted, or a function that adds ``prediction``."""
    rows, sums = test, []
    for i, add in enumerate(models.values()):
        rows = getattr(add, "transform", add)(rows).select(*rows.columns, F.col("prediction").alias(f"__p{i}"))
        sums += _errors(target, f"__p{i}")
    got = rows.agg(*sums).first()  # four numbers a model
    return test.sparkSession.createDataFrame([(n, *_metrics(*got[4 * i : 4 * i + 4])) for i, n in enumerate(models)], "model string, r2 double, mae double, rmse double")
