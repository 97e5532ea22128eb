"""MLlib models over feature tables: training, folds, search, ensembles, calibration."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as mc
from pyspark.ml import regression as mr
from pyspark.ml.feature import IDF, PCA, HashingTF, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators import metrics as M
from ledgerlens.operators.ordering import only_row
from ledgerlens.operators.splits import stratified_folds
from ledgerlens.session import cut_lineage

CLASSIFIERS: dict[str, Callable] = {
    "logistic": mc.LogisticRegression,
    "tree": mc.DecisionTreeClassifier,
    "forest": mc.RandomForestClassifier,
    "boosted": mc.GBTClassifier,
    "network": mc.MultilayerPerceptronClassifier,
    "svc": mc.LinearSVC,
    "bayes": mc.NaiveBayes,
}
REGRESSORS: dict[str, Callable] = {
    "linear": mr.LinearRegression,
    "forest": mr.RandomForestRegressor,
    "boosted": mr.GBTRegressor,
}
SEEDED = {"tree", "forest", "boosted", "network"}


def _inputs(features: Sequence[str] | str, scaled: bool) -> tuple[list, str]:
    """Stages that build the vector column, and its name."""
    if isinstance(features, str):
        stages, name = [], features
    else:
        stages, name = [VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")], "_features"
    if scaled:
        stages.append(StandardScaler(inputCol=name, outputCol="_scaled", withMean=True))
        name = "_scaled"
    return stages, name


def classifier(kind: str, features: Sequence[str] | str, label: str = "label", weight: str | None = None, seed: int = 42, several: bool = False, **params) -> Pipeline:
    """A pipeline for one model kind. Complement naive Bayes is ``bayes`` with ``modelType="complement"``.

    ``network`` needs ``layers``. ``several`` wraps binary-only models one-vs-rest.
    """
    stages, name = _inputs(features, scaled=kind in ("logistic", "network", "svc"))
    args = {"featuresCol": name, "labelCol": label, **params}
    if weight and kind not in ("network",):
        args["weightCol"] = weight
    if kind in SEEDED:
        args["seed"] = seed
    model = CLASSIFIERS[kind](**args)
    if several and kind in ("boosted", "svc"):
        model = mc.OneVsRest(classifier=model, featuresCol=name, labelCol=label)
    return Pipeline(stages=[*stages, model])


def regressor(kind: str, features: Sequence[str] | str, label: str, weight: str | None = None, seed: int = 42, **params) -> Pipeline:
    """``linear`` with regParam/elasticNetParam covers ridge, elastic net and the lag regression."""
    stages, name = _inputs(features, scaled=kind == "linear")
    args = {"featuresCol": name, "labelCol": label, **params}
    if weight:
        args["weightCol"] = weight
    if kind in SEEDED:
        args["seed"] = seed
    return Pipeline(stages=[*stages, REGRESSORS[kind](**args)])


def score_table(model: PipelineModel, df: DataFrame, keep: Sequence[str], name: str = "score") -> DataFrame:
    """Batch scoring: probability of class 1, or the margin or prediction where there is none."""
    out = model.transform(df)
    if "probability" in out.columns:
        score = vector_to_array("probability")[1]
    elif "rawPrediction" in out.columns:
        score = vector_to_array("rawPrediction")[1]
    else:
        score = F.col("prediction")
    return out.select(*keep, score.alias(name))


def evaluate(scored: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """One row: AUC, average precision and the rates at a threshold, all from one score curve."""
    curve = M.score_curve(scored, label, score)
    d = lambda c: F.col(c).cast("double")
    above = F.col(score) >= threshold
    row = curve.agg(
        (F.sum(d("pos") * (d("N") - d("fp")) + d("pos") * d("neg") / 2) / F.nullif(F.max(d("P") * d("N")), F.lit(0.0))).alias("auc"),
        F.sum(d("pos") / F.nullif(d("P"), F.lit(0.0)) * d("tp") / (d("tp") + d("fp"))).alias("average_precision"),
        F.coalesce(F.sum(F.when(above, d("pos"))), F.lit(0.0)).alias("_tp"),
        F.coalesce(F.sum(F.when(above, d("neg"))), F.lit(0.0)).alias("_fp"),
        F.max(d("P")).alias("_P"),
        F.max(d("N")).alias("_N"),
    )
    rates = M.rates(F.col("_tp"), F.col("_fp"), F.col("_P") - F.col("_tp"), F.col("_N") - F.col("_fp"))
    return row.select(*[rates[n].alias(n) for n in ("precision", "recall", "f1", "accuracy")], "auc", "average_precision")


def compare_models(train: DataFrame, val: DataFrame, models: Mapping[str, Pipeline], unique_id: str, label: str = "label") -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Train each model, evaluate it on val; rows ordered by AUC and the fitted models."""
    fitted = {n: p.fit(train) for n, p in models.items()}
    rows = [evaluate(score_table(m, val, [unique_id, label]), label).withColumn("model", F.lit(n)) for n, m in fitted.items()]
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("auc"), "model"), fitted


def champion(comparison: DataFrame, measure: str = "auc") -> str:
    return comparison.orderBy(F.desc(measure), "model").first()["model"]


def cross_validate(df: DataFrame, model: Pipeline, unique_id: str, label: str = "label", k: int = 5, seed: int = 42, folds: DataFrame | None = None) -> DataFrame:
    """Mean and deviation of each metric over stratified folds, or over given (fold, part) rows."""
    results = []
    if folds is None:
        dealt = cut_lineage(stratified_folds(df, unique_id, label, k, seed))  # every fold reads all rows several times
        pairs = [(dealt.where(F.col("fold") != i), dealt.where(F.col("fold") == i)) for i in range(k)]
    else:
        numbers = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]
        side = lambda i, p: folds.where((F.col("fold") == i) & (F.col("part") == p))
        pairs = [(side(i, "train"), side(i, "val")) for i in numbers]
    for i, (train, val) in enumerate(pairs):
        scored = score_table(model.fit(train), val, [unique_id, label])
        results.append(evaluate(scored, label).withColumn("fold", F.lit(i)))
    every = reduce(DataFrame.unionByName, results)
    names = [c for c in every.columns if c != "fold"]
    long = every.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("folds"))


def parameter_grid(space: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(space, combo)) for combo in itertools.product(*space.values())]


def parameter_sample(space: Mapping[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """n random draws from the grid, without repetition while it lasts."""
    grid = parameter_grid(space)
    return random.Random(seed).sample(grid, min(n, len(grid)))


def search(train: DataFrame, val: DataFrame, build: Callable[[dict], Pipeline], candidates: Sequence[dict], unique_id: str, label: str = "label") -> tuple[dict, list[tuple[dict, float]]]:
    """Fit every candidate, score AUC on val, return the best and all results."""
    results = []
    for params in candidates:
        scored = score_table(build(params).fit(train), val, [unique_id, label])
        results.append((params, M.roc_auc(scored, label, "score").first()["auc"] or 0.0))
    return max(results, key=lambda r: r[1])[0], results


def soft_vote(scored: Sequence[DataFrame], unique_id: str, label: str = "label", score: str = "score") -> DataFrame:
    """Mean of several models' scores per row."""
    stacked = reduce(DataFrame.unionByName, [s.select(unique_id, label, score) for s in scored])
    return stacked.groupBy(unique_id, label).agg(F.avg(score).alias(score))


def sigmoid_calibration(held_out: DataFrame, margin: str, label: str = "label") -> PipelineModel:
    """Logistic map from margins to probabilities, fitted on held-out rows."""
    lr = mc.LogisticRegression(featuresCol="_margin", labelCol=label, probabilityCol="calibrated", rawPredictionCol="_cal_raw", predictionCol="_cal_pred")
    return Pipeline(stages=[VectorAssembler(inputCols=[margin], outputCol="_margin"), lr]).fit(held_out)


def isotonic_calibration(df: DataFrame, score: str, label: str = "label", name: str = "calibrated") -> tuple[PipelineModel, DataFrame]:
    """Monotone map from scores to rates; scores outside the fitted range keep the end values."""
    iso = mr.IsotonicRegression(featuresCol="_score", labelCol=label, predictionCol=name)
    model = Pipeline(stages=[VectorAssembler(inputCols=[score], outputCol="_score"), iso]).fit(df.withColumn(label, F.col(label).cast("double")))
    return model, model.transform(df.withColumn(label, F.col(label).cast("double"))).drop("_score")


def blend_weights(df: DataFrame, a: str, b: str, target: str, ridge: float = 1.0) -> tuple[float, float, float]:
    """Non-negative ridge weights of two predictions and the intercept, from one row of sums.

    Rows in which a prediction is missing were never validated and are left out.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    row = only_row(rows.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(target).alias("my"),
        F.covar_pop(a, a).alias("aa"), F.covar_pop(b, b).alias("bb"), F.covar_pop(a, b).alias("ab"), F.covar_pop(a, target).alias("ay"), F.covar_pop(b, target).alias("by")))
    v = {k: row.value(k) or 0.0 for k in ("n", "ma", "mb", "my", "aa", "bb", "ab", "ay", "by")}
    aa, bb, ab = v["aa"] * v["n"] + ridge, v["bb"] * v["n"] + ridge, v["ab"] * v["n"]
    ay, by = v["ay"] * v["n"], v["by"] * v["n"]
    wa, wb = np.linalg.solve([[aa, ab], [ab, bb]], [ay, by])
    if wa < 0 or wb < 0:
        alone = [(max(ay / aa, 0.0), 0.0), (0.0, max(by / bb, 0.0))]
        loss = lambda w: aa * w[0] ** 2 + bb * w[1] ** 2 + 2 * ab * w[0] * w[1] - 2 * (ay * w[0] + by * w[1])
        wa, wb = min(alone, key=loss)
    return float(wa), float(wb), float(v["my"] - wa * v["ma"] - wb * v["mb"])


def blend(a: str, b: str, weights: tuple[float, float, float]) -> Column:
    return F.greatest(F.col(a) * weights[0] + F.col(b) * weights[1] + weights[2], F.lit(0.0))


def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """The fitted trees' own feature importances."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(x)) for f, x in zip(features, values)], "feature string, importance double")


# --- projections ------------------------------------------------------------

def fit_pca(train: DataFrame, features: Sequence[str] | str, k: int = 50) -> PipelineModel:
    """Scaled principal components."""
    stages, name = _inputs(features, scaled=True)
    return Pipeline(stages=[*stages, PCA(k=k, inputCol=name, outputCol="_pca")]).fit(train)


def apply_pca(model: PipelineModel, df: DataFrame, prefix: str = "fe_pca_") -> DataFrame:
    """Component columns; each sign makes the largest loading positive."""
    loadings = model.stages[-1].pc.toArray()
    signs = [1.0 if loadings[np.abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(loadings.shape[1])]
    out = model.transform(df).withColumn("_a", vector_to_array("_pca"))
    names = {f"{prefix}{j:02d}": F.col("_a")[j] * s for j, s in enumerate(signs)}
    return out.withColumns(names).select(*df.columns, *names)


def as_vector(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, array_to_vector(F.col(column).cast("array<double>")))




def monotonicity(scored: DataFrame, features: Sequence[str], score: str, bins: int = 10) -> DataFrame:
    """Mean score by equal-width bins (from 0 to the largest value) of features that should not lower it.

    ``violates`` marks bins whose mean is below that of the bin before. Spark's trees take no monotone constraints, so a
    model is checked after fitting instead. Rows without a value are left out.
    """
    tops = only_row(scored.agg(*[F.max(c).alias(c) for c in features]))
    out = None
    for c in features:
        place = F.least(F.floor(F.col(c) * bins / tops.getField(c)), F.lit(bins - 1)).cast("int")
        means = scored.where(F.col(c).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"))
        before = F.lag("mean_score").over(Window.partitionBy(F.lit(c)).orderBy("bin"))  # a row a bin
        part = means.select(F.lit(c).alias("feature"), "bin", "n", "mean_score", F.coalesce(F.col("mean_score") < before, F.lit(False)).alias("violates"))
        out = part if out is None else out.unionByName(part)
    return out


def term_bayes(tokens: str, label: str, width: int = 1 << 14) -> Pipeline:
    """Complement naive Bayes on hashed term frequencies times inverse document frequencies."""
    counts = HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=width)
    weighted = IDF(inputCol="_tf", outputCol="_tfidf", minDocFreq=2)
    bayes = mc.NaiveBayes(featuresCol="_tfidf", labelCol=label, modelType="complement")
    return Pipeline(stages=[counts, weighted, bayes])
