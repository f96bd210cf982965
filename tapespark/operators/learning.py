"""Models over feature tables with Spark ML: folds by a keyed hash, thresholds and capture by windows."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch


def folds(rows: DataFrame, key: str, k: int = 5) -> DataFrame:
    """A fold per key, so that rows of one key are never on both sides."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(k)).cast("int"))


def out_of_fold(rows: DataFrame, features: list[str], target: str, key: str, k: int = 3, classify: bool = False, depth: int = 3, trees: int = 8) -> DataFrame:
    """Predictions of boosted trees for every row by the model that did not see its key. Features are written once, and so are
    the predictions."""
    rows = scratch.written(folds(rows, key, k), "fold-rows")
    rows = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep").transform(rows)
    learner = GBTClassifier if classify else GBTRegressor
    out = None
    for fold in range(k):
        model = learner(featuresCol="__x", labelCol=target, maxDepth=depth, maxIter=trees, seed=7).fit(rows.where(F.col("fold") != fold))
        part = model.transform(rows.where(F.col("fold") == fold))
        part = part.withColumn("pred", vector_to_array("probability")[1] if classify else F.col("prediction"))
        part = part.drop("__x", "prediction", *(["probability", "rawPrediction"] if classify else []))
        out = part if out is None else out.unionByName(part)
    return scratch.written(out, "fold-predictions")


def above_quantile(rows: DataFrame, pred: str, q: float, key: str, order: list[str]) -> DataFrame:
    """The first row per key whose prediction is at or over a quantile of all, which is taken to a ten-thousandth of the rows."""
    cut = rows.agg(F.percentile_approx(pred, q, 10_000).alias("__cut"))
    hit = rows.crossJoin(F.broadcast(cut)).where(F.col(pred) >= F.col("__cut")).drop("__cut")
    return hit.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def balanced_logistic(train: DataFrame, test: DataFrame, features: list[str], label: str, penalty: float = 0.01) -> DataFrame:
    """``test`` with ``pred`` of an L2 logistic regression on standardised features, classes of equal weight."""
    share = train.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"]
    weight = F.when(F.col(label) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9))
    steps = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep"), StandardScaler(inputCol="__x", outputCol="__z", withMean=True), LogisticRegression(featuresCol="__z", labelCol=label, weightCol="__w", regParam=penalty)])
    model = steps.fit(train.withColumn("__w", weight))
    return model.transform(test).withColumn("pred", vector_to_array("probability")[1]).drop("__x", "__z", "rawPrediction", "probability", "prediction")


def capture(rows: DataFrame, group: str, pred: str, label: str, k: int, order: list[str]) -> DataFrame:
    """Share of groups whose positive row is among the k best predictions; equal ones are in ``order``."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(F.col(pred).desc(), *order))
    hit = rows.withColumn("__r", r).groupBy(group).agg(F.max(F.when((F.col(label) == 1) & (F.col("__r") <= k), 1.0).otherwise(0.0)).alias("hit"), F.max(label).alias("any")).where("any = 1")
    return hit.agg(F.count("*").alias("groups"), F.avg("hit").alias("captured"))
