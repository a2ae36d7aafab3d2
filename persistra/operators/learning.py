"""Supervised protocols over case tables: grouped folds, transfer, nearest neighbours.

Models are Spark ML pipelines; a fold never sees its own groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from persistra.operators.evaluate import clip, group_folds


def make_model(name: str, features: Sequence[str], label: str):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    filled = [f"_{c}" for c in features]
    head = [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)]
    last = {
        "ridge": lambda: LinearRegression(featuresCol="_x", labelCol=label, regParam=0.1, elasticNetParam=0.0),
        "forest": lambda: RandomForestRegressor(featuresCol="_x", labelCol=label, numTrees=50, maxDepth=8, seed=7),
        "boosted": lambda: GBTRegressor(featuresCol="_x", labelCol=label, maxIter=30, seed=7),
    }[name]()
    return Pipeline(stages=[*head, last])


def fit_predict(train: DataFrame, test: DataFrame, name: str, features: Sequence[str], label: str, keys: Sequence[str]) -> DataFrame:
    """Predictions of benchmark models are clipped to [0, 1]."""
    model = make_model(name, features, label).fit(train.filter(F.col(label).isNotNull()))
    return model.transform(test).select(*keys, F.col(label).alias("y_true"), clip(F.col("prediction")).alias("prediction"))


def group_kfold(cases: DataFrame, name: str, features: Sequence[str], label: str, folds: int = 5) -> DataFrame:
    """Out-of-fold predictions; cases: case_id, group_id, features, label."""
    placed = cases.join(F.broadcast(group_folds(cases, folds=folds)), "group_id").persist()
    out = None
    for (f,) in placed.select("fold").distinct().orderBy("fold").collect():
        part = fit_predict(placed.filter(F.col("fold") != f), placed.filter(F.col("fold") == f), name, features, label, ["case_id", "group_id", "fold"])
        out = part if out is None else out.unionByName(part)
    return out


def leave_one_block_out(cases: DataFrame, block: str, name: str, features: Sequence[str], label: str, least_groups: int = 5) -> DataFrame:
    """Trains on the other blocks, without groups that the held-out block shares."""
    out = None
    for (b,) in cases.select(block).distinct().orderBy(block).collect():
        test = cases.filter(F.col(block) == b)
        train = cases.filter(F.col(block) != b).join(test.select("group_id").distinct(), "group_id", "left_anti")
        if train.select("group_id").distinct().count() < least_groups:
            continue
        part = fit_predict(train, test, name, features, label, ["case_id", "group_id"]).withColumn("held_out", F.lit(b))
        out = part if out is None else out.unionByName(part)
    return out


def transfer(cases: DataFrame, is_train: str, name: str, features: Sequence[str], label: str) -> DataFrame:
    """From simulated to real: fits where ``is_train`` holds, predicts elsewhere."""
    return fit_predict(cases.filter(is_train), cases.filter(f"not ({is_train})"), name, features, label, ["case_id", "group_id"])
