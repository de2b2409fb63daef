"""Pair classifiers on Spark ML: out-of-fold scores, final fits, metadata. Missing features get a sentinel and a flag."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions.hashing import fold


@dataclass(frozen=True)
class BoostParams:
    """Boosting of depth-wise trees; ``rounds``, ``rate``, ``sample`` and ``least`` stand for the reference's parameters."""

    rounds: int = 20
    depth: int = 5
    rate: float = 0.1
    sample: float = 0.8
    least: int = 20
    seed: int = 7


def filled(df: DataFrame, features: list[str]) -> DataFrame:
    """NULL (and NaN) becomes -1 with a flag beside it."""
    missing = {f"{c}_na": F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1.0).otherwise(0.0) for c in features}
    return df.withColumns(missing).withColumns({f"{c}_in": F.when(F.col(f"{c}_na") == 1.0, -1.0).otherwise(F.col(c).cast("double")) for c in features})


def fit(df: DataFrame, features: list[str], b: BoostParams = BoostParams()) -> PipelineModel:
    inputs = [f"{c}_in" for c in features] + [f"{c}_na" for c in features]
    boost = GBTClassifier(labelCol="label", featuresCol="x", maxIter=b.rounds, maxDepth=b.depth, stepSize=b.rate, subsamplingRate=b.sample, minInstancesPerNode=b.least, seed=b.seed)
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="x"), boost]).fit(filled(df, features))


def score(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """M5: adds ``p``."""
    out = model.transform(filled(df, features))
    return out.withColumn("p", F.round(vector_to_array("probability")[1], 6)).select(*df.columns, "p")


def out_of_fold(df: DataFrame, features: list[str], seed: int = 11, b: BoostParams = BoostParams()) -> DataFrame:
    """M2: every pair scored by the model of the other half of the S1 records."""
    halves = df.withColumn("fold", fold(F.col("s1"), seed, 2))
    parts = [score(fit(halves.filter(F.col("fold") == k), features, b), halves.filter(F.col("fold") == 1 - k), features) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def stage_two(scored: DataFrame, group_features: DataFrame, diff_features: DataFrame, b: BoostParams = BoostParams(seed=17)) -> DataFrame:
    """M3: (s1, o, label, p): pairs scored anew, out of fold, by their first score, their group and what differs."""
    x = scored.join(group_features.drop("p"), ["s1", "o"]).join(diff_features, ["s1", "o"], "left").withColumnRenamed("p", "p1")
    names = [c for c in x.columns if c not in ("s1", "o", "label")]
    return out_of_fold(x, names, b=b).select("s1", "o", "label", "p")


def blend(features: DataFrame, names: tuple[str, ...], seed: int = 77, b: BoostParams = BoostParams(seed=1)) -> DataFrame:
    """M4: (s1, o, label, p) from the blend's features of two scorers, out of fold."""
    return out_of_fold(features.select("s1", "o", "label", *names), list(names), seed, b).select("s1", "o", "label", "p")


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features by gain, the flags with their feature."""
    gains = model.stages[-1].featureImportances.toArray()
    n = len(features)
    return sorted(((f, float(gains[i] + gains[n + i])) for i, f in enumerate(features)), key=lambda x: (-x[1], x[0]))


def save(model: PipelineModel, path: str, features: list[str], threshold: float) -> None:
    """IO15: the model and its contract."""
    model.write().overwrite().save(path)
    meta = json.dumps({"threshold": threshold, "features": features})
    SparkSession.getActiveSession().createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(path + "/contract")


def load(path: str) -> tuple[PipelineModel, list[str], float]:
    meta = json.loads(SparkSession.getActiveSession().read.text(path + "/contract").first()["value"])
    return PipelineModel.load(path), meta["features"], meta["threshold"]
