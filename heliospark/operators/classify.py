"""A gradient-boosted classifier of pixels, judged on blocks that it has not seen."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.constants import FOLDS, MAX_PER_CLASS
from heliospark.functions.geo import block
from heliospark.operators.quality import fold_of, hash_sample


def samples(positives: DataFrame, roofs: DataFrame, lawns: DataFrame, per_class: int = MAX_PER_CLASS) -> DataFrame:
    """Labelled pixels (id, x, y, features…): trees against roofs and lawns, at most `per_class` of each label. A bounded sample of labelled rows is what the model is fitted on."""
    both = positives.withColumn("label", F.lit(1.0)).unionByName(roofs.withColumn("label", F.lit(0.0))).unionByName(lawns.withColumn("label", F.lit(0.0)))
    return hash_sample(both, "id", per_class, ["label"])


def _model(df: DataFrame, features: list[str], trees: int):
    vec = VectorAssembler(inputCols=features, outputCol="__f")
    return vec, GBTClassifier(featuresCol="__f", labelCol="label", maxIter=trees, seed=7).fit(vec.transform(df))


def out_of_fold(df: DataFrame, features: list[str], trees: int = 20, folds: int = FOLDS) -> DataFrame:
    """df with score: the probability of label 1 by a model that has seen no pixel of the row's block."""
    d = df.withColumn("fold", fold_of(block(F.col("x"), F.col("y")), folds)).cache()
    parts = []
    for k in range(folds):
        train, test = d.where(F.col("fold") != k), d.where(F.col("fold") == k)
        if train.select("label").distinct().count() == 2:
            vec, model = _model(train, features, trees)
            parts.append(model.transform(vec.transform(test)).withColumn("score", vector_to_array("probability")[1]).select(*d.columns, "score"))
        else:
            parts.append(test.withColumn("score", F.lit(0.5)))
    return reduce(DataFrame.unionByName, parts)


def fit_predict(train: DataFrame, everything: DataFrame, features: list[str], trees: int = 20) -> DataFrame:
    vec, model = _model(train, features, trees)
    return model.transform(vec.transform(everything)).withColumn("score", vector_to_array("probability")[1]).select(*everything.columns, "score")
