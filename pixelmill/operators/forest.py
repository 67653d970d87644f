"""A random forest over pixels: the plain rival of the network."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.functions import pixel


def fitted(pixels: DataFrame, channels: list[str], trees: int = 50, depth: int = 10, seed: int = 0) -> PipelineModel:
    """A forest from pixels (channels, idx); ignored labels are left out, missing values are their channel's median."""
    known = pixels.where(F.col("idx") != pixel.IGNORE).withColumn("idx", F.col("idx").cast("double"))
    filled = [f"_{c}" for c in channels]
    stages = [Imputer(inputCols=channels, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_v"), RandomForestClassifier(featuresCol="_v", labelCol="idx", predictionCol="predicted", numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(known)


def predicted(model: PipelineModel, pixels: DataFrame) -> DataFrame:
    """``pixels`` with ``predicted``, the index of the likeliest class."""
    out = model.transform(pixels)
    return out.select(*pixels.columns, F.col("predicted").cast("int").alias("predicted"))
