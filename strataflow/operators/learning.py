"""Forests over cell features, held out by district."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grids, radar


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def water_classifier(df: DataFrame, features: list[str], label: str, held_out: list, trees: int = 140, depth: int = 16):
    """A balanced forest, and ``precision, recall, f1, n`` on the districts
    it hasn't seen, never on a random split."""
    rows = df.withColumn("label", F.col(label).cast("double"))
    own = rows.where(~F.col("district").isin(held_out))
    share = own.agg(F.avg("label")).first()[0] or 0.5
    weighted = own.withColumn("weight", F.when(F.col("label") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=4, weightCol="weight", seed=7).fit(_assembled(weighted, features))
    said = model.transform(_assembled(rows.where(F.col("district").isin(held_out)), features))
    hit, miss, false = (F.count_if((F.col("prediction") == a) & (F.col("label") == b)) for a, b in ((1, 1), (0, 1), (1, 0)))
    report = said.agg(F.try_divide(hit, hit + false).alias("precision"), F.try_divide(hit, hit + miss).alias("recall"), F.try_divide(2 * hit, 2 * hit + miss + false).alias("f1"), F.count("*").alias("n"))
    return model, report


def surrogate(df: DataFrame, features: list[str], target: str, held_out: list, trees: int = 150, depth: int = 18):
    """A regression forest, and ``mae, r2, mean_mae`` on held-out districts,
    the last that of always saying the mean."""
    rows = df.withColumn("label", F.col(target).cast("double"))
    own = rows.where(~F.col("district").isin(held_out))
    mean = own.agg(F.avg("label")).first()[0] or 0.0
    model = RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=7).fit(_assembled(own, features))
    said = model.transform(_assembled(rows.where(F.col("district").isin(held_out)), features))
    error = F.col("label") - F.col("prediction")
    report = said.agg(F.avg(F.abs(error)).alias("mae"), (1 - F.sum(error * error) / F.greatest(F.var_pop("label") * F.count("*"), F.lit(1e-12))).alias("r2"), F.avg(F.abs(F.col("label") - mean)).alias("mean_mae"))
    return model, report


def local_statistics(cells: DataFrame, value: str, radius: int = 2) -> DataFrame:
    """``local_mean, local_std`` over a square around each cell, as features."""
    squared = cells.withColumn("_sq", F.col(value) * F.col(value))
    both = grids.box_blur(grids.box_blur(squared, value, radius, out="local_mean"), "_sq", radius, out="_msq")
    return both.withColumn("local_std", F.sqrt(F.greatest(F.col("_msq") - F.col("local_mean") * F.col("local_mean"), F.lit(0.0)))).drop("_sq", "_msq")


def importances(model, features: list[str], spark: SparkSession) -> DataFrame:
    """``feature, importance``, the largest first; they sum to 1."""
    rows = sorted(zip(features, model.featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame(rows, "feature string, importance double").coalesce(1)


def save(model, features: list[str], report: DataFrame, path: str, name: str) -> None:
    """The model, the names of its features and its report below ``path/name``,
    any earlier one replaced.  A model is there once its card is, which is
    written last."""
    spark = report.sparkSession
    card = spark.createDataFrame([(type(model).__module__, type(model).__name__, features)], "module string, kind string, features array<string>")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/card")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    model.write().overwrite().save(f"{path}/{name}/model")
    report.coalesce(1).write.mode("overwrite").json(f"{path}/{name}/report")
    card.coalesce(1).write.json(f"{path}/{name}/card")


def load(spark: SparkSession, path: str, name: str):
    """``model, features, report`` of a saved model; None if there is none."""
    import importlib

    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/card/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    card = spark.read.json(f"{path}/{name}/card").first()
    if not card["module"].startswith("pyspark.ml."):
        raise ValueError(f"{name} is no model of Spark's")
    kind = getattr(importlib.import_module(card["module"]), card["kind"])
    return kind.load(f"{path}/{name}/model"), card["features"], spark.read.json(f"{path}/{name}/report")


def score(model, features: list[str], df: DataFrame) -> DataFrame:
    """``df`` with ``prediction``."""
    return model.transform(_assembled(df, features)).select(*df.columns, "prediction")


def cut_baseline(df: DataFrame, value: str, label: str, held_out: list) -> DataFrame:
    """``precision, recall, f1, n`` of calling water what is at or below each
    held-out district's own two-class threshold: what a forest has to beat."""
    rows = df.where(F.col("district").isin(held_out))
    said = rows.join(radar.otsu(rows, value), "district").select((F.col(value) <= F.col("cut")).alias("p"), F.col(label).cast("boolean").alias("l"))
    hit, miss, false = (F.count_if(F.expr(e)) for e in ("p and l", "not p and l", "p and not l"))
    return said.agg(F.try_divide(hit, hit + false).alias("precision"), F.try_divide(hit, hit + miss).alias("recall"), F.try_divide(2 * hit, 2 * hit + miss + false).alias("f1"), F.count("*").alias("n"))
