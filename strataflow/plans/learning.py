"""Queries that train and score a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids as G
from ..operators import learning
from ..sources import tables as T
from .build import query


def _features(spark, sf):
    blurred = G.box_blur(T.cells(spark, sf), radius=2)
    return G.slope_aspect(blurred).where("(r * 40 + c) % 3 = 0").withColumn("wet", (F.col("blur") > 95) & (F.col("slope") < 78))


@query()
def water_forest(spark, sf):
    """Every third cell, one district held out."""
    return learning.water_classifier(_features(spark, sf), ["v", "blur", "slope"], "wet", [3], trees=20, depth=8)[1]


@query()
def redzone_surrogate(spark, sf):
    rows = _features(spark, sf).withColumn("y", F.expr("least(1D, blur / 150 + slope / 300)"))
    return learning.surrogate(rows, ["v", "blur", "slope"], "y", [3], trees=20, depth=8)[1]


@query()
def cut_baseline(spark, sf):
    """What a district's own two-class threshold makes of the same question."""
    return learning.cut_baseline(_features(spark, sf).withColumn("dry", -F.col("blur")), "dry", "wet", [3])


@query()
def feature_importances(spark, sf):
    """What the water forest looks at, local statistics among it."""
    names = ["v", "blur", "slope", "local_mean", "local_std"]
    rows = learning.local_statistics(_features(spark, sf), "v")
    return learning.importances(learning.water_classifier(rows, names, "wet", [3], trees=20, depth=8)[0], names, spark)
