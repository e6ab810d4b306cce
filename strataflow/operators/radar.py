"""Water in radar scenes: speckle filtered, cut at the scene's own threshold,
held against the scene before and against the ground."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import grids

# Looks of the product, the highest backscatter of water (dB), and
# from which separability on a threshold is trusted.
LOOKS, CEILING, HIGH, MODERATE = 4.4, -13.0, 0.80, 0.70


def lee(cells: DataFrame, value: str, out: str, radius: int = 2, looks: float = LOOKS) -> DataFrame:
    """``out``: between the local mean and the cell's own value, the nearer to
    the latter the more of the local variance isn't speckle."""
    squared = cells.withColumn("_sq", F.col(value) * F.col(value))
    local = grids.box_blur(grids.box_blur(squared, value, radius, out="_mean"), "_sq", radius, out="_msq")
    var = F.greatest(F.col("_msq") - F.col("_mean") * F.col("_mean"), F.lit(0.0))
    seen = var / F.greatest(F.col("_mean") * F.col("_mean"), F.lit(1e-9))
    weight = F.least(F.greatest((seen - 1 / looks) / F.greatest(seen, F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
    return local.withColumn(out, F.col("_mean") + weight * (F.col(value) - F.col("_mean"))).drop("_sq", "_mean", "_msq")


def otsu(df: DataFrame, value: str, by: str = "district", bins: int = 256) -> DataFrame:
    """``by, cut, separability``: the centre of the bin that parts a histogram
    into the two classes furthest apart, and their share of its variance.

    Nulls and what is no number don't count.  Of equally good bins
    the first counts: in a group of one value, whose bins span 1 around it, that
    is the lowest, with separability 0.
    """
    numbers = df.select(by, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v) and abs(_v) < double('infinity')")
    ends = numbers.groupBy(by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))  # a row a group
    # of one value the bins span one around it
    ends = ends.withColumn("_one", F.col("_lo") == F.col("_hi")).select(by, F.when(F.col("_one"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"), F.when(F.col("_one"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    placed = numbers.join(ends, by).withColumn("_bin", F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1)))
    counts = placed.groupBy(by, "_lo", "_hi", "_bin").agg(F.count("*").alias("_n")).withColumn("_c", F.col("_lo") + (F.col("_bin") + 0.5) * width)
    whole = W.partitionBy(by)  # at most a row a bin
    upto = whole.orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("_n").over(whole)
    shares = counts.select(by, "_bin", (F.col("_lo") + 0.5 * width).alias("_first"), "_c", (F.col("_n") / total).alias("_p")).withColumns({"_omega": F.sum("_p").over(upto), "_mu": F.sum(F.col("_p") * F.col("_c")).over(upto), "_all": F.sum(F.col("_p") * F.col("_c")).over(whole)})
    apart = F.coalesce(F.try_divide(F.pow(F.col("_all") * F.col("_omega") - F.col("_mu"), 2), F.when(F.col("_omega") < 1 - 1e-12, F.col("_omega") * (1 - F.col("_omega")))), F.lit(0.0))
    scored = shares.withColumn("_apart", apart).withColumn("_spread", F.sum(F.pow(F.col("_c") - F.col("_all"), 2) * F.col("_p")).over(whole))
    best = scored.groupBy(by).agg(F.max_by(F.struct("_first", "_c", "_apart", "_spread"), F.struct("_apart", -F.col("_bin"))).alias("b"))
    return best.select(by, F.when(F.col("b._apart") > 0, F.col("b._c")).otherwise(F.col("b._first")).alias("cut"), F.least(F.coalesce(F.try_divide("b._apart", "b._spread"), F.lit(0.0)), F.lit(1.0)).alias("separability"))


def detect(cells: DataFrame, *, drop: float = 2.5, slope: float = 12.0, hand: float = 25.0) -> DataFrame:
    """``district, r, c, flood, permanent, confidence`` of cells with ``after``
    and ``before`` (dB), ``slope`` (degrees), ``hand`` (m), ``stream``, ``sea``.

    Water is at or below the scene's own threshold, or -13 dB if that is lower.
    Permanent water was dark before and lies on the drainage or the sea; flood
    is dark now, fell by ``drop``, isn't permanent or sea, and lies on ground
    that can hold water.  How far to trust a district's threshold is
    ``confidence``.
    """
    seen = lee(lee(cells, "after", "_after"), "before", "_before")
    cut = lambda name: otsu(seen, name).select("district", F.col("cut").alias(f"{name}_cut"), F.col("separability").alias(f"{name}_sep"))
    # a row a district each
    judged = seen.join(cut("_after"), "district").join(cut("_before"), "district")
    dark = F.col("_after") <= F.least("_after_cut", F.lit(CEILING))
    permanent = (F.col("_before") <= F.least("_before_cut", F.lit(CEILING))) & (F.col("stream") | F.col("sea"))
    flood = dark & (F.col("_before") - F.col("_after") >= drop) & ~permanent & (F.col("slope") <= slope) & (F.col("hand") <= hand) & ~F.col("sea")
    trust = F.when(F.col("_after_cut") > CEILING, "low").when(F.col("_after_sep") >= HIGH, "high").when(F.col("_after_sep") >= MODERATE, "moderate").otherwise("low")
    return judged.select("district", "r", "c", flood.alias("flood"), permanent.alias("permanent"), trust.alias("confidence"))
