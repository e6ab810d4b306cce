"""Focal, zonal and distance operators on cell tables.

Every operator takes ``(district, r, c, ...)`` rows and works along one axis at
a time with windows partitioned by district and line, so a line is the largest
thing that meets in one place, and lines of all districts run side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AXES = (("r", "c"), ("c", "r"))


def _line(fixed: str, moving: str) -> W:
    return W.partitionBy("district", fixed).orderBy(moving)


def box_blur(cells: DataFrame, value: str = "v", radius: int = 1, passes: int = 1, out: str = "blur") -> DataFrame:
    """Mean over a square of ``2 * radius + 1``; the rim repeats outwards."""
    df = cells.withColumn(out, F.col(value).cast("double"))
    for _ in range(passes):
        for fixed, moving in AXES:
            line = _line(fixed, moving)
            whole = W.partitionBy("district", fixed)
            ends = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            low = F.greatest(F.lit(0), F.lit(radius) - F.col(moving))
            high = F.greatest(F.lit(0), F.lit(radius) - (F.max(moving).over(whole) - F.col(moving)))
            total = F.sum(out).over(line.rowsBetween(-radius, radius)) + low * F.first(out).over(ends) + high * F.last(out).over(ends)
            df = df.withColumn("_blurred", total / (2 * radius + 1)).withColumn(out, F.col("_blurred")).drop("_blurred")
    return df


def extent(cells: DataFrame, value: str = "v", radius: int = 5) -> DataFrame:
    """Local relief: highest minus lowest within the square."""
    df = cells.withColumn("_hi", F.col(value)).withColumn("_lo", F.col(value))
    for fixed, moving in AXES:
        line = _line(fixed, moving).rowsBetween(-radius, radius)
        df = df.select(*[c for c in df.columns if c not in ("_hi", "_lo")], F.max("_hi").over(line).alias("_hi"), F.min("_lo").over(line).alias("_lo"))
    return df.withColumn("relief", F.col("_hi") - F.col("_lo")).drop("_hi", "_lo")


def shifted(cells: DataFrame, value: str = "v") -> DataFrame:
    """The eight neighbours as columns ``z<dr><dc>`` (m: -1, z: 0, p: 1); the
    rim repeats outwards."""
    across, down = _line("r", "c"), _line("c", "r")
    df = cells.select("*", F.coalesce(F.lag(value).over(across), value).alias("_w"), F.coalesce(F.lead(value).over(across), value).alias("_e"))
    names = {"m": "_w", "z": value, "p": "_e"}
    return df.select(
        *cells.columns,
        *[F.coalesce(F.lag(col).over(down), F.col(col)).alias(f"zm{dc}") for dc, col in names.items()],
        F.col("_w").alias("zzm"),
        F.col("_e").alias("zzp"),
        *[F.coalesce(F.lead(col).over(down), F.col(col)).alias(f"zp{dc}") for dc, col in names.items()],
    )


def slope_aspect(cells: DataFrame, value: str = "v", size: float = 30.0) -> DataFrame:
    """Horn's slope and aspect in degrees."""
    df = shifted(cells, value)
    gx = f"((zmp + 2 * zzp + zpp) - (zmm + 2 * zzm + zpm)) / (8 * {size}D)"
    gy = f"((zpm + 2 * zpz + zpp) - (zmm + 2 * zmz + zmp)) / (8 * {size}D)"
    return df.select(*cells.columns, F.expr(f"degrees(atan(sqrt(pow({gx}, 2) + pow({gy}, 2))))").alias("slope"), F.expr(f"pmod(degrees(atan2({gy}, 0D - ({gx}))) + 360.0D, 360.0D)").alias("aspect"))


def curvature(cells: DataFrame, value: str = "v", size: float = 30.0) -> DataFrame:
    df = shifted(cells, value)
    return df.select(*cells.columns, F.expr(f"((zmz + zpz + zzm + zzp) - 4 * {value}) / ({size}D * {size}D) * 10000").alias("curvature"))


def distance(cells: DataFrame, seed: str, cap: int | None = None, out: str = "dist") -> DataFrame:
    """City-block distance to the nearest cell where ``seed`` holds; null
    beyond ``cap`` or without a seed.  Exact: nearest along the column first,
    then the lower envelope along the row."""
    column = W.partitionBy("district", "c").orderBy("r")
    seen = F.when(F.col(seed), F.col("r"))
    above = F.last(seen, ignorenulls=True).over(column.rowsBetween(W.unboundedPreceding, 0))
    below = F.first(seen, ignorenulls=True).over(column.rowsBetween(0, W.unboundedFollowing))
    df = cells.withColumn("_v", F.least(F.col("r") - above, below - F.col("r")))
    row = W.partitionBy("district", "r").orderBy("c")
    left = F.min(F.col("_v") - F.col("c")).over(row.rowsBetween(W.unboundedPreceding, 0)) + F.col("c")
    right = F.min(F.col("_v") + F.col("c")).over(row.rowsBetween(0, W.unboundedFollowing)) - F.col("c")
    df = df.withColumn(out, F.least(left, right)).drop("_v")
    return df if cap is None else df.withColumn(out, F.when(F.col(out) <= cap, F.col(out)))


# The eight directions in order of preference on a tie.
DIRECTIONS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def receivers(cells: DataFrame, value: str = "v", size: float = 30.0) -> DataFrame:
    """``recv_r, recv_c`` of the steepest descent among eight neighbours (null
    in a pit); of equally steep ones the first direction."""
    marks = {-1: "m", 0: "z", 1: "p"}
    ends = cells.groupBy("district").agg(F.max("r").alias("_hr"), F.max("c").alias("_hc"))  # a row a district
    df = shifted(cells, value).join(ends, "district")
    inside = "(r + {a} between 0 and _hr) and (c + {b} between 0 and _hc)"
    drops = [
        f"case when {inside.format(a=a, b=b)} and {value} > z{marks[a]}{marks[b]} then named_struct('drop', ({value} - z{marks[a]}{marks[b]}) / {'1.0D' if a == 0 or b == 0 else 'sqrt(2.0D)'}, 'rank', {-i}, 'r', r + {a}, 'c', c + {b}) end"
        for i, (a, b) in enumerate(DIRECTIONS)
    ]
    df = df.withColumn("_best", F.expr(f"array_max(array({', '.join(drops)}))"))
    return df.select(*cells.columns, F.col("_best.r").alias("recv_r"), F.col("_best.c").alias("recv_c"))


def shoreline(cells: DataFrame, mask: str) -> DataFrame:
    """Whether a cell outside the mask has one of its four neighbours inside."""
    df = shifted(cells.withColumn("_m", F.col(mask).cast("int")), "_m")
    return df.select(*cells.columns, ((F.col("_m") == 0) & (F.greatest("zmz", "zpz", "zzm", "zzp") == 1)).alias("shore"))


def normalised(df: DataFrame, value: str, by: str = "district", out: str = "norm") -> DataFrame:
    ends = df.groupBy(F.col(by).alias("_by")).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))  # a row a district
    share = (F.col(value) - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-9))
    return df.join(ends, F.col(by).eqNullSafe(F.col("_by"))).withColumn(out, share).drop("_by", "_low", "_high")


def block_reduce(cells: DataFrame, k: int, value: str = "v") -> DataFrame:
    return cells.groupBy("district", F.floor(F.col("r") / k).alias("br"), F.floor(F.col("c") / k).alias("bc")).agg(
        F.avg(value).alias("mean"), F.percentile(value, 0.9).alias("p90"), F.max(value).alias("high"), F.sum(value).alias("total")
    )


def around(features: DataFrame, cells: DataFrame, k: int, r: str = "r0", c: str = "c0", tile: int = 16) -> DataFrame:
    """Pairs of a feature and the cells within ``k`` rows and columns of it.

    Both sides are put on tiles, so it is an equi-join whatever the sizes.
    """
    spread = features.withColumn("_tr", F.explode(F.expr(f"sequence(floor(({r} - {k}) / {tile}), floor(({r} + {k}) / {tile}))")))
    spread = spread.withColumn("_tc", F.explode(F.expr(f"sequence(floor(({c} - {k}) / {tile}), floor(({c} + {k}) / {tile}))")))
    tiled = cells.withColumn("_tr", F.floor(F.col("r") / tile)).withColumn("_tc", F.floor(F.col("c") / tile))
    return spread.join(tiled, ["district", "_tr", "_tc"]).where(F.col("r").between(F.col(r) - k, F.col(r) + k) & F.col("c").between(F.col(c) - k, F.col(c) + k)).drop("_tr", "_tc")
