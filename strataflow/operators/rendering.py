"""Layers as pictures: ramps, flat colours, and layers laid over each other.

Colours are columns of ``struct<red, green, blue, alpha>`` of whole numbers from
0 to 255, computed in single precision as image arithmetic is, so that the same
cells come out whatever draws them.  All is one projection over the cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grids

# The colour stops of the ramps.
RAMPS = {
    "depth": ("#CBE3F0", "#8FC4E2", "#4E9BC9", "#2A72A8", "#164C7D", "#0B2E52"),
    "hand": ("#8C2D18", "#C4562A", "#E0A34A", "#A9BFA0", "#5E8C6A", "#2F5D46"),
    "wetness": ("#F4EFE4", "#D8D2A8", "#9DBE8E", "#5A9E86", "#2E7183", "#1B3F5C"),
    "sar": ("#000000", "#2B2B2B", "#575757", "#8A8A8A", "#C2C2C2", "#FFFFFF"),
    "risk": ("#2E8B57", "#9FBF3B", "#E3B23C", "#E07B39", "#C4362C", "#7E1F17"),
    "land": ("#20303A", "#2A3D42", "#36474A", "#455551", "#57655C", "#6E7A6C", "#8A9184", "#A8AC9E"),
    "sea": ("#0A1B2A", "#123047", "#194461"),
}
CHANNELS = ("red", "green", "blue")
COLOUR = "struct<red: int, green: int, blue: int, alpha: int>"
MAJOR = 8.0  # fixed value: a trunk river drains so many times the threshold


def rgb(colour: str) -> tuple[int, int, int]:
    number = int(colour.lstrip("#"), 16)
    return number >> 16, number >> 8 & 255, number & 255


def _single(x: Column) -> Column:
    return x.cast("float")


def _byte(x: Column) -> Column:
    """Cut off to a whole number from 0 to 255."""
    return F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0))).cast("int")


def share(value: Column, low: Column | float, high: Column | float) -> Column:
    """Where a value is between two others, from 0 to 1."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.least(F.greatest((value - low) / F.greatest(high - low, F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))


def ramp(at: Column, stops: Sequence[str]) -> list[Column]:
    """Red, green and blue at a share of a ramp: one of 256 steps, each on the
    straight line between the stops beside it."""
    step = F.floor(at * 255).cast("double")
    place = step * (len(stops) - 1) / 255
    k = F.least(F.floor(place), F.lit(len(stops) - 2)).cast("int")
    out = []
    for channel in range(3):
        values = F.array(*[F.lit(float(rgb(s)[channel])) for s in stops])
        a, b = F.get(values, k), F.get(values, k + 1)
        x0 = k * (255.0 / (len(stops) - 1))
        out.append(_byte(_single((b - a) / (255.0 / (len(stops) - 1)) * (step - x0) + a)))
    return out


def colourise(value: Column, name: str, low: Column | float, high: Column | float, alpha: Column | None = None, mask: Column | None = None) -> Column:
    """A layer's colour by a ramp: transparent where ``mask`` doesn't hold, else
    as opaque as ``alpha`` (0 to 1) says.  A null value has no colour at all."""
    opaque = F.lit(255) if alpha is None else _byte(F.least(F.greatest(alpha, F.lit(0.0)), F.lit(1.0)) * 255)
    shown = opaque if mask is None else F.when(mask, opaque).otherwise(0)
    channels = ramp(share(value, low, high), RAMPS[name])
    return F.when(value.isNull(), clear()).otherwise(F.struct(*[c.alias(n) for c, n in zip(channels, CHANNELS)], shown.cast("int").alias("alpha")))


def solid(mask: Column, colour: str, alpha: float = 1.0) -> Column:
    """One colour where ``mask`` holds, the same but transparent elsewhere."""
    opaque = int(min(max(alpha, 0.0), 1.0) * 255)
    return F.struct(*[F.lit(v).alias(n) for v, n in zip(rgb(colour), CHANNELS)], F.when(mask, F.lit(opaque)).otherwise(0).cast("int").alias("alpha"))


def clear() -> Column:
    return F.struct(*[F.lit(0).alias(n) for n in (*CHANNELS, "alpha")])


def over(base: Column, top: Column) -> Column:
    """One colour laid over another.  Not commutative."""
    part = lambda c, n: _single(_single(c[n]) / 255.0)
    ta, ba = part(top, "alpha"), part(base, "alpha")
    left = _single(F.lit(1.0) - ta)
    alpha = _single(ta + _single(ba * left))
    safe = F.greatest(alpha, _single(F.lit(1e-6)))
    mixed = [_single(_single(_single(part(top, n) * ta) + _single(_single(part(base, n) * ba) * left)) / safe) for n in CHANNELS]
    return F.struct(*[_byte(_single(m * 255.0)).alias(n) for m, n in zip(mixed, CHANNELS)], _byte(_single(alpha * 255.0)).alias("alpha"))


def flatten(layers: Sequence[Column]) -> Column:
    """Layers laid over each other, the first at the bottom: a fold, as order counts."""
    rest = F.array(*[layer.cast(COLOUR) for layer in layers[1:]]) if len(layers) > 1 else F.array().cast(f"array<{COLOUR}>")
    return F.aggregate(rest, layers[0].cast(COLOUR), lambda below, top: over(below, top).cast(COLOUR))


def dilate(cells: DataFrame, mask: str, out: str) -> DataFrame:
    """``out``: whether a cell or one of its four neighbours has ``mask``."""
    marked = cells.withColumn("_m", F.coalesce(F.expr(mask).cast("int"), F.lit(0)))
    wide = grids.shifted(marked, "_m")
    return wide.select(*cells.columns, (F.greatest("_m", "zmz", "zpz", "zzm", "zzp") == 1).alias(out))


def tiers(accum: str, threshold: float) -> tuple[Column, Column]:
    """Whether a cell is on a minor, and on a major channel."""
    major = F.col(accum) >= threshold * MAJOR
    return (F.col(accum) >= threshold) & ~major, major
