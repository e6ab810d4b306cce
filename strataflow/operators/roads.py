"""Cheapest ways over ground, and the roads they make together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .courses import gather
from .drainage import PLACE


def travel_cost(cells: DataFrame, slope: str, stream: str, sea: str, inside: str) -> DataFrame:
    """``price`` added: what a step over a cell costs.  Steep ground and rivers
    are dear, the sea all but closed, and ways rather stay inside."""
    # The prices.
    price = f"1 + 0.35D * greatest(0, least(40, {slope})) + if({stream}, 26, 0) + if({sea}, 1e5D, 0) + if({inside}, 0, 12)"
    return cells.withColumn("price", F.expr(price).cast("double"))


def cost_distance(cells: DataFrame, price: str, sources: DataFrame, side: int = tiles.SIDE) -> DataFrame:
    """``district, r, c, price, cost, way``: the least cost from a source of the
    district to each cell over eight neighbours, and the direction of the
    neighbour it comes over.

    A step costs the mean price of its two cells, a diagonal one 1.414 times
    that.  ``sources``: district, r, c.  Prices must be above 0; a cell without
    one can't be entered.  A cell no source reaches has a null cost, a source
    the cost 0; both have no way.  Of ways of equal cost the first direction
    counts.
    """
    seeds = sources.select(*PLACE).distinct().withColumn("seed", F.lit(0.0))
    marked = cells.select(*PLACE, F.col(price).cast("double").alias("price")).join(seeds, PLACE, "left")

    def start(padded):
        import numpy as np

        if (padded[0] <= 0).any():
            raise ValueError("prices must be above 0")
        return np.where(np.isnan(padded[1, 1:-1, 1:-1]), np.inf, 0.0)[None]

    def step(cost, theirs, own, length):
        return cost + length * 0.5 * (theirs[0] + own[0])

    def finish(padded, values):
        import numpy as np

        price, cost = padded[0], values[0]
        here = cost[1:-1, 1:-1]
        way = np.full(here.shape, np.nan)
        for k, ((a, b), near) in enumerate(tiles.around(np.stack([price, cost]))):
            over = step(near[1], near, price[None, 1:-1, 1:-1], 1.0 if 0 in (a, b) else tiles.DIAGONAL)
            way = np.where(np.isnan(way) & (over == here), k, way)
        return [price[1:-1, 1:-1], here, way]

    return tiles.relax(marked, ["price", "seed"], start, step, ["price", "cost", "way"], side, finish=finish)


def routes(reached: DataFrame, goals: DataFrame, side: int = tiles.SIDE) -> DataFrame:
    """``district, r, c, uses``: the union of the ways from the sources to the
    goals, with the number of goals whose way passes a cell.

    ``reached`` is a result of ``cost_distance``; the ways make a forest, and
    all are walked back at once, tile by tile.  A goal that can't be
    reached has no way; goals at one cell count each.  ``goals``: district, r, c.
    """
    wanted = goals.groupBy(*PLACE).agg(F.count("*").alias("w"))
    ground = reached.where("cost is not null").join(wanted, PLACE, "left")
    forest = ground.select(*PLACE, "way", F.coalesce("w", F.lit(0)).alias("w"))
    return gather(forest, "w", side=side).where("accum > 0").select(*PLACE, F.col("accum").cast("long").alias("uses"))
