"""Greedy selection and capacity-bound allocation, one district a group.

These depend on order: what is chosen first limits what comes after.  Spark
ranks and joins the candidates; only the choice among one district's own
candidates is made in a grouped function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spaced_maxima(candidates: DataFrame, apart: float, most: int) -> DataFrame:
    """``district, r, c, score, rank``: best first, none nearer than ``apart``
    cells to one chosen before; ties by row, then column."""

    def choose(pdf):
        chosen: list = []
        for row in pdf.sort_values(["score", "r", "c"], ascending=[False, True, True]).itertuples():
            if all((row.r - x.r) ** 2 + (row.c - x.c) ** 2 >= apart * apart for x in chosen):
                chosen.append(row)
                if len(chosen) == most:
                    break
        import pandas as pd

        return pd.DataFrame([(x.district, x.r, x.c, x.score, i + 1) for i, x in enumerate(chosen)], columns=["district", "r", "c", "score", "rank"])

    return candidates.select("district", "r", "c", F.col("score").cast("double")).groupBy("district").applyInPandas(choose, "district long, r long, c long, score double, rank long")


def nearest_with_room(demand: DataFrame, sites: DataFrame, reach: float, most: int = 3) -> DataFrame:
    """``district, id, site, placed``: demand in order of ``turn`` goes to the
    nearest sites within ``reach`` that have room, at most ``most`` sites each.

    ``demand``: district, id, turn, people, r0, c0.  ``sites``: district, site,
    room, r1, c1.  What finds no room is a row with a null site.
    """
    away = F.sqrt(F.pow(F.col("r0") - F.col("r1"), 2) + F.pow(F.col("c0") - F.col("c1"), 2))
    pairs = demand.join(sites, "district", "left").withColumn("away", away).withColumn("site", F.when(F.col("away") <= reach, F.col("site")))

    def allot(pdf):
        import pandas as pd

        room = dict(zip(pdf.site.dropna(), pdf.room[pdf.site.notna()]))
        out = []
        for (_, who), own in pdf.sort_values(["turn", "id", "away", "site"]).groupby(["turn", "id"], sort=True):
            left, used = int(own.people.iloc[0]), 0
            for row in own.itertuples():
                if left and used < most and pd.notna(row.site) and room[row.site] > 0:
                    n = int(min(left, room[row.site]))
                    room[row.site] -= n
                    left, used = left - n, used + 1
                    out.append((row.district, who, int(row.site), n))
            if left:
                out.append((own.district.iloc[0], who, None, left))
        return pd.DataFrame(out, columns=["district", "id", "site", "placed"]).astype({"site": "Int64"})

    return pairs.select("district", "id", "turn", "people", "site", "room", "away").groupBy("district").applyInPandas(allot, "district long, id long, site long, placed long")
