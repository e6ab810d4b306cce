"""How a query and its oracle are written down together."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_CTES = {"cells": T.CELLS, "settlements": T.SETTLEMENTS, "points": T.POINTS, "hourly": T.HOURLY, "terrain": T.TERRAIN}


def oracle(body: str, *uses: str, recursive: bool = False) -> str:
    """SQL over the derived layers it uses; ``body`` may add further CTEs by
    beginning with a comma."""
    head = ", ".join(f"{name} AS ({_CTES[name]})" for name in uses)
    word = "WITH RECURSIVE " if recursive else "WITH "
    if not head and body.startswith(", "):
        return word + body[2:]
    return (word + head + " " if head else "") + body


def query(sql: str | None = None):
    """Registers a function under its name, with its oracle if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def pointwise(name: str, rows: Callable[[SparkSession, str], DataFrame], uses: str, columns: dict[str, str], keys: tuple[str, ...], doubles: int = 6) -> None:
    """A projection of formulas over a layer: the same expressions in both
    engines; numbers are rounded to ``doubles`` digits."""

    def out(expr: str, round_it: bool) -> str:
        return f"round({expr}, {doubles}) + 0.0" if round_it else expr

    # as doubles in both engines, not as decimals of some precision
    columns = {k: re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", v) for k, v in columns.items()}
    named = {k: (v[1:], False) if v.startswith("=") else (v, True) for k, v in columns.items()}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kind = {k: f"cast({out(*v)} as double) as {k}" if v[1] else f"{v[0]} as {k}" for k, v in named.items()}
        return rows(spark, sf_dir).selectExpr(*keys, *kind.values())

    listed = ", ".join([*keys, *(f"CAST({out(*v)} AS DOUBLE) AS {k}" if v[1] else f"{v[0]} AS {k}" for k, v in named.items())])
    QUERIES[name] = run
    SQL[name] = oracle(f"SELECT {listed} FROM {uses}", uses)
