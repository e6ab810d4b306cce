"""Queries that draw layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rendering as D
from ..sources import tables as T
from .build import oracle, query

CHANNELS = (*D.CHANNELS, "alpha")


def lookup(name: str) -> str:
    """A ramp's 256 steps as SQL rows: step, red, green, blue."""
    stops = [D.rgb(s) for s in D.RAMPS[name]]
    n = len(stops) - 1
    rows = ", ".join(f"({i}, {a[0]}e0, {a[1]}e0, {a[2]}e0, {b[0]}e0, {b[1]}e0, {b[2]}e0)" for i, (a, b) in enumerate(zip(stops, stops[1:])))
    step = lambda a, b: f"CAST(floor(CAST(({b} - {a}) / ({255.0 / n!r}e0) * (range - k * {255.0 / n!r}e0) + {a} AS FLOAT)) AS INTEGER)".replace("e0)", ")")
    return f"{name}_ramp AS (SELECT range AS step, {step('r0', 'r1')} AS red, {step('g0', 'g1')} AS green, {step('b0', 'b1')} AS blue FROM range(256) JOIN (VALUES {rows}) t(k, r0, g0, b0, r1, g1, b1) ON k = least(range * {n} // 255, {n - 1}))"


def laid(base: str, top: str, out: str, source: str) -> str:
    """One layer over another, in single precision."""
    one = lambda side, c: f"(CAST({side}.{c} AS FLOAT) / CAST(255 AS FLOAT))"
    ta, ba = one("t", "alpha"), one("b", "alpha")
    alpha = f"({ta} + {ba} * (CAST(1 AS FLOAT) - {ta}))"
    mix = lambda c: f"({one('t', c)} * {ta} + {one('b', c)} * {ba} * (CAST(1 AS FLOAT) - {ta})) / greatest({alpha}, CAST(1e-6 AS FLOAT))"
    byte = lambda x: f"CAST(floor(least(greatest({x} * CAST(255 AS FLOAT), CAST(0 AS FLOAT)), CAST(255 AS FLOAT))) AS INTEGER)"
    listed = ", ".join(f"{byte(mix(c))} AS {c}" for c in D.CHANNELS)
    return f"{out} AS (SELECT district, r, c, {listed}, {byte(alpha)} AS alpha FROM {base} b JOIN {top} t USING (district, r, c))"


GROUND = "ground AS (SELECT district, r, c, red, green, blue, 255 AS alpha FROM cells JOIN wetness_ramp ON step = floor(greatest(0, least(1, v / 400e0)) * 255))"
WATER = "water AS (SELECT district, r, c, red, green, blue, CASE WHEN v % 3 > 0 THEN CAST(floor(least(1, 0.2e0 + v % 97 / 120e0) * 255) AS INTEGER) ELSE 0 END AS alpha FROM cells JOIN depth_ramp ON step = floor(least(1, (v % 97 / 10e0) / 9.6e0) * 255))"
LINES = "ways AS (SELECT a.district, a.r, a.c, 78 AS red, 155 AS green, 201 AS blue, CASE WHEN bool_or(b.v > 300) THEN 216 ELSE 0 END AS alpha FROM cells a JOIN cells b ON b.district = a.district AND abs(a.r - b.r) + abs(a.c - b.c) <= 1 GROUP BY 1, 2, 3)"


@query(oracle(f", {lookup('wetness')}, {lookup('depth')}, {GROUND}, {WATER}, {LINES}, {laid('ground', 'water', 'wet', '')}, {laid('wet', 'ways', 'drawn', '')} SELECT * FROM drawn", "cells"))
def render_layers(spark, sf):
    """Ground by a ramp, water over it as opaque as it is deep, and the widened
    lines of the highest cells on top."""
    cells = D.dilate(T.cells(spark, sf), "v > 300", "way")
    depth = F.expr("v % 97 / 10D")
    layers = [
        D.colourise(F.col("v"), "wetness", 0.0, 400.0),
        D.colourise(depth, "depth", 0.0, 9.6, F.expr("0.2D + v % 97 / 120D"), F.expr("v % 3 > 0")),
        D.solid(F.col("way"), "#4E9BC9", 0.85),
    ]
    return cells.select("district", "r", "c", D.flatten(layers).alias("p")).select("district", "r", "c", *[F.col(f"p.{c}").alias(c) for c in CHANNELS])
