"""Queries that are one projection over a layer."""

from __future__ import annotations

from ..functions import bands as B
from ..functions import formulas as M
from ..functions.bands import clip
from ..sources import tables as T
from .build import pointwise

CELL = ("district", "r", "c")
# columns of a made-up cell, from its value
SLOPE, AREA, BUILT, CROP = "(v % 53)", "(1.0 + (v % 997))", "((v % 89) / 89.0)", "((v % 97) / 97.0)"

pointwise("clip_scale", T.cells, "cells", {"scaled": clip("(v - 100.0) / 400.0", "0.0", "1.0")}, CELL)
pointwise("grid_coords", T.cells, "cells", {"lat": "27.0 - (r + 0.5) * (1.0 / 40)", "lon": "85.0 + (c + 0.5) * (1.0 / 40)"}, CELL)
pointwise("rowcol", T.points, "points", {"row": f"=CAST({clip('floor((36.0 - lat) / 28.0 * 160)', '0', '159')} AS BIGINT)", "col": f"=CAST({clip('floor((lon - 68.0) / 29.0 * 160)', '0', '159')} AS BIGINT)"}, ("k",))
pointwise("grid_frame", T.points, "points", {"height_km": f"0.5 * {M.KM_PER_DEGREE}", "width_km": f"0.5 * {M.KM_PER_DEGREE} * cos(radians(lat))", "cell_m": f"0.5 * {M.KM_PER_DEGREE} * 1000 / 160"}, ("k",))
pointwise("haversine", T.points, "points", {"km": M.haversine("lat", "lon", "20.0", "80.0")}, ("k",), 5)
pointwise("compass16", T.points, "points", {"bearing": M.bearing("20.0", "80.0", "lat", "lon"), "compass": "=" + M.compass(M.bearing("20.0", "80.0", "lat", "lon"))}, ("k",), 5)
pointwise("location_label", T.points, "points", {"label": f"=CASE WHEN {M.haversine('lat', 'lon', '20.0', '80.0')} < 1.5 THEN 'town centre' ELSE CAST(CAST(floor({M.haversine('lat', 'lon', '20.0', '80.0')} + 0.5) AS BIGINT) AS STRING) || ' km ' || {M.compass(M.bearing('20.0', '80.0', 'lat', 'lon'))} || ' of the town' END"}, ("k",))
pointwise("twi", T.cells, "cells", {"twi": M.wetness(AREA + " * 900.0", "30.0", SLOPE)}, CELL)
pointwise("amc_adjust", T.cells, "cells", {f"cn_{a}": M.moisture_adjusted("(40.0 + v % 55)", f"{a}.0") for a in (0, 13, 40, 70, 120)}, CELL)
pointwise("runoff_scs", T.cells, "cells", {"q": M.runoff("v", "(40.0 + v % 55)")}, CELL)
pointwise("channel_geom", T.cells, "cells", {"tp": M.time_to_peak(AREA, "(v % 7)"), "width": M.channel_width(AREA), "bank": M.bankfull(AREA)}, CELL)
pointwise("manning_stage", T.cells, "cells", {"stage": M.manning_stage("v", M.channel_width(AREA), SLOPE)}, CELL)
pointwise("conveyance", T.cells, "cells", {"q": M.conveyance("((v % 31) / 5.0)", M.channel_width(AREA), M.slope_term(SLOPE), M.bankfull(AREA), "1100.0")}, CELL, 4)
pointwise("gumbel_depth", T.cells, "cells", {f"rp_{t}": M.design_depth("(600.0 + v)", f"{t}.0") for t in (1, 2, 10, 50, 100)}, CELL)
pointwise("surge_curve", T.hourly, "hourly", {"surge": "3.5 * exp(-0.5 * pow((h - 360) / 8.0, 2))"}, ("point", "h"))
pointwise("lhef_ratings", T.cells, "cells", {"slope_rating": M.slope_rating(SLOPE), "relief_rating": M.relief_rating("v"), "land_rating": M.land_rating(BUILT, CROP, SLOPE), "zone": "=" + B.below(f"({M.slope_rating(SLOPE)} + {M.relief_rating('v')} + {M.land_rating(BUILT, CROP, SLOPE)} + 2.0)", B.HAZARD_ZONE)}, CELL)
pointwise("caine", T.cells, "cells", {"threshold": M.caine("(v % 73)")}, CELL)
pointwise("drain_down", T.cells, "cells", {"hours": clip(f"CASE WHEN v / 500.0 <= 0.15 THEN 0.0 ELSE (78.0 - 64.0 * {BUILT}) * (0.55 + 1.35 * {CROP}) * ln(v / 500.0 / 0.15) END", "0.0", "1440.0")}, CELL)
pointwise("bruun", T.cells, "cells", {"rate": clip(f"0.0032 / {clip(f'tan(radians({SLOPE}))', '0.0008', '0.15')} * (0.55 + 0.90 * {BUILT}) * (1.0 - 0.75 * {CROP})", "0.0", "12.0")}, CELL)
pointwise("deforest_delta", T.cells, "cells", {"cohesion_lost": f"{BUILT} * (1.0 - exp(-10 / 4.0))", "runoff_delta": f"{M.runoff('120.0', '(60.0 + 20.0 * ' + BUILT + ')')} - {M.runoff('120.0', '60.0')}"}, CELL)
pointwise("cloudburst_susc", T.cells, "cells", {"orographic": f"CASE WHEN v < 400 THEN 0.0 ELSE exp(-0.5 * pow((v - 600.0) / 250.0, 2)) * (0.35 + 0.85 * {BUILT}) END", "flashiness": f"0.45 * exp(-{AREA} / 60.0) + 0.35 * {BUILT} + 0.20 * {CROP}"}, CELL)
pointwise("cloudburst_assess", T.hourly, "hourly", {"severity": "CASE WHEN mm >= 100 THEN 1.0 WHEN mm >= 50 THEN 0.6 WHEN mm >= 20 THEN 0.3 ELSE 0.0 END", "convection": clip("(mm * 40 - 800.0) / 2000.0", "0.0", "1.0")}, ("point", "h"))
pointwise("registry_derive", T.points, "points", {"projected": "=CAST(floor(pop * pow(1.016, 14)) AS BIGINT)", "density": "pop * pow(1.016, 14) / (50.0 + k % 500)"}, ("k",))
pointwise("static_risk", T.points, "points", {"risk": "least((CASE nation % 4 WHEN 0 THEN 62 WHEN 1 THEN 58 WHEN 2 THEN 54 ELSE 46 END) * (1 + least(pop / 3000.0, 0.6)), 100)"}, ("k",))
pointwise("band_join", T.cells, "cells", {"depth_band": "=" + B.below("(v / 200.0)", B.DEPTH), "wind_band": "=" + B.below("(v % 140)", B.WIND), "horizon": "=" + B.below("(v % 130)", B.HORIZON, B.HORIZON_ELSE), "cape_band": "=" + B.below("(v * 10)", B.CAPE)}, CELL)
pointwise("imd_band", T.hourly, "hourly", {"band": "=" + B.reached("(mm * 4)", B.RAIN_24H)}, ("point", "h"))
pointwise("cloud_state", T.hourly, "hourly", {"state": "=" + M.cloud_state("cloud", "(cloud * 7 % 101)", "(cloud * 13 % 101)", "(mm * 60)", "(h % 3 <> 0)"), "structure_only": "=" + M.cloud_state("cloud", "(cloud * 7 % 101)", "(cloud * 13 % 101)", "(mm * 60)", "(1 = 0)")}, ("point", "h"))
pointwise("watch_score", T.hourly, "hourly", {"score": M.watch_score("(mm * 3)", "(mm * 5)", "(h % 4)", "(cloud / 100.0)", "mm", "(h % 5 = 0)", "(h * 2000.0)")}, ("point", "h"))
pointwise("watch_action", T.hourly, "hourly", {"action": "=" + M.action("cloud", "CASE WHEN h % 7 = 0 THEN NULL ELSE h % 50 END")}, ("point", "h"))
pointwise("national_score", T.hourly, "hourly", {"score": M.national_score("(mm * 3)", "(mm * 5)", "(cloud / 100.0)", "(mm * 60)", "mm", "CASE WHEN h % 3 = 0 THEN NULL ELSE (h % 10) / 10.0 END")}, ("point", "h"))
pointwise(
    "strategy_cost",
    T.points,
    "points",
    {
        "strategy": "=" + M.strategy("CASE WHEN k % 6 = 0 THEN NULL ELSE CAST(k % 60 AS DOUBLE) END", "(pop - 500)", "CASE WHEN k % 7 = 0 THEN 'erosion' ELSE 'flood' END"),
        "families": "=CAST(floor(pop / 4.8 + 0.5) AS BIGINT)",
        "relocate_low": "570000.0 * floor(pop / 4.8 + 0.5) * 0.8",
        "protect_high": "25000000.0 * greatest(0.5, round(sqrt(floor(pop / 4.8 + 0.5)) * 0.06, 2)) * 1.8",
    },
    ("k",),
    4,
)
pointwise("exceed_band", T.hourly, "hourly", {"band": "=CASE WHEN mm >= 45 THEN 'above p99' WHEN mm >= 10 THEN 'above p90' WHEN mm >= 3 THEN 'above mean' ELSE 'below mean' END"}, ("point", "h"))
pointwise("gauge_status", T.points, "points", {"above_danger": "pop / 100.0 - 60.0", "status": "=CASE WHEN pop / 100.0 >= 60 THEN 'danger' WHEN pop / 100.0 >= 50 THEN 'warning' ELSE 'normal' END"}, ("k",))
pointwise("cloud_anomaly", T.hourly, "hourly", {"above_norm": "cloud - 40.0", "reading": "=CASE WHEN h % 11 = 0 THEN 'no norm' WHEN cloud - 40 >= 20 THEN 'deeper than normal' WHEN cloud - 40 >= 8 THEN 'modestly above' ELSE 'normal' END"}, ("point", "h"))
pointwise("facility_class", T.points, "points", {"kind": "=CASE WHEN nation IN (1, 4, 9) THEN 'hospital' WHEN nation % 3 = 0 THEN 'shelter' ELSE 'other' END"}, ("k",))
pointwise("vulnerability_idx", T.points, "points", {"index": "0.35 * " + clip("0.5 + (pop / 10000.0 - 0.5)", "0.0", "1.0") + " + 0.30 * " + clip("0.5 + (nation / 25.0 - 0.5)", "0.0", "1.0") + " + 0.35 * " + clip("0.5 + ((k % 100) / 100.0 - 0.5)", "0.0", "1.0")}, ("k",))
pointwise("tile_cover", T.points, "points", {"tile": "=CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(CAST(floor(lat) AS BIGINT) AS STRING), 2, '0') || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(CAST(floor(lon) AS BIGINT) AS STRING), 3, '0')"}, ("k",))
pointwise("redzone_score", T.points, "points", {"unsuitability": M.unsuitability("CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(1 + k % 100 AS DOUBLE) END", "((k % 10) / 10.0)", "(1 + k % 5)")}, ("k",))
