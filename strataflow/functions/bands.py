"""Bands, thresholds and weights that are fixed by the published schemes."""

from __future__ import annotations

# Value bands, each (upper limit, name); a value takes the first band whose limit it is below.
DEPTH = ((0.15, "nuisance"), (0.50, "wadeable"), (1.00, "impassable"), (2.00, "boat-only"), (99.0, "severe"))
HAZARD_ZONE = ((3.5, "very low"), (5.0, "low"), (6.0, "moderate"), (7.5, "high"), (99.0, "very high"))
WIND = ((34, "depression"), (48, "cyclonic storm"), (64, "severe cyclonic storm"), (90, "very severe cyclonic storm"), (120, "extremely severe cyclonic storm"), (999, "super cyclonic storm"))
HORIZON = ((10.0, "immediate"), (30.0, "short-term"), (100.5, "medium-term"))
HORIZON_ELSE = "monitor"
CAPE = ((1000.0, "marginal"), (2500.0, "moderate"), (4000.0, "strong"), (1e9, "extreme"))
# Rain bands, each (lower limit, name); a value takes the last band whose limit it reaches.
RAIN_24H = ((0.0, "no warning"), (64.5, "heavy"), (115.6, "very heavy"), (204.5, "extremely heavy"))
HAZARDS = ("flood", "landslide", "waterlogging", "erosion", "cloudburst")
STATES = ("quiet", "building", "deep convection", "mature system")


def below(value: str, bands, otherwise: str | None = None) -> str:
    """SQL: the first band whose limit ``value`` is below."""
    arms = " ".join(f"WHEN {value} < {limit} THEN '{name}'" for limit, name in bands)
    return f"CASE {arms} ELSE '{otherwise or bands[-1][1]}' END"


def reached(value: str, bands) -> str:
    """SQL: the last band whose limit ``value`` reaches."""
    arms = " ".join(f"WHEN {value} >= {limit} THEN '{name}'" for limit, name in reversed(bands))
    return f"CASE {arms} ELSE '{bands[0][1]}' END"


def clip(value: str, low: float | str, high: float | str) -> str:
    return f"greatest({low}, least({high}, {value}))"
