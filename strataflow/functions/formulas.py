"""Pointwise formulas as SQL expressions over named columns.

They are plain expressions of functions every engine has, so Catalyst keeps
them inside whole-stage code generation and an oracle can check them.
"""

from __future__ import annotations

from .bands import clip

EARTH_KM = 6371.0088
KM_PER_DEGREE = 110.574
MANNING_CHANNEL, MANNING_FLOODPLAIN, FLOODPLAIN_WIDTH = 0.035, 0.06, 6000.0


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(2 * {EARTH_KM} * asin(least(1.0, sqrt({a}))))"


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    y = f"sin(radians({lon2} - {lon1})) * cos(radians({lat2}))"
    x = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1}))"
    turned = f"degrees(atan2({y}, {x}))"
    return f"(CASE WHEN {turned} < 0 THEN {turned} + 360 ELSE {turned} END)"


COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def compass(degrees: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(COMPASS))
    return f"CASE CAST(floor(({degrees} + 11.25) / 22.5) AS BIGINT) % 16 {arms} END"


def moisture_adjusted(cn2: str, antecedent: str) -> str:
    """The curve number for antecedent moisture: dry below 13 mm, soaked from 93."""
    cn1, cn3 = f"(4.2 * {cn2} / (10.0 - 0.058 * {cn2}))", f"(23.0 * {cn2} / (10.0 + 0.13 * {cn2}))"
    f = clip(f"(({antecedent}) - 13.0) / 40.0", "0.0", "2.0")
    return clip(f"CASE WHEN {f} <= 1.0 THEN {cn1} + ({cn2} - {cn1}) * {f} ELSE {cn2} + ({cn3} - {cn2}) * ({f} - 1.0) END", "30.0", "98.0")


def runoff(rain: str, cn: str) -> str:
    s = f"(25400.0 / {clip(cn, '0.001', '100.0')} - 254.0)"
    excess = f"greatest({rain} - 0.2 * {s}, 0.0)"
    return f"({excess} * {excess} / greatest({excess} + {s}, 0.000001))"


def time_to_peak(area: str, slope_percent: str) -> str:
    return clip(f"1.6 * pow(greatest({area}, 0.05), 0.30) / pow(greatest({slope_percent}, 0.05), 0.15)", "0.6", "48.0")


def channel_width(area: str) -> str:
    return clip(f"2.6 * pow(greatest({area}, 0.01), 0.50)", "3.0", "2500.0")


def bankfull(area: str) -> str:
    return clip(f"0.30 * pow(greatest({area}, 0.01), 0.30)", "0.5", "14.0")


def slope_term(slope_degrees: str) -> str:
    return f"sqrt({clip(f'tan(radians({slope_degrees}))', '0.0001', '0.2')})"


def manning_stage(q: str, width: str, slope_degrees: str) -> str:
    return f"pow(greatest({q}, 0.0) * {MANNING_CHANNEL} / greatest({width} * {slope_term(slope_degrees)}, 0.000001), 0.6)"


def conveyance(h: str, width: str, root_slope: str, bank: str, spread: str) -> str:
    deep, over = f"greatest({h}, 0.0)", f"greatest(greatest({h}, 0.0) - {bank}, 0.0)"
    return (
        f"(({width} / {MANNING_CHANNEL}) * pow({deep}, 5.0 / 3.0) * {root_slope}"
        f" + (least({spread} * {over}, {FLOODPLAIN_WIDTH}) / {MANNING_FLOODPLAIN}) * pow({over}, 5.0 / 3.0) * {root_slope})"
    )


def design_depth(annual: str, years: str) -> str:
    """The 24-hour depth of a return period, by Gumbel factors (cv 0.35)."""

    def k(t: str) -> str:
        return f"(-sqrt(6.0) / pi() * (0.5772 + ln(ln({t} / ({t} - 1.0)))))"

    return f"((0.13 * {annual} + 120.0) * greatest((1.0 + 0.35 * {k(f'greatest({years}, 1.05)')}) / (1.0 + 0.35 * {k('100.0')}), 0.15))"


def wetness(area: str, cell: str, slope_degrees: str) -> str:
    return f"ln(greatest({area}, {cell}) / greatest(tan(radians({slope_degrees})), 0.0015))"


def slope_rating(slope: str) -> str:
    return f"CASE WHEN {slope} > 45 THEN 2.0 WHEN {slope} > 35 THEN 1.7 WHEN {slope} > 25 THEN 1.2 WHEN {slope} > 15 THEN 0.8 WHEN {slope} > 5 THEN 0.5 ELSE 0.0 END"


def relief_rating(relief: str) -> str:
    return f"CASE WHEN {relief} > 300 THEN 1.0 WHEN {relief} > 100 THEN 0.6 ELSE 0.3 END"


def land_rating(built: str, crop: str, slope: str) -> str:
    return (
        f"CASE WHEN {built} > 0.15 AND {slope} > 25 THEN 2.0 WHEN {built} > 0.15 THEN 1.8 WHEN {crop} > 0.25 THEN 1.5"
        f" WHEN {slope} > 20 AND {built} < 0.15 AND {crop} < 0.25 THEN 0.8 ELSE 1.2 END"
    )


def caine(hours: str) -> str:
    """Landslide-triggering intensity in mm an hour for a duration."""
    return f"(14.82 * pow(greatest({hours}, 0.167), -0.39))"


def cloud_state(low: str, mid: str, high: str, cape: str, known: str) -> str:
    filled = f"(CASE WHEN {low} >= 55 THEN 1 ELSE 0 END + CASE WHEN {mid} >= 55 THEN 1 ELSE 0 END + CASE WHEN {high} >= 55 THEN 1 ELSE 0 END)"
    anvil = f"({high} - {low} >= 25 AND {high} >= 55)"
    top = f"CASE WHEN {anvil} THEN 'mature system' ELSE 'deep convection' END"
    return (
        f"CASE WHEN NOT {known} THEN CASE WHEN {filled} >= 3 THEN {top} WHEN {filled} >= 1 THEN 'building' ELSE 'quiet' END"
        f" WHEN {filled} = 0 OR {cape} < 1000 THEN 'quiet' WHEN {filled} >= 3 AND {cape} >= 2500 THEN {top} ELSE 'building' END"
    )


def watch_score(r24: str, r72: str, escalation: str, soil: str, burst: str, anomalous: str, pop: str) -> str:
    base = (
        f"100.0 * (0.30 * {clip(f'{r24} / 204.5', '0.0', '1.0')} + 0.16 * {clip(f'{r72} / 350.0', '0.0', '1.0')} + 0.24 * {escalation} / 3.0"
        f" + 0.18 * {clip(soil, '0.0', '1.0')} + 0.12 * {clip(f'{burst} / 50.0', '0.0', '1.0')})"
    )
    return clip(f"({base}) * CASE WHEN {anomalous} THEN 1.15 ELSE 1.0 END * (1.0 + 0.25 * {clip(f'{pop} / 1000000.0', '0.0', '1.0')})", "0.0", "100.0")


def action(urgency: str, lead: str) -> str:
    return f"CASE WHEN {urgency} >= 60 THEN CASE WHEN {lead} IS NULL OR {lead} <= 24 THEN 'ACT' ELSE 'PREPARE' END WHEN {urgency} >= 40 THEN 'PREPARE' WHEN {urgency} >= 25 THEN 'WATCH' ELSE 'ROUTINE' END"


def national_score(r24: str, r72: str, soil: str, cape: str, burst: str, red: str) -> str:
    base = (
        f"100.0 * (0.34 * {clip(f'{r24} / 204.5', '0.0', '1.0')} + 0.18 * {clip(f'{r72} / 350.0', '0.0', '1.0')} + 0.22 * {clip(soil, '0.0', '1.0')}"
        f" + 0.14 * {clip(f'({cape} - 800.0) / 3200.0', '0.0', '1.0')} + 0.12 * {clip(f'{burst} / 50.0', '0.0', '1.0')})"
    )
    return clip(f"({base}) * (1.0 + 0.25 * {clip(f'coalesce({red}, 0.0)', '0.0', '1.0')})", "0.0", "100.0")


def strategy(rp: str, pop: str, hazard: str) -> str:
    return (
        f"CASE WHEN {rp} IS NULL THEN 'monitor' WHEN {pop} <= 0 THEN 'regulate' WHEN {hazard} = 'erosion' THEN 'relocate'"
        f" WHEN {rp} <= 10.0 THEN 'relocate' WHEN {rp} <= 30.0 THEN 'protect' ELSE 'regulate' END"
    )


def unsuitability(rp: str, intensity: str, hazards: str, premium: float = 0.12) -> str:
    return f"CASE WHEN {rp} IS NULL THEN 0.0 ELSE {clip(f'0.72 * ln(100.0 / {rp}) / ln(100.0) + 0.28 * {intensity} + {premium} * {clip(f'{hazards} - 1', 0, 3)}', '0.0', '1.0')} END"
