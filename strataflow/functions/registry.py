"""Registries of doctrine: authorities, and the rules for action and mitigation."""

from __future__ import annotations

from ..operators.rules import Rule

# Authorities by level, with their names.
LEVELS = ("national", "state", "district", "local")
AUTHORITIES = {
    "NDMA": ("National Disaster Management Authority", "national"),
    "NDRF": ("National Disaster Response Force", "national"),
    "GSI": ("Geological Survey of India", "national"),
    "CWC": ("Central Water Commission", "national"),
    "NCCR": ("National Centre for Coastal Research", "national"),
    "SDMA": ("State Disaster Management Authority", "state"),
    "SEC": ("State Executive Committee", "state"),
    "REV": ("Revenue Department", "state"),
    "PWD": ("Public Works Department", "state"),
    "PHED": ("Public Health Engineering Department", "state"),
    "WRD": ("Water Resources / Irrigation Department", "state"),
    "FOREST": ("State Forest Department", "state"),
    "TCP": ("Town and Country Planning Department", "state"),
    "HOUSING": ("State Housing Board / Rural Development Dept", "state"),
    "DDMA": ("District Disaster Management Authority", "district"),
    "DM": ("District Magistrate / Collector", "district"),
    "TEHSIL": ("Tehsildar / Revenue Circle Officer", "district"),
    "GP": ("Gram Panchayat", "local"),
    "ULB": ("Urban Local Body / Municipal Corporation", "local"),
    "VDMC": ("Village Disaster Management Committee", "local"),
}

# Facts with their types, and what stands for one that is missing.
ZONE_FACTS = {
    "max_depth_m": ("double", "0"),
    "is_cut_off": ("boolean", "false"),
    "population_affected": ("bigint", "0"),
    "facilities_at_risk": ("bigint", "0"),
    "shelter_shortfall": ("bigint", "0"),
    "cropland_flooded_km2": ("double", "0"),
    "duration_hours": ("bigint", "0"),
}
PLACE_FACTS = {
    "return_period_years": ("double", "double('infinity')"),
    "population_in_red_zone": ("bigint", "0"),
    "dominant_hazard": ("string", "''"),
    "relocation_horizon": ("string", "''"),
}

URGENCY = ("immediate", "urgent", "routine")
HORIZONS = ("immediate", "short-term", "medium-term", "ongoing")
STRATEGIES = {
    "relocate": ("relocation", "regulatory", "preparedness"),
    "protect": ("structural", "regulatory", "preparedness"),
    "regulate": ("regulatory", "preparedness"),
    "monitor": ("preparedness",),
}

# What is done in a flooded zone, when, and by whom.
ACTIONS = (
    Rule("EVAC-MANDATORY", "response", "immediate", "max_depth_m >= 1.5", "District Magistrate / SDRF"),
    Rule("EVAC-CUTOFF", "response", "immediate", "is_cut_off and max_depth_m >= 0.7", "District Magistrate / SDRF"),
    Rule("EVAC-ADVISE", "response", "urgent", "max_depth_m >= 0.7 and max_depth_m < 1.5 and not is_cut_off", "Block Development Officer"),
    Rule("EVAC-STANDBY", "warning", "routine", "max_depth_m >= 0.3 and max_depth_m < 0.7", "Block Development Officer"),
    Rule("BOAT-DEPLOY", "response", "immediate", "max_depth_m >= 1.0", "SDRF / NDRF"),
    Rule("AIRLIFT-REQUEST", "response", "immediate", "is_cut_off and population_affected >= 25000", "District Magistrate"),
    Rule("HEALTH-CAMP", "response", "urgent", "population_affected >= 5000", "Chief Medical Officer"),
    Rule("HEALTH-FACILITY", "response", "immediate", "facilities_at_risk > 0", "Chief Medical Officer"),
    Rule("WATER-DISINFECT", "recovery", "urgent", "max_depth_m >= 0.5", "PHED"),
    Rule("POWER-ISOLATE", "response", "immediate", "max_depth_m >= 0.5", "Electricity Distribution Company"),
    Rule("ROAD-ALT", "response", "urgent", "is_cut_off", "Public Works Department"),
    Rule("RELIEF-CAMP", "response", "urgent", "shelter_shortfall > 0", "District Magistrate"),
    Rule("CROP-ASSESS", "recovery", "routine", "cropland_flooded_km2 >= 1.0", "District Agriculture Officer"),
    Rule("DEWATER", "recovery", "urgent", "duration_hours >= 48 and max_depth_m >= 0.3", "Municipal Body / PHED"),
    Rule("FODDER", "recovery", "routine", "cropland_flooded_km2 >= 2.0", "Animal Husbandry Department"),
)

_SOON = "relocation_horizon in ('immediate', 'short-term')"
_PEOPLE = "population_in_red_zone > 0"
# What is done about a place at risk, when, by whom and on what ground.
MEASURES = (
    Rule("REL-PROPOSE", "relocation", "immediate", f"relocation_horizon = 'immediate' and {_PEOPLE}", "DDMA", ("SDMA", "REV", "DM"), "NDMP-2019"),
    Rule("REL-SIA", "relocation", "immediate", f"{_SOON} and {_PEOPLE}", "REV", ("GP", "DM", "TEHSIL"), "RFCTLARR-SIA"),
    Rule("REL-ENTITLE", "relocation", "short-term", f"{_SOON} and {_PEOPLE}", "REV", ("TEHSIL", "GP"), "RFCTLARR-2013"),
    Rule("REL-SITE", "relocation", "short-term", f"{_SOON} and {_PEOPLE}", "REV", ("PWD", "PHED", "TEHSIL"), "RFCTLARR-2013"),
    Rule("REL-FOREST", "relocation", "short-term", f"{_SOON} and dominant_hazard in ('landslide', 'erosion')", "FOREST", ("REV", "SDMA"), "FCA-1980"),
    Rule("REL-HOUSING", "relocation", "medium-term", f"{_SOON} and population_in_red_zone >= 100", "HOUSING", ("SDMA", "GP"), "PMAY-G"),
    Rule("REL-VACATE", "relocation", "medium-term", f"{_SOON} and {_PEOPLE}", "REV", ("DM", "GP", "TEHSIL"), "DM-ACT-30"),
    Rule("STR-EMBANK", "structural", "short-term", "dominant_hazard = 'flood' and relocation_horizon = 'short-term'", "WRD", ("CWC", "DDMA"), "NDMA-FLOOD"),
    Rule("STR-DRAIN", "structural", "short-term", "dominant_hazard = 'waterlogging'", "WRD", ("ULB", "GP"), "DM-ACT-38"),
    Rule("STR-SLOPE", "structural", "short-term", "dominant_hazard = 'landslide' and relocation_horizon in ('short-term', 'medium-term')", "GSI", ("PWD", "DDMA"), "NDMA-LANDSLIDE"),
    Rule("STR-BIOENG", "structural", "medium-term", "dominant_hazard = 'landslide'", "FOREST", ("GSI", "GP"), "NDMA-LANDSLIDE"),
    Rule("STR-COAST", "structural", "medium-term", "dominant_hazard = 'erosion'", "NCCR", ("FOREST", "WRD"), "CRZ-2019"),
    Rule("REG-NOBUILD", "regulatory", "immediate", f"return_period_years <= 100 and {_PEOPLE}", "TCP", ("DM", "ULB", "GP"), "MBBL-2016"),
    Rule("REG-ZONING", "regulatory", "medium-term", "return_period_years <= 100", "DDMA", ("TCP", "SDMA"), "DM-ACT-31"),
    Rule("REG-CRZ", "regulatory", "short-term", "dominant_hazard = 'erosion'", "TCP", ("NCCR", "ULB"), "CRZ-2019"),
    Rule("PRE-EWS", "preparedness", "immediate", f"return_period_years <= 100 and {_PEOPLE}", "VDMC", ("DDMA", "GP"), "NDMP-2019"),
    Rule("PRE-DRILL", "preparedness", "ongoing", f"return_period_years <= 30 and {_PEOPLE}", "VDMC", ("DDMA", "GP"), "DM-ACT-31"),
    Rule("PRE-MONITOR", "preparedness", "ongoing", "return_period_years <= 100", "DDMA", ("SDMA",), "DM-ACT-31"),
)
