"""Queries of the rule engine over facts about places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas as M
from ..functions import registry as R
from ..operators import rules
from ..sources import tables as T
from .build import oracle, query

ZONES = (
    "k, (k % 23) / 10e0 AS max_depth_m, CASE WHEN k % 5 > 0 THEN k % 3 = 0 END AS is_cut_off, pop * 7 AS population_affected, k % 4 AS facilities_at_risk, k % 5 - 2 AS shelter_shortfall, "
    "CASE WHEN k % 13 > 0 THEN (k % 31) / 10e0 END AS cropland_flooded_km2, CASE WHEN k % 11 = 0 THEN 'not known' ELSE CAST(k % 72 AS STRING) END AS duration_hours"
)
# the rules as the doctrine words them, one query each
ACT = {
    "EVAC-MANDATORY": ("immediate", "NOT d < 1.5"),
    "EVAC-CUTOFF": ("immediate", "off AND d BETWEEN 0.7 AND 99"),
    "EVAC-ADVISE": ("urgent", "NOT off AND d >= 0.7 AND d < 1.5"),
    "EVAC-STANDBY": ("routine", "d >= 0.3 AND NOT d >= 0.7"),
    "BOAT-DEPLOY": ("immediate", "d >= 1"),
    "AIRLIFT-REQUEST": ("immediate", "off AND people > 24999"),
    "HEALTH-CAMP": ("urgent", "people > 4999"),
    "HEALTH-FACILITY": ("immediate", "k % 4 <> 0"),
    "WATER-DISINFECT": ("urgent", "k % 23 >= 5"),
    "POWER-ISOLATE": ("immediate", "k % 23 >= 5"),
    "ROAD-ALT": ("urgent", "off"),
    "RELIEF-CAMP": ("urgent", "k % 5 IN (3, 4)"),
    "CROP-ASSESS": ("routine", "crops >= 1"),
    "DEWATER": ("urgent", "k % 11 <> 0 AND k % 72 >= 48 AND d >= 0.3"),
    "FODDER": ("routine", "crops >= 2"),
}
ACT_SQL = " UNION ALL ".join(f"SELECT k, '{name}' AS rule, '{u}' AS urgency, {n} AS place FROM z WHERE {w}" for n, (name, (u, w)) in enumerate(ACT.items()))


@query(oracle(f", z AS (SELECT k, (k % 23) / 10e0 AS d, k % 5 > 0 AND k % 3 = 0 AS off, pop * 7 AS people, CASE WHEN k % 13 > 0 THEN (k % 31) / 10e0 ELSE 0 END AS crops FROM points), m AS ({ACT_SQL}) SELECT k, rule, urgency, row_number() OVER (PARTITION BY k ORDER BY list_position(['immediate', 'urgent', 'routine'], urgency), place) AS rank FROM m", "points"))
def rule_match(spark, sf):
    """What is to be done in each zone, the most urgent first: all rules for
    action, their predicates read from a table."""
    facts = T.points(spark, sf).selectExpr(*split(ZONES))
    got = rules.matches(facts, rules.table(spark, R.ACTIONS), ["k"], R.ZONE_FACTS, R.URGENCY)
    return got.select("k", F.col("id").alias("rule"), "urgency", "rank")


def split(listed: str) -> list[str]:
    """The expressions of a select list."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(listed):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(listed[at:i])
            at = i + 1
    return [*out, listed[at:]]


HAZARD = "CASE k % 6 WHEN 0 THEN 'flood' WHEN 1 THEN 'waterlogging' WHEN 2 THEN 'landslide' WHEN 3 THEN 'erosion' WHEN 4 THEN 'cyclone' END"
HORIZON = "CASE k % 4 WHEN 0 THEN 'immediate' WHEN 1 THEN 'short-term' WHEN 2 THEN 'medium-term' ELSE 'monitor' END"
PLACES = f"k, nation, CASE WHEN k % 8 > 0 THEN 1 + (k * 7) % 140 END AS return_period_years, greatest(pop - 500, 0) % 900 AS population_in_red_zone, {HAZARD} AS dominant_hazard, {HORIZON} AS relocation_horizon"
DO = {
    "REL-PROPOSE": ("relocation", "immediate", "when_ = 'immediate' AND pop > 0", "DDMA"),
    "REL-SIA": ("relocation", "immediate", "soon AND pop > 0", "REV"),
    "REL-ENTITLE": ("relocation", "short-term", "soon AND pop > 0", "REV"),
    "REL-SITE": ("relocation", "short-term", "soon AND pop > 0", "REV"),
    "REL-FOREST": ("relocation", "short-term", "soon AND (hazard = 'landslide' OR hazard = 'erosion')", "FOREST"),
    "REL-HOUSING": ("relocation", "medium-term", "soon AND pop > 99", "HOUSING"),
    "REL-VACATE": ("relocation", "medium-term", "soon AND pop > 0", "REV"),
    "STR-EMBANK": ("structural", "short-term", "hazard = 'flood' AND when_ = 'short-term'", "WRD"),
    "STR-DRAIN": ("structural", "short-term", "hazard = 'waterlogging'", "WRD"),
    "STR-SLOPE": ("structural", "short-term", "hazard = 'landslide' AND (when_ = 'short-term' OR when_ = 'medium-term')", "GSI"),
    "STR-BIOENG": ("structural", "medium-term", "hazard = 'landslide'", "FOREST"),
    "STR-COAST": ("structural", "medium-term", "hazard = 'erosion'", "NCCR"),
    "REG-NOBUILD": ("regulatory", "immediate", "pop > 0 AND NOT coalesce(rp, 999) > 100", "TCP"),
    "REG-ZONING": ("regulatory", "medium-term", "coalesce(rp, 999) < 101", "DDMA"),
    "REG-CRZ": ("regulatory", "short-term", "hazard = 'erosion'", "TCP"),
    "PRE-EWS": ("preparedness", "immediate", "pop > 0 AND rp < 101", "VDMC"),
    "PRE-DRILL": ("preparedness", "ongoing", "pop > 0 AND rp < 31", "VDMC"),
    "PRE-MONITOR": ("preparedness", "ongoing", "rp < 101", "DDMA"),
}
DO_SQL = " UNION ALL ".join(f"SELECT k, nation, strategy, '{n}' AS rule, '{f}' AS family, '{u}' AS horizon, '{lead}' AS lead FROM p WHERE {w}" for n, (f, u, w, lead) in DO.items())
PLAN = f""", h AS (SELECT {PLACES} FROM points), p AS (SELECT k, nation, return_period_years AS rp, population_in_red_zone AS pop, dominant_hazard AS hazard, relocation_horizon AS when_, relocation_horizon IN ('immediate', 'short-term') AS soon,
 CASE WHEN return_period_years IS NULL THEN 'monitor' WHEN population_in_red_zone <= 0 THEN 'regulate' WHEN dominant_hazard = 'erosion' OR return_period_years <= 10 THEN 'relocate' WHEN return_period_years <= 30 THEN 'protect' ELSE 'regulate' END AS strategy FROM h),
 m AS (SELECT * FROM ({DO_SQL}) WHERE family = 'preparedness' OR (family = 'regulatory' AND strategy <> 'monitor') OR (family = 'relocation' AND strategy = 'relocate') OR (family = 'structural' AND strategy = 'protect'))"""


def plans(spark, sf):
    """Each place's strategy and the measures of the families it allows."""
    facts = T.points(spark, sf).selectExpr(*split(PLACES))
    chosen = facts.withColumn("strategy", F.expr(M.strategy("cast(return_period_years as double)", "population_in_red_zone", "dominant_hazard")))
    got = rules.matches(chosen, rules.table(spark, R.MEASURES), ["k", "nation", "strategy"], R.PLACE_FACTS, R.HORIZONS, ["family", "id"])
    allowed = F.create_map(*[x for s, families in R.STRATEGIES.items() for x in (F.lit(s), F.array(*map(F.lit, families)))])
    return got.where(F.array_contains(allowed[F.col("strategy")], F.col("family")))


@query(oracle(f"{PLAN} SELECT k, strategy, rule, family, horizon, lead FROM m", "points"))
def plan_measures(spark, sf):
    """The plan of each place: the measures its strategy allows."""
    return plans(spark, sf).select("k", "strategy", F.col("id").alias("rule"), "family", F.col("urgency").alias("horizon"), "lead")


@query(oracle(f"{PLAN}, s AS (SELECT * FROM (VALUES " + ", ".join(f"('{r.id}', '{a}')" for r in R.MEASURES for a in r.supporting) + ") t(rule, authority)), a AS (SELECT nation, lead AS authority, rule, true AS leads FROM m UNION SELECT nation, authority, rule, false FROM m JOIN s USING (rule)) SELECT nation, authority, coalesce(list_sort(list(rule) FILTER (leads)), []) AS leads, coalesce(list_sort(list(rule) FILTER (NOT leads)), []) AS supports FROM a GROUP BY 1, 2", "points"))
def plan_authorities(spark, sf):
    """Who leads and who supports the measures of each nation's plans."""
    return rules.involved(plans(spark, sf), ["nation"])
