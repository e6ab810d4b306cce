"""The rule engine: every rule by hand, failures that stay alone, order."""

import random

import pytest
from pyspark.sql import functions as F

from strataflow.functions import formulas as M
from strataflow.functions import registry as R
from strataflow.operators import rules
from strataflow.operators.rules import Rule

KNOWN = {"depth": ("double", "0"), "n": ("bigint", "0"), "name": ("string", "''"), "open": ("boolean", "false")}


def hits(spark, rows, schema, made, **more):
    df = spark.createDataFrame(rows, schema)
    got = rules.matches(df, rules.table(spark, made), ["k"], KNOWN, R.URGENCY, **more).collect()
    return {k: [x["id"] for x in sorted((x for x in got if x["k"] == k), key=lambda x: x["rank"])] for k in {x["k"] for x in got}}


def rule(name, predicate, urgency="routine", family="f"):
    return Rule(name, family, urgency, predicate, "A", ("B", "C"))


def test_a_rule_that_fails_costs_no_other_its_own(spark):
    made = [
        rule("divides", "1 / n > 0"),
        rule("casts", "cast(name as int) = 7"),
        rule("unknown", "no_such_fact > 1"),
        rule("broken", "depth >"),
        rule("aggregate", "sum(n) > 1"),
        rule("good", "depth >= 1"),
        rule("null", "null"),
        rule("text", "name = '7'"),
    ]
    got = hits(spark, [(1, 1.0, 0, "x"), (2, 0.0, 2, "7"), (3, None, None, None)], "k long, depth double, n long, name string", made)
    assert got == {1: ["good"], 2: ["divides", "casts", "text"]}
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_missing_facts_have_defaults(spark):
    made = [rule("shut", "not open"), rule("shallow", "depth < 1"), rule("named", "name <> ''")]
    assert hits(spark, [(1, "not a number")], "k long, depth string", made) == {1: ["shut", "shallow"]}
    assert hits(spark, [(1, "2.5", "yes")], "k long, DEPTH string, open string", made) == {}
    assert hits(spark, [], "k long", made) == {}


def test_the_most_urgent_first_and_then_in_order(spark):
    made = [rule("a", "true", "routine"), rule("b", "true", "whenever"), rule("c", "true", "immediate"), rule("d", "true", "urgent"), rule("e", "true", "immediate"), rule("f", "k is null", "urgent")]
    assert hits(spark, [(1,), (2,)], "k long", made) == dict.fromkeys((1, 2), ["c", "e", "d", "a", "b"])
    named = [Rule(x, f, "urgent", "true", "A") for x, f in (("z", "m"), ("y", "m"), ("x", "n"))]
    assert hits(spark, [(1,)], "k long", named, by=["family", "id"]) == {1: ["y", "z", "x"]}


def test_too_many_rules_and_none(spark, monkeypatch):
    assert hits(spark, [(1,)], "k long", []) == {}
    monkeypatch.setattr(rules, "MOST", 2)
    with pytest.raises(ValueError):
        hits(spark, [(1,)], "k long", [rule(str(i), "true") for i in range(3)])


def test_the_registries_hold_together():
    assert len(R.ACTIONS) + len(R.MEASURES) == 33 and len({r.id for r in (*R.ACTIONS, *R.MEASURES)}) == 33
    assert {r.family for r in R.MEASURES} == {f for families in R.STRATEGIES.values() for f in families}
    assert {a for r in R.MEASURES for a in (r.lead, *r.supporting)} <= set(R.AUTHORITIES)
    assert {r.urgency for r in R.ACTIONS} == set(R.URGENCY) and {r.urgency for r in R.MEASURES} == set(R.HORIZONS)
    assert {level for _, level in R.AUTHORITIES.values()} == set(R.LEVELS)


def test_actions_against_plain_conditions(spark):
    r = random.Random(4)
    rows = [(k, r.choice([None, r.uniform(0, 3), 0.3, 0.7, 1.5]), r.choice([None, True, False]), r.choice([0, 4999, 5000, 24999, 25000, None]), r.randint(0, 2), r.randint(-2, 2), r.choice([0.5, 1.0, 2.0, None]), r.choice([None, 10, 48, 90])) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, max_depth_m double, is_cut_off boolean, population_affected long, facilities_at_risk long, shelter_shortfall long, cropland_flooded_km2 double, duration_hours long")
    got: dict = {}
    for x in rules.matches(df, rules.table(spark, R.ACTIONS), ["k"], R.ZONE_FACTS, R.URGENCY).collect():
        got.setdefault(x["k"], set()).add(x["id"])
    for k, d, off, people, ill, short, crops, hours in rows:
        d, off, people, crops, hours = d or 0, bool(off), people or 0, crops or 0, hours or 0
        want = {
            "EVAC-MANDATORY": d >= 1.5, "EVAC-CUTOFF": off and d >= 0.7, "EVAC-ADVISE": 0.7 <= d < 1.5 and not off, "EVAC-STANDBY": 0.3 <= d < 0.7, "BOAT-DEPLOY": d >= 1, "AIRLIFT-REQUEST": off and people >= 25000,
            "HEALTH-CAMP": people >= 5000, "HEALTH-FACILITY": ill > 0, "WATER-DISINFECT": d >= 0.5, "POWER-ISOLATE": d >= 0.5, "ROAD-ALT": off, "RELIEF-CAMP": short > 0, "CROP-ASSESS": crops >= 1,
            "DEWATER": hours >= 48 and d >= 0.3, "FODDER": crops >= 2,
        }
        assert got.get(k, set()) == {x for x, yes in want.items() if yes}


@pytest.mark.parametrize(
    "rp, horizon, hazard, people, strategy, must, mustnt",
    [
        (5.0, "immediate", "flood", 500, "relocate", {"REL-PROPOSE", "REL-SIA", "REL-ENTITLE", "REL-VACATE"}, {"STR-EMBANK"}),
        (25.0, "short-term", "flood", 500, "protect", {"STR-EMBANK", "REG-NOBUILD", "PRE-DRILL"}, {"REL-SIA", "REL-HOUSING"}),
        (90.0, "medium-term", "landslide", 500, "regulate", {"REG-ZONING", "PRE-EWS"}, {"STR-SLOPE", "PRE-DRILL"}),
        (60.0, "short-term", "erosion", 500, "relocate", {"REG-CRZ", "REL-FOREST"}, {"STR-COAST"}),
        (5.0, "immediate", "flood", 0, "regulate", {"REG-ZONING", "PRE-MONITOR"}, {"REL-SIA", "REG-NOBUILD"}),
        (None, "monitor", "flood", 500, "monitor", set(), {"PRE-MONITOR", "REG-ZONING"}),
    ],
)
def test_plans_follow_the_strategy(spark, rp, horizon, hazard, people, strategy, must, mustnt):
    df = spark.createDataFrame([(1, rp, people, hazard, horizon)], "k long, return_period_years double, population_in_red_zone long, dominant_hazard string, relocation_horizon string")
    df = df.withColumn("strategy", F.expr(M.strategy("return_period_years", "population_in_red_zone", "dominant_hazard")))
    got = rules.matches(df, rules.table(spark, R.MEASURES), ["k", "strategy"], R.PLACE_FACTS, R.HORIZONS, ["family", "id"]).where(F.col("family").isin(*R.STRATEGIES[strategy]))
    rows = got.orderBy("rank").collect()
    assert {x["strategy"] for x in rows} <= {strategy} and df.first()["strategy"] == strategy
    assert must <= {x["id"] for x in rows} and not mustnt & {x["id"] for x in rows}
    assert [R.HORIZONS.index(x["urgency"]) for x in rows] == sorted(R.HORIZONS.index(x["urgency"]) for x in rows)
    who = {x["authority"]: x for x in rules.involved(got, ["k"]).collect()}
    assert not rows or any(x["leads"] for x in who.values())
    for x in rows:
        assert x["id"] in who[x["lead"]]["leads"] and all(x["id"] in who[a]["supports"] for a in x["supporting"])
