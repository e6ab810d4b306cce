"""A rule engine: predicates are rows of a table, facts are columns.

All predicates are compiled into one projection over the facts, so a row of
facts is read once, whatever the number of rules, and nothing is joined but the
few rules themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 2000  # rules of a table; they become one expression


@dataclass(frozen=True)
class Rule:
    """``predicate`` is SQL over the facts; ``basis`` the instrument it stands on."""

    id: str
    family: str
    urgency: str
    predicate: str
    lead: str
    supporting: tuple[str, ...] = ()
    basis: str = ""


def table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The rules as rows, in their order (``place``)."""
    rows = [(i, *asdict(r).values()) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "place int, id string, family string, urgency string, predicate string, lead string, supporting array<string>, basis string")


def typed(facts: DataFrame, keys: Sequence[str], known: dict[str, tuple[str, str]]) -> DataFrame:
    """The keys and all known facts in their types; the default stands for a
    fact that is null, can't be read as its type, or has no column."""
    there = {c.lower() for c in facts.columns}
    of = lambda n, kind, other: f"coalesce(try_cast(`{n}` as {kind}), cast({other} as {kind}))" if n.lower() in there else f"cast({other} as {kind})"
    return facts.select(*keys, *[F.expr(of(n, *k)).alias(n) for n, k in known.items()])


def _columns(facts: DataFrame, predicates: Sequence[str]) -> list[Column | None]:
    """Each predicate as a column; None if it can't be analysed over the facts."""
    out: list[Column | None] = []
    for p in predicates:
        try:
            facts.where(F.expr(p).cast("boolean"))  # where a predicate over a row, and nothing else, may stand
            out.append(F.expr(p).cast("boolean"))
        except (AnalysisException, ParseException):
            out.append(None)
    return out


def matches(facts: DataFrame, rules: DataFrame, keys: Sequence[str], known: dict[str, tuple[str, str]], order: Sequence[str], by: Sequence[str] = ("place",)) -> DataFrame:
    """``keys, id, family, urgency, lead, supporting, basis, rank``: the rules
    that hold for each row of facts, the most urgent first.

    ``rules`` is a table like ``table`` makes; ``order`` lists the urgencies,
    others come after; rules of equal urgency follow by the columns ``by``.  A
    predicate that is null, fails over a row (a division by nothing, a text
    that is no number) or can't be analysed is no match, and costs no other
    rule its own.  Rows of facts without a match give no row; equal keys are
    rows of their own.  More than ``MOST`` rules end with a ValueError.
    """
    spark = facts.sparkSession
    urgency = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), F.col("urgency")), F.lit(0))
    sorted_ = rules.withColumn("_at", F.when(urgency == 0, len(order) + 1).otherwise(urgency)).orderBy("_at", *by)
    listed = sorted_.limit(MOST + 1).collect()
    if len(listed) > MOST:
        raise ValueError(f"there are more than {MOST} rules")
    ready = typed(facts, keys, known)
    was = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")  # while the predicates are analysed: what fails is null
    try:
        hold = [(i, c) for i, c in enumerate(_columns(ready, [r["predicate"] for r in listed])) if c is not None]
        found = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in hold])) if hold else F.array().cast("array<int>")
        hits = ready.select(*keys, found.alias("_found"))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", was)
    shown = ["id", "family", "urgency", "lead", "supporting", "basis"]
    numbered = spark.createDataFrame([(i, *(r[c] for c in shown)) for i, r in enumerate(listed)], "_found int, id string, family string, urgency string, lead string, supporting array<string>, basis string")
    # a row a rule, of at most MOST
    each = hits.select(*keys, F.posexplode("_found").alias("_rank", "_found")).join(F.broadcast(numbered), "_found")
    return each.select(*keys, *shown, (F.col("_rank") + 1).cast("long").alias("rank"))


def involved(matched: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, authority, leads, supports``: the authorities that lead or support
    a rule of each group, with the rules' sorted names."""
    roles = matched.select(*by, "id", F.explode(F.concat(F.array(F.struct(F.col("lead").alias("a"), F.lit(True).alias("l"))), F.transform("supporting", lambda s: F.struct(s.alias("a"), F.lit(False).alias("l"))))).alias("x"))
    few = roles.select(*by, "id", F.col("x.a").alias("authority"), F.col("x.l").alias("leads")).distinct()  # no more than rules times roles a group
    of = lambda lead: F.sort_array(F.collect_list(F.when(F.col("leads") == lead, F.col("id"))))
    return few.groupBy(*by, "authority").agg(of(True).alias("led"), of(False).alias("supports")).withColumnRenamed("led", "leads")
