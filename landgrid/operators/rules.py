"""Eligibility rules: claims scored against schemes, and village summaries.

A scheme is data: conditions with points and reasons, a benefit, requirements. Each
scheme becomes one struct expression; a claim is scored against all schemes in one
narrow pass over claims joined to their villages.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scheme:
    """conditions: (points, SQL predicate over the joined row, reason); null predicates fail."""

    id: str
    benefit: str
    conditions: tuple[tuple[int, str, str], ...] = ()
    requirements: tuple[str, ...] = ()
    active: bool = True
    named: dict = field(default_factory=dict, compare=False)


_HOUSEHOLDS = "ceil((CASE WHEN coalesce(population, 0) = 0 THEN 100 ELSE population END) / 5)"

#: Schemes, points, thresholds, amounts. `{accepted}` is the accepting status;
#: amounts that a catalogue does not give are parameters.
SCHEMES = (
    Scheme("pm-kisan", "CASE WHEN claim_type = 'IFR' AND area <= 10 THEN 6000 ELSE 0 END", (
        (50, "claim_type = 'IFR' AND area <= 10", "small farmer with individual rights"),
        (25, "status = '{accepted}'", "accepted claim shows ownership"),
        (15, "state_name IN ('MP', 'Odisha', 'Telangana', 'Tripura')", "target state"),
    ), ("identity card", "bank account", "land documents", "cultivation certificate")),
    Scheme("jal-jeevan-mission", _HOUSEHOLDS + " * 35000", (
        (40, "type = 'rural'", "rural household"),
        (40, "NOT coalesce(water_access, false) OR water_quality = 'poor'", "poor access to water"),
        (20, "claim_type = 'IFR'", "holder of individual rights"),
    ), ("household survey", "water committee", "community contribution", "quality test")),
    Scheme("mgnrega", _HOUSEHOLDS + " * 100 * 250", (
        (30, "type = 'rural'", "rural area"),
        (40, "claim_type IN ('IFR', 'CFR', 'CR')", "holder of forest rights"),
        (30, "status = '{accepted}' AND area > 0.5", "land fit for works"),
    ), ("job card", "bank account", "application for work", "social audit")),
    Scheme("dajgua", "0"),
    Scheme("pmjdy", "{pmjdy_benefit}", (
        (60, "true", "open to all adults"),
        (20, "claim_type IS NOT NULL", "transfers need an account"),
    ), ("identity card", "proof of address", "photograph"), active=False),
    Scheme("pmfby", "CASE WHEN claim_type = 'IFR' AND area > 0 THEN area * 25000 ELSE 0 END", (
        (50, "claim_type = 'IFR' AND area > 0", "cultivator"),
        (30, "status = '{accepted}'", "accepted claim allows cover"),
    ), ("cultivation rights", "bank account", "crop details", "premium"), active=False),
    Scheme("pm-awas-gramin", "CASE WHEN coalesce(elevation > 1000, false) OR coalesce(tribal_population > 30, false) THEN {hill_benefit} ELSE {plain_benefit} END", (
        (45, "type = 'rural'", "rural family"),
        (35, "claim_type IS NOT NULL AND status = '{accepted}'", "accepted claim"),
        (20, "coalesce(elevation > 1000, false) OR coalesce(tribal_population > 30, false)", "hill or tribal area"),
    ), ("survey entry", "identity card", "bank account", "no solid house"), active=False),
    Scheme("swachh-bharat-mission", "CASE WHEN type = 'rural' THEN {toilet_benefit} ELSE 0 END", (
        (50, "type = 'rural'", "rural household"),
        (30, "claim_type IS NOT NULL AND forest_area > 50", "forest community"),
    ), ("household survey", "no toilet yet", "own contribution", "check of the building"), active=False),
)
AMOUNTS = {"pmjdy_benefit": 210000, "hill_benefit": 130000, "plain_benefit": 120000, "toilet_benefit": 12000}
CATALOGUE = tuple(s for s in SCHEMES if s.active)
KEPT_ABOVE = 50


def with_village(claims: DataFrame, villages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims joined to their village, claims without one)."""
    v = villages.select(F.col("id").alias("village_id"), "state_name", "type", "water_access", "water_quality", "population", "tribal_population", "elevation", "forest_area")
    return claims.join(v, "village_id"), claims.join(v.select("village_id"), "village_id", "left_anti")


def score(scheme: Scheme, accepted: str = "approved", amounts: dict[str, int] = AMOUNTS) -> Column:
    """struct(scheme, ord, score, benefit, rationale, requirements) for a joined row; score at most 100."""
    fill = amounts | {"accepted": accepted}
    tests = [(p, F.coalesce(F.expr(c.format(**fill)), F.lit(False)), r) for p, c, r in scheme.conditions]
    points = F.lit(0)
    for p, ok, _ in tests:
        points = points + F.when(ok, p).otherwise(0)
    reasons = F.array_join(F.array_compact(F.array(*[F.when(ok, F.lit(r)) for _, ok, r in tests]).cast("array<string>")), "; ")
    return F.struct(
        F.lit(scheme.id).alias("scheme"), F.lit([s.id for s in SCHEMES].index(scheme.id)).alias("ord"),
        F.least(F.lit(100), points).alias("score"), F.expr(scheme.benefit.format(**fill)).cast("double").alias("benefit"),
        reasons.alias("rationale"), F.array(*[F.lit(r) for r in scheme.requirements]).cast("array<string>").alias("requirements"),
    )


def priority(points: Column) -> Column:
    return F.when(points >= 80, "high").when(points >= 60, "medium").otherwise("low")


def scored(joined: DataFrame, schemes: tuple[Scheme, ...] = CATALOGUE, accepted: str = "approved") -> DataFrame:
    """One row per claim and scheme, without a shuffle."""
    each = F.explode(F.array(*[score(s, accepted) for s in schemes])).alias("r")
    return joined.select("id", "village_id", "status", each).select("id", "village_id", "status", "r.*").withColumn("priority", priority(F.col("score")))


def recommendations(joined: DataFrame, accepted: str = "approved", schemes: tuple[Scheme, ...] = CATALOGUE) -> DataFrame:
    """Scored pairs above the threshold, ranked within the claim by score, then catalogue order."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "ord"))
    return scored(joined, schemes, accepted).where(F.col("score") > KEPT_ABOVE).withColumn("rank", rank)


def village_best(recs: DataFrame) -> DataFrame:
    """Per village and scheme the highest score; ties go to the smallest claim id."""
    best = F.max_by(F.struct("score", "benefit", "priority", "id"), F.struct("score", -F.col("id").cast("long"))).alias("b")
    return recs.groupBy("village_id", "scheme").agg(best).select("village_id", "scheme", "b.score", "b.benefit", "b.priority", F.col("b.id").alias("claim"))


def village_summary(best: DataFrame, villages: DataFrame) -> DataFrame:
    """All villages with the sum of best benefits and a level: high with more than two high, medium with any, else low."""
    agg = best.groupBy("village_id").agg(F.sum("benefit").alias("total_benefit"), F.count_if(F.col("priority") == "high").alias("n_high"), F.count(F.lit(1)).alias("schemes"))
    v = villages.select(F.col("id").alias("village_id")).join(agg.hint("merge"), "village_id", "left")
    n = F.coalesce(F.col("n_high"), F.lit(0))
    return v.select("village_id", F.coalesce("total_benefit", F.lit(0.0)).alias("total_benefit"), F.coalesce("schemes", F.lit(0)).alias("schemes"), F.when(n > 2, "high").when(n > 0, "medium").otherwise("low").alias("level"))


def eligibility_matrix(joined: DataFrame, accepted: str = "approved") -> DataFrame:
    """Per village and scheme: claims, verified and eligible ones, and the benefits of all claims."""
    return scored(joined, CATALOGUE, accepted).groupBy("village_id", "scheme").agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(F.col("status") == "verified").alias("verified"),
        F.count_if(F.col("score") > KEPT_ABOVE).alias("eligible"), F.sum("benefit").alias("benefit"))


def claim_summary(recs: DataFrame) -> DataFrame:
    return recs.groupBy("id").agg(F.count_if(F.col("priority") == "high").alias("high"), F.sum("benefit").alias("benefit"))


def priority_rank(summary: DataFrame, villages: DataFrame) -> DataFrame:
    """Dense rank of villages by total benefit within their state."""
    v = summary.join(villages.select(F.col("id").alias("village_id"), "state_name").hint("merge"), "village_id")
    return v.withColumn("rank", F.dense_rank().over(Window.partitionBy("state_name").orderBy(F.desc("total_benefit")))).select("village_id", "state_name", "total_benefit", "rank")
