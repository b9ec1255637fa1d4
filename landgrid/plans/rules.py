"""Queries over the eligibility rules. The SQL states the points anew, scheme by scheme."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rules as R
from .views import load, with_views

ACCEPTED = "verified"
HH = "CAST(ceil((CASE WHEN coalesce(population, 0) = 0 THEN 100 ELSE population END) / 5e0) AS DOUBLE)"
POINTS = {
    "pm-kisan": ("(CASE WHEN claim_type = 'IFR' AND area <= 10 THEN 50 ELSE 0 END) + (CASE WHEN status = 'verified' THEN 25 ELSE 0 END) + (CASE WHEN state_name IN ('MP', 'Odisha', 'Telangana', 'Tripura') THEN 15 ELSE 0 END)", "CASE WHEN claim_type = 'IFR' AND area <= 10 THEN 6000e0 ELSE 0e0 END"),
    "jal-jeevan-mission": ("(CASE WHEN type = 'rural' THEN 40 ELSE 0 END) + (CASE WHEN NOT coalesce(water_access, false) OR coalesce(water_quality = 'poor', false) THEN 40 ELSE 0 END) + (CASE WHEN claim_type = 'IFR' THEN 20 ELSE 0 END)", f"{HH} * 35000"),
    "mgnrega": ("(CASE WHEN type = 'rural' THEN 30 ELSE 0 END) + (CASE WHEN claim_type IN ('IFR', 'CFR', 'CR') THEN 40 ELSE 0 END) + (CASE WHEN status = 'verified' AND area > 0.5 THEN 30 ELSE 0 END)", f"{HH} * 25000"),
    "dajgua": ("0", "0e0"),
    "pmjdy": ("60 + (CASE WHEN claim_type IS NOT NULL THEN 20 ELSE 0 END)", "210000e0"),
    "pmfby": ("(CASE WHEN claim_type = 'IFR' AND area > 0 THEN 50 ELSE 0 END) + (CASE WHEN status = 'verified' THEN 30 ELSE 0 END)", "CASE WHEN claim_type = 'IFR' AND area > 0 THEN area * 25000 ELSE 0e0 END"),
    "pm-awas-gramin": ("(CASE WHEN type = 'rural' THEN 45 ELSE 0 END) + (CASE WHEN status = 'verified' THEN 35 ELSE 0 END) + (CASE WHEN elevation > 1000 OR tribal_population > 30 THEN 20 ELSE 0 END)", "CASE WHEN elevation > 1000 OR tribal_population > 30 THEN 130000e0 ELSE 120000e0 END"),
    "swachh-bharat-mission": ("(CASE WHEN type = 'rural' THEN 50 ELSE 0 END) + (CASE WHEN forest_area > 50 THEN 30 ELSE 0 END)", "CASE WHEN type = 'rural' THEN 12000e0 ELSE 0e0 END"),
}
KEYS = {"score_pm_kisan": "pm-kisan", "score_jjm": "jal-jeevan-mission", "score_mgnrega": "mgnrega", "score_dajgua": "dajgua", "score_pmjdy": "pmjdy", "score_pmfby": "pmfby", "score_pmayg": "pm-awas-gramin", "score_sbm": "swachh-bharat-mission"}
JOINED = with_views("claims", "villages").rstrip() + ", j AS (SELECT c.id, c.village_id, status, claim_type, area, state_name, type, water_access, water_quality, population, tribal_population, elevation, forest_area FROM claims c JOIN villages v ON c.village_id = v.id)"
ALL = JOINED + ", a AS (" + " UNION ALL ".join(f"SELECT id, village_id, status, '{s}' AS scheme, {i} AS ord, least(100, {POINTS[s][0]}) AS score, {POINTS[s][1]} AS benefit FROM j" for i, s in enumerate(list(POINTS)[:4])) + "), x AS (SELECT *, CASE WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS priority FROM a), recs AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS rank FROM x WHERE score > 50)"
BEST = ALL + ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY village_id, scheme ORDER BY score DESC, CAST(id AS BIGINT)) AS n FROM recs) WHERE n = 1)"
SUMMARY = BEST + ", summ AS (SELECT v.id AS village_id, coalesce(sum(benefit), 0e0) AS total_benefit, count(benefit) AS schemes, CASE WHEN count(*) FILTER (priority = 'high') > 2 THEN 'high' WHEN count(*) FILTER (priority = 'high') > 0 THEN 'medium' ELSE 'low' END AS level FROM villages v LEFT JOIN best b ON b.village_id = v.id GROUP BY v.id)"


def joined(s, d):
    return R.with_village(load(s, d, "claims"), load(s, d, "villages"))[0]


def recs(s, d):
    return R.recommendations(joined(s, d), ACCEPTED)


def summary(s, d):
    return R.village_summary(R.village_best(recs(s, d)), load(s, d, "villages"))


def _one(scheme):
    chosen = next(x for x in R.SCHEMES if x.id == scheme)
    return lambda s, d: joined(s, d).select("id", R.score(chosen, ACCEPTED).alias("r")).select("id", "r.score", F.round("r.benefit", 4).alias("benefit"), "r.rationale", F.array_join("r.requirements", "; ").alias("requirements"))


#: Reasons in the order of the points, and requirements.
TOLD = {
    "pm-kisan": (("small farmer with individual rights", "accepted claim shows ownership", "target state"), "identity card; bank account; land documents; cultivation certificate"),
    "jal-jeevan-mission": (("rural household", "poor access to water", "holder of individual rights"), "household survey; water committee; community contribution; quality test"),
    "mgnrega": (("rural area", "holder of forest rights", "land fit for works"), "job card; bank account; application for work; social audit"),
    "dajgua": ((), ""),
    "pmjdy": (("open to all adults", "transfers need an account"), "identity card; proof of address; photograph"),
    "pmfby": (("cultivator", "accepted claim allows cover"), "cultivation rights; bank account; crop details; premium"),
    "pm-awas-gramin": (("rural family", "accepted claim", "hill or tribal area"), "survey entry; identity card; bank account; no solid house"),
    "swachh-bharat-mission": (("rural household", "forest community"), "household survey; no toilet yet; own contribution; check of the building"),
}


def _told_sql(scheme):
    points, (reasons, needs) = POINTS[scheme][0], TOLD[scheme]
    held = ["true"] * points.startswith("60 + ") + re.findall(r"CASE WHEN (.*?) THEN \d+ ELSE 0 END", points)
    told = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, r in zip(held, reasons, strict=True))
    return f"{f'concat_ws({chr(39)}; {chr(39)}, {told})' if told else chr(39) * 2} AS rationale, '{needs}' AS requirements"


REC_COLUMNS = ("id", "scheme", "score", "benefit", "priority", "rank")
PAIRS = {key: (_one(scheme), JOINED + f" SELECT id, least(100, {POINTS[scheme][0]}) AS score, round({POINTS[scheme][1]}, 4) AS benefit, {_told_sql(scheme)} FROM j") for key, scheme in KEYS.items()}
PAIRS |= {
    "claim_village_required": (lambda s, d: R.with_village(load(s, d, "claims"), load(s, d, "villages"))[1].select("id", "claim_id"), with_views("claims", "villages") + "SELECT id, claim_id FROM claims WHERE village_id IS NULL OR village_id NOT IN (SELECT id FROM villages)"),
    "claims_x_schemes": (lambda s, d: R.scored(joined(s, d), R.CATALOGUE, ACCEPTED).where("score > 50").select("id", "scheme", "score"), ALL + " SELECT id, scheme, score FROM recs"),
    "priority_bucket": (lambda s, d: R.scored(joined(s, d), R.CATALOGUE, ACCEPTED).groupBy("scheme", "priority").agg(F.count(F.lit(1)).alias("n")), ALL + " SELECT scheme, priority, count(*) AS n FROM x GROUP BY ALL"),
    "claim_recommendations": (lambda s, d: recs(s, d).select(*REC_COLUMNS), ALL + f" SELECT {', '.join(REC_COLUMNS)} FROM recs"),
    "recs_ranked": (lambda s, d: recs(s, d).select("id", "rank", "scheme", "score"), ALL + " SELECT id, rank, scheme, score FROM recs"),
    "village_best_recs": (lambda s, d: R.village_best(recs(s, d)), BEST + " SELECT village_id, scheme, score, benefit, priority, id AS claim FROM best"),
    "best_rec_per_scheme": (lambda s, d: R.village_best(recs(s, d)).withColumn("rank", F.dense_rank().over(Window.partitionBy("village_id").orderBy(F.desc("score")))).select("village_id", "rank", "scheme", "score", "claim"), BEST + " SELECT village_id, CAST(dense_rank() OVER (PARTITION BY village_id ORDER BY score DESC) AS INT) AS rank, scheme, score, id AS claim FROM best"),
    "village_recs_concat": (lambda s, d: recs(s, d).groupBy("village_id").agg(F.count(F.lit(1)).alias("recs"), F.sum("score").alias("points")), ALL + " SELECT village_id, count(*) AS recs, CAST(sum(score) AS BIGINT) AS points FROM recs GROUP BY 1"),
    "village_summary": (summary, SUMMARY + " SELECT * FROM summ"),
    "village_priority_rank": (lambda s, d: R.priority_rank(summary(s, d), load(s, d, "villages")), SUMMARY + " SELECT village_id, state_name, total_benefit, CAST(dense_rank() OVER (PARTITION BY state_name ORDER BY total_benefit DESC) AS INT) AS rank FROM summ JOIN villages ON id = village_id"),
    "eligibility_matrix": (lambda s, d: R.eligibility_matrix(joined(s, d), ACCEPTED), ALL + " SELECT village_id, scheme, count(*) AS claims, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (score > 50) AS eligible, sum(benefit) AS benefit FROM x GROUP BY ALL"),
    "dss_claim_summary": (lambda s, d: R.claim_summary(recs(s, d)), ALL + " SELECT id, count(*) FILTER (priority = 'high') AS high, sum(benefit) AS benefit FROM recs GROUP BY id"),
}
