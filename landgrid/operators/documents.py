"""Documents to claim records, updates and quality figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .lineage import cut


def extract(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with an array column per kind of entity; a narrow step."""
    return docs.withColumns({k: X.entities(F.col(text), k) for k in X.KINDS})


def claim_records(found: DataFrame) -> DataFrame:
    """The primary record of each document, from its entity columns."""
    about = lambda words: F.get(F.filter("dates", lambda d: d.rlike(words)), 0)
    return found.select(
        "id", F.coalesce(F.get("names", 0), F.lit("Unknown Claimant")).alias("claimant_name"), F.coalesce(F.get("villages", 0), F.lit("Unknown Village")).alias("village_name"),
        X.claim_type(F.col("claim_types")).alias("claim_type"), X.claim_status(F.col("claim_status")).alias("status"),
        F.get("areas", 0).alias("area_claimed"), F.get("coordinates", 0).alias("coordinates"),
        F.coalesce(about("(?i)application|आवेदन"), F.get("dates", 0)).alias("application_date"), about("(?i)approval|अनुमोदन|approved").alias("approval_date"),
        F.get("survey_numbers", 0).alias("survey_number"), "names")


def explode_claimants(records: DataFrame) -> DataFrame:
    """One record per name; documents without names keep their default one."""
    names = F.when(F.size("names") > 0, F.col("names")).otherwise(F.array("claimant_name"))
    return records.select("id", "claim_type", "status", F.posexplode(names).alias("pos", "claimant")).select("id", "claim_type", "status", "claimant", (F.col("pos") == 0).alias("is_primary"))


def claim_updates(found: DataFrame) -> DataFrame:
    """What a document says about its claim: name, area above 0, and confidence by kinds found."""
    area = X.first_number(F.get("areas", 0))
    kinds = sum((F.when(F.size(k) > 0, 1).otherwise(0) for k in X.KINDS), F.lit(0))
    return found.select("id", F.get("names", 0).alias("claimant_name"), F.when(area > 0, area).alias("area"), F.least(F.lit(95), kinds * 20).alias("ai_confidence"))


def claim_text_updates(docs: DataFrame, claim: str) -> DataFrame:
    """All texts of a claim, in document order, joined by blanks, extracted again.

    Texts of one claim meet in one row, as the joined text must.
    """
    joined = docs.groupBy(claim).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").cast("long").alias("k"), F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias("text"))
    found = joined.select(claim, *[X.entities(F.col("text"), k).alias(k) for k in ("names", "areas", "coordinates")])
    place = r"(\d+(?:\.\d+)?)[,\s]+(\d+(?:\.\d+)?)"
    first = F.get("coordinates", 0)
    out = found.select(claim, F.get("names", 0).alias("claimant_name"), X.first_number(F.get("areas", 0)).alias("area"), *[F.when(first.rlike(place), F.regexp_extract(first, place, i)).try_cast("double").alias(n) for i, n in ((1, "latitude"), (2, "longitude"))])
    fields = [F.when(F.col(c).isNotNull(), F.lit(c)) for c in ("claimant_name", "area", "latitude", "longitude")]
    return out.withColumn("fields", F.array_join(F.array_compact(F.array(*fields)), ","))


def entity_counts(found: DataFrame) -> DataFrame:
    return found.select("id", *[F.size(k).alias(k) for k in X.KINDS], F.greatest(F.size("names"), F.lit(1)).alias("records"))


def extraction_quality(found: DataFrame, truth: DataFrame, kinds: Sequence[str] = X.KINDS, by: Sequence[str] = ()) -> DataFrame:
    """Values found, true and both, precision and recall per kind, and per `by`, against `truth` (id, kind, value and `by`).

    `found` has id, `by` and a column of values per kind. A value counts once for each
    document; kinds without any value found, or without truth, have a null precision or
    recall. Documents of either side alone count as missed or as wrongly found.
    """
    keys = ["id", *by, "kind", "value"]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("vs")) for k in kinds])).alias("e")
    got = found.select("id", *by, each).select("id", *by, "e.kind", F.explode("e.vs").alias("value")).distinct().withColumn("got", F.lit(1))
    both = got.hint("merge").join(truth.select(*keys).distinct().withColumn("true", F.lit(1)).hint("merge"), keys, "full")
    hit = F.count_if(F.col("got").isNotNull() & F.col("true").isNotNull())
    counts = both.groupBy(*by, "kind").agg(F.count("got").alias("found"), F.count("true").alias("true"), hit.alias("right"))
    share = lambda n: F.round(F.try_divide("right", n), 6)
    return counts.select("*", share("found").alias("precision"), share("true").alias("recall"))


def quality_within(told: DataFrame, kinds: Sequence[str] = X.KINDS, by: Sequence[str] = ()) -> DataFrame:
    """`extraction_quality` of rows (id, `by`, a column of values per kind and of true ones, `true_<kind>`) that hold found and true values side by side.

    Values are counted inside their row, and only counts are shuffled. Rows that share an id are one document, and made one row
    first; rows without an id are left out.
    """
    columns = [*kinds, *[f"true_{k}" for k in kinds]]
    told = told.select("id", *by, *columns).where("id is not null")
    shared = cut(told.groupBy("id").count().where("count > 1").select("id"))
    if not shared.isEmpty():
        one = told.join(shared.hint("merge"), "id", "left_semi").groupBy("id", *by).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in columns])
        told = told.join(shared.hint("merge"), "id", "left_anti").unionByName(one)
    different = lambda c: F.coalesce(F.size(F.array_distinct(c)), F.lit(0))
    sums = lambda k: (F.sum(different(k)).alias("found"), F.sum(different(f"true_{k}")).alias("true"), F.sum(F.coalesce(F.size(F.array_intersect(k, f"true_{k}")), F.lit(0))).alias("right"))
    counts = told.groupBy(*by).agg(*[c.alias(f"{k} {i}") for k in kinds for i, c in enumerate(sums(k))])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), *[F.col(f"{k} {i}").alias(n) for i, n in enumerate(("found", "true", "right"))]) for k in kinds])).alias("e")
    share = lambda n: F.round(F.try_divide("right", n), 6)
    return counts.select(*by, rows).select(*by, "e.*").where((F.col("found") > 0) | (F.col("true") > 0)).select("*", share("found").alias("precision"), share("true").alias("recall"))


def character_error(a: str, b: str):
    return F.round(F.levenshtein(F.col(a), F.col(b)) / F.greatest(F.length(b), F.lit(1)), 6)
