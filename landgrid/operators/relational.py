"""Listings, filters, joins, aggregates and pages over the claims tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Who may do what.
PERMISSIONS = {
    "update_status": ("admin", "state", "district"),
    "detect_assets": ("admin", "state", "district"),
    "implement": ("admin", "state", "district"),
    "reprocess": ("admin", "state"),
    "view_queue": ("admin", "state"),
    "create_claim": ("admin", "state", "district", "field"),
}


def geo_join(claims: DataFrame, villages: DataFrame, districts: DataFrame) -> DataFrame:
    """Claims with village_name, district_id, district_name and state_id; claims without village stay."""
    v = villages.select(F.col("id").alias("village_id"), F.col("name").alias("village_name"), "district_id")
    d = districts.select(F.col("id").alias("district_id"), F.col("name").alias("district_name"), "state_id")
    return claims.join(v.join(d, "district_id", "left"), "village_id", "left")


def user_scopes(users: DataFrame) -> DataFrame:
    """(user_id, role, state, district, scope): what bounds a user's claims: district, state or all."""
    u = users.select(F.col("id").alias("user_id"), "role", "state", "district")
    narrow = F.when((F.col("role") == "district") & F.col("district").isNotNull(), "district").when((F.col("role") == "state") & F.col("state").isNotNull(), "state").otherwise("all")
    return u.withColumn("scope", narrow)


def scope_totals(joined: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, claims, least_id): number and least id of the claims of role_scope, for users with any.

    Claims are counted once per district, and no claim is multiplied with its users.
    """
    places = cut(joined.groupBy("district_id", "state_id").agg(F.count(F.lit(1)).alias("claims"), F.min("id").alias("least_id")))
    measures = [F.sum("claims").alias("claims"), F.min("least_id").alias("least_id")]
    u = user_scopes(users)
    one = lambda place: u.where(F.col("scope") == place).select("user_id", F.col(place).alias("place")).join(places.groupBy(F.col(f"{place}_id").alias("place")).agg(*measures).hint("shuffle_hash"), "place").drop("place")
    all_ = u.where("scope = 'all'").select("user_id").crossJoin(F.broadcast(places.agg(*measures).where("claims > 0")))  # one row
    return one("district").unionByName(one("state")).unionByName(all_)


def role_scope(joined: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user_id and columns of the claims that bound users may see, user_id of those who see all).

    A district officer sees the own district, a state officer the own state, if set;
    everyone else sees all claims. Those are not multiplied with their users.
    """
    u = user_scopes(users)
    own = joined.drop("user_id")
    by_district = own.join(u.where("scope = 'district'").select("user_id", F.col("district").alias("district_id")), "district_id")
    by_state = own.join(u.where("scope = 'state'").select("user_id", F.col("state").alias("state_id")), "state_id")
    return by_district.unionByName(by_state), u.where("scope = 'all'").select("user_id")


def filter_claims(claims: DataFrame, status: str | None = None, claim_type: str | None = None) -> DataFrame:
    for column, value in (("status", status), ("claim_type", claim_type)):
        if value is not None:
            claims = claims.where(F.col(column) == value)
    return claims


def listing(joined: DataFrame) -> DataFrame:
    """The eight columns of a listing and its village as a struct."""
    return joined.select("id", "claim_id", "claimant_name", "claim_type", "area", "status", "ai_confidence", "created_at", F.struct(F.col("village_id").alias("id"), F.col("village_name").alias("name")).alias("village"))


def newest_first(df: DataFrame, time: str = "created_at") -> list[Column]:
    return [F.col(time).desc_nulls_first(), F.col("id").asc()]


def page(claims: DataFrame, number: int = 1, size: int = 10) -> DataFrame:
    """One page of a listing, newest first, ties by id; a deep page costs as much as a filter.

    Rows before the page are counted, not sorted: counts of narrower and narrower ranges of
    the time, then of the id, lead to a place at most NEAR rows before it.
    """
    rows, before = from_position(claims, (number - 1) * size)
    return rows.orderBy(*newest_first(claims)).offset(before).limit(size)


#: A position is found once so few rows lie between it and the place that was reached; ranges are counted in so many cells.
NEAR, CELLS = 1000, 1024


def from_position(df: DataFrame, position: int, time: str = "created_at") -> tuple[DataFrame, int]:
    """(the rows of newest_first from some place on, how many of them lie before `position`): at most NEAR, or all rows of one id."""
    if position <= NEAR:
        return df, position
    age = -_micros(df, time)
    undated, dated = df.where(age.isNull()), df.where(age.isNotNull())
    none, least, most = df.agg(F.count_if(age.isNull()), F.min(age), F.max(age)).first()
    if position < none:
        same, before = _from_id(undated, position)
        return same.unionAll(dated), before
    if least is None:
        return df.where(F.lit(False)), 0
    passed, low, high = none, least, most
    while position - passed > NEAR and low < high:
        width = (high - low) // CELLS + 1
        cell = F.floor((age - low) / width).cast("long")
        at, passed = _enter(dated.where(age.between(low, high)), cell, position, passed, lambda x: x)
        if at is None:
            return df.where(F.lit(False)), 0
        low, high = low + at * width, min(high, low + (at + 1) * width - 1)
    if position - passed <= NEAR:
        return dated.where(age >= low), position - passed
    same, before = _from_id(dated.where(age == low), position - passed)
    return same.unionAll(dated.where(age > low)), before


def _micros(df: DataFrame, time: str) -> Column:
    """Microseconds that order as the times do, for dates and local times too."""
    t = F.col(time)
    if df.schema[time].dataType.typeName() == "timestamp":
        return F.unix_micros(t)
    t = t.cast("timestamp_ntz")
    whole = (F.unix_date(t.cast("date")) * 24 + F.hour(t)) * 60 + F.minute(t)
    return whole.cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def _enter(rows: DataFrame, cell: Column, position: int, passed: int, order) -> tuple:
    """The cell that holds `position`, if `passed` rows lie before all cells; and how many lie before it. None beyond the last one."""
    counts = rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per cell
    for row in sorted(counts, key=lambda r: order(r["cell"])):
        if passed + row["n"] > position:
            return row["cell"], passed
        passed += row["n"]
    return None, passed


def _from_id(rows: DataFrame, position: int) -> tuple[DataFrame, int]:
    """from_position for rows of one time, by id: a letter more of the id in each round."""
    prefix, passed = "", 0
    same = rows
    while position - passed > NEAR:
        same = same.where(F.startswith("id", F.lit(prefix)))
        letter, passed = _enter(same, F.substring("id", len(prefix) + 1, 1), position, passed, lambda x: x.encode())
        if letter is None:
            return rows.where(F.lit(False)), 0
        prefix += letter
        if not letter:  # all rows of one id
            break
    return rows.where(F.col("id") >= prefix), position - passed


def page_totals(claims: DataFrame, size: int = 10) -> DataFrame:
    return claims.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def page_label(claims: DataFrame, number: int, size: int = 10) -> DataFrame:
    total = page_totals(claims, size)
    return total.select(F.concat(F.lit((number - 1) * size + 1).cast("string"), F.lit("-"), F.least(F.lit(number * size), F.col("total")).cast("string"), F.lit(" of "), F.col("total").cast("string")).alias("label"))


def dashboard(scoped: DataFrame, by: list[str], accepting: str = "verified") -> DataFrame:
    """total_claims, verified_claims and active_villages per group, in one pass.

    Active villages are the distinct villages of verified claims; those without a
    village count as one more.
    """
    done = F.col("status") == accepting
    return scoped.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if(done).alias("verified_claims"),
        (F.count_distinct(F.when(done, F.col("village_id"))) + F.coalesce(F.max(F.when(done & F.col("village_id").isNull(), 1)), F.lit(0))).alias("active_villages"),
    )


def scoped_dashboard(joined: DataFrame, users: DataFrame, accepting: str = "verified") -> DataFrame:
    """dashboard() per user: aggregated once per district, state and overall, then joined to users."""
    district = dashboard(joined.where("district_id is not null"), ["district_id"], accepting)
    state = dashboard(joined.where("state_id is not null"), ["state_id"], accepting)
    everything = dashboard(joined, [], accepting)
    u = users.select(F.col("id").alias("user_id"), "role", F.col("state").alias("own_state"), F.col("district").alias("own_district"))
    own_d, own_s = (F.col("role") == "district") & F.col("own_district").isNotNull(), (F.col("role") == "state") & F.col("own_state").isNotNull()
    measures = ["total_claims", "verified_claims", "active_villages"]
    zero = [F.coalesce(F.col(m), F.lit(0).cast("long")).alias(m) for m in measures]
    a = u.where(own_d).join(district, F.col("own_district") == F.col("district_id"), "left").select("user_id", *zero)
    b = u.where(own_s & ~own_d).join(state, F.col("own_state") == F.col("state_id"), "left").select("user_id", *zero)
    c = u.where(~F.coalesce(own_d, F.lit(False)) & ~F.coalesce(own_s, F.lit(False))).crossJoin(F.broadcast(everything)).select("user_id", *zero)  # one row
    return a.unionByName(b).unionByName(c)


def processing_status(papers: DataFrame, assets: DataFrame) -> DataFrame:
    """Queue sizes of text recognition, entity extraction and asset review, in one row."""
    p = papers.agg(F.count_if(F.col("ocr_text").isNull()).alias("ocr_queue"), F.count_if(F.col("ocr_text").isNotNull() & ~F.col("has_entities")).alias("ner_queue"), F.count_if("processed").alias("total_processed"))
    a = assets.agg(F.count_if(~F.col("verified")).alias("asset_queue"))
    return p.crossJoin(a).withColumn("pending_review", F.col("ocr_queue") + F.col("ner_queue") + F.col("asset_queue"))  # one row each


def percent(done: Column, queued: Column) -> Column:
    """Share done, in percent, 100 at most; 0 with nothing to do."""
    return F.least(F.lit(100.0), F.round(done / F.greatest(F.lit(1), done + queued) * 100))


def attribute_search(villages: DataFrame, districts: DataFrame, claims: DataFrame, text: str, k: int = 10) -> DataFrame:
    """Villages by own or district's name, then claims by claimant or id, that contain the text in any case."""
    wanted = F.lit(text.lower())
    v = villages.join(districts.select(F.col("id").alias("district_id"), F.col("name").alias("district_name")), "district_id", "left")
    v = v.where(F.contains(F.lower("name"), wanted) | F.contains(F.lower(F.coalesce("district_name", F.lit(""))), wanted)).select(F.lit(0).alias("ord"), F.lit("village").alias("kind"), "id", F.col("name").alias("label"))
    c = claims.where(F.contains(F.lower("claimant_name"), wanted) | F.contains(F.lower("claim_id"), wanted)).select(F.lit(1).alias("ord"), F.lit("claim").alias("kind"), "id", F.col("claimant_name").alias("label"))
    return v.unionByName(c).orderBy("ord", "label", "id").limit(k).drop("ord")


def foreign_key_violations(tables: dict[str, DataFrame], keys: list[tuple[str, str, str]]) -> DataFrame:
    """(source, fk, target, id): rows whose reference, if set, leads nowhere. keys: (table, column, target)."""
    out = None
    for table, column, target in keys:
        left = tables[table].where(F.col(column).isNotNull()).select(F.lit(table).alias("source"), F.lit(column).alias("fk"), F.lit(target).alias("target"), F.col("id").cast("string").alias("id"), F.col(column).alias("_k"))
        bad = left.join(tables[target].select(F.col("id").alias("_k")), "_k", "left_anti").drop("_k")
        out = bad if out is None else out.unionByName(bad)
    return out


def permission_filter(requests: DataFrame, users: DataFrame) -> DataFrame:
    """`requests` (user_id, permission, ...) with allowed: whether the user's role may do it; unknown users may not."""
    roles = F.map_from_arrays(F.array(*[F.lit(a) for a in PERMISSIONS]), F.array(*[F.array(*[F.lit(r) for r in rs]) for rs in PERMISSIONS.values()]))
    u = users.select(F.col("id").alias("user_id"), "role")
    return requests.join(u, "user_id", "left").withColumn("allowed", F.coalesce(F.array_contains(F.try_element_at(roles, F.col("permission")), F.col("role")), F.lit(False)))


def progress_rollup(joined: DataFrame, accepting: str = "verified") -> DataFrame:
    """Claims and verified claims per village, district, state and overall; level 0 is a village, 7 overall."""
    return joined.rollup("state_id", "district_id", "village_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("status") == accepting).alias("verified"), F.grouping_id().cast("int").alias("level"))


def feature_union(villages: DataFrame, claims: DataFrame, assets: DataFrame) -> DataFrame:
    """All features with kind, category, layer and point."""
    v = villages.select(F.lit("village").alias("kind"), F.lit("administrative").alias("category"), F.lit("villages").alias("layer"), "id", "latitude", "longitude")
    c = claims.select(F.lit("claim").alias("kind"), F.lit("claims").alias("category"), F.lower("claim_type").alias("layer"), "id", "latitude", "longitude")
    a = assets.select(F.lit("asset").alias("kind"), F.lit("assets").alias("category"), F.col("asset_type").alias("layer"), "id", "latitude", "longitude")
    return v.unionByName(c).unionByName(a)


def layer_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("category", "layer").agg(F.count(F.lit(1)).alias("features"))


def merge_pages(pages: DataFrame, low: float = 60.0) -> DataFrame:
    """Per document the text of its pages in order, blank lines between, mean confidence, and the
    language of the last page whose confidence is above `low` (else eng) and the last quality."""
    one = pages.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("page", "text"))).alias("all"),
        F.avg("confidence").alias("confidence"),
        F.coalesce(F.max_by(F.when(F.col("confidence") > low, F.col("language")), F.when(F.col("confidence") > low, F.col("page"))), F.lit("eng")).alias("language"),
        F.max_by("quality", "page").alias("quality"), F.count(F.lit(1)).alias("pages"),
    )
    return one.select("document_id", F.trim(F.array_join("all.text", "\n\n")).alias("text"), F.round("confidence", 6).alias("confidence"), "language", "quality", "pages")


def export_rows(joined: DataFrame, cap: int = 10_000) -> DataFrame:
    """The columns of an export under their headings; the newest `cap` rows, as the export promises."""
    newest = joined.orderBy(*newest_first(joined)).limit(cap)
    return newest.select(F.col("claim_id").alias("Claim ID"), F.col("claimant_name").alias("Claimant Name"), F.col("village_name").alias("Village"), F.col("claim_type").alias("Type"), F.col("area").alias("Area"), F.col("status").alias("Status"), F.col("ai_confidence").alias("AI Confidence"))


def tribal_share(villages: DataFrame) -> Column:
    return F.round(F.try_divide(F.col("tribal_population") * 100.0, F.col("population")), 4)
