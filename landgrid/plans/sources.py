"""Queries over readers, sinks and table maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..operators.lineage import shared_folder
from ..sources import sinks, tables
from .relational import GEO, NEWEST, geo
from .rules import ALL, recs
from .text import L, entities_cte, letters
from .views import load, with_views


def folder(spark, name):
    """A new folder on shared storage."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _manifests(s, d):
    q = load(s, d, "queue")
    b = q.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("tiebreak", "document_id", F.concat(F.lit("c"), "document_id").alias("claim")))).alias("x"))
    claims = F.when(F.col("batch_id").cast("long") % 10 == 3, F.slice("x.claim", 1, F.size("x") - 1)).otherwise(F.col("x.claim"))
    return b.select("batch_id", F.col("x.document_id").alias("files"), claims.alias("claims"))


def _pairs(s, d):
    rows, refused = tables.pair_manifest(_manifests(s, d))
    return rows.select("batch_id", "item", "file", "claim").unionByName(refused.select("batch_id", F.lit(-1).alias("item"), F.col("reason").alias("file"), F.lit("").alias("claim")))


MANIFEST = with_views("queue").rstrip() + ", n AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS total, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY tiebreak, document_id) - 1 AS INT) AS place FROM queue) SELECT batch_id, place AS item, document_id AS file, 'c' || document_id AS claim FROM n WHERE CAST(batch_id AS BIGINT) % 10 <> 3 AND total <= 50 UNION ALL SELECT batch_id, -1, CASE WHEN total > 50 THEN 'too many files' ELSE 'lengths differ' END, '' FROM (SELECT DISTINCT batch_id, total FROM n) WHERE CAST(batch_id AS BIGINT) % 10 = 3 OR total > 50"


def _csv(s, d):
    path = folder(s, "csv")
    sinks.write_csv(R.export_rows(geo(s, d)), path)
    return s.read.text(path).where(~F.col("value").startswith('"Claim ID"')).withColumnRenamed("value", "line")


def _json(s, d):
    path = folder(s, "json")
    rows = R.export_rows(geo(s, d)).select(F.col("Claim ID").alias("claim_id"), F.col("Status").alias("status"), F.struct(F.col("Village").alias("name")).alias("village"))
    sinks.write_json(rows, path)
    return s.read.schema(rows.schema).json(path).select("claim_id", "status", F.col("village.name").alias("village"))


def _geojson(s, d):
    """Features of a document of many parts that was written and read back."""
    g = geo(s, d).where("latitude is not null and longitude is not null")
    path, c = folder(s, "geojson"), F.col
    features = sinks.geojson_feature(c("latitude"), c("longitude"), id=c("id"), claim=c("claim_id"), name=c("claimant_name"), type=c("claim_type"), status=c("status"), village=c("village_name"))
    sinks.write_geojson(g.select("id", features.alias("feature")), path)
    at = lambda p: F.get_json_object("feature", p)
    return sinks.read_geojson(s, path).select(at("$.properties.id").alias("id"), at("$.type").alias("kind"), at("$.geometry.coordinates[0]").cast("double").alias("lng"), at("$.geometry.coordinates[1]").cast("double").alias("lat"), at("$.properties.claim").alias("claim"), at("$.properties.status").alias("status"))


def _audit(s, d):
    path = folder(s, "audit")
    a = load(s, d, "audit").select("id", "entity_type", "action", "ts")
    sinks.append_audit(a.where("id % 2 = 0"), path)
    sinks.append_audit(a.where("id % 2 = 1"), path)
    return s.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"), "action").agg(F.count(F.lit(1)).alias("entries"))


def _typed(s, d):
    """Claims with their villages, written and read with the declared schemas; tables without a source are empty."""
    base = folder(s, "typed")
    for name, schema in tables.SCHEMAS.items():
        rows = load(s, d, name) if name in ("states", "districts", "villages", "users", "claims", "assets") else s.createDataFrame([], schema)
        rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(f"{base}/{name}.parquet")
    read = tables.load(s, base)
    villages = read["villages"].select(F.col("id").alias("village_id"), F.col("name").alias("village"), "population")
    return read["claims"].join(villages.hint("merge"), "village_id", "left").select("id", "village", "population", "status", *[F.col(c).cast("double").alias(c) for c in ("area", "ai_confidence", "latitude")])


RAW = {"name": "CASE WHEN CAST(id AS BIGINT) % 19 = 1 THEN 'x' ELSE claimant_name END", "kind": "CASE WHEN CAST(id AS BIGINT) % 23 = 2 THEN 'ABC' ELSE claim_type END", "area": "CASE WHEN CAST(id AS BIGINT) % 29 = 3 THEN 'two' WHEN CAST(id AS BIGINT) % 29 = 4 THEN '' ELSE CAST(CAST(id AS BIGINT) % 50 AS STRING) END", "coordinates": "CASE WHEN CAST(id AS BIGINT) % 31 = 3 THEN '{bad' WHEN CAST(id AS BIGINT) % 31 = 4 THEN '' ELSE '{\"lat\": 1}' END"}


def _errors(s, d):
    r = load(s, d, "claims").select("id", "village_id", *[F.expr(e).alias(n) for n, e in RAW.items()])
    return r.select("id", F.array_join(tables.claim_errors(*[F.col(c) for c in ("name", "village_id", "kind", "area", "coordinates")]), ",").alias("errors"))


AT = "CAST('2024-05-01 12:00:00' AS TIMESTAMP)"
BEFORE = "CAST('2020-01-01 00:00:00' AS TIMESTAMP)"


def _users(s, d):
    u = load(s, d, "users").select("id", "email", "role", F.expr(BEFORE).alias("updated_at"))
    new = u.where("CAST(id AS BIGINT) % 4 = 0").select("id", F.concat("email", F.lit(".new")).alias("email"), F.lit(None).cast("string").alias("role"))
    more = u.select(F.concat(F.lit("n"), "id").alias("id"), "email", F.lit("public").alias("role")).where("email like '%1@%'")
    return tables.upsert(u, new.unionByName(more), stamp="updated_at", at=F.expr(AT)).withColumn("updated_at", F.col("updated_at").cast("string"))


USERS = with_views("users") + f"SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN email || '.new' ELSE email END AS email, role, CAST(CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN {AT} ELSE {BEFORE} END AS STRING) AS updated_at FROM users UNION ALL SELECT 'n' || id, email, 'public', CAST({AT} AS STRING) FROM users WHERE email LIKE '%1@%'"


def _patches(s, d):
    p = load(s, d, "audit").where("entity_type = 'claim'").select(F.col("entity_id").alias("id"), F.struct("ts", "id").alias("ts"), F.when(F.col("action") == "click", F.lit("patched")).alias("status"), F.when(F.col("action") == "view", F.col("value")).alias("area"))
    claims = load(s, d, "claims").select("id", "status", "area", F.col("created_at").cast("timestamp_ntz").alias("updated_at"))
    return tables.patch(claims, p, stamp="updated_at", at="ts").withColumn("updated_at", F.unix_micros(F.col("updated_at").cast("timestamp")))


PATCHED = with_views("claims", "audit").rstrip() + ", p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, id DESC) AS n FROM audit WHERE entity_type = 'claim') WHERE n = 1) SELECT c.id, CASE WHEN action = 'click' THEN 'patched' ELSE status END AS status, CASE WHEN action = 'view' THEN value ELSE area END AS area, epoch_us(CAST(coalesce(p.ts, created_at) AS TIMESTAMP)) AS updated_at FROM claims c LEFT JOIN p ON c.id = p.entity_id"
CHANGE = "CASE action WHEN 'purchase' THEN 'verified' WHEN 'error' THEN 'rejected' ELSE 'under_review' END"


HELD = {"verified_date": "CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN CAST('2020-01-01 00:00:00' AS TIMESTAMP) END", "verified_by": "CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN concat('u', id) END", "notes": "CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'old note' END"}  # what claims hold before the changes


def _status(s, d):
    c = load(s, d, "audit").where("entity_type = 'claim'").select(F.col("entity_id").alias("id"), F.expr(CHANGE).alias("status"), "user_id", F.when(F.col("action") == "view", "").otherwise(F.col("action")).alias("notes"), "ts")
    return tables.apply_status(load(s, d, "claims").select("id", "status", *[F.expr(e).alias(n) for n, e in HELD.items()]), c).withColumn("verified_date", F.col("verified_date").cast("string").substr(1, 10))


STATUS = with_views("claims", "audit").rstrip() + f", p AS (SELECT *, {CHANGE} AS s FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, {CHANGE} DESC) AS n FROM audit WHERE entity_type = 'claim') WHERE n = 1) SELECT c.id, coalesce(s, status) AS status, substr(CAST(CASE WHEN s = 'verified' THEN ts ELSE old_date END AS STRING), 1, 10) AS verified_date, CASE WHEN s = 'verified' THEN p.user_id ELSE old_by END AS verified_by, CASE WHEN action <> 'view' THEN action ELSE old_notes END AS notes FROM (SELECT id, status, {HELD['verified_date']} AS old_date, {HELD['verified_by']} AS old_by, {HELD['notes']} AS old_notes FROM claims) c LEFT JOIN p ON c.id = p.entity_id"


def _implemented(s, d):
    a = load(s, d, "audit").where("action = 'purchase'").groupBy(F.col("entity_id").alias("id")).agg(F.max_by(F.struct("user_id", "ts"), F.struct("ts", "id")).alias("m"))
    return recs(s, d).where("rank = 1").join(a.hint("merge"), "id", "left").select("id", "scheme", F.col("m.user_id").alias("implemented_by"))


def _of_states(s, d):
    g = geo(s, d).join(load(s, d, "states").select(F.col("id").alias("state_id"), F.col("name").alias("state")), "state_id", "left")
    return g.select("id", "state")


def _ids(s, d):
    return tables.claim_ids(_of_states(s, d), F.col("state")).select("id", "new_id")


def _ids_again(s, d):
    """Claims with even ids first, then the others, whose numbers go on from those."""
    claims = _of_states(s, d)
    even, odd = (claims.where(F.col("id").cast("long") % 2 == k) for k in (0, 1))
    first = tables.claim_ids(even, F.col("state")).select("id", "new_id")
    return first.unionByName(tables.claim_ids(odd, F.col("state"), given=first).select("id", "new_id"))


def _ids_beyond(s, d):
    claims = _of_states(s, d)
    given = claims.select(F.concat(F.lit("FRA-"), F.coalesce(F.upper(F.substring("state", 1, 2)), F.lit("XX")), F.lit("-999900")).alias("new_id")).distinct()
    return tables.claim_ids(claims, F.col("state"), given=given).select("id", "new_id")


def _ids_sql(given=0, order="CAST(id AS BIGINT)"):
    number = f"CAST({given} + row_number() OVER (PARTITION BY code ORDER BY {order}) AS STRING)"
    states = GEO.rstrip().replace("WITH ", with_views("states").rstrip() + ", ", 1)
    return states + f", c AS (SELECT g.id, coalesce(upper(substr(s.name, 1, 2)), 'XX') AS code FROM g LEFT JOIN states s ON g.state_id = s.id), n AS (SELECT id, code, {number} AS n FROM c) SELECT id, concat('FRA-', code, '-', CASE WHEN length(n) < 6 THEN lpad(n, 6, '0') ELSE n END) AS new_id FROM n"


def _saved(s, d):
    """All recommendations, then new ones of every third claim."""
    path, all_ = folder(s, "recs"), recs(s, d).select("id", "scheme", "score", "rank")
    sinks.save_recommendations(all_.unionByName(all_).drop("rank"), path)
    sinks.save_recommendations(all_.where("rank = 1 and CAST(id AS BIGINT) % 3 = 0").select("id", "scheme", (F.col("score") + 1).alias("score")), path)
    return sinks.read_recommendations(s, path).select("id", "scheme", "score")


#: Entities of a letter as JSON; some are cut short. Criteria of no fixed shape.
CRITERIA = "CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN concat('{\"maxArea\": ', CAST(CAST(area AS DECIMAL(8, 2)) AS STRING), '}') WHEN 1 THEN concat('{\"types\": [\"', claim_type, '\", \"any\"]}') WHEN 2 THEN '{no json' ELSE '{}' END"


def _entities(s, d):
    found = letters(s, d).select("id", *[X.entities(F.col("text"), k).alias(k) for k in X.KINDS])
    text = F.to_json(F.struct(*X.KINDS))
    kept = found.select("id", F.when(F.col("id").cast("long") % 13 == 5, F.substring(text, 2, 1 << 30)).otherwise(text).alias("j"))
    e = kept.select("id", tables.decode_entities(F.col("j")).alias("e"))
    return e.select("id", F.col("e._corrupt").isNotNull().alias("corrupt"), *[F.array_join(f"e.{k}", "|").alias(k) for k in X.KINDS])


def _criteria(s, d):
    v = load(s, d, "claims").select("id", tables.decode_criteria(F.expr(CRITERIA)).alias("v"))
    return v.select("id", F.try_variant_get("v", "$.maxArea", "double").alias("max_area"), F.try_variant_get("v", "$.types[0]", "string").alias("first_type"), F.col("v").isNotNull().alias("valid"))


#: GeoJSON points of claims; some are no JSON.
GEOMETRY = "CASE WHEN latitude IS NOT NULL THEN concat(CASE WHEN CAST(id AS BIGINT) % 13 = 5 THEN '' ELSE '{' END, '\"type\": \"Point\", \"coordinates\": [', CAST(CAST(longitude AS DECIMAL(10, 5)) AS STRING), ', ', CAST(CAST(latitude AS DECIMAL(10, 5)) AS STRING), ']}') END"

PAIRS = {
    "load_typed": (_typed, with_views("claims", "villages") + "SELECT c.id, v.name AS village, population, status, CAST(CAST(area AS DECIMAL(8, 2)) AS DOUBLE) AS area, ai_confidence, c.latitude FROM claims c LEFT JOIN villages v ON c.village_id = v.id"),
    "landing_validation": (lambda s, d: load(s, d, "papers").select("id", F.coalesce(tables.landing_reason(F.col("file_type"), F.col("file_size") * 500), F.lit("accepted")).alias("outcome")), with_views("papers") + "SELECT id, CASE WHEN file_type NOT IN ('application/pdf', 'image/jpeg', 'image/png', 'image/tiff') THEN 'type' WHEN file_size * 500 > 10485760 THEN 'size' ELSE 'accepted' END AS outcome FROM papers"),
    "manifest_pairing": (_pairs, MANIFEST),
    "export_claims_csv": (_csv, GEO + f"SELECT concat('\"', coalesce(CAST(claim_id AS STRING), ''), '\",\"', coalesce(CAST(claimant_name AS STRING), ''), '\",\"', coalesce(CAST(village_name AS STRING), ''), '\",\"', coalesce(CAST(claim_type AS STRING), ''), '\",\"', coalesce(CAST(area AS STRING), ''), '\",\"', coalesce(CAST(status AS STRING), ''), '\",\"', coalesce(CAST(ai_confidence AS STRING), ''), '\"') AS line FROM g {NEWEST} LIMIT 10000"),
    "export_claims_json": (_json, GEO + f"SELECT claim_id, status, village_name AS village FROM g {NEWEST} LIMIT 10000"),
    "export_geojson": (_geojson, GEO + "SELECT id, 'Feature' AS kind, longitude AS lng, latitude AS lat, claim_id AS claim, status FROM g WHERE latitude IS NOT NULL AND longitude IS NOT NULL"),
    "append_audit": (_audit, with_views("audit") + "SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, action, count(*) AS entries FROM audit GROUP BY ALL"),
    "decode_json_columns": (lambda s, d: load(s, d, "audit").select("id", F.from_json("new_values", "k int").alias("j"), F.try_variant_get(F.try_parse_json("new_values"), "$.k", "double").alias("v")).select("id", F.col("j.k").alias("k"), "v"), with_views("audit") + "SELECT id, CAST(json_extract(new_values, '$.k') AS INT) AS k, CAST(json_extract(new_values, '$.k') AS DOUBLE) AS v FROM audit"),
    "decode_geometry": (lambda s, d: load(s, d, "claims").select("id", F.from_json(F.expr(GEOMETRY), "type string, coordinates array<double>").alias("g")).select("id", F.col("g.type").alias("kind"), F.get("g.coordinates", 0).alias("lng"), F.get("g.coordinates", 1).alias("lat")), with_views("claims").rstrip() + f", j AS (SELECT id, CASE WHEN json_valid({GEOMETRY}) THEN {GEOMETRY} END AS g FROM claims) SELECT id, json_extract_string(g, '$.type') AS kind, CAST(json_extract(g, '$.coordinates[0]') AS DOUBLE) AS lng, CAST(json_extract(g, '$.coordinates[1]') AS DOUBLE) AS lat FROM j"),
    "claim_validation": (_errors, with_views("claims").rstrip() + ", r AS (SELECT id, village_id, " + ", ".join(f"{e} AS {n}" for n, e in RAW.items()) + " FROM claims) SELECT id, concat_ws(',', CASE WHEN length(name) < 2 THEN 'name' END, CASE WHEN village_id IS NULL THEN 'village' END, CASE WHEN kind NOT IN ('IFR', 'CFR', 'CR') THEN 'type' END, CASE WHEN area <> '' AND TRY_CAST(area AS DOUBLE) IS NULL THEN 'area' END, CASE WHEN coordinates <> '' AND NOT json_valid(coordinates) THEN 'coordinates' END) AS errors FROM r"),
    "upsert_users": (_users, USERS),
    "apply_patches": (_patches, PATCHED),
    "apply_status_changes": (_status, STATUS),
    "mark_implemented": (_implemented, ALL.replace("WITH ", with_views("audit").rstrip() + ", ", 1) + " SELECT r.id, scheme, m AS implemented_by FROM recs r LEFT JOIN (SELECT entity_id, max_by(user_id, (ts, id)) AS m FROM audit WHERE action = 'purchase' GROUP BY 1) a ON a.entity_id = r.id WHERE rank = 1"),
    "assign_claim_ids": (_ids, _ids_sql()),
    "assign_claim_ids_beyond": (_ids_beyond, _ids_sql(999_900)),
    "assign_claim_ids_again": (_ids_again, _ids_sql(order="CAST(id AS BIGINT) % 2, CAST(id AS BIGINT)")),
    "save_recommendations": (_saved, ALL + " SELECT id, scheme, score FROM recs WHERE CAST(id AS BIGINT) % 3 <> 0 UNION ALL SELECT id, scheme, score + 1 FROM recs WHERE CAST(id AS BIGINT) % 3 = 0 AND rank = 1"),
    "decode_entities": (_entities, L + entities_cte(X.KINDS) + " SELECT id, CAST(id AS BIGINT) % 13 = 5 AS corrupt, " + ", ".join(f"CASE WHEN CAST(id AS BIGINT) % 13 <> 5 THEN array_to_string({k}, '|') END AS {k}" for k in X.KINDS) + " FROM ent"),
    "decode_criteria": (_criteria, with_views("claims") + f"SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN CAST(CAST(area AS DECIMAL(8, 2)) AS DOUBLE) END AS max_area, CASE WHEN CAST(id AS BIGINT) % 4 = 1 THEN claim_type END AS first_type, coalesce(json_valid({CRITERIA}), false) AS valid FROM claims"),
}
