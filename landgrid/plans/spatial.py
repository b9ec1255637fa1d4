"""Queries over places. SQL compares all pairs, the operators only those in nearby cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import spatial as S
from .relational import FEATURES_SQL, _features
from .views import load, with_views


def hav(a, b, c, d):
    """SQL text of the great-circle distance in km."""
    s = f"(sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2))"
    return f"(12742e0 * atan2(sqrt({s}), sqrt(1 - {s})))"


CV = with_views("claims", "villages")
GOOD = "latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180"
D = f"{hav('c.latitude', 'c.longitude', 'v.latitude', 'v.longitude')} * 1000"
PAIRED = CV.rstrip() + f""", m AS (SELECT c.id, v.id AS village, v.name, v.district_id, {D} AS meters FROM (SELECT * FROM claims WHERE {GOOD}) c, villages v),
con AS (SELECT id, arg_min(village, (name, village)) AS contained FROM m WHERE meters <= 1000 GROUP BY id),
near AS (SELECT id, arg_min(village, (meters, name, village)) AS nearest, arg_min(district_id, (meters, name, village)) AS nearest_district, min(meters) AS nearest_m FROM m GROUP BY id)"""
STATE = "CASE " + " ".join(f"WHEN latitude BETWEEN {s} AND {n} AND longitude BETWEEN {w} AND {e} THEN '{x}'" for x, s, n, w, e in G.STATE_BOXES) + " END"
PLACES = "length(rtrim(split_part(CAST(CAST({} AS DECIMAL(18, 8)) AS STRING), '.', 2), '0'))"
PLACED = f"least({PLACES.format('latitude')}, {PLACES.format('longitude')})"
CHECKED = PAIRED + f""", loc AS (SELECT c.*, contained, nearest, nearest_district, nearest_m, coalesce({GOOD}, false) AS good, CASE WHEN {GOOD} THEN {STATE} END AS state, {PLACED} AS places FROM claims c LEFT JOIN con USING (id) LEFT JOIN near USING (id)),
chk AS (SELECT *, CASE WHEN NOT good THEN 0e0 ELSE 1e0 - (CASE WHEN latitude BETWEEN 6 AND 37 AND longitude BETWEEN 68 AND 98 THEN 0e0 ELSE 3e-1 END) - (CASE WHEN contained IS NULL AND nearest_m > 2000 THEN 2e-1 ELSE 0e0 END) - (CASE WHEN places < 4 THEN 1e-1 ELSE 0e0 END) END AS raw FROM loc)"""
LINKED = CHECKED + f""", l0 AS (SELECT k.*, coalesce(contained, CASE WHEN nearest_m <= 2000 THEN nearest END) AS f, round(raw, 2) * (CASE WHEN contained IS NULL AND nearest_m <= 2000 THEN 8e-1 ELSE 1e0 END) AS c1, {hav('k.latitude', 'k.longitude', 'v.latitude', 'v.longitude')} * 1000 AS gap, v.latitude AS vlat, v.longitude AS vlng FROM chk k LEFT JOIN villages v ON k.village_id = v.id),
lnk AS (SELECT *, coalesce(f <> village_id AND gap <= 4000, false) AS declared FROM l0),
links AS (SELECT id, CASE WHEN declared THEN village_id ELSE f END AS linked_village, nearest_district AS linked_district, state AS linked_state, round(CASE WHEN declared THEN c1 * 9e-1 ELSE c1 END, 6) AS confidence, [111000e0, 11100e0, 1110e0, 111e0, 111e-1, 111e-2, 111e-3][least(places, 6) + 1] AS accuracy, true AS geofenced, declared FROM lnk)"""


def _checked(s, d):
    return S.validated(S.located(load(s, d, "claims"), load(s, d, "villages")))


def _links(s, d):
    return S.linked(_checked(s, d), load(s, d, "villages"))


NEARER = "23 + (latitude - 8) / 200 AS latitude, 80 + (longitude - 70) / 200 AS longitude"


def _dense(df):
    """The same places two hundred times closer together, so that claims lie near other villages than their own."""
    return df.withColumns({"latitude": 23 + (F.col("latitude") - 8) / 200, "longitude": 80 + (F.col("longitude") - 70) / 200})


def _dense_links(s, d):
    claims, villages = _dense(load(s, d, "claims")), _dense(load(s, d, "villages"))
    return S.linked(S.validated(S.located(claims, villages)), villages)


def _dense_sql(rest):
    far = CV.rstrip().replace("claims AS (", "claims0 AS (", 1).replace("villages AS (", "villages0 AS (", 1)
    near = ", ".join(f"{t} AS (SELECT * REPLACE ({NEARER}) FROM {t}0)" for t in ("claims", "villages"))
    return LINKED.replace(CV.rstrip(), f"{far}, {near}", 1) + rest


def _points(s, d):
    return load(s, d, "villages").select(F.col("id").alias("point"), F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lng"))


def _places(s, d):
    return _features(s, d).withColumnsRenamed({"latitude": "f_lat", "longitude": "f_lng"})


def _radius(s, d):
    return S.near(_points(s, d), _places(s, d).drop("category"), 25_000)


def _sorted(s, d):
    return S.near(_points(s, d), _places(s, d).drop("category"), 25_000, ["kind", "id"])


RADIUS = FEATURES_SQL.rstrip() + f", p AS (SELECT id AS point, latitude AS plat, longitude AS plng FROM villages), r AS (SELECT point, kind, layer, id, {hav('plat', 'plng', 'latitude', 'longitude')} AS km FROM p, f WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180) "


def _ring(s, d):
    at = lambda a, b: F.struct((F.col("latitude") + a).alias("lat"), (F.col("longitude") + b).alias("lng"))
    w = F.col("population") / 1e5
    return load(s, d, "villages").where("population is not null").select("id", F.array(at(F.lit(0.0), F.lit(0.0)), at(w, F.lit(0.0)), at(w, w), at(F.lit(0.0), w)).alias("ring"))


RING = with_views("villages").rstrip() + ", r AS (SELECT id, latitude AS a, longitude AS b, latitude + population / 1e5 AS c, longitude + population / 1e5 AS e FROM villages WHERE population IS NOT NULL) "


def _path(s, d):
    order = Window.partitionBy("village_id").orderBy(F.col("id").cast("long"))
    step = G.haversine_km(F.lag("latitude").over(order), F.lag("longitude").over(order), F.col("latitude"), F.col("longitude"))
    good = load(s, d, "claims").where(G.valid_latlng(F.col("latitude"), F.col("longitude")) & F.col("village_id").isNotNull())
    return good.withColumn("step", step).groupBy("village_id").agg(F.round(F.coalesce(F.sum("step"), F.lit(0.0)), 4).alias("km"), F.count(F.lit(1)).alias("points"))


def _utm(s, d):
    v = load(s, d, "villages").select("id", "latitude", "longitude", G.utm_zone(F.col("longitude")).alias("zone"))
    return v.withColumn("u", G.to_utm(F.col("latitude"), F.col("longitude"), F.col("zone")))


def _utm_sql():
    x, y = "eta", "xi"
    for j, a in enumerate(G._ALPHA, 1):
        x += f" + {a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)"
        y += f" + {a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)"
    k = G._K0 * G._A
    return with_views("villages").rstrip() + f""", z AS (SELECT *, CASE WHEN longitude < 78 THEN 43 WHEN longitude < 84 THEN 44 ELSE 45 END AS zone FROM villages),
a AS (SELECT *, sin(radians(latitude)) AS s, radians(longitude - (zone * 6 - 183)) AS lam FROM z),
b AS (SELECT *, sinh(atanh(s) - {G._E!r}::DOUBLE * atanh({G._E!r}::DOUBLE * s)) AS t FROM a),
q AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM b),
u AS (SELECT id, zone, latitude, longitude, 500000 + {k!r}::DOUBLE * ({x}) AS x, {k!r}::DOUBLE * ({y}) AS y FROM q) """


def _proximity(s, d):
    a = load(s, d, "assets").select("asset_type", F.col("latitude").alias("f_lat"), F.col("longitude").alias("f_lng"))
    return S.within(S._as_points(load(s, d, "claims")), a, 5_000).groupBy(F.col("p_id").alias("id"), "asset_type").agg(F.count(F.lit(1)).alias("assets"), F.round(F.min("meters"), 1).alias("nearest_m"))


BUFFER = "round(pi() * 25 * 25, 2)"
PAIRS = {
    "containing_village": (lambda s, d: S.containing_village(load(s, d, "claims"), load(s, d, "villages")), PAIRED + " SELECT id, contained AS village FROM con"),
    "nearest_village": (lambda s, d: S.nearest_village(load(s, d, "claims"), load(s, d, "villages")).select("id", "village", F.round("meters", 1).alias("meters")), PAIRED + " SELECT id, nearest AS village, round(nearest_m, 1) AS meters FROM near"),
    "containing_district": (lambda s, d: S.nearest_village(load(s, d, "claims"), load(s, d, "villages")).select("id", "district_id"), PAIRED + " SELECT id, nearest_district AS district_id FROM near"),
    "containing_state": (lambda s, d: load(s, d, "claims").select("id", G.containing_state(F.col("latitude"), F.col("longitude")).alias("state")), CV + f"SELECT id, {STATE} AS state FROM claims"),
    "linkage_crossref": (lambda s, d: _links(s, d).where("declared").select("id", "linked_village", "confidence"), LINKED + " SELECT id, linked_village, confidence FROM links WHERE declared"),
    "linkage_crossref_dense": (lambda s, d: _dense_links(s, d).where("declared").select("id", "linked_village", "confidence"), _dense_sql(" SELECT id, linked_village, confidence FROM links WHERE declared")),
    "radius_search": (_radius, RADIUS + "SELECT point, kind, layer, id, round(km, 4) AS km FROM r WHERE km <= 25"),
    "radius_sorted": (_sorted, RADIUS + ", k AS (SELECT point, kind, layer, id, round(km, 4) AS km FROM r WHERE km <= 25) SELECT *, CAST(row_number() OVER (PARTITION BY point ORDER BY km, kind, id) AS INT) AS rank FROM k"),
    "buffer_stats": (lambda s, d: S.count_within(_points(s, d), _places(s, d), 25_000).withColumn("area_km2", F.round(F.pi() * 25 * 25, 2)), RADIUS + f"SELECT point, count(*) AS features, {BUFFER} AS area_km2 FROM r WHERE km <= 25 GROUP BY point"),
    "asset_proximity": (_proximity, with_views("claims", "assets") + f"SELECT id, asset_type, count(*) AS assets, round(min(m), 1) AS nearest_m FROM (SELECT c.id, asset_type, {hav('c.latitude', 'c.longitude', 'a.latitude', 'a.longitude')} * 1000 AS m FROM (SELECT * FROM claims WHERE {GOOD}) c JOIN assets a ON abs(c.latitude - a.latitude) < 1e-1) WHERE m <= 5000 GROUP BY ALL"),
    "haversine_km": (lambda s, d: load(s, d, "claims").join(load(s, d, "villages").select(F.col("id").alias("village_id"), F.col("latitude").alias("a"), F.col("longitude").alias("b")), "village_id").where(G.valid_latlng(F.col("latitude"), F.col("longitude"))).select("id", F.round(G.haversine_km(F.col("latitude"), F.col("longitude"), F.col("a"), F.col("b")), 5).alias("km")), CV + f"SELECT c.id, round({hav('c.latitude', 'c.longitude', 'v.latitude', 'v.longitude')}, 5) AS km FROM claims c JOIN villages v ON c.village_id = v.id WHERE c.latitude BETWEEN -90 AND 90"),
    "distance_m": (lambda s, d: load(s, d, "villages").select("id", F.round(G.distance_m(F.col("latitude"), F.col("longitude"), F.lit(23.25), F.lit(77.41)), 2).alias("meters")), with_views("villages") + f"SELECT id, round({hav('latitude', 'longitude', '2325e-2', '7741e-2')} * 1000, 2) AS meters FROM villages"),
    "polygon_area_m2": (lambda s, d: _ring(s, d).select("id", F.round(G.polygon_area_m2(F.col("ring")), 0).alias("m2"), F.round(G.polygon_area_m2(F.col("ring")) / 10000, 2).alias("hectares")), RING + ", q AS (SELECT id, abs(radians(b) * radians(c) - radians(b) * radians(a) + radians(b) * radians(c) - radians(e) * radians(c) + radians(e) * radians(a) - radians(e) * radians(c) + radians(e) * radians(a) - radians(b) * radians(a)) * 6371000e0 * 6371000e0 / 2 AS m2 FROM r) SELECT id, round(m2, 0) AS m2, round(m2 / 10000, 2) AS hectares FROM q"),
    "polygon_perimeter_m": (lambda s, d: _ring(s, d).select("id", F.round(G.polygon_perimeter_m(F.col("ring")), 2).alias("m")), RING + f"SELECT id, round(1000 * ({hav('a', 'b', 'c', 'b')} + {hav('c', 'b', 'c', 'e')} + {hav('c', 'e', 'a', 'e')} + {hav('a', 'e', 'a', 'b')}), 2) AS m FROM r"),
    "path_length": (_path, CV + f"SELECT village_id, round(coalesce(sum({hav('pa', 'pb', 'latitude', 'longitude')}), 0), 4) AS km, count(*) AS points FROM (SELECT *, lag(latitude) OVER w AS pa, lag(longitude) OVER w AS pb FROM claims WHERE {GOOD} AND village_id IS NOT NULL WINDOW w AS (PARTITION BY village_id ORDER BY CAST(id AS BIGINT))) GROUP BY village_id"),
    "valid_latlng": (lambda s, d: load(s, d, "claims").select("id", G.valid_latlng(F.col("latitude"), F.col("longitude")).alias("valid")), CV + f"SELECT id, coalesce({GOOD}, false) AS valid FROM claims"),
    "in_country_bounds": (lambda s, d: load(s, d, "claims").select("id", G.in_country_bounds(F.col("latitude"), F.col("longitude")).alias("inside")), CV + "SELECT id, latitude BETWEEN 6 AND 37 AND longitude BETWEEN 68 AND 98 AS inside FROM claims"),
    "adequate_precision": (lambda s, d: load(s, d, "claims").where("latitude is not null").select("id", G.adequate_precision(F.col("latitude"), F.col("longitude")).alias("adequate")), CV + f"SELECT id, {PLACED} >= 4 AS adequate FROM claims WHERE latitude IS NOT NULL"),
    "spatial_accuracy_m": (lambda s, d: load(s, d, "claims").where("latitude is not null").select("id", G.spatial_accuracy_m(F.col("latitude"), F.col("longitude")).alias("meters")), CV + f"SELECT id, [111000e0, 11100e0, 1110e0, 111e0, 111e-1, 111e-2, 111e-3][least({PLACED}, 6) + 1] AS meters FROM claims WHERE latitude IS NOT NULL"),
    "validate_coordinates": (lambda s, d: _checked(s, d).select("id", "valid", "confidence", F.size("warnings").alias("warnings"), "contained", "state"), CHECKED + " SELECT id, good AND raw >= 7e-1 AS valid, round(raw, 2) AS confidence, CASE WHEN NOT good THEN 1 ELSE CAST(NOT (latitude BETWEEN 6 AND 37 AND longitude BETWEEN 68 AND 98) AS INT) + CAST(contained IS NULL AND nearest_m > 2000 AS INT) + CAST(places < 4 AS INT) END AS warnings, contained, state FROM chk"),
    "link_claims": (lambda s, d: _links(s, d).drop("declared"), LINKED + " SELECT * EXCLUDE (declared) FROM links"),
    "validation_passed": (lambda s, d: _links(s, d).select("id", (F.col("confidence") > 0.7).alias("passed")), LINKED + " SELECT id, confidence > 7e-1 AS passed FROM links"),
    "spatial_report": (lambda s, d: S.spatial_report(load(s, d, "claims"), _links(s, d), load(s, d, "villages")), LINKED + " SELECT k.village_id, count(*) AS claims, count(linked_village) AS linked, count(*) FILTER (confidence > 8e-1) AS high, count(*) FILTER (confidence < 7e-1 AND confidence > 0) AS low, round(sum(confidence) / count(*), 6) AS mean_confidence, coalesce(string_agg(CASE WHEN good AND gap > 2000 THEN concat(claim_id, ' ', CAST(round(gap) AS BIGINT)) END, ';' ORDER BY CASE WHEN good AND gap > 2000 THEN concat(claim_id, ' ', CAST(round(gap) AS BIGINT)) END), '') AS issues FROM lnk k JOIN links USING (id) WHERE vlat IS NOT NULL GROUP BY k.village_id"),
    "to_utm": (lambda s, d: _utm(s, d).select("id", "zone", F.round("u.x", 2).alias("x"), F.round("u.y", 2).alias("y")), _utm_sql() + "SELECT id, zone, round(x, 2) AS x, round(y, 2) AS y FROM u"),
    "from_utm": (lambda s, d: _utm(s, d).withColumn("g", G.from_utm(F.col("u.x"), F.col("u.y"), F.col("zone"))).select("id", F.round("g.lat", 6).alias("lat"), F.round("g.lng", 6).alias("lng")), with_views("villages") + "SELECT id, round(latitude, 6) AS lat, round(longitude, 6) AS lng FROM villages"),
}
