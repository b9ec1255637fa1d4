"""Queries over spectral bands and detections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import landuse as L
from .views import load, with_views

B = with_views("bands")
V, W, X = "(nir - red) / (nir + red)", "(green - nir) / (green + nir)", "(swir - nir) / (swir + nir)"
CLASSES = B.rstrip() + f""", i AS (SELECT *, {V} AS v, {W} AS w, {X} AS b FROM bands),
s AS (SELECT *, CASE WHEN v > 3e-1 AND v < 6e-1 THEN least(100e0, (v - 3e-1) * 333) ELSE 0e0 END AS a, CASE WHEN v > 6e-1 THEN least(100e0, (v - 6e-1) * 250) ELSE 0e0 END AS f, CASE WHEN w > 3e-1 THEN least(100e0, (w - 3e-1) * 142) ELSE 0e0 END AS t, CASE WHEN b > 1e-1 THEN least(100e0, (b - 1e-1) * 111) ELSE 0e0 END AS u FROM i),
c AS (SELECT id, village_id, CASE WHEN a + f + t + u > 0 THEN a / (a + f + t + u) * 100 ELSE 0e0 END AS agriculture, CASE WHEN a + f + t + u > 0 THEN f / (a + f + t + u) * 100 ELSE 0e0 END AS forest, CASE WHEN a + f + t + u > 0 THEN t / (a + f + t + u) * 100 ELSE 0e0 END AS water, CASE WHEN a + f + t + u > 0 THEN u / (a + f + t + u) * 100 ELSE 0e0 END AS built_up, least(95e0, 70 + (abs(v) + abs(w) + abs(b)) * 25) AS confidence FROM s)
"""
SHARES = ("agriculture", "forest", "water", "built_up", "confidence")
KINDS = {"water": ("pond", "water_body"), "farm": ("farm",), "homestead": ("homestead",), "infrastructure": ("infrastructure",)}
ACCEPTED_SQL = "CASE WHEN asset_type = 'pond' THEN confidence > 80 WHEN asset_type = 'farm' THEN least(95, ndvi * 100) > 70 ELSE asset_type IN ('homestead', 'infrastructure') END"


def _classes(s, d):
    return load(s, d, "bands").select("id", "village_id", L.classify(*[F.col(c) for c in ("red", "green", "nir", "swir")]).alias("c")).select("id", "village_id", "c.*")


def _index(fn, a, name, sql):
    return (lambda s, d: load(s, d, "bands").select("id", F.round(fn(F.col(a), F.col("nir")), 6).alias(name)), B + f"SELECT id, round({sql}, 6) AS {name} FROM bands")


def _accepted(s, d):
    return load(s, d, "assets").where(L.accepted(F.col("asset_type"), F.col("confidence"), F.col("ndvi")))


PAIRS = {
    "ndvi": _index(L.ndvi, "red", "ndvi", V), "ndwi": _index(L.ndwi, "green", "ndwi", W), "ndbi": _index(L.ndbi, "swir", "ndbi", X),
    "classify_land_use": (lambda s, d: _classes(s, d).select("id", *[F.round(c, 1).alias(c) for c in SHARES]), CLASSES + "SELECT id, " + ", ".join(f"round({c}, 1) AS {c}" for c in SHARES) + " FROM c"),
    "land_use_by_village": (lambda s, d: _classes(s, d).groupBy("village_id").agg(*[F.round(F.sum(F.col(c) * F.col("confidence")) / F.sum("confidence"), 4).alias(c) for c in SHARES[:4]], F.count(F.lit(1)).alias("parcels")), CLASSES + "SELECT village_id, " + ", ".join(f"round(sum({c} * confidence) / sum(confidence), 4) AS {c}" for c in SHARES[:4]) + ", count(*) AS parcels FROM c GROUP BY 1"),
    "accept_detections": (lambda s, d: _accepted(s, d).select("id", "asset_type", "confidence"), with_views("assets") + f"SELECT id, asset_type, confidence FROM assets WHERE {ACCEPTED_SQL}"),
    "detections_union": (lambda s, d: reduce(lambda a, b: a.unionByName(b), [load(s, d, "assets").where(F.col("asset_type").isin(*ks)).select(F.lit(n).alias("detector"), "id", "asset_type") for n, ks in KINDS.items()]), with_views("assets") + " UNION ALL ".join(f"SELECT '{n}' AS detector, id, asset_type FROM assets WHERE asset_type IN ({', '.join(repr(k) for k in ks)})" for n, ks in KINDS.items())),
}
