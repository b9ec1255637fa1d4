"""Spectral indices and land-use shares as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ndvi(red: Column, nir: Column) -> Column:
    return F.try_divide(nir - red, nir + red)


def ndwi(green: Column, nir: Column) -> Column:
    return F.try_divide(green - nir, green + nir)


def ndbi(swir: Column, nir: Column) -> Column:
    return F.try_divide(swir - nir, swir + nir)


def classify(red: Column, green: Column, nir: Column, swir: Column) -> Column:
    """struct(agriculture, forest, water, built_up, confidence), unrounded; shares sum to 100 or 0."""
    v, w, b = ndvi(red, nir), ndwi(green, nir), ndbi(swir, nir)
    some = lambda test, value: F.when(test, F.least(F.lit(100.0), value)).otherwise(F.lit(0.0))
    shares = {
        "agriculture": some((v > 0.3) & (v < 0.6), (v - 0.3) * 333), "forest": some(v > 0.6, (v - 0.6) * 250),
        "water": some(w > 0.3, (w - 0.3) * 142), "built_up": some(b > 0.1, (b - 0.1) * 111),
    }
    total = shares["agriculture"] + shares["forest"] + shares["water"] + shares["built_up"]
    confidence = F.least(F.lit(95.0), F.lit(70.0) + (F.abs(v) + F.abs(w) + F.abs(b)) * 25)
    return F.struct(*[F.when(total > 0, x / total * 100).otherwise(F.lit(0.0)).alias(n) for n, x in shares.items()], confidence.alias("confidence"))


def accepted(kind: Column, confidence: Column, ndvi_value: Column) -> Column:
    """Whether a detection is kept: ponds over 80, farms by greenness over 70, buildings always."""
    green = F.least(F.lit(95.0), ndvi_value * 100)
    return F.when(kind == "pond", confidence > 80).when(kind == "farm", green > 70).otherwise(kind.isin("homestead", "infrastructure"))
