"""Typed readers, landing checks and validation of incoming rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What may be uploaded.
FILE_TYPES = ("application/pdf", "image/jpeg", "image/png", "image/tiff")
MAX_BYTES = 10 * 1024 * 1024
MAX_FILES = 50
CLAIM_TYPES = ("IFR", "CFR", "CR")

_S, _D, _TS = T.StringType(), T.DoubleType(), T.TimestampNTZType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


#: Declared schemas of the analytical tables; readers never infer.
SCHEMAS = {
    "states": _struct(id=_S, name=_S, code=_S, created_at=_TS),
    "districts": _struct(id=_S, name=_S, code=_S, state_id=_S, created_at=_TS),
    "villages": _struct(id=_S, name=_S, code=_S, district_id=_S, latitude=T.DecimalType(10, 8), longitude=T.DecimalType(11, 8), boundary=_S, population=T.IntegerType(), tribal_population=T.IntegerType(), created_at=_TS, state_name=_S, type=_S, water_access=T.BooleanType(), water_quality=_S, elevation=_D, forest_area=_D),
    "users": _struct(id=_S, email=_S, role=_S, state=_S, district=_S),
    "claims": _struct(id=_S, claim_id=_S, claimant_name=_S, claimant_father_name=_S, claimant_address=_S, village_id=_S, claim_type=_S, area=T.DecimalType(8, 2), coordinates=_S, status=_S, ai_confidence=T.DecimalType(5, 2), submitted_date=_TS, verified_date=_TS, verified_by=_S, rejection_reason=_S, notes=_S, created_at=_TS, updated_at=_TS, latitude=T.DecimalType(10, 8), longitude=T.DecimalType(11, 8), spatially_linked=T.BooleanType(), spatial_confidence=_D, linked_village_id=_S, linked_district_id=_S, linked_state_id=_S, geofenced=T.BooleanType()),
    "documents": _struct(id=_S, claim_id=_S, file_name=_S, file_type=_S, file_size=T.IntegerType(), file_path=_S, ocr_text=_S, ocr_confidence=T.DecimalType(5, 2), ocr_language=_S, languages_used=T.ArrayType(_S), processing_status=_S, processing_time=T.IntegerType(), image_quality=_S, preprocessing_applied=T.ArrayType(_S), processing_attempts=T.IntegerType(), last_error=_S, processed_at=_TS, created_at=_TS, updated_at=_TS, document_type=_S),
    "assets": _struct(id=_S, village_id=_S, asset_type=_S, coordinates=_S, area=T.DecimalType(8, 2), confidence=T.DecimalType(5, 2), detected_at=_TS, verified_at=_TS, verified_by=_S),
    "recommendations": _struct(id=_S, claim_id=_S, scheme_id=_S, score=T.DecimalType(5, 2), benefit=T.DecimalType(12, 2), priority=_S, implemented_at=_TS, implemented_by=_S, created_at=_TS),
    "audit_trail": _struct(id=_S, entity_type=_S, entity_id=_S, action=_S, user_id=_S, old_values=_S, new_values=_S, timestamp=_TS, notes=_S),
}


def load(spark: SparkSession, folder: str, kind: str = "parquet") -> dict[str, DataFrame]:
    """The tables below `folder`, one folder or file each, with their declared schemas."""
    reader = lambda t: spark.read.format(kind).schema(SCHEMAS[t]).option("header", True)
    return {t: reader(t).load(f"{folder}/{t}" + (".parquet" if kind == "parquet" else "")) for t in SCHEMAS}


def landing_reason(file_type: Column, size: Column) -> Column:
    """Why a file is refused, null if it is accepted; the type is looked at first."""
    return F.when(~F.coalesce(file_type.isin(*FILE_TYPES), F.lit(False)), "type").when(F.coalesce(size, F.lit(0)) > MAX_BYTES, "size")


def pair_manifest(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows batch_id, item, file, claim; refused batches with reason) of manifests (batch_id, files, claims)."""
    reason = F.when(F.size("files") > MAX_FILES, "too many files").when(F.size("files") != F.size("claims"), "lengths differ")
    m = manifests.withColumn("reason", reason)
    rows = m.where("reason is null").select("batch_id", F.posexplode(F.arrays_zip("files", "claims")).alias("item", "p")).select("batch_id", "item", F.col("p.files").alias("file"), F.col("p.claims").alias("claim"))
    return rows, m.where("reason is not null").select("batch_id", "reason")


def claim_errors(name: Column, village: Column, kind: Column, area: Column, coordinates: Column) -> Column:
    """Array of what is wrong with a raw claim; empty if nothing."""
    return F.array_compact(F.array(
        F.when(F.length(F.coalesce(name, F.lit(""))) < 2, F.lit("name")),
        F.when(F.coalesce(village, F.lit("")) == "", F.lit("village")),
        F.when(~F.coalesce(kind.isin(*CLAIM_TYPES), F.lit(False)), F.lit("type")),
        F.when((area != "") & area.try_cast("double").isNull(), F.lit("area")),
        F.when((coordinates != "") & F.try_parse_json(coordinates).isNull(), F.lit("coordinates"))))


def upsert(current: DataFrame, changes: DataFrame, key: str = "id", stamp: str | None = None, at: Column | None = None) -> DataFrame:
    """`current` with `changes` (one row per key) laid over it: their non-null values win; new keys are added."""
    columns = [c for c in current.columns if c != key]
    n = changes.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns if c in changes.columns], F.lit(True).alias("_changed"))
    both = current.join(n, key, "full")
    value = lambda c: F.coalesce(f"_n_{c}", c) if c in changes.columns else F.col(c)
    out = {c: value(c) for c in columns}
    if stamp:
        out[stamp] = F.when(F.col("_changed"), at).otherwise(F.col(stamp))
    return both.select(key, *[x.alias(c) for c, x in out.items()])


def patch(current: DataFrame, patches: DataFrame, key: str = "id", order: str = "ts", stamp: str | None = None, at: str | None = None) -> DataFrame:
    """The last patch of each key, its non-null fields applied; keys that `current` lacks are ignored.

    The column `stamp` of patched rows becomes the patch's `order`, or the field `at` of it.
    """
    fields = [c for c in patches.columns if c not in (key, order)]
    last = patches.groupBy(key).agg(F.max_by(F.struct(order, *fields), F.struct(order, *fields)).alias("_p"))
    both = current.join(last, key, "left")
    out = {f: F.coalesce(F.col(f"_p.{f}"), F.col(f)) for f in fields}
    if stamp:
        out[stamp] = F.coalesce(F.col(f"_p.{order}" + (f".{at}" if at else "")), F.col(stamp))
    return both.withColumns(out).drop("_p")


def apply_status(claims: DataFrame, changes: DataFrame) -> DataFrame:
    """`claims` (id, status, ...) with the newest change (id, status, user_id, notes, ts) of each.

    Verified claims also get verified_date and verified_by; notes only if not empty.
    What a change does not touch stays as it is; columns that `claims` lacks are added.
    """
    last = changes.groupBy("id").agg(F.max_by(F.struct("status", "user_id", "notes", "ts"), F.struct("ts", "status")).alias("_c"))
    both = claims.join(last, "id", "left")
    verified = F.col("_c.status") == "verified"
    new = {
        "status": F.col("_c.status"),
        "verified_date": F.when(verified, F.col("_c.ts")), "verified_by": F.when(verified, F.col("_c.user_id")),
        "notes": F.when(F.length(F.col("_c.notes")) > 0, F.col("_c.notes")),
    }
    return both.withColumns({c: F.coalesce(x, F.col(c)) if c in claims.columns else x for c, x in new.items()}).drop("_c")


#: Extracted entities as a document keeps them, and what could not be read.
ENTITY_KINDS = ("names", "claim_types", "claim_status", "document_types", "survey_numbers", "boundaries", "villages", "areas", "coordinates", "dates")
ENTITIES = T.StructType([*[T.StructField(k, T.ArrayType(_S)) for k in ENTITY_KINDS], T.StructField("_corrupt", _S)])


def decode_entities(text: Column) -> Column:
    """A struct of ten arrays from JSON; missing kinds are null, and text that is no JSON is kept in _corrupt. Null stays null."""
    return F.from_json(text, ENTITIES, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def decode_criteria(text: Column) -> Column:
    """Criteria of any shape as a variant, null for text that is no JSON."""
    return F.try_parse_json(text)


def claim_ids(claims: DataFrame, states: Column, prefix: str = "FRA", given: DataFrame | None = None) -> DataFrame:
    """`claims` with new_id: prefix, two letters of the state (XX without), number within the state by id.

    Numbers have six digits or more, and go on in each state from the largest of `given`
    (new_id), what was given out already; ids of another form count for nothing. States
    may hold most claims, so numbers come from a total order, not one window.
    """
    from ..operators.workflow import global_rank

    code = F.coalesce(F.upper(F.substring(states, 1, 2)), F.lit("XX"))
    ranked = global_rank(claims.withColumn("_code", code), F.col("_code"), F.col("id").cast("long"))
    first = ranked.groupBy("_code").agg((F.min("position") - 1).alias("_first"))  # one row per code
    if given is not None:
        form = rf"^{re.escape(prefix)}-(.*)-(\d+)$"
        number = F.regexp_extract("new_id", form, 2).try_cast("long")
        last = given.select(F.regexp_extract("new_id", form, 1).alias("_code"), number.alias("n")).where("n is not null").groupBy("_code").agg(F.max("n").alias("_last"))
        first = first.join(last, "_code", "left").select("_code", (F.col("_first") - F.coalesce("_last", F.lit(0))).alias("_first"))
    digits = (F.col("position") - F.col("_first")).cast("string")
    number = F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0"))
    return ranked.join(F.broadcast(first), "_code").withColumn("new_id", F.concat_ws("-", F.lit(prefix), "_code", number)).drop("_code", "_first", "position")
