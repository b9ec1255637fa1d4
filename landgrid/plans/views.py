"""Domain tables derived from the supplied ones by expressions that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import spread

_LAT = "8 + ({k} * 7919 % 280000) / 1e4"
_LNG = "70 + ({k} * 104729 % 270000) / 1e4"
_STATES = "CASE {k} % 8 WHEN 0 THEN 'MP' WHEN 1 THEN 'Odisha' WHEN 2 THEN 'Telangana' WHEN 3 THEN 'Tripura' WHEN 4 THEN 'Jharkhand' END"

#: name -> (source table, {column: expression})
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "states": ("region", {"id": "CAST(r_regionkey AS STRING)", "name": "r_name", "code": "substr(r_name, 1, 2)"}),
    "districts": ("nation", {"id": "CAST(n_nationkey AS STRING)", "name": "n_name", "code": "concat('D', CAST(n_nationkey AS STRING))", "state_id": "CAST(n_regionkey AS STRING)"}),
    "villages": ("customer", {
        "id": "CAST(c_custkey AS STRING)", "name": "c_name", "district_id": "CAST(c_nationkey AS STRING)",
        "latitude": f"CAST(round({_LAT.format(k='c_custkey')}, 5) AS DOUBLE)", "longitude": f"CAST(round({_LNG.format(k='c_custkey')}, 5) AS DOUBLE)",
        "population": "CASE WHEN c_custkey % 50 = 49 THEN NULL ELSE CAST(100 + c_custkey * 37 % 5000 AS INT) END",
        "tribal_population": "CASE WHEN c_custkey % 50 = 49 THEN NULL ELSE CAST(c_custkey * 13 % 100 AS INT) END",
        "state_name": _STATES.format(k="c_custkey"),
        "type": "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'urban' ELSE 'rural' END",
        "water_access": "c_mktsegment = 'HOUSEHOLD'",
        "water_quality": "CASE c_custkey % 4 WHEN 0 THEN 'poor' WHEN 1 THEN 'good' END",
        "elevation": "CAST(c_custkey * 11 % 2000 AS DOUBLE)", "forest_area": "CAST(c_custkey * 17 % 120 AS DOUBLE)",
    }),
    "claims": ("orders", {
        "id": "CAST(o_orderkey AS STRING)", "claim_id": "concat('FRA-', CAST(o_orderkey AS STRING))",
        "claimant_name": "concat(CASE o_orderkey % 5 WHEN 0 THEN 'Asha' WHEN 1 THEN 'Ravi' WHEN 2 THEN 'Meena' WHEN 3 THEN 'Somu' ELSE 'Lata' END, ' ', CASE o_orderkey % 3 WHEN 0 THEN 'Gond' WHEN 1 THEN 'Devi' ELSE 'Munda' END)",
        "village_id": "CASE WHEN o_orderkey % 97 = 5 THEN NULL ELSE CAST(o_custkey AS STRING) END",
        "claim_type": "CASE o_orderkey % 3 WHEN 0 THEN 'IFR' WHEN 1 THEN 'CFR' ELSE 'CR' END",
        "area": "CASE WHEN o_orderkey % 41 = 7 THEN NULL ELSE (o_orderkey % 2500) / 1e2 END",
        "status": "CASE WHEN o_orderstatus = 'F' AND o_orderpriority < '3' THEN 'verified' WHEN o_orderstatus = 'F' THEN 'rejected' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'under_review' END",
        "ai_confidence": "CASE WHEN o_orderkey % 11 = 3 THEN NULL ELSE CAST(o_orderkey * 7 % 100 AS DOUBLE) END",
        "created_at": "o_orderdate",
        "latitude": f"CASE WHEN o_orderkey % 53 = 9 THEN 95e0 WHEN o_orderkey % 59 = 4 THEN NULL ELSE round({_LAT.format(k='o_custkey')} + (o_orderkey * 31 % 1000 - 500) / 2e4, 5) END",
        "longitude": f"round({_LNG.format(k='o_custkey')} + (o_orderkey * 57 % 1000 - 500) / 2e4, 5)",
        "user_id": "CAST(o_orderkey % 10 AS STRING)",
    }),
    "users": ("supplier", {
        "id": "CAST(s_suppkey AS STRING)", "email": "concat(s_name, '@example.org')",
        "role": "CASE s_suppkey % 6 WHEN 0 THEN 'admin' WHEN 1 THEN 'state' WHEN 2 THEN 'district' WHEN 3 THEN 'field' WHEN 4 THEN 'ngo' ELSE 'public' END",
        "state": "CAST(s_nationkey % 5 AS STRING)", "district": "CASE WHEN s_suppkey % 12 = 2 THEN NULL ELSE CAST(s_nationkey AS STRING) END",
    }),
    "papers": ("documents", {
        "id": "CAST(doc_id AS STRING)", "claim_id": "CAST(doc_id % 500 AS STRING)", "file_size": "CASE WHEN doc_id % 31 = 8 THEN 0 ELSE n_chars END",
        "file_type": "CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png' WHEN 3 THEN 'image/tiff' ELSE 'text/plain' END",
        "document_type": "CASE doc_id % 3 WHEN 0 THEN 'form' WHEN 1 THEN 'map' ELSE 'record' END",
        "ocr_text": "CASE WHEN doc_id % 13 = 6 THEN NULL ELSE text END",
        "ocr_confidence": "CASE WHEN doc_id % 17 = 3 THEN NULL ELSE CAST(doc_id * 29 % 100 AS DOUBLE) END",
        "ocr_language": "CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'eng+hin' WHEN 'de' THEN 'hin+mar' ELSE 'ben' END",
        "has_entities": "doc_id % 13 <> 6 AND doc_id % 3 = 0",
        "processing_time": "CASE WHEN doc_id % 4 = 1 THEN NULL ELSE CAST(doc_id * 17 % 5000 AS INT) END",
        "processed": "doc_id % 4 <> 1",
        "width": "CAST(400 + doc_id * 91 % 3600 AS INT)", "mean": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id * 13 % 256 AS DOUBLE) END", "stdev": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id * 7 % 70 AS DOUBLE) END",
    }),
    "pages_of": ("conversations", {"document_id": "CAST(conv_id AS STRING)", "page": "CAST(turn AS INT)", "text": "text", "confidence": "CAST((conv_id * 31 + turn * 17) % 100 AS DOUBLE)", "language": "CASE (conv_id + turn) % 4 WHEN 0 THEN 'eng' WHEN 1 THEN 'hin+mar' WHEN 2 THEN 'ben' ELSE 'tam' END", "quality": "CASE turn % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'fair' ELSE 'low' END"}),
    "assets": ("part", {
        "id": "CAST(p_partkey AS STRING)", "village_id": "CAST(p_partkey % 1500 AS STRING)",
        "asset_type": "CASE p_size % 6 WHEN 0 THEN 'pond' WHEN 1 THEN 'farm' WHEN 2 THEN 'homestead' WHEN 3 THEN 'forest' WHEN 4 THEN 'water_body' ELSE 'infrastructure' END",
        "confidence": "CAST(p_size * 2 AS DOUBLE)", "ndvi": "p_size / 6e1", "verified": "p_partkey % 3 = 0", "detected_day": "CAST(p_partkey * 7 % 400 AS INT)",
        "latitude": f"CASE WHEN p_partkey % 23 = 2 THEN NULL ELSE round({_LAT.format(k='(p_partkey % 1500)')} + (p_partkey % 100 - 50) / 1e3, 5) END", "longitude": f"round({_LNG.format(k='(p_partkey % 1500)')} + (p_partkey * 3 % 100 - 50) / 1e3, 5)",
    }),
    "queue": ("lineitem", {
        "batch_id": "CAST(l_orderkey AS STRING)", "item": "l_linenumber", "document_id": "CAST(l_partkey AS STRING)",
        "priority": "CASE l_linenumber % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' ELSE 'low' END",
        "outcome": "CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE CASE WHEN l_linestatus = 'O' THEN 'queued' ELSE 'processing' END END",
        "error": "CASE WHEN l_returnflag = 'R' THEN concat('E', CAST(l_suppkey AS STRING)) END", "ts": "l_shipdate", "seq": "l_orderkey * 8 + l_linenumber",
        "tiebreak": "concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '/', CAST(l_suppkey AS STRING), '/', CAST(l_quantity AS STRING), '/', CAST(l_extendedprice AS STRING))",
    }),
    "audit": ("events", {
        "id": "event_id", "entity_type": "CASE event_id % 3 WHEN 0 THEN 'claim' WHEN 1 THEN 'document' ELSE 'recommendation' END", "entity_id": "CAST(user_id AS STRING)",
        "action": "event_type", "user_id": "CAST(event_id % 10 AS STRING)", "ts": "ts", "value": "value", "new_values": "props",
        "outcome": "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END",
    }),
    "bands": ("embeddings", {"id": "CAST(vec_id AS STRING)", "village_id": "CAST(vec_id % 100 AS STRING)", "red": "abs(CAST(embedding[{0}] AS DOUBLE))", "green": "abs(CAST(embedding[{1}] AS DOUBLE))", "nir": "abs(CAST(embedding[{2}] AS DOUBLE)) * 3", "swir": "abs(CAST(embedding[{3}] AS DOUBLE))"}),
}

#: A letter per claim whose fields are the truth for the extraction operators.
LETTER = (
    "concat('Claimant Name: ', claimant_name, chr(10), 'Village: ', CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN 'Rampur' WHEN 1 THEN 'Sitapur' WHEN 2 THEN 'Bandhavgarh' ELSE 'Kheri' END, '. Area Claimed: ', CAST(CAST(coalesce(area, 0) AS DECIMAL(8, 2)) AS STRING), ' acres. ', "
    "'Application Date: ', CAST(CAST(created_at AS DATE) AS STRING), '. Status: ', CASE status WHEN 'verified' THEN 'approved' WHEN 'under_review' THEN 'under review' ELSE status END, '. Type: ', claim_type, ' ', "
    "CASE claim_type WHEN 'IFR' THEN 'Individual Forest Rights' WHEN 'CFR' THEN 'Community Forest Resource Rights' ELSE 'Community Rights' END, '. Survey No: ', CAST(CAST(id AS BIGINT) % 900 AS STRING), '/', CAST(CAST(id AS BIGINT) % 7 AS STRING), "
    "'. Lat: ', CAST(CAST(coalesce(latitude, 0) AS DECIMAL(10, 5)) AS STRING), ', Lon: ', CAST(CAST(longitude AS DECIMAL(10, 5)) AS STRING), '. Form A', CAST(CAST(id AS BIGINT) % 10 AS STRING), ' Revenue Record. North: river bank, South: hill road. ')"
)


def columns_of(view: str, first_index: int) -> dict[str, str]:
    source, columns = VIEWS[view]
    if view == "bands":
        return {c: e.format(*[first_index + i for i in range(4)]) for c, e in columns.items()}
    return columns


def load(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A domain table as a DataFrame; only the columns a query uses are read."""
    if view == "letters":
        return spread(load(spark, sf_dir, "claims"), "id").selectExpr("id", "claim_id", "ai_confidence", f"{LETTER} AS text")
    table = spark.read.parquet(f"{sf_dir}/{VIEWS[view][0]}.parquet")
    return table.selectExpr(*[f"{e} AS {c}" for c, e in columns_of(view, 0).items()])


def with_views(*views: str) -> str:
    """`WITH` clause that defines the domain tables for DuckDB."""
    parts = []
    for view in views:
        if view == "letters":
            parts.append(f"letters AS (SELECT id, claim_id, ai_confidence, {LETTER} AS text FROM claims)")
        else:
            parts.append(f"{view} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns_of(view, 1).items())} FROM {VIEWS[view][0]})")
    return "WITH " + ",\n".join(parts) + "\n"
