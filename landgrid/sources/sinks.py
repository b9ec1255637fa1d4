"""Exports and append-only stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut


def write_csv(rows: DataFrame, path: str) -> None:
    """Every cell quoted, inner quotes doubled, null as an empty cell, one heading per file."""
    text = rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns])
    text.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def geojson_feature(lat: Column, lng: Column, **properties: Column) -> Column:
    """A Feature as JSON text, with a point in longitude, latitude order."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties")))


HEAD, TAIL = '{"type":"FeatureCollection","features":[', "]}"


def write_geojson(features: DataFrame, path: str, key: str = "id", column: str = "feature") -> None:
    """One FeatureCollection as numbered text files: laid end to end in the order of their names they are the document.

    `key` must be unique. Features are written in its order by as many tasks as the table asks
    for: rows are dealt by ranges of the key, and the head and the tail are rows before and
    after all others. Only the first feature has no comma before it.
    """
    first = features.agg(F.min(key)).first()[0]  # one value
    comma = F.when(F.col(key) == F.lit(first), F.lit("")).otherwise(F.lit(","))
    spark, kind = features.sparkSession, features.schema[key].dataType
    ends = spark.createDataFrame([(0, HEAD), (2, TAIL)], "place int, value string").select("place", F.lit(None).cast(kind).alias("key"), "value")
    rows = features.select(F.lit(1).alias("place"), F.col(key).alias("key"), F.concat(comma, F.col(column)).alias("value")).unionByName(ends)
    rows.repartitionByRange("place", "key").sortWithinPartitions("place", "key").select("value").write.mode("overwrite").text(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(feature) of each feature of a document that write_geojson wrote."""
    lines = spark.read.text(path).where(~F.col("value").isin(HEAD, TAIL))
    return lines.select(F.regexp_replace("value", "^,", "").alias("feature"))


def append_audit(entries: DataFrame, path: str) -> None:
    """Append entries (with ts) by day. Small days share a task, and a large one is split over several."""
    entries.withColumn("day", F.col("ts").cast("date")).hint("rebalance", F.col("day")).write.mode("append").partitionBy("day").parquet(path)


def save_recommendations(recs: DataFrame, path: str, key: str = "id", buckets: int = 64) -> None:
    """Make `recs` (claim `key`, scheme and others) the recommendations of its claims; those of other claims stay.

    The store is partitioned by a hash of the claim. Only partitions that hold a saved claim are
    written again, by one commit; what they hold of other claims is copied. What is
    written is on shared storage before anything is replaced. A repeated pair of
    claim and scheme is saved once. One writer at a time.
    """
    spark = recs.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = cut(recs.dropDuplicates([key, "scheme"]).withColumn("bucket", bucket))
    rows = new
    if stored := read_recommendations(spark, path):
        touched = new.select("bucket").distinct()  # at most one row per bucket
        others = stored.join(F.broadcast(touched), "bucket", "left_semi").join(new.select(key).distinct().hint("merge"), key, "left_anti")
        rows = cut(new.unionByName(others, allowMissingColumns=True))
    rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_recommendations(spark: SparkSession, path: str) -> DataFrame | None:
    """All saved recommendations with their bucket; None before the first save."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if files.exists(folder) else None
