"""Two-pass external shuffle into shards of equal row counts.

Pass 1 scatters whole records uniformly into memory-sized buckets by a seeded
hash; pass 2 shuffles each bucket with Fisher-Yates. The buckets laid end to end
are one random permutation of the table, which is cut into `n_shards` runs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_keys, keep_clear, materialise, read, repeated, row_keys, shared_dir, text_of

#: Bucket tables up to this many rows (16 MB) are broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST_BUCKETS = 1_000_000


def shuffle_into_shards(docs: DataFrame, n_shards: int = 8, *, seed: int = 17, bucket_bytes: int = 16 << 20, max_tasks: int = 20_000) -> DataFrame:
    """All rows of `docs` with `shard` (int) and `slot` (long, gapless from 0 in each shard).

    Shards hold contiguous runs of the permutation, so their row counts differ by
    one at most (law "rows"). The same table and seed always give the same result:
    rows are told apart by all their columns, and rows alike in all are interchangeable.
    A group of very many equal rows is kept once and dealt out anew, copy by copy,
    over all buckets. A task takes several buckets if there are more than `max_tasks`.

    Nulls count as values; empty tables give no rows; repeated rows are all kept and
    take slots of their own; a text longer than a bucket makes that bucket longer.
    Input columns called shard or slot get the suffix `_in`.
    """
    docs = keep_clear(docs, "shard", "slot")
    sizes = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)).cast("long") for f in docs.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    weight = sum(sizes, F.lit(64).cast("long"))
    counts = materialise(docs.select(*row_keys(docs), weight.alias("w")).groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("b")), "shard-rows")
    total = counts.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    n_rows, n_buckets = total["n"] or 0, max(1, math.ceil((total["b"] or 0) / bucket_bytes))
    hot = hot_keys(counts, n_rows)

    def bucket_of(nth: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "_k1", "_k2", nth), F.lit(n_buckets))

    first = F.lit(0).cast("long")
    rows = docs.select(F.struct("*").alias("rec"), *row_keys(docs)).withColumn("_nth", first)
    dealt = counts.select("_k1", "_k2", "n").withColumn("_nth", first)
    if not hot.isEmpty():
        few = F.broadcast(hot)
        once = rows.join(few, ["_k1", "_k2"]).groupBy("_k1", "_k2").agg(F.any_value("rec").alias("rec"), F.any_value("n").alias("n"))
        rows = rows.join(few, ["_k1", "_k2"], "left_anti").unionByName(repeated(once, F.col("n"), "_nth").select(*rows.columns))
        dealt = dealt.join(few, ["_k1", "_k2"], "left_anti").unionByName(repeated(hot, F.col("n"), "_nth").withColumn("n", F.lit(1).cast("long")))
    n_spans = min(n_buckets, max_tasks)
    scattered = rows.withColumn("bucket", bucket_of(F.col("_nth"))).withColumn("span", F.expr(f"bucket * {n_spans}L div {n_buckets}"))
    starts = (
        dealt.groupBy(bucket_of(F.col("_nth")).alias("bucket")).agg(F.sum("n").alias("n"))
        .select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"))
    )  # one row per bucket

    def fisher_yates(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        order = np.lexsort([table.column(c).to_numpy() for c in ("_nth", "_k2", "_k1")])  # the order of arrival must not matter
        order = order[np.random.Generator(np.random.PCG64([seed, bucket])).permutation(len(order))]
        return table.select(["rec", "bucket"]).take(pa.array(order)).append_column("at", pa.array(np.arange(len(order))))

    out = T.StructType([scattered.schema["rec"], T.StructField("bucket", T.LongType()), T.StructField("at", T.LongType())])
    shuffled = scattered.repartition(n_spans, "span").groupBy("span", "bucket").applyInArrow(fisher_yates, out)
    starts = F.broadcast(starts) if n_buckets <= MAX_BROADCAST_BUCKETS else starts.hint("shuffle_hash")
    position = F.col("start") + F.col("at")
    shard = F.expr(f"int((start + at) * {n_shards} div {max(n_rows, 1)})")
    first = F.expr(f"(shard * {n_rows}L + {n_shards - 1}) div {n_shards}")
    return shuffled.join(starts, "bucket").withColumn("shard", shard).select("rec.*", "shard", (position - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within each file; tasks write the buckets they hold, without a shuffle."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    text = text_of()
    return shuffle_into_shards(read(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
