"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the "plain words" contracts: space and \t \n \v \f \r.
BLANKS = r"[\x20\x09-\x0D]+"
#: Everything that is neither a digit, a lower-case a-z nor outside ASCII.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a batch of rows for Python. Each task holds several of them at once, outside of the JVM's heap: Spark's own 64 MB add up.
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one: a temporary folder in local mode, refused on a cluster.

    Every operator asks for it first, so the size of batches is bounded here, too, unless the session has a size of its own.
    """
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, BATCH)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, and survives lost executors.

    Tables of an application lie in one folder, to be deleted when it has ended.

    Spark knows the true size of what it reads back, unlike that of generated rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files behind materialised tables that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def keep_clear(df: DataFrame, *names: str) -> DataFrame:
    """Rename input columns that clash with an operator's own ones, in any case: `_in` is appended until free."""
    for name in names:
        for column in [c for c in df.columns if c.lower() == name.lower()]:
            taken, new = {c.lower() for c in df.columns}, column + "_in"
            while new.lower() in taken:
                new += "_in"
            df = df.withColumnRenamed(column, new)
    return df


def spare(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def text_of(column: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def n_plain_words(text: Column) -> Column:
    """Number of maximal runs of characters that are no blanks; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. Texts of ASCII alone take the quick way."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def words_of(text: Column) -> Column:
    """Lower-cased runs of digits, letters and characters outside ASCII, as an array; null: empty."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NON_WORD), "")


#: Keys with more than this share of all rows (and 1000 rows) are hot: there are at most so many of them.
HOT_KEYS = 100_000


def row_keys(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all columns, _k1 and _k2: rows alike in every column are alike in both.

    The hash skips nulls, so which columns are null is hashed along. Nested columns, inside
    of which nulls would be skipped, too, are hashed as JSON with all fields.
    """
    whole = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    nested = ("map<", "struct<", "array<")
    plain = [whole(F.col(f"`{f.name}`")) if f.dataType.simpleString().startswith(nested) else F.col(f"`{f.name}`") for f in df.schema.fields]
    nulls = F.concat(F.lit(""), *[F.when(F.col(f"`{f.name}`").isNull(), "0").otherwise("1") for f in df.schema.fields])
    return [F.xxhash64(F.lit(k), nulls, *plain).alias(f"_k{k}") for k in (1, 2)]


def hot_keys(counts: DataFrame, n_rows: int) -> DataFrame:
    """Of a written table with (_k1, _k2, n), the keys of hot groups of equal rows; HOT_KEYS rows at most, so they may be broadcast."""
    return counts.where(F.col("n") > max(1000, n_rows // HOT_KEYS)).select("_k1", "_k2", "n")


def repeated(df: DataFrame, times: Column, name: str, chunk: int = 1024) -> DataFrame:
    """Each row `times` times, with a number `name` from 0; the copies of one row are spread over tasks."""
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / chunk).cast("long")))
    parts = df.withColumn("_times", times.cast("long")).where("_times > 0").select("*", chunks.alias("_chunk"))
    parts = parts.repartition(F.xxhash64(*[c for c in df.columns if c.startswith("_k")], "_chunk"))
    within = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(chunk).cast("long"), F.col("_times") - F.col("_chunk") * chunk) - 1))
    return parts.select("*", within.alias("_in")).withColumn(name, F.col("_chunk") * chunk + F.col("_in")).drop("_times", "_chunk", "_in")
