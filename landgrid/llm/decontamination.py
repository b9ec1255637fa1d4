"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Windows are item-sized: `window` consecutive words of an item, or all of a shorter
item. A document that contains a window contains all its shingles, so a join on one
of them, the rarest in the corpus, finds every candidate (the prefix of a set whose
whole content is required has length one). Its offset fixes where the window would
have to start; positions and lengths that do not fit are cut off, the others are
verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep_clear, materialise, read, shared_dir, words_of

#: Results of documents with hits up to this many rows (of fixed width, about 150 bytes) are broadcast to the documents.
MAX_BROADCAST_HITS = 200_000
#: Window tables up to this many words and of so many bytes are broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST_WINDOWS, MAX_BROADCAST_BYTES = 100_000, 32 << 20


def item_windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(id, words, size) of each distinct window, and (id, item) of the items that hold it."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("all")).where("size(all) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("all") - (window - 1), F.lit(1))))
    held = (
        items.select("item_id", "all", starts.alias("at"))
        .select(F.col("item_id").cast("string").alias("item"), F.slice("all", F.col("at"), F.lit(window)).alias("words"))
    )
    windows = materialise(held.select("words").distinct().select(F.monotonically_increasing_id().alias("id"), "words", F.size("words").alias("size")), "windows")
    owners = held.where("item is not null").distinct().join(windows.hint("merge"), "words").select("id", "item")
    return windows, materialise(owners, "window-items")


def shingle_hash(words: Column, at: Column, width: int) -> Column:
    """Hash of `width` words from position `at` (0-based); seeded by the width."""
    return F.xxhash64(F.lit(width), *[F.get(words, at + i) for i in range(width)])


def doc_shingles(texts: DataFrame, widths: list[int]) -> DataFrame:
    """(_k, _h, words, at, shingle) for each position of each text and each width that fits."""
    spread = texts.select("*", F.posexplode("words").alias("at", "word")).drop("word")
    if len(widths) == 1:
        return spread.withColumn("shingle", shingle_hash(F.col("words"), F.col("at"), widths[0])).where(F.size("words") - F.col("at") >= widths[0])
    each = F.explode(F.array(*[F.when(F.size("words") - F.col("at") >= w, shingle_hash(F.col("words"), F.col("at"), w)) for w in widths]))
    return spread.select("*", each.alias("shingle")).where("shingle is not null")


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, shingle: int = 5, share: int = 20) -> DataFrame:
    """`docs` (columns kept) with n_words, n_hit, n_items, items_sha256 and contaminated.

    A word is hit inside any occurrence of a window; a document is contaminated if
    it has hit words and share * n_hit >= n_words. Null texts have no words, items
    without words no windows; null item ids hit but are not listed. Very long texts are
    read whole. Equal documents (doc_id and text) get equal results, each row its own.
    Empty tables are allowed. Input columns with the names of results get the suffix `_in`.
    """
    docs = keep_clear(docs, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    windows, owners = item_windows(benchmark, window)
    n_windows, n_bytes = windows.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.array_join("words", " ")))).first()
    small = n_windows <= MAX_BROADCAST_WINDOWS and (n_bytes or 0) <= MAX_BROADCAST_BYTES
    widths = sorted(r[0] for r in windows.select(F.least(F.col("size"), F.lit(shingle))).distinct().collect())  # at most `shingle` values
    found = _occurrences(docs, windows, small, widths or [shingle], shingle)

    order = Window.partitionBy("_k", "_h").orderBy("start", "end")
    seen = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(seen, F.lit(0))))
    hits = (
        found.select("_k", "_h", "n_words", "start", "end").distinct().withColumn("fresh", fresh)
        .groupBy("_k", "_h").agg(F.sum("fresh").cast("long").alias("_hit"), (F.sum("fresh") * share >= F.max("n_words")).alias("_bad"))
    )
    listed = found.select("_k", "_h", "id").distinct().join(owners.hint("merge"), "id").select("_k", "_h", "item").distinct()
    ids = F.array_sort(F.collect_list("item"))
    items = listed.groupBy("_k", "_h").agg(F.count(F.lit(1)).alias("_items"), F.sha2(F.array_join(ids, ","), 256).alias("_digest"))
    judged = materialise(hits.join(items.hint("merge"), ["_k", "_h"], "left"), "contaminated")
    out = _attach(docs, judged)
    return out.select(
        "_row.*", n_words(F.col("_row.text")).alias("n_words"),
        F.coalesce("_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("_digest", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce(F.col("_hit") > 0, F.lit(False)) & F.coalesce("_bad", F.lit(False))).alias("contaminated"),
    )


def n_words(text: Column) -> Column:
    """Number of words of a text as words_of splits it, without building them; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def _attach(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows of `docs` as _row with their hits: without a shuffle of documents if few have any. `judged` has rows of fixed width."""
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64("doc_id").alias("_k"), F.xxhash64("text").alias("_h"))
    return rows.join(F.broadcast(judged) if judged.count() <= MAX_BROADCAST_HITS else judged.hint("merge"), ["_k", "_h"], "left")


def _occurrences(docs: DataFrame, windows: DataFrame, small: bool, widths: list[int], shingle: int) -> DataFrame:
    """(_k, _h, n_words, start, end, id): all places where windows occur in documents, verified. _k and _h: hashes of id and text."""
    texts = docs.select(F.xxhash64("doc_id").alias("_k"), F.xxhash64("text").alias("_h"), words_of(F.col("text")).alias("words")).where("size(words) > 0")
    spread = doc_shingles(texts, widths)

    width = F.least(F.col("size"), F.lit(shingle))
    places = F.explode(F.sequence(F.lit(0), F.col("size") - width))
    hashed = F.coalesce(*[F.when(width == w, shingle_hash(F.col("words"), F.col("offset"), w)) for w in widths])
    parts = windows.select("id", "words", "size", places.alias("offset")).withColumn("shingle", hashed)
    asked = parts.select("shingle").distinct()
    asked = F.broadcast(asked) if small else asked.hint("shuffle_hash")
    counts = materialise(spread.select("shingle").join(asked, "shingle").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "shingle-counts")
    rarest = F.min(F.struct("n", "offset", "shingle")).alias("rarest")
    # a window with a shingle that no document has cannot occur
    prefix = parts.join(counts.hint("merge"), "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0))).groupBy("id").agg(rarest).where("rarest.n > 0")
    index = windows.join(prefix.hint("merge"), "id").select("id", F.col("words").alias("want"), "size", "rarest.offset", F.col("rarest.shingle").alias("key"))
    index = materialise(index, "prefix-index")

    start = F.col("at") - F.col("offset")
    if small:
        fits = (F.col("shingle") == F.col("key")) & (start >= 0) & (start + F.col("size") <= F.size("words"))
        same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("want")
        met = spread.withColumn("n_words", F.size("words")).join(F.broadcast(index), fits & same)
    else:  # rows of the shuffle carry the words around the shingle, not whole texts
        most = index.agg(F.max("size")).first()[0] or 1
        low = F.greatest(F.col("at") - most + 1, F.lit(0))
        near = spread.select("_k", "_h", F.size("words").alias("n_words"), "at", "shingle", low.alias("low"), F.slice("words", low + 1, F.lit(2 * most)).alias("words"))
        fits = (F.col("shingle") == F.col("key")) & (start >= F.col("low")) & (start - F.col("low") + F.col("size") <= F.size("words"))
        same = F.slice("words", F.greatest(start - F.col("low"), F.lit(0)) + 1, F.col("size")) == F.col("want")
        met = near.join(index.hint("merge"), fits & same)
    return materialise(met.select("_k", "_h", "n_words", start.alias("start"), (start + F.col("size")).alias("end"), "id"), "occurrences")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, read(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
pos AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)),
occ AS (SELECT doc_id, item_id, i, pos.k FROM pos JOIN win USING (k, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""
