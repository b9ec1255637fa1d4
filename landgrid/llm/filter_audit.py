"""Filter interaction audit: what each filter of a chain removes, in every order of the filters.

A document fails some set of filters, its mask. What a filter removes at a step of an
order follows from the mask alone, so documents are counted by part and mask once and
the counts are added up for every order and step.

Whether a text repeats a smaller document's is found in two steps. A counting Bloom
filter over all texts, one sparse sketch a task, merged by a sum per cell, clears texts
with a cell of their own: no other text can equal them. Only the rest, possible repeats,
are shuffled with their whole text for the least doc_id of each text.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, read, shared_dir

FILTERS = "ABCDE"
#: Cells per document and hash function; and the number of hash functions.
CELLS_PER_ROW, HASHES = 64, 2
#: Repeated cells up to this many (about 30 MB) are broadcast; more are joined by a shuffle.
MAX_BROADCAST_CELLS = 500_000
_UPPER, _SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text (null: empty) fails; A is bit 0."""

    @F.arrow_udf("int")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.cast(pa.binary()).to_pylist():
            t = t or b""
            words = t.split()  # at ASCII blanks
            points = len(t.translate(None, bytes(range(0x80, 0xC0))))  # without bytes that continue a character
            capitals = len(t) - len(t.translate(None, _UPPER))
            signs = len(t) != len(t.translate(None, _SIGNS))
            out.append((len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * capitals > 3 * points) + 8 * signs)
        return pa.array(out, pa.int32())

    return of(text)


def cells(text: Column, n_cells: int) -> list[Column]:
    """The text's cell under each hash function; functions have cells of their own."""
    return [(F.pmod(F.xxhash64(F.lit(k), text), F.lit(n_cells)) * HASHES + k).alias(f"_c{k}") for k in range(HASHES)]


def repeated_cells(hashed: DataFrame) -> DataFrame:
    """Cells (c) that more than one row of (_c0, _c1, ...) counts in; sketches are merged from each task's own."""
    counts = hashed.select(F.explode(F.array(*[f"_c{k}" for k in range(HASHES)])).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return materialise(counts.where("n > 1").select("c"), "audit-cells")


def possible_repeats(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows with (_c0, _c1, ...) whose every cell is shared; the others are unique for sure."""
    few = repeated.count() <= MAX_BROADCAST_CELLS
    for k in range(HASHES):
        side = repeated.select(F.col("c").alias(f"_c{k}"))
        rows = rows.join(F.broadcast(side) if few else side.hint("merge"), f"_c{k}", "left_semi")
    return rows


def repeats(docs: DataFrame, hashed: DataFrame, n_cells: int) -> DataFrame:
    """(doc_id, copies): how many rows of each doc_id repeat the text of a smaller one.

    `hashed` holds the cells of all rows. Copies are joined with the least id of their
    text, which is aggregated in each task first, so a text that many rows hold is
    never gathered: both sides are shuffled, and Spark may split such a text's rows.
    """
    text = F.coalesce("text", F.lit(""))
    repeated = repeated_cells(hashed)
    rows = possible_repeats(docs.where("doc_id is not null").select("doc_id", text.alias("text"), *cells(text, n_cells)), repeated).select("doc_id", "text")
    least = rows.groupBy("text").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("text", "least")
    least = materialise(least, "audit-least")
    out = rows.join(least.hint("merge"), "text").where("doc_id > least").groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("copies"))
    out = materialise(out, "audit-copies")
    discard(repeated, least)
    return out


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): documents by part and set of failed filters, with those labelled good or toxic."""
    text = F.coalesce("text", F.lit(""))
    n_cells = 1 << max(10, (CELLS_PER_ROW * docs.count() - 1).bit_length())
    part = F.coalesce("lang", F.lit(""))
    hashed = docs.select("doc_id", part.alias("part"), F.xxhash64(text).alias("h"), own_failures(F.col("text")).alias("mask"), *cells(text, n_cells))
    hashed = materialise(hashed, "audit-flags")
    copies = repeats(docs, hashed, n_cells)
    # rows alike are counted before they meet copies and labels, so an id with many rows is one row
    rows = hashed.groupBy("doc_id", "part", "h", "mask").agg(F.count(F.lit(1)).alias("n"))
    copied = rows.join(copies.select("doc_id", "h", F.lit(16).alias("e")).hint("merge"), ["doc_id", "h"], "left")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = copied.join(marks.hint("merge"), "doc_id", "left")
    return joined.groupBy("part", (F.col("mask") + F.coalesce("e", F.lit(0))).alias("mask")).agg(
        F.sum("n").alias("docs"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with additive document counts.

    The filters: A under 200 words; B fewer than half of the words distinct; C over 3
    percent capitals A-Z; D any of #$%&*|; E the text of a smaller doc_id. Parts are the
    values of lang, null as ''. Null texts are empty and equal to empty ones; rows with
    null doc_id repeat nothing, and nothing repeats them; rows that share a doc_id do not
    repeat each other. A document is good or toxic if any of its labels says so; null
    labels say nothing. Texts are compared whole. An empty table gives no rows.
    """
    counts = materialise(mask_counts(docs.select("doc_id", "text", "lang"), labels), "audit-masks")
    orders = ["".join(p) for p in permutations(FILTERS)]
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = [(o, s + 1, bit[o[s]], sum(bit[f] for f in o[:s])) for o in orders for s in range(len(FILTERS))]
    table = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, own int, before int")
    met = counts.join(F.broadcast(table))  # 600 steps for each part and mask
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    count = lambda of, when: F.sum(F.when(when, F.col(of)).otherwise(0)).cast("long")
    out = met.groupBy("part", "filter_order", "step", "own").agg(
        count("docs", ~fails & ~gone).alias("kept"), count("docs", fails & ~gone).alias("removed"), count("docs", fails & gone).alias("redundant"),
        count("docs", F.col("mask") == F.col("own")).alias("unique_fails"), count("good", fails & ~gone).alias("good_lost"), count("toxic", fails & ~gone).alias("toxic_lost"),
    )
    out = materialise(out, "audit-steps")
    total = out.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return out.join(F.broadcast(total) if total.count() <= MAX_BROADCAST_CELLS else total.hint("merge"), ["part", "own"]).drop("own")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
least AS (SELECT t, min(doc_id) AS m FROM d GROUP BY t),
f AS (
  SELECT w.doc_id, part, CAST(len(w) < 200 AS INT) AS A, CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) AS B,
    CAST(100 * (length(w.t) - length(regexp_replace(w.t, '[A-Z]', '', 'g'))) > 3 * length(w.t) AS INT) AS C,
    CAST(regexp_matches(w.t, '[#$%&*|]') AS INT) AS D, CAST(coalesce(w.doc_id > m, false) AS INT) AS E
  FROM w JOIN least ON w.t = least.t),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
n AS (SELECT part, A + 2 * B + 4 * C + 8 * D + 16 * E AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.b + q.b + r.b + s.b + t.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5),
steps AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
x AS (SELECT part, filter_order, step, own, n, good, toxic, mask, mask & own <> 0 AS fails, mask & CAST(before AS INT) <> 0 AS gone FROM n, steps),
y AS (
  SELECT part, filter_order, step, own,
    CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM y
"""
