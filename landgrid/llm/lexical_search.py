"""Ranked lexical search by NRA: sequential reads of impact-sorted lists until the best k are certain.

Statistics of all documents (their number and length, and how many hold each term that is
asked for) take one pass. In a second pass each task searches the documents that it
reads, a batch at a time: lists of a query's terms are sorted by impact and read from the
top in ever larger steps, no document is ever looked up. What was read is the lower end of
a document's score; the next unread impact of each list that it was not seen in is what it
may still gain. Reading ends when every document whose upper end reaches the k-th best
lower end is known exactly, ties included, and no unseen one can reach it. What a task
found bounds its later batches; the best of all tasks are merged, k rows a task and query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read, shared_dir

#: Queries are asked in blocks of at most about so many bytes of text, which travel with the tasks.
BLOCK_BYTES = 32 << 20
#: Entries of each list that the first step reads; later steps double it.
FIRST_READ = 32
#: Partial results of a query are merged in so many groups first.
GROUPS = 64
#: Everything but digits, letters and bytes outside ASCII becomes a blank; A-Z become a-z.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def texts_of(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def corpus_statistics(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms of all documents, documents that hold each term of the vocabulary)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, df = 0, 0, np.zeros(len(vocabulary) + 2, np.int64)
        for batch in batches:
            for text in texts_of(batch):
                words = terms_of(text)
                held += bool(words)
                total += len(words)
                df[[vocabulary[w] for w in vocabulary.keys() & set(words)]] += 1
        df[-2:] = held, total
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"k": at, "n": df[at]})

    sums = docs.select("text").mapInArrow(partial, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # a row per term asked for
    df = np.zeros(len(vocabulary) + 2, np.int64)
    df[sums["k"].to_numpy()] = sums["n"].to_numpy()
    return int(df[-2]), int(df[-1]), df[:-2]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Lists:
    """Impact-sorted lists of a batch: for each term of the vocabulary its documents (rows of the batch), highest impact first."""

    def __init__(self, texts: list[bytes | None], vocabulary: dict[bytes, int], n_docs: int, n_terms: int):
        docs, terms, counts, lengths = [], [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = terms_of(text)
            lengths[i] = len(words)
            counted = Counter(words)
            for w in vocabulary.keys() & counted.keys():
                docs.append(i)
                terms.append(vocabulary[w])
                counts.append(counted[w])
        docs, terms, tf = (np.array(x, np.int64) for x in (docs, terms, counts))
        m = 25 + 75 * lengths * n_docs // max(n_terms, 1)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[docs])
        order = np.lexsort((-impact, terms))
        self.size, self.docs, self.impact = len(texts), docs[order], impact[order]
        self.begin = np.searchsorted(terms[order], np.arange(len(vocabulary) + 1))


def nra(lists: Lists, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, score) of all documents whose score is above 0, at least `floor` and among the k best of the batch, ties with the k-th included."""
    begin, end = lists.begin[terms], lists.begin[terms + 1]
    used = np.flatnonzero((weights > 0) & (end > begin))
    begin, end, weights = begin[used], end[used], weights[used]
    at, step = begin.copy(), FIRST_READ
    lower, seen = np.zeros(lists.size, np.int64), np.zeros((lists.size, len(used)), bool)
    while True:
        following = np.where(at < end, lists.impact[np.minimum(at, end - 1)], 0) * weights if len(used) else at
        unseen = int(following.sum())  # the most that a document can have that was not seen at all
        best = max(floor, int(np.partition(lower, -k)[-k]) if lists.size >= k else 0, 1)
        rows = np.flatnonzero(lower + unseen >= best) if unseen < best else np.arange(lists.size)
        gain = unseen - seen[rows] @ following
        rows, gain = rows[lower[rows] + gain >= best], gain[lower[rows] + gain >= best]
        if not gain.any():  # all that may be among the best are known exactly
            return rows, lower[rows]
        for i in np.flatnonzero(at < end):
            upto = min(end[i], at[i] + step)
            docs = lists.docs[at[i] : upto]  # a document is once in a list
            lower[docs] += weights[i] * lists.impact[at[i] : upto]
            seen[docs, i] = True
            at[i] = upto
        step *= 2


def search_block(docs: DataFrame, queries: list[tuple[int, bytes]], k: int) -> DataFrame:
    """(query, doc_id, score): the best k documents of each task for each query (number, text)."""
    asked = [(number, Counter(terms_of(text))) for number, text in queries]
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, counted in asked for w in counted}))}
    n_docs, n_terms, df = corpus_statistics(docs, vocabulary)
    w = np.array([weight(n_docs, int(n)) for n in df], np.int64)
    plans = []
    for number, counted in asked:
        terms = np.array([vocabulary[t] for t in counted], np.int64)
        plans.append((number, terms, np.array(list(counted.values()), np.int64) * w[terms]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple[int, float, int | None]]] = {}
        for batch in batches:
            lists, ids = Lists(texts_of(batch), vocabulary, n_docs, n_terms), batch.column("doc_id").to_pylist()
            for number, terms, weights in plans:
                top = found.get(number, [])
                rows, scores = nra(lists, terms, weights, k, -top[-1][0] if len(top) == k else 0)
                if len(rows):
                    new = ((-int(s), math.inf if ids[r] is None else ids[r], ids[r]) for r, s in zip(rows, scores, strict=True))
                    found[number] = sorted([*top, *new], key=lambda x: x[:2])[:k]
        flat = [(number, doc, -score) for number, top in found.items() for score, _, doc in top]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat, strict=True)], ["query", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(search, "query long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of `docs` (doc_id, text) with the highest scores above 0 for each of `items` (item_id, text).

    Terms are runs of digits, letters and characters outside ASCII, A-Z lower-cased, of
    whole texts; a term counts as often as the item repeats it. Null texts have none, and
    an item without terms, or none that a document holds, no rows. Ties go to the smaller doc_id,
    ids before null; repeated rows of `docs` rank each on their own; rows of `items` alike in
    id and text are one item, those with the same id and another text are ranked apart. Empty tables
    give no rows. Other columns are left alone.
    """
    asked = items.select("item_id", "text").where("text is not null").distinct()
    asked = materialise(asked.select(F.monotonically_increasing_id().alias("query"), "item_id", "text"), "search-items")
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    best = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "text").collect()  # a block of bounded size
        some = search_block(docs, [(r["query"], r["text"].encode()) for r in rows], k)
        best = some if best is None else best.unionAll(some)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    grouped = best.withColumn("part", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(GROUPS)))
    grouped = materialise(grouped, "search-best")
    some = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item_id").hint("merge"), "query").select("item_id", "rank", "doc_id", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = r"""
WITH dt AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
it AS (
  SELECT item_id, term, count(*) AS c FROM (
    SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term
    FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM dt),
tf AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM dt) WHERE term IN (SELECT term FROM it) GROUP BY ALL),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
x AS (
  SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * tf.n * s.n) // s.l)))) AS BIGINT) AS score
  FROM tf JOIN it USING (term) JOIN wt USING (term), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 10
"""
