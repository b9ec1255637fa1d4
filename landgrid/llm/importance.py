"""Quality selection by importance resampling with hashed n-gram models.

Words and word pairs are hashed into buckets; the target model counts the buckets in
texts known to be good, the raw model in all texts. A document's log-weight is the sum
of log(target / raw) over its n-grams; Gumbel noise added to it and a cut at the top k
draw k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read, shared_dir

BUCKETS = 10_000
#: Cells of a histogram, which is what reaches the driver in each round of the search for the cut.
CELLS = 4096
#: Bytes of text hashed at a time; a word longer than a piece is hashed in parts.
PIECE = 1 << 18
_R = 0x9E3779B97F4A7C15 | 1
_ZERO, _ONE = np.zeros(1, np.uint64), np.ones(1, np.uint64)  # uint64 throughout: mixed with int64 they would turn to floats
_TABLES: dict[str, np.ndarray] = {}
#: 0 blank or control, 1 letter, digit or outside ASCII, 2 punctuation.
_KINDS = np.array([0 if b <= 32 or b == 127 else 1 if b > 127 or chr(b).isalnum() else 2 for b in range(256)], np.int8)


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse; made where they are used, as they are too large to send along."""
    if not _TABLES:
        for name, base in (("powers", _R), ("inverses", pow(_R, -1, 1 << 64))):
            _TABLES[name] = np.concatenate([_ONE, np.cumprod(np.full(PIECE + 64, base, np.uint64))])
    return _TABLES["powers"], _TABLES["inverses"]


def pieces(data: bytes):
    """The text in pieces that end between words, each short of PIECE bytes."""
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            end = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end)) + 1 or end
        yield data[at:end]
        at = end


def ngram_counts(text: bytes) -> np.ndarray:
    """Counts of the hashed words and word pairs of a text, A-Z lower-cased.

    A word is a run of digits, letters and bytes outside ASCII, or a run of punctuation.
    """
    counts, last = np.zeros(BUCKETS, np.int64), None
    up, down = powers()
    with np.errstate(over="ignore"):
        for piece in pieces(text.lower()):
            data = np.frombuffer(piece, np.uint8)
            kind = np.concatenate([[0], _KINDS[data], [0]])
            edges = np.flatnonzero(kind[1:] != kind[:-1])  # runs of one kind; those of blanks are left out
            full = _KINDS[data[np.minimum(edges, len(data) - 1)]][:-1] > 0 if len(edges) else np.zeros(0, bool)
            start, end = edges[:-1][full], edges[1:][full]
            if not len(start):
                continue
            sums = np.concatenate([_ZERO, np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
            words = (sums[end] - sums[start]) * down[start]  # polynomial of each word, free of its place
            words ^= words >> np.uint64(29)
            words *= np.uint64(0xBF58476D1CE4E5B9)
            chain = words if last is None else np.concatenate([last, words])
            pairs = chain[:-1] * np.uint64(0x94D049BB133111EB) + chain[1:]
            pairs ^= pairs >> np.uint64(31)
            last = words[-1:]
            for hashed in (words, pairs):
                counts += np.bincount((hashed >> np.uint64(20)) % np.uint64(BUCKETS), minlength=BUCKETS)
    return counts


def bucket_sums(texts: DataFrame) -> np.ndarray:
    """n-gram counts of all rows' `text`, by bucket; one vector leaves each partition."""
    def partial(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                total += ngram_counts(t or b"")
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": full, "n": total[full]})

    rows = texts.select("text").mapInArrow(partial, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS)
    for row in rows:  # BUCKETS rows at any size
        out[row["bucket"]] = row["n"]
    return out


def log_weights(target: np.ndarray, raw: np.ndarray, smooth: float = 1.0):
    """Function of (text, whether it is one of the target's): sum of log(target / raw) and number of n-grams.

    A text's own counts are left out of both models, so that texts the target model
    was fitted on have no advantage over texts alike.
    """
    t_all, r_all = target.sum() + smooth * BUCKETS, raw.sum() + smooth * BUCKETS

    @F.arrow_udf("log_weight double, n_grams long")
    def of(texts: pa.Array, fitted: pa.Array) -> pa.Array:
        weights, sizes = [], []
        for t, own in zip(texts.cast(pa.binary()).to_pylist(), fitted.to_pylist(), strict=True):
            counts = ngram_counts(t or b"")
            at = np.flatnonzero(counts)
            c, n = counts[at], int(counts.sum())
            ratio = np.log((target[at] - own * c + smooth) / (raw[at] - c + smooth)) - np.log((t_all - own * n) / (r_all - n))
            weights.append(float(c @ ratio))
            sizes.append(n)
        return pa.StructArray.from_arrays([pa.array(weights, pa.float64()), pa.array(sizes, pa.int64())], ["log_weight", "n_grams"])
    return of


def kth_largest(scored: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest value of a double column, exactly: histograms of CELLS cells, each of the last one's cell."""
    low, high, n = scored.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n or k <= 0:
        return None
    left = min(k, n)
    while low < high:
        cell = F.least(F.floor((F.col(key) - low) / ((high - low) / CELLS)), F.lit(CELLS - 1))
        cells = scored.where(F.col(key).between(low, high)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for row in sorted(cells, key=lambda r: -r["cell"]):
            if left <= row["n"]:
                low, high = row["low"], row["high"]
                break
            left -= row["n"]
    return low


def resample(docs: DataFrame, good: DataFrame, *, share: float = 0.5, seed: int = 31, max_targets: int = 20_000) -> DataFrame:
    """doc_id, log_weight, n_grams, score and selected for every row of `docs`.

    `good` holds the doc_ids of texts of the target kind; at most `max_targets` of
    them, those of least hash, fit the target model, so their ids may be broadcast.
    The raw model counts all texts. score is the log-weight plus Gumbel noise from a hash
    of doc_id and text, so the share of rows with the largest scores is a draw without
    replacement in proportion to target / raw; rows that tie with the last one are
    selected, too.

    Null and blank texts have log-weight 0 and are never selected; without any good
    text all weights are equal. Very long texts are read whole. Equal rows have equal
    scores; an empty table gives no rows. Other columns are dropped.
    """
    docs = docs.select("doc_id", "text")
    few = good.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_targets)
    few = materialise(few, "importance-targets")
    known = docs.join(F.broadcast(few), "doc_id", "left_semi")
    target, raw = bucket_sums(known), bucket_sums(docs)
    if not target.sum():
        target = raw
    flagged = docs.join(F.broadcast(few.withColumn("fitted", F.lit(1))), "doc_id", "left")
    weighed = flagged.withColumn("_w", log_weights(target, raw)(F.col("text"), F.coalesce("fitted", F.lit(0)))).select("doc_id", "_w.log_weight", "_w.n_grams", gumbel(seed).alias("noise"))
    weighed = materialise(weighed, "importance")
    scored = weighed.withColumn("score", F.when(F.col("n_grams") > 0, F.col("log_weight") + F.col("noise")))
    cut = kth_largest(scored, "score", round(share * scored.where("n_grams > 0").count()))
    chosen = F.coalesce(F.col("score") >= F.lit(cut), F.lit(False)) if cut is not None else F.lit(False)
    return scored.select("doc_id", "log_weight", "n_grams", "score", chosen.alias("selected"))


def gumbel(seed: int) -> Column:
    """Gumbel noise of a row, from a hash of its doc_id and text."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(uniform))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many documents as labels lead to expect: the share of good quality among the labelled ones."""
    shared_dir(spark)
    labels = read(spark, sf_dir, "labels")
    share = labels.where("quality is not null").agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    return resample(read(spark, sf_dir, "documents"), labels.where("quality = 1 and toxic = 0"), share=share or 0.0)
