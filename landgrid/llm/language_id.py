"""Language identification with blended-spectrum string kernels.

A text is the set of byte n-grams (lengths 1 to 5, hashed) that it holds anywhere;
the kernel of two texts is the size of their sets' overlap over the geometric mean of
their sizes. Landmark texts give Nyström features, on which one ridge regression per
language is fitted against the rest. The learned weights fold back into the n-gram
space (landmark sets x coefficients), so texts are scored by products of batches of
presence rows with one matrix.

A whole long text would fill its row, so sets are those of spans of bounded size: a
text's margins are the mean over its spans, without those that tell no language.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, keep_clear, materialise, read, shared_dir, spare

#: n-grams are hashed into so many bins.
BINS = 1 << 14
ORDERS = (1, 2, 3, 4, 5)
#: Bytes of a text that are hashed at a time; whole texts are read, piece by piece.
PIECE = 1 << 18
#: Most bytes of a text that share one presence row.
SPAN = 1 << 12
#: Smaller spans, read in turn where no larger one tells a language: words between junk.
FINER = (1 << 9, 1 << 7)
#: Spans of one sampled text that are learned from, evenly spaced; all spans of every text are scored.
LEARNED_SPANS = 4


def presence(text: str) -> np.ndarray:
    """The 0/1 row of the n-gram bins that occur in the lower-cased text."""
    return presence_of(text.lower().encode("utf-8", "replace"))


def spans(text: str, size: int | None = None) -> list[bytes]:
    """The lower-cased text in parts of about equal size; each reads on as far as n-grams that begin in it."""
    data = text.lower().encode("utf-8", "replace")
    n = max(1, -(-len(data) // (size or SPAN)))
    cuts = [len(data) * i // n for i in range(n + 1)]
    return [data[a : b + max(ORDERS) - 1] for a, b in zip(cuts, cuts[1:])]


def learned_spans(text: str) -> list[bytes]:
    """All spans of a short text, LEARNED_SPANS evenly spaced ones of a long one."""
    parts = spans(text)
    few = min(len(parts), LEARNED_SPANS)
    return [parts[len(parts) * i // few] for i in range(few)]


def presence_of(data: bytes) -> np.ndarray:
    seen = np.zeros(BINS, bool)
    data = np.frombuffer(data, np.uint8)
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE + max(ORDERS) - 1].astype(np.uint32)
        rolling = np.zeros(len(piece), np.uint32)
        for n in ORDERS:
            if len(piece) < n:
                break
            rolling = rolling[: len(piece) - n + 1] * np.uint32(0x01000193) ^ piece[n - 1 :]
            mixed = (rolling + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            seen[mixed >> np.uint32(32 - 14)] = True
    return seen


def scaled(rows: np.ndarray) -> np.ndarray:
    """Presence rows divided by the root of their sizes: products of two are kernel values."""
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1.0))


def leads(margins: np.ndarray) -> np.ndarray:
    """By how much the best margin of each row exceeds the second; infinite with one language."""
    if margins.shape[1] < 2:
        return np.full(len(margins), np.inf)
    top = np.partition(margins, -2, axis=1)
    return top[:, -1] - top[:, -2]


class Model:
    """Weights from n-gram bins to languages; spans whose best margin is negative or leads by less than `floor` tell none."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, warmth: float, floor: float = 0.0):
        self.languages, self.weights, self.bias, self.warmth, self.floor = languages, weights.astype(np.float32), bias, warmth, floor

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """One margin per presence row and language."""
        return scaled(rows.astype(np.float32)) @ self.weights + self.bias

    def tells(self, margins: np.ndarray) -> np.ndarray:
        """Whether a row of margins is that of a text in a learned language."""
        return (leads(margins) >= self.floor) & (margins.max(axis=1, initial=-np.inf) > 0)

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its share of the softmax, per row of margins."""
        margins = margins * self.warmth
        margins -= margins.max(axis=1, keepdims=True)
        odds = np.exp(margins)
        return odds.argmax(axis=1), odds.max(axis=1) / odds.sum(axis=1)


def fit(packed: np.ndarray, labels: list[str], landmarks: int, ridge: float, warmth: float = 8.0) -> Model:
    """Kernel ridge regression, one language against the rest, on Nyström features of evenly spaced landmarks.

    `packed` holds presence rows of eight bins a byte; they are unpacked a few at a time.
    """
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BINS, 0)), np.zeros(0), warmth)

    def rows(which) -> np.ndarray:
        return scaled(np.unpackbits(packed[which], axis=1).astype(np.float32))

    base = rows(np.unique(np.linspace(0, len(packed) - 1, min(landmarks, len(packed))).round().astype(int)))
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    good = values > values.max() * 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.vstack([rows(slice(at, at + 128)) @ base.T for at in range(0, len(packed), 128)]).astype(np.float64) @ root
    features = np.hstack([features, np.ones((len(features), 1))])
    wanted = np.array([[1.0 if label == language else -1.0 for language in languages] for label in labels])
    share = np.array([labels.count(language) for language in languages], float)
    weight = np.array([1.0 / share[languages.index(label)] for label in labels])[:, None]
    weight *= len(labels) / weight.sum()
    gram = features.T @ (features * weight) + ridge * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, features.T @ (wanted * weight))
    floor = float(np.median(leads(features @ solved))) / 4
    return Model(languages, base.T @ (root @ solved[:-1]).astype(np.float32), solved[-1], warmth, floor)


def least_hashes(usable: DataFrame, per_language: int, margin: int = 8) -> DataFrame:
    """(lang, cut): the per_language-th least hash h of each language of `usable` (lang, h), its largest if there are fewer.

    Hashes are even, so a bound that lets about `margin` times as many pass is known
    from a language's rows; where repeats leave too few below it, it is widened and
    the round run again. So no more than a bounded number is ever ranked per language.
    """
    spark = usable.sparkSession
    rows = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    shares = {lang: min(1.0, per_language * margin / n) for lang, n in rows.items()}
    cuts: dict[str, int] = {}
    while shares:
        bounds = [(lang, int(min(share * 2.0**64, 2.0**64 - 2**12)) - (1 << 63) if share < 1 else (1 << 63) - 1) for lang, share in shares.items()]
        below = usable.join(F.broadcast(spark.createDataFrame(bounds, "lang string, most long")), "lang").where("h <= most").select("lang", "h").distinct()
        ranked = below.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nth") <= per_language)
        found = {r["lang"]: (r["n"], r["cut"]) for r in ranked.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("cut")).collect()}
        for lang, share in list(shares.items()):
            n, cut = found.get(lang, (0, None))
            if n == per_language or share >= 1:
                cuts[lang] = cut
                del shares[lang]
            else:
                shares[lang] = min(1.0, share * 8)
    return spark.createDataFrame(list(cuts.items()), "lang string, cut long")


def train(labelled: DataFrame, *, per_language: int = 400, landmarks: int = 300, ridge: float = 0.1) -> Model:
    """Fit on at most `per_language` different rows (doc_id, text, lang) of each language, those of least hash.

    That bound makes the fitted sample, and what reaches the driver (2 kB a row), as
    large for any corpus (a long text gives LEARNED_SPANS rows); languages are expected to number hundreds at most. Hashes
    alone are ranked, so no text is shuffled.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))  # ids only deal out the sample
    hashes = materialise(usable.select("lang", "h"), "language-hashes")
    chosen = usable.join(F.broadcast(least_hashes(hashes, per_language)), "lang").where("h <= cut").select("lang", "h", "text")
    discard(hashes)

    def rows(batches):
        for batch in batches:
            parts = [(i, n, part) for i, t in enumerate(batch.column("text").to_pylist()) for n, part in enumerate(learned_spans(t))]
            at = pa.array([i for i, _, _ in parts], pa.int32())
            bits = pa.array([np.packbits(presence_of(part)).tobytes() for _, _, part in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(at), batch.column("h").take(at), pa.array([n for _, n, _ in parts], pa.int32()), bits], ["lang", "h", "n", "bits"])

    sample = chosen.mapInArrow(rows, "lang string, h long, n int, bits binary").groupBy("lang", "h", "n").agg(F.first("bits").alias("bits")).collect()
    sample.sort(key=lambda r: (r["h"], r["lang"], r["n"]))
    packed = np.frombuffer(b"".join(r["bits"] for r in sample), np.uint8).reshape(len(sample), BINS // 8)
    return fit(packed, [r["lang"] for r in sample], landmarks, ridge)


def text_margins(model: Model, texts, size: int = SPAN, finer=FINER, batch_rows: int = 64):
    """Pairs (position, margins) of an iterable of pairs (position, text), each text read to its end.

    Only spans that tell a language count, so that neither length nor a run of junk
    outweighs what a text says elsewhere. A text without any is read again in finer
    spans; if none of them tells one either, all count.
    """
    def pending():
        for i, text in texts:
            parts = spans(text, size)
            for k, part in enumerate(parts):
                yield i, text if k + 1 == len(parts) else None, presence_of(part)

    found, n, rest, count, again = 0.0, 0, 0.0, 0, {}
    rows = pending()
    while batch := list(islice(rows, batch_rows)):
        margins = model.margins(np.vstack([row for _, _, row in batch]))
        for (i, ended, _), row, tells in zip(batch, margins, model.tells(margins), strict=True):
            if tells:
                found, n = found + row, n + 1
            else:
                rest, count = rest + row, count + 1
            if ended is not None:
                if n or not finer:
                    yield i, found / n if n else rest / count
                else:
                    again[i] = ended
                found, n, rest, count = 0.0, 0, 0.0, 0
    if again:
        yield from text_margins(model, again.items(), finer[0], finer[1:], batch_rows)


def classified(model: Model):
    """Function of a text column: struct<lang: string, score: double> per text."""

    @F.arrow_udf("lang string, score double")
    def of(texts: pa.Array) -> pa.Array:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        told = ((i, t) for i, t in enumerate(texts.to_pylist()) if model.languages and t and any(map(str.isalpha, t)))
        for i, margins in text_margins(model, told):
            best, share = model.predict(margins[None])
            langs[i], scores[i] = model.languages[best[0]], float(share[0])
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return of


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 modulo 3; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def identify_languages(docs: DataFrame, **how) -> DataFrame:
    """`docs` with held_out, lang_pred and score; learned from its own labelled rows that are not held out.

    lang_pred is one of the learned values of lang, or "und" with score 0 for null
    texts, texts without a letter, and if nothing could be learned. The score is the
    best language's softmax share. Very long texts are read whole; repeated rows and
    ties get equal results, ties in score going to the first language; an empty table
    gives no rows. Input columns of these names get the suffix `_in`.
    """
    docs = keep_clear(docs, "held_out", "lang_pred", "score")
    return predicted(docs, learned(docs, **how))


def learned(docs: DataFrame, **how) -> Model:
    """The model of the labelled rows of `docs` that are not held out."""
    return train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), **how)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` (with none of the result's columns) with held_out, lang_pred and score."""
    found = spare(docs, "_found")
    out = docs.withColumn("held_out", held_out(F.col("doc_id"))).withColumn(found, classified(model)(F.col("text")))
    return out.withColumns({"lang_pred": F.col(f"{found}.lang"), "score": F.col(f"{found}.score")}).drop(found)


def in_known_language(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` whose language can be told; texts that are null or have no letter go.

    If nothing could be learned, as on an unlabelled corpus, all texts with a letter stay.
    """
    names, docs = docs.columns, keep_clear(docs, "held_out", "lang_pred", "score")
    model = learned(docs, **how)
    told = F.col("lang_pred") != "und" if model.languages else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return predicted(docs, model).where(told).select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_languages(docs).select("doc_id", "held_out", "lang_pred", "score")
