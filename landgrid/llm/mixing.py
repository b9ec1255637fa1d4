"""Mixing sources to target weights by balanced sampling (the cube method).

Each source's rate is target words / words it has, between 0 and 2. A document is
taken floor(rate) times, and once more if the sample picks it; its inclusion
probability is the fraction of the rate. The flight phase moves probabilities
along vectors of the null space of the balancing constraints (words and documents
of the source) until at most two documents of a block are left open.
What is left of all blocks flies again, block by block, until one block per source
remains; only there is a landing phase needed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_keys, keep_clear, materialise, n_plain_words, read, repeated, row_keys

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
#: Source tables up to this many rows are broadcast.
MAX_BROADCAST_SOURCES = 50_000


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: source, source_rows, source_size, target. `sized`: source, size and n, the number of equal rows.

    Sources by code point, null last, get the weights in turn. Capping and sharing
    the excess again ends where target = min(cap * size, level * weight), with one
    level for all; sorted by cap / weight, running sums give that level. Totals per
    source are ordered in one task, which holds some hundred bytes per source.
    """
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("source_rows"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    per = per.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    per = per.withColumn("capped", F.col("ratio") <= F.col("level"))
    per = per.withColumn("open", F.when(~F.col("capped"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level")))
    level = F.min("open").over(everything)["level"]
    return per.select("source", "source_rows", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("w")).alias("target"))


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Final probabilities; all are 0 or 1 if `land`, otherwise all but two at most.

    p: inclusion probabilities, x: words, longest first. Each step moves the longest
    open unit up or down at random and lets all other open units make up for it, along
    the projection of its axis on the null space of (documents, words), until a unit
    is settled. So long documents are settled early and the last open ones are short.
    Landing gives up the document total first, then lets one short document decide.
    """
    p, tiny = np.clip(np.asarray(p, float), 0.0, 1.0), 1e-9
    x = np.asarray(x, float) / max(1.0, float(np.max(x, initial=1.0)))
    p[p < tiny], p[p > 1 - tiny] = 0.0, 1.0
    open_ = np.flatnonzero((p > 0) & (p < 1))

    def settle(open_: np.ndarray, u: np.ndarray) -> np.ndarray:
        q = p[open_]
        with np.errstate(divide="ignore", invalid="ignore"):
            far, near = (1 - q) / u, -q / u  # where each would reach 1 and 0
        far, near = far[u != 0], near[u != 0]
        up, down = np.maximum(far, near).min(), -np.minimum(far, near).max()
        q = q + (u * up if rng.random() * (up + down) < down else -u * down)
        q[q < tiny], q[q > 1 - tiny] = 0.0, 1.0
        p[open_] = q
        return open_[(q > 0) & (q < 1)]

    def null_vector(open_: np.ndarray) -> np.ndarray:
        q, z = p[open_], x[open_]
        wide = q * (1 - q)
        n, t, tt = wide.sum(), wide @ z, (wide * z) @ z
        det = n * tt - t * t
        alike = det <= 1e-12 * n * tt  # equal sizes: the two constraints are one
        for k in range(len(open_)):
            u = -wide / n if alike else -wide * ((tt - t * z[k]) + (n * z[k] - t) * z) / det
            u[k] += 1.0
            if abs(u[k]) > 1e-6 and abs(u.sum()) < 1e-6 and abs(u @ z) < 1e-6:
                return u
        return np.zeros(len(open_))

    while len(open_) > 2 and (u := null_vector(open_)).any():
        open_ = settle(open_, u)
    while land and len(open_) > 1:
        i, j = open_[:2]
        pair = np.array([x[j], -x[i]]) if x[i] + x[j] > 0 else np.array([1.0, -1.0])
        open_ = np.concatenate([settle(open_[:2], pair), open_[2:]])
    if land and len(open_):
        p[open_] = float(rng.random() < p[open_[0]])
    return p


def closer(p: np.ndarray, x: np.ndarray, wanted: float, near: float = 0.005, most: int = 256) -> np.ndarray:
    """Landed probabilities with some units taken or left instead, so that the words come nearer to `wanted`; longest units first.

    Landing draws the last open unit; where that one weighs as much as a small source,
    the draw alone would miss the target by far. Units are changed by one or two as long
    as that helps, from what was drawn, and from each of the three longest taken alone.
    Totals within the share `near` stay as drawn.
    """
    if abs(x @ p - wanted) <= near * wanted:
        return p
    found = []
    for first in (None, 0, 1, 2):
        q = p.copy() if first is None else (np.arange(len(p)) == first).astype(float)
        while abs(miss := float(x @ q) - wanted) > near * wanted:
            step = np.where(q > 0.5, -x, x)[:most].astype(float)
            both = step[:, None] + step[None, :]
            np.fill_diagonal(both, step)
            i, j = np.unravel_index(np.argmin(np.abs(miss + both)), both.shape)
            if abs(miss + both[i, j]) >= abs(miss):
                break
            for k in {int(i), int(j)}:
                q[k] = 1.0 - q[k]
        found.append(q)
    return min(found, key=lambda q: abs(float(x @ q) - wanted))


def balanced_copies(sized: DataFrame, *, seed: int = 23, block_rows: int = 2048, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """`sized` (source, size long, any other narrow columns) plus source_size, target and copies.

    Rows alike in all columns are one unit: of n of them with rate r, floor(n r) copies
    are sure and the fraction is sampled, so a large group of copies costs no more than
    one row; the unit's copies are then dealt over its rows as evenly as whole numbers
    allow. A hash of the row seeds the draws and cuts the blocks, so reruns agree and a
    source that holds most rows is spread like any other. Null sources are a source of
    their own; empty tables give no rows.
    Columns called source_size, target or copies on input get the suffix `_in`.
    """
    sized = keep_clear(sized, "source_size", "source_rows", "target", "copies")
    units = materialise(sized.select(F.struct("*").alias("row"), "source", "size", *row_keys(sized)).groupBy("_k1", "_k2").agg(*[F.any_value(c).alias(c) for c in ("row", "source", "size")], F.count(F.lit(1)).alias("n")), "mix-units")
    taken = unit_copies(units, seed, block_rows, weights, share, cap)
    each = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("nth") < F.col("copies") % F.col("n"), 1).otherwise(0)
    once = taken.where("n = 1").select("row.*", "source_size", "target", F.col("copies").cast("int").alias("copies"))
    more = repeated(taken.where("n > 1"), F.col("n"), "nth").select("row.*", "source_size", "target", each.cast("int").alias("copies"))
    return once.unionAll(more)


def unit_copies(units: DataFrame, seed: int = 23, block_rows: int = 2048, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """`units` (_k1, _k2, source, size, n and others) with source_size, target and copies (long, of the n rows together)."""
    targets = materialise(source_targets(units, weights, share, cap), "mix-targets")
    n_sources, most = targets.agg(F.count(F.lit(1)), F.max("source_rows")).first()
    targets = targets.withColumnRenamed("source", "_source")
    small = F.broadcast(targets) if n_sources <= MAX_BROADCAST_SOURCES else targets.hint("merge")
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) * F.col("n")
    state = units.join(small, units["source"].eqNullSafe(F.col("_source")), "inner").drop("_source")
    state = state.withColumn("base", F.floor(mean)).withColumn("p", mean - F.floor(mean))

    def fly(land: bool, level: int):
        def block(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["_k1", "_k2", "size"], kind="stable").reset_index(drop=True)
            rng = np.random.Generator(np.random.PCG64([seed, level, int(group["_k1"].iloc[0]) & (2**63 - 1)]))
            # long documents are settled first, so that what is left to land is short
            order = np.lexsort((rng.random(len(group)), -group["size"].to_numpy()))
            p = np.empty(len(group))
            open_, size = group["p"].to_numpy()[order], group["size"].to_numpy()[order]
            landed = flight(open_, size, rng, land)
            free = np.flatnonzero((open_ > 0) & (open_ < 1))
            if land and len(free):
                landed[free] = closer(landed[free], size[free], float(size[free] @ open_[free]))
            p[order] = landed
            return group.assign(p=p)
        return block

    columns = ["_k1", "_k2", "source", "size", "n", "base", "p", "source_rows"]  # what a block needs; the rest waits
    rest = state.select("_k1", "_k2", *[c for c in state.columns if c not in columns])
    state, done, level = state.select(*columns), None, 0
    while True:
        blocks = max(1, -(-(most or 1) // block_rows))
        last = blocks == 1
        own = F.ceil(F.col("source_rows") / F.lit(float(block_rows) * (block_rows / 2) ** level)).cast("long")
        level += 1
        keyed = state.withColumn("block", F.pmod(F.xxhash64("_k1", "_k2", F.lit(seed + level)), F.greatest(own, F.lit(1))))
        flown = keyed.groupBy("source", "block").applyInPandas(fly(last, level), keyed.schema).drop("block")
        if last:
            break
        flown = materialise(flown, f"mix-level{level}")
        settled = flown.where(F.col("p").isin(0.0, 1.0))
        done = settled if done is None else done.unionByName(settled)
        state, most = flown.where(~F.col("p").isin(0.0, 1.0)), 2 * blocks
    done = flown if done is None else done.unionByName(flown)
    done = done.select("_k1", "_k2", (F.col("base") + F.round("p").cast("long")).alias("copies"))
    return done.hint("merge").join(rest, ["_k1", "_k2"]).join(units.select("_k1", "_k2", "source", "size", "n").hint("merge"), ["_k1", "_k2"])


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row of `docs` as often as the sample takes it, columns as given.

    Rows alike in all columns are interchangeable: the mix holds as many of them as it
    takes of all together, at most twice their number. Null or empty texts have size 0
    and no words to take; they follow the source's rate like any other row. Null
    sources are a source of their own; an empty table gives an empty mix.
    """
    keyed = docs.select(*row_keys(docs), "source", n_plain_words(F.col("text")).alias("size"))
    units = materialise(keyed.groupBy("_k1", "_k2").agg(F.any_value("source").alias("source"), F.any_value("size").alias("size"), F.count(F.lit(1)).alias("n")), "mix-units")
    taken = materialise(unit_copies(units, **how).select("_k1", "_k2", "n", "copies"), "mix-copies")
    hot = hot_keys(units, units.agg(F.sum("n")).first()[0] or 0)
    rows = docs.select(F.struct("*").alias("_row"), *row_keys(docs))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    if hot.isEmpty():
        cold = rows
    else:
        few = F.broadcast(hot)
        once = rows.join(few, ["_k1", "_k2"]).groupBy("_k1", "_k2").agg(F.any_value("_row").alias("_row")).join(taken.hint("merge"), ["_k1", "_k2"])
        copied = repeated(once, F.col("copies"), "_nth").select("_row")
        cold = rows.join(few, ["_k1", "_k2"], "left_anti")
    met = cold.join(taken.where("copies > 0").hint("merge"), ["_k1", "_k2"])
    out = met.where("n = 1").select("_row", times).select("_row")
    equal = met.where("n > 1").groupBy("_k1", "_k2").agg(F.any_value("_row").alias("_row"), F.any_value("copies").alias("copies"))
    out = out.unionAll(equal.select("_row", times).select("_row"))
    return (out if hot.isEmpty() else out.unionAll(copied)).select("_row.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("h"), n_plain_words(F.col("text")).alias("size"))
    mixed = balanced_copies(materialise(sized, "mix-sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies")
