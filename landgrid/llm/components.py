"""Connected components by alternating large and small stars, on tables of links only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: A task contracts so many links at a time (16 MB).
CONTRACTED = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least): links of the same components in which every node but the least hangs on the least one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for side in (x, y, root[x], root[y]):  # hang both ends, and what they hang on, lower
            np.minimum.at(new, side, low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[hung], nodes[root[hung]]


def contracted(links: DataFrame) -> DataFrame:
    """`links` (a, b) with those of each task made into stars, so that fewer are shuffled and fewer rounds are needed."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            held = tuple(np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, "ab", strict=True))
            if len(held[0]) >= CONTRACTED:
                held = stars(*held)
                if len(held[0]) >= CONTRACTED // 2:  # too many components to hold
                    yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], ["a", "b"])
                    held = (held[0][:0], held[1][:0])
        yield pa.RecordBatch.from_arrays([pa.array(h) for h in stars(*held)], ["a", "b"])

    return links.select("a", "b").mapInArrow(contract, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a long, b long); root is the smallest node it can reach.

    Links are contracted within tasks first. Each round then lets every node point its
    larger neighbours, then its smaller ones, to the least node it sees, and contracts
    again; a logarithmic number of rounds leaves stars. Minima are aggregated map-side and
    written before they are joined back: both sides of that join come straight from
    shuffles, so Spark can split a hub's links over tasks. An empty table of links gives no
    nodes.
    """
    edges = materialise(contracted(links.where("a <> b")), "links")
    while not _are_stars(edges):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a")), "least")
        larger = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = materialise(larger.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "large-star")
        discard(least, edges)
        least = materialise(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = down.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(contracted(least.select("a", F.col("m").alias("b")).unionAll(moved)), "small-star")
        discard(least, down)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select("b", "b").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node (a) has one link, and none of the nodes linked to (b) has one. Links lead from larger to smaller nodes."""
    seen = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
    ups = seen.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
    return ups.where("up > 1 or up = 1 and least = 0").isEmpty()
