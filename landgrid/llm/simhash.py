"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint bit is the majority of that bit over the hashes of all word shingles.
Bits that go together are grouped into parts. If the parts' thresholds sum to
(distance - parts + 1), any two fingerprints within the distance agree to within the
threshold in some part; a threshold of -1 leaves a part out. Thresholds are chosen by
dynamic programming on candidate counts estimated from all fingerprints.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_clear, materialise, read, row_keys, shared_dir
from .components import components
from .jaccard_join import with_components
from .shingles import BITS, shingle_hashes, simhash_of

#: A bucket with more fingerprints is probed by flipped bits: fewer rows than its pairs, and as exact.
MAX_PAIRED = 64


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Column of fingerprints (long); null and blank texts give 0."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([simhash_of(shingle_hashes(t or b"", shingle)) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())

    return of(text)


def bit_statistics(prints: DataFrame) -> np.ndarray:
    """64 x 64 shares of fingerprints with both bits set; partial sums leave each partition."""

    def partial(batches):
        both = np.zeros((BITS, BITS))
        for batch in batches:
            raw = np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
        yield pa.RecordBatch.from_pydict({"cell": np.arange(BITS * BITS), "n": both.ravel()})

    sums = prints.select("fp").mapInArrow(partial, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS)
    for row in sums:  # 4096 cells at any size
        both[row["cell"]] = row["n"]
    return both.reshape(BITS, BITS)


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Parts of equal width; each grows from the most balanced free bit by the bits most correlated with it."""
    mean = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    related = np.abs((both / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = (len(free) + parts - k - 1) // (parts - k)
        part = [max(sorted(free), key=lambda b: spread[b])]
        free.discard(part[0])
        while len(part) < width:
            part.append(max(sorted(free), key=lambda b: related[b, part].mean()))
            free.discard(part[-1])
        out.append(sorted(part))
    return out


def allocate(cost: list[list[float]], budget: int) -> list[int]:
    """Thresholds from -1 up, one per part, of the given sum and least total cost; cost[i][t + 1] for threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t, more in enumerate(row, start=-1):
                entry = (c + more, [*chosen, t])
                if used + t not in step or entry < step[used + t]:
                    step[used + t] = entry
        best = step
    return best[budget][1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def likely_parts(both: np.ndarray, n: int, distance: int) -> int:
    """The number of parts for which probes and pairs to compare are fewest, were bits independent; more fingerprints ask for wider parts."""
    mean = np.diag(both) / max(n, 1)
    differ = 2 * mean * (1 - mean)
    costs = []
    for parts in range(1, distance + 2):
        groups = group_bits(both, n, parts)
        equal = [float(n) * n * float(np.prod(1 - differ[g])) for g in groups]
        cost = [[0.0, *_part_costs(g, e, differ, n, distance)] for g, e in zip(groups, equal, strict=True)]
        chosen = allocate(cost, distance - parts + 1)
        costs.append((sum(row[t + 1] for row, t in zip(cost, chosen, strict=True)), parts))
    return min(costs)[1]


def _part_costs(group: list[int], equal: float, differ: np.ndarray, n: int, distance: int) -> list[float]:
    """Estimated cost of a part for thresholds from 0 to `distance`: pairs that share a probe key, and rows probed with."""
    odds, near, out = differ / np.maximum(1 - differ, 0.25), 1.0, []
    for t in range(distance + 1):
        near = 1.0 if t == 0 else near + odds[group].sum() ** t / math.factorial(t)
        out.append(equal * near + n * math.comb(len(group), t))
    return out


def probe_masks(prints: DataFrame, distance: int, parts: int | None) -> list[int]:
    """Bit masks: two fingerprints within the distance are equal under one of them at least."""
    n = prints.count()
    both = bit_statistics(prints)
    parts = parts or likely_parts(both, n, distance)
    groups = group_bits(both, n, parts)
    masks = [sum(1 << b for b in g) for g in groups]
    mean = np.diag(both) / max(n, 1)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(masks)]))
    counts = prints.select(keys.alias("k")).groupBy("k.part", "k.v").agg(F.count(F.lit(1)).alias("c"))
    equal = {r["part"]: float(r["pairs"]) for r in counts.groupBy("part").agg(F.sum(F.col("c") * F.col("c")).alias("pairs")).collect()}
    cost = [[0.0, *_part_costs(g, equal.get(i, 0.0), 2 * mean * (1 - mean), n, distance)] for i, g in enumerate(groups)]
    thresholds = allocate(cost, distance - parts + 1)
    return [masks[i] & ~sum(1 << b for b in away) for i, t in enumerate(thresholds) if t >= 0 for away in combinations(groups[i], t)]


def near_links(prints: DataFrame, distance: int = 2, parts: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect all pairs within the distance, and no others.

    Small buckets of one probe key are compared pairwise. Larger ones, at distance
    2: their fingerprints are sent to everything within half the distance of them;
    those that meet there are within the distance, and each such pair meets; a meeting
    point takes few fingerprints, so no bucket is too large. At other distances they
    are split again by the bits their key leaves free (see `split_links`). Without
    `parts`, their number follows from the number of fingerprints.
    """
    masks = probe_masks(prints, distance, parts)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("probe"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(masks)]))
    keyed = prints.select("fp", keys.alias("k")).select("fp", "k.probe", "k.v")
    paired, crowded = bucket_pairs(keyed, distance)
    if crowded is None:
        return paired.distinct()
    if distance != 2:
        return paired.unionAll(split_links(crowded, masks, distance)).distinct()
    spots = F.explode(F.array(F.lit(0), *[F.lit(_signed(1 << b)) for b in range(BITS)]))
    met = crowded.select("fp").distinct().select("fp", spots.alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("spot"))
    met = met.groupBy("spot").agg(F.collect_list("fp").alias("all")).where("size(all) > 1")  # 65 at most meet
    flipped = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return paired.unionAll(flipped.where(_close(distance))).distinct()


def _close(distance: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance


def bucket_pairs(keyed: DataFrame, distance: int) -> tuple[DataFrame, DataFrame | None]:
    """Close pairs (a, b) of the small buckets of (fp, probe, v), and the rows of larger ones, if there are any."""
    sizes = materialise(keyed.groupBy("probe", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-sizes")  # written, so that the join may split a large bucket
    shared = materialise(keyed.join(sizes.hint("merge"), ["probe", "v"]), "simhash-buckets")
    crowded = shared.where(F.col("n") > MAX_PAIRED).select("fp", "probe", "v")
    return _pairs(shared.where(F.col("n") <= MAX_PAIRED), distance), None if crowded.isEmpty() else crowded


def _pairs(shared: DataFrame, distance: int) -> DataFrame:
    left = shared.select("probe", "v", F.col("fp").alias("a"))
    right = left.withColumnRenamed("a", "b").hint("merge")
    return left.join(right, (left["probe"] == right["probe"]) & (left["v"] == right["v"]) & (F.col("a") < F.col("b")) & _close(distance)).select("a", "b")


def split_links(crowded: DataFrame, masks: list[int], distance: int, levels: int = 2) -> DataFrame:
    """Close pairs of the large buckets (fp, probe, v) of keys under `masks`.

    Members agree on the key's bits. Of the others, cut into distance + 1 pieces, a
    close pair agrees on one piece at least, by which buckets are split; `levels` times.
    What is still large then shares most of its bits, and is compared pairwise by a
    join that Spark may split; only close pairs leave it.
    """
    links = None
    for _ in range(levels):
        free = [[b for b in range(BITS) if not m >> b & 1] for m in masks]
        pieces = [(i, i * (distance + 1) + k, sum(1 << b for b in bits[k :: distance + 1])) for i, bits in enumerate(free) for k in range(distance + 1)]
        table = crowded.sparkSession.createDataFrame([(i, child, _signed(bits)) for i, child, bits in pieces], "probe int, child int, bits long")
        keyed = crowded.join(F.broadcast(table), "probe").select("fp", F.col("child").alias("probe"), F.xxhash64("v", F.col("fp").bitwiseAND(F.col("bits"))).alias("v"))
        paired, crowded = bucket_pairs(keyed, distance)
        links = paired if links is None else links.unionAll(paired)
        if crowded is None:
            return links
        masks = [masks[i] | bits for i, _, bits in pieces]
    return links.unionAll(_pairs(crowded, distance))


def near_duplicates(docs: DataFrame, *, shingle: int = 3, distance: int = 2, parts: int | None = None) -> DataFrame:
    """`docs` (doc_id, text and others) with fp (long) and component_id.

    component_id is the smallest doc_id reachable over links between fingerprints
    that differ in `distance` bits at most; equal fingerprints are linked. Null and blank
    texts have fingerprint 0; very long texts are read whole; ties go to the smaller
    doc_id. Repeated rows stay, each with the same result. Rows with null doc_id take
    part; a component of such rows alone has a null id. An empty table gives no rows.
    Input columns fp and component_id get `_in`.
    """
    docs = keep_clear(docs, "fp", "component_id")
    printed = materialise(docs.withColumn("fp", fingerprint(F.col("text"), shingle)).drop("text"), "simhash")
    prints = materialise(printed.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    reached = components(near_links(prints, distance, parts))
    roots = prints.join(reached.hint("merge"), prints["fp"] == reached["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    roots = materialise(roots, "simhash-roots")
    ids = materialise(roots.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-ids")
    classes = roots.join(ids.hint("merge"), "root").select("fp", "component_id")
    return printed.join(classes.hint("merge"), "fp")


def likely_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """Of (node, fp), pairs (a, b) that connect nodes whose fingerprints differ in `distance` bits at most: few for each node, to be verified."""
    first = materialise(nodes.groupBy("fp").agg(F.min("node").alias("first")), "simhash-distinct")
    alike = nodes.join(first.hint("merge"), "fp").select(F.col("node").alias("a"), F.col("first").alias("b")).where("a <> b")
    ends = [first.select(F.col("fp").alias(c), F.col("first").alias(f"n{c}")).hint("merge") for c in "ab"]
    near = near_links(first.select("fp"), distance).join(ends[0], "a").join(ends[1], "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    return materialise(near.unionAll(alike), "simhash-likely")


def one_of_each(docs: DataFrame, *, shingle: int = 5, distance: int = 2, least: int = 80) -> DataFrame:
    """One row of `docs` for each group of near copies, all columns as given.

    Texts are near copies if their sets of word shingles share `least` percent of their
    union, or if neither has a word. Fingerprints within `distance` bits propose pairs, the
    Jaccard join those that fingerprints miss; all are verified. The row with the smallest
    doc_id stays (ids go before nulls), of rows that share it the one with the least hash
    of the text, then of all columns. Only rows of kept ids and texts are told apart by
    all columns, so whole texts are shuffled once. An empty table gives no rows.
    """
    same = F.xxhash64("text").alias("same")
    found = with_components(docs.select("doc_id", "text", same), "root", shingle=shingle, least=least, prints=lambda nodes: likely_pairs(nodes, distance))
    found = materialise(found.select("doc_id", "row.same", "root"), "near-groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")
    best = found.groupBy("root").agg(F.min(order).alias("best"))
    held = found.groupBy("doc_id", "same").agg(F.count(F.lit(1)).alias("held"))
    best = best.select(F.col("best.doc_id").alias("_id"), F.col("best.same").alias("_same"))
    kept = best.join(held.hint("merge"), best["_id"].eqNullSafe(held["doc_id"]) & (best["_same"] == held["same"]))
    kept = materialise(kept.select("_id", "_same", "held"), "kept")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(*row_keys(docs)).alias("all"), "doc_id", same)
    met = rows.join(kept.hint("merge"), rows["doc_id"].eqNullSafe(kept["_id"]) & (rows["same"] == kept["_same"]))
    repeats = met.where("held > 1").groupBy("_id", "_same").agg(F.min_by("row", "all").alias("row"))
    return met.where("held = 1").select("row.*").unionAll(repeats.select("row.*"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
