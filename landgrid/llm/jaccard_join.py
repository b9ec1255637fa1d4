"""N-gram Jaccard join: all pairs of texts whose sets of word shingles are alike, exactly.

Sets that share `least` percent of their union share one of their rarest shingles: of n,
the first n - ceil(n * least / 100) + 1 in an order that all sets keep. Rarity is read off
counts of all shingles in a fixed number of hashed cells, so passages that many documents
share come last, whatever the order of the rest. Sets that meet at such a shingle are cut
into tiles of one size band; two can only be alike in the same band or in neighbouring
ones. In a tile, bit counts of hashed parity bitmaps bound the overlap from above; pairs
that may still be alike are decided by intersecting their sorted arrays.

Links are needed as far as they connect: each set is first tried with one likely partner,
and then only sets that are not connected yet meet in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, keep_clear, materialise, read, shared_dir, spare
from .components import components
from .shingles import simhash_of

#: Cells of the shingle counts: their number is fixed, 2 MB of counts at any size of the corpus.
CELL_BITS = 18
#: Buckets of one shingle with more sets than this are cut into tiles of at most about TILE.
MAX_PAIRED, TILE = 64, 1024
#: Tables of this many rows of two or three numbers (about 30 MB) are broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST_ROWS = 250_000
#: Widths of bitmaps, as powers of two; a set of n shingles takes 2n to 4n bits within these bounds.
NARROW, WIDE = 6, 15


#: Texts are taken from a batch so many at a time.
PIECE = 512
#: Words of more bytes are hashed one by one.
LONG_WORD = 64

_TIMES = np.random.default_rng(42).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_IN_WORD = bytes(0 if c in b" \t\n\v\f\r" else 1 for c in range(256))
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values ^= values >> np.uint64(32)
    values *= np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(29)
    return values


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text in UTF-8, A-Z lower-cased: its length, then its bytes, eight at a time, are mixed in."""
    lower = text.lower()
    none = np.zeros(1, np.int8)
    edges = np.flatnonzero(np.diff(np.frombuffer(lower.translate(_IN_WORD), np.int8), prepend=none, append=none))
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    out = _mixed(lengths.astype(np.uint64))
    padded = lower + bytes(8)
    eights = np.ndarray((len(lower) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    at = np.flatnonzero(lengths <= LONG_WORD)
    for done in range(0, LONG_WORD, 8):
        if not len(at):
            break
        left = lengths[at] - done
        out[at] = _mixed(out[at] ^ (eights[starts[at] + done] & _FIRST_BYTES[np.minimum(left, 8)]))
        at = at[left > 8]
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(lower[starts[i] : ends[i]], 7)
    return out


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """A 64-bit hash of each word shingle: those of its words, each times a number for its place, summed and mixed."""
    each = word_hashes(text or b"")
    if not len(each):
        return each
    width = min(shingle, len(each))
    count = len(each) - width + 1
    out = np.full(count, width, np.uint64)
    for i in range(width):
        out += each[i : i + count] * _TIMES[i % 64] + np.uint64(i // 64)
    return _mixed(out)


def different(hashes: np.ndarray) -> np.ndarray:
    """The sorted signed values, each once."""
    values = np.sort(hashes.view(np.int64))
    return values[np.diff(values, prepend=values[:1] - 1) != 0]


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            yield batch.slice(at, PIECE)


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The sorted signed hashes of a text's different shingles."""
    return different(shingle_hashes(text, shingle))


def node_of(found: np.ndarray) -> int:
    """The signed hash that stands for a set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).view(np.int64)) if len(found) else 0


def cells_of(found: np.ndarray) -> np.ndarray:
    return (found.view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int32)


def bitmap(found: np.ndarray) -> bytes:
    """One parity bit per hashed place; narrower bitmaps are the halves of wider ones, combined by exclusive or."""
    bits = min(max(int(2 * len(found) - 1).bit_length(), NARROW), WIDE)
    places = (found & ((1 << bits) - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=1 << bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def needed(sizes, least: int):
    """The least overlap of two sets, of sizes that sum to `sizes`, that makes them alike."""
    return -(-(sizes * least) // (100 + least))


def prefix_length(n: int, least: int) -> int:
    return n - -(-n * least // 100) + 1


def sketched(docs: DataFrame, shingle: int, prints: bool = False) -> tuple[DataFrame, np.ndarray]:
    """(`docs` without its text, with node and n, and fp if `prints`; count of shingles per cell). One pass over the texts.

    Counts leave each partition as one row of arrays beside those of its documents.
    """
    plain = T.StructType([f for f in docs.schema.fields if f.name != "text"])
    own = [T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType())]
    counted = [T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kept = np.zeros(1 << CELL_BITS, np.int64), None
        for batch in pieces(batches):
            nodes, sizes, fps, cells = [], [], [], [np.zeros(0, np.int32)]
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(text, shingle)
                found = different(hashes)
                nodes.append(node_of(found))
                sizes.append(len(found))
                fps.append(simhash_of(hashes) if prints else 0)
                cells.append(cells_of(found))
            total += np.bincount(np.concatenate(cells), minlength=1 << CELL_BITS)
            rest = batch.drop_columns(["text"])
            kept = rest.schema
            none = [pa.nulls(len(nodes), pa.list_(pa.int32())), pa.nulls(len(nodes), pa.list_(pa.int64()))]
            columns = [*rest.columns, pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), *none]
            yield pa.RecordBatch.from_arrays(columns, [*kept.names, "node", "n", "fp", "cells", "counts"])
        if kept is not None and total.any():
            held = np.flatnonzero(total)
            row = [*[pa.nulls(1, f.type) for f in kept], *[pa.nulls(1, pa.int64())] * 3, pa.array([held], pa.list_(pa.int32())), pa.array([total[held]], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(row, [*kept.names, "node", "n", "fp", "cells", "counts"])

    nullable = [T.StructField(f.name, f.dataType, True) for f in plain.fields]
    table = materialise(docs.mapInArrow(sketch, T.StructType([*nullable, *own, *counted])), "jaccard-sketch")
    pairs = table.where("cells is not null").select(F.explode(F.arrays_zip("cells", "counts")).alias("c"))
    counts = np.zeros(1 << CELL_BITS, np.int64)
    summed = pairs.groupBy("c.cells").agg(F.sum("c.counts").alias("n")).toArrow()  # at most one row per cell
    counts[summed["cells"].to_numpy()] = summed["n"].to_numpy()
    return table.where("cells is null").drop("cells", "counts", *([] if prints else ["fp"])), counts


def prefixes(docs: DataFrame, counts: np.ndarray, shingle: int, least: int) -> DataFrame:
    """(node, n, bits, prefix): each set once per task, with its bitmap and its rarest shingles."""

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches):
            rows = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = shingle_set(text, shingle)
                node = node_of(found)
                if len(found) and node not in seen:
                    seen.add(node)
                    first = np.lexsort((found, counts[cells_of(found)]))[: prefix_length(len(found), least)]
                    rows.append((node, len(found), bitmap(found), found[first]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["node", "n", "bits", "prefix"])

    return materialise(docs.select("text").mapInArrow(rarest, "node long, n long, bits binary, prefix array<long>"), "jaccard-prefixes")


def _few(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df.hint("merge")


def shared_buckets(prefixed: DataFrame) -> DataFrame:
    """(token, node, n, held, lo, hi): sets that share one of their rarest shingles with others, and the ends of that bucket."""
    tokens = prefixed.select("node", "n", F.explode("prefix").alias("token"))
    twice = materialise(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token"), "jaccard-tokens")
    rows = materialise(tokens.join(_few(twice), "token").distinct(), "jaccard-members")
    end = F.struct("node", "n")
    sizes = rows.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.min(end).alias("lo"), F.max(end).alias("hi")).where("held > 1")
    out = materialise(rows.join(materialise(sizes, "jaccard-sizes").hint("merge"), "token"), "jaccard-shared")
    discard(twice, rows)
    return out


def _sizes_fit(a: Column, b: Column, least: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * least


def overlap_bound(a: Column, b: Column, sizes: Column) -> Column:
    """The most shingles that sets with bitmaps `a` and `b`, of sizes that sum to `sizes`, can share."""

    @F.arrow_udf("long")
    def of(a: pa.Array, b: pa.Array, sizes: pa.Array) -> pa.Array:
        left, right = a.to_pylist(), b.to_pylist()
        kinds = np.array([(len(x), len(y)) for x, y in zip(left, right, strict=True)]).reshape(-1, 2)
        apart = np.zeros(len(left), np.int64)
        for kind in np.unique(kinds, axis=0):
            at = np.flatnonzero((kinds == kind).all(axis=1))
            xs, ys = (np.frombuffer(b"".join(side[i] for i in at), np.uint64).reshape(len(at), -1) for side in (left, right))
            narrow = min(xs.shape[1], ys.shape[1])
            apart[at] = np.bitwise_count(folded(xs, narrow) ^ folded(ys, narrow)).sum(axis=1, dtype=np.int64)
        return pa.array((sizes.to_numpy(zero_copy_only=False) - apart) // 2, pa.int64())

    return of(a, b, sizes)


def folded(rows: np.ndarray, width: int) -> np.ndarray:
    while rows.shape[1] > width:
        rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
    return rows


def common(xs: Column, ys: Column) -> Column:
    """The number of equal values in two sorted arrays."""

    @F.arrow_udf("long")
    def of(xs: pa.Array, ys: pa.Array) -> pa.Array:
        def lists(side):
            return side.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(side.value_lengths().to_numpy(zero_copy_only=False))])

        (x, at_x), (y, at_y) = lists(xs), lists(ys)
        out = []
        for i in range(len(xs)):
            a, b = x[at_x[i] : at_x[i + 1]], y[at_y[i] : at_y[i + 1]]
            near = np.minimum(np.searchsorted(b, a), len(b) - 1)
            out.append(int((b[near] == a).sum()))
        return pa.array(out, pa.int64())

    return of(xs, ys)


def star_pairs(shared: DataFrame, bitmaps: DataFrame, least: int, more: DataFrame | None = None) -> DataFrame:
    """(a, b): each set with the one, of its buckets' ends and of the pairs `more` (a, b), whose bitmap is nearest to its own."""
    met = shared.select(F.col("node").alias("a"), "n", F.explode(F.array("lo", "hi")).alias("end")).where((F.col("end.node") != F.col("a")) & _sizes_fit(F.col("n"), F.col("end.n"), least))
    met = met.select("a", F.col("end.node").alias("b"))
    rated = bounded((met if more is None else met.unionAll(more)).distinct(), bitmaps, least)
    return rated.groupBy("a").agg(F.max_by("b", F.struct("share", "b")).alias("b"))


def bounded(pairs: DataFrame, bitmaps: DataFrame, least: int) -> DataFrame:
    """Those `pairs` (a, b) that their bitmaps leave possible, with share: the bound's part of the sizes."""
    first = bitmaps.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xs")).hint("merge")
    second = bitmaps.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("ys")).hint("merge")
    both = pairs.join(first, "a").join(second, "b").where(_sizes_fit(F.col("na"), F.col("nb"), least))
    sizes = F.col("na") + F.col("nb")
    rated = both.select("a", "b", sizes.alias("sizes"), overlap_bound(F.col("xs"), F.col("ys"), sizes).alias("most"))
    return rated.where(F.col("most") * (100 + least) >= F.col("sizes") * least).select("a", "b", (F.col("most") / F.col("sizes")).alias("share"))


def small_pairs(open_: DataFrame, bitmaps: DataFrame, tried: DataFrame, least: int) -> DataFrame:
    """(a, b), a < b: possible pairs of sets not connected yet, of buckets that are compared whole."""
    left = open_.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    right = open_.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb")).hint("merge")
    on = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _sizes_fit(F.col("na"), F.col("nb"), least)
    pairs = left.join(right, "token").where(on).select("a", "b").join(tried.hint("merge"), ["a", "b"], "left_anti").distinct()
    return bounded(pairs, bitmaps, least).select("a", "b")


def tile_pairs(open_: DataFrame, bitmaps: DataFrame, least: int, best: bool) -> DataFrame:
    """(a, b), a < b: possible pairs of sets not connected yet, of large buckets; with `best` one of each two components and tile.

    A bucket's size band of h sets is dealt into h / TILE tiles; each tile meets the others
    of its band and of the next one, one task at a time.
    """
    band = (F.floor(F.log(F.col("n").cast("double")) / np.log(100.0 / least)) if least < 100 else F.col("n")).cast("int")
    rows = open_.select("token", "node", "n", "root", band.alias("band"))
    held = rows.groupBy("token", "band").agg(F.count(F.lit(1)).alias("h"))
    tiles = held.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("h") / TILE).cast("int")))).alias("tiles"))  # a few dozen bands
    rows = rows.join(materialise(tiles, "jaccard-tiles").hint("merge"), "token")
    count = lambda b: F.coalesce(F.try_element_at("tiles", b), F.lit(0))
    here, upper, lower = count(F.col("band")), count(F.col("band") + 1), count(F.col("band") - 1)
    own = F.pmod(F.xxhash64("node"), here).cast("int")
    each = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<struct<band:int,up:int,i:int,j:int,side:int>>"))
    spot = lambda b, up, i, j, side: F.struct(b.alias("band"), F.lit(up).alias("up"), i.alias("i"), j.alias("j"), side.alias("side"))
    one = F.lit(1)
    spots = F.concat(
        each(here, lambda j: spot(F.col("band"), 0, F.least(own, j), F.greatest(own, j), F.when(j >= own, 0).otherwise(1))),
        each(upper, lambda j: spot(F.col("band"), 1, own, j, one - 1)),
        each(lower, lambda i: spot(F.col("band") - 1, 1, i, own, one)),
    )
    dealt = rows.select("token", "node", "n", "root", F.explode(spots).alias("s")).select("token", "node", "n", "root", "s.*")
    dealt = dealt.join(bitmaps.select("node", "bits").hint("merge"), "node")

    def meet(tile: pa.Table) -> pa.Table:
        side, node, n, root = (tile.column(c).to_numpy() for c in ("side", "node", "n", "root"))
        bits = tile.column("bits").to_pylist()
        narrow = min(map(len, bits)) // 8
        words = np.concatenate([folded(np.frombuffer(b, np.uint64).reshape(1, -1), narrow) for b in bits])
        left = np.flatnonzero(side == 0)
        right = left if tile.column("up")[0].as_py() == 0 and tile.column("i")[0].as_py() == tile.column("j")[0].as_py() else np.flatnonzero(side == 1)
        found = [np.zeros((3, 0), np.int64)]
        step = max(1, (1 << 20) // max(1, len(right) * narrow))  # 8 MB at a time
        for at in range(0, len(left), step):
            some = left[at : at + step]
            apart = np.bitwise_count(words[some, None] ^ words[None, right]).sum(axis=2, dtype=np.int64)
            sizes = n[some, None] + n[None, right]
            most = (sizes - apart) // 2
            fit = (np.minimum(n[some, None], n[None, right]) * 100 >= np.maximum(n[some, None], n[None, right]) * least) & (most >= needed(sizes, least)) & (root[some, None] != root[None, right])
            i, j = np.nonzero(fit)
            found.append(np.stack([some[i], right[j], apart[i, j]]))
        i, j, apart = np.concatenate(found, axis=1)
        if best and len(i):
            order = np.lexsort((apart, np.maximum(root[i], root[j]), np.minimum(root[i], root[j])))
            ends = np.stack([np.minimum(root[i], root[j]), np.maximum(root[i], root[j])])[:, order]
            first = np.concatenate([[True], (ends[:, 1:] != ends[:, :-1]).any(axis=0)])
            i, j = i[order[first]], j[order[first]]
        return pa.table({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})

    return dealt.groupBy("token", "band", "up", "i", "j").applyInArrow(meet, "a long, b long")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, least: int) -> DataFrame:
    """Those `pairs` (a, b), a written table, that are alike. One text of each node is read again, from `docs` (id, text)."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = materialise(asked.join(nodes.select("node", "id").hint("merge"), "node"), "jaccard-asked")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [shingle_set(t, shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "found"])

    read_again = docs.join(_few(asked), "id").select("node", "text")
    sets = materialise(read_again.mapInArrow(sets_of, "node long, found array<long>").dropDuplicates(["node"]), "jaccard-sets")
    first, second = (sets.select(F.col("node").alias(c), F.col("found").alias(v)).hint("merge") for c, v in (("a", "xs"), ("b", "ys")))
    both = pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", (F.size("xs") + F.size("ys")).alias("sizes"), common(F.col("xs"), F.col("ys")).alias("common"))
    out = materialise(both.where(F.col("common") * (100 + least) >= F.col("sizes") * least).select("a", "b"), "jaccard-links")
    discard(asked, sets)
    return out


def linked(docs: DataFrame, sketch: DataFrame, counts: np.ndarray, shingle: int, least: int, likely: DataFrame | None = None) -> DataFrame:
    """(node, root): components of sets over all pairs that are alike; sets without any are left out.

    `docs` has id (long) and text, `sketch` id, node and n of the same rows. Pairs `likely`
    (a, b) of nodes may be given to be tried first.
    """
    nodes = materialise(sketch.where("n > 0").groupBy("node").agg(F.min("id").alias("id")), "jaccard-nodes")
    prefixed = prefixes(docs, counts, shingle, least)
    shared = shared_buckets(prefixed)
    met = shared.select("node").distinct() if likely is None else shared.select("node").unionAll(likely.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    bitmaps = materialise(prefixed.select("node", "n", "bits").join(met.hint("merge"), "node").dropDuplicates(["node"]), "jaccard-bitmaps")
    discard(prefixed)

    stars = star_pairs(shared, bitmaps, least, likely).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars = materialise(stars, "jaccard-stars")
    roots = materialise(components(verified(docs, nodes, stars, shingle, least)), "jaccard-roots")
    for best in (True, False):
        rooted = shared.select("token", "node", "n", "held").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = materialise(rooted, "jaccard-rooted")
        mixed = rooted.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("token")
        open_ = materialise(rooted.join(materialise(mixed, "jaccard-mixed").hint("merge"), "token"), "jaccard-open")  # buckets of one component have nothing to tell
        discard(rooted)
        crowded = open_.where(F.col("held") > MAX_PAIRED)
        large = None if crowded.isEmpty() else tile_pairs(crowded, bitmaps, least, best)
        pairs = [*([small_pairs(open_.where(F.col("held") <= MAX_PAIRED), bitmaps, stars, least)] if best else []), *([] if large is None else [large])]
        if pairs:
            pairs = materialise((pairs[0].unionAll(pairs[1]) if len(pairs) > 1 else pairs[0]).distinct(), "jaccard-pairs")
            more = None if pairs.isEmpty() else verified(docs, nodes, pairs, shingle, least)
            if more is not None and not more.isEmpty():
                links = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more)
                roots = materialise(components(links), "jaccard-roots")
        if large is None:
            break
    return roots


def jaccard_groups(docs: DataFrame, *, shingle: int = 5, least: int = 80) -> DataFrame:
    """`docs` (doc_id, text and others) without the text, with n_shingles (long) and component_id.

    Texts link when the sets of their word shingles (A-Z lower-cased, words between ASCII
    blanks) have at least `least` percent of their union in common; component_id is the
    smallest doc_id reachable. Texts with fewer words than a shingle have one, all their
    words; those without words, and nulls, have none and are linked with nothing. Texts are
    read whole; equal sets are one node, however many texts have it. Repeated rows stay,
    each with the same result. Rows with null doc_id take part; a component of such rows
    alone has a null id. Empty tables give no rows. Shingles are told apart by 64-bit
    hashes. Input columns n_shingles and component_id get the suffix `_in`.
    """
    docs = keep_clear(docs, "n_shingles", "component_id")
    root = spare(docs, "_root")
    out = with_components(docs, root, shingle=shingle, least=least)
    own = F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id"))
    names = [c for c in docs.columns if c != "text"]
    return out.select(*[f"row.`{c}`" for c in names], F.col("n").alias("n_shingles"), own.alias("component_id"))


def with_components(docs: DataFrame, root: str, *, shingle: int, least: int, prints=None) -> DataFrame:
    """(row, doc_id, n, fp, first, `root`): each row of `docs` without its text, its set's size, the smallest doc_id it reaches, and a
    number that its component shares with no other. Empty sets are one component here.

    `prints` may turn a table (node, fp) into pairs of nodes that are likely to be alike.
    """
    names = [c for c in docs.columns if c != "text"]
    keyed = docs.select(F.struct(*[f"`{c}`" for c in names]).alias("row"), "doc_id", F.xxhash64("doc_id", "text").alias("id"), "text")
    sketch, counts = sketched(keyed, shingle, prints is not None)
    likely = None if prints is None else prints(sketch.where("n > 0").select("node", "fp").distinct())
    roots = linked(keyed.select("id", "text"), sketch, counts, shingle, least, likely)
    ids = sketch.groupBy("node").agg(F.min("doc_id").alias("first"))
    placed = materialise(ids.join(roots.hint("merge"), "node", "left").select("node", "first", F.coalesce("root", "node").alias(root)), "jaccard-placed")
    firsts = materialise(placed.groupBy(root).agg(F.min("first").alias("first")), "jaccard-firsts")
    classes = materialise(placed.drop("first").join(firsts.hint("merge"), root), "jaccard-classes")
    return sketch.drop("id").join(classes.hint("merge"), "node").drop("node")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return jaccard_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS m FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.m = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id) f ON f.doc_id = w.doc_id
"""
