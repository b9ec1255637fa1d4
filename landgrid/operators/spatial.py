"""Linking points to villages: grid-cell joins, nearest villages, validation, reports."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo as G
from .lineage import cut, spread

#: Fixed values of the linkage, in metres.
CONTAINED_M, LINKED_M, DECLARED_M = 1000, 2000, 4000
_HALF_WORLD_M = math.pi * G.EARTH_KM * 1000 * 1.001


def _columns(row: Column, high: float, angle: float, fine: int) -> Column:
    """Number of cells around the world in a row of cells: as many as are wider than a `fine`th of the radius there, all round at the poles.

    Points at most `angle` (radians) apart differ in longitude by 2 asin(sin(angle / 2) /
    cos(latitude)) at most, for the highest latitude that either can have.
    """
    half = math.sin(min(angle, math.pi) / 2)
    top = F.least(F.lit(90.0), (F.greatest(F.abs(row), F.abs(row + 1)) + fine) * high)
    share = F.lit(half) / F.cos(F.radians(top))
    wide = F.degrees(F.asin(F.least(share, F.lit(1.0)))) * 2 * 1.0001
    return F.when((share >= 0.999) | (top >= 90), F.lit(1).cast("long")).otherwise(F.greatest(F.floor(F.lit(360.0 * fine) / wide), F.lit(1).cast("long")))


def _in_cells(df: DataFrame, x: str, radius_m: float, around: bool, fine: int = 1) -> DataFrame:
    """Rows with a valid place (`x`_lat, `x`_lng), each with its grid cell (_r, _c), a `fine`th of the radius wide, or once for each of the cells around that the radius can reach."""
    angle = radius_m / (G.EARTH_KM * 1000) * 1.0001
    high = min(math.degrees(angle), 180.0) / fine
    lat, lng = F.col(f"{x}_lat"), F.col(f"{x}_lng")
    place = F.floor((lng + 180) / 360 * F.col("_n"))
    row, steps = F.floor(lat / high), [F.lit(v) for v in range(-fine, fine + 1)]
    df = df.where(G.valid_latlng(lat, lng)).withColumn("_r", F.explode(F.array(*[row + v for v in steps])) if around else row)
    df = df.withColumn("_n", _columns(F.col("_r"), high, angle, fine))
    near = F.array(*[F.pmod(place + v, F.col("_n")) for v in steps])
    column = F.explode(F.when(F.col("_n") > 2 * fine, near).otherwise(F.array_distinct(near))) if around else F.pmod(place, F.col("_n"))
    return df.withColumn("_c", column).drop("_n")


def _placed(df: DataFrame, x: str) -> DataFrame:
    """Rows with a valid place (`x`_lat, `x`_lng), each computed once a row.

    Spark moves no filter past a generator; past a projection it does, and would work
    out costly places again for each condition on them. Neither column is nullable, which spares each pair the checks.
    """
    held = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)
    place = [f"{x}_lat", f"{x}_lng"]
    df = df.select(*[c for c in df.columns if c not in place], F.inline(F.array(F.struct(*map(held, place)))))
    return df.where(G.valid_latlng(*map(F.col, place)))


def _unit(df: DataFrame, x: str) -> DataFrame:
    """Valid places (`x`_lat, `x`_lng) with their point on the unit sphere, so that a pair needs no sine or cosine."""
    lat, lng = F.radians(f"{x}_lat"), F.radians(f"{x}_lng")
    return _placed(df, x).withColumns({f"_{x}1": F.cos(lat) * F.cos(lng), f"_{x}2": F.cos(lat) * F.sin(lng), f"_{x}3": F.sin(lat)})


def _chord2() -> Column:
    """Square of the straight distance of a pair's points on the unit sphere."""
    x, y, z = [F.col(f"_p{i}") - F.col(f"_f{i}") for i in (1, 2, 3)]
    return x * x + y * y + z * z


def _meters() -> Column:
    return G.distance_m(F.col("p_lat"), F.col("p_lng"), F.col("f_lat"), F.col("f_lng"))


def _reached(radius_m: float) -> Column:
    """Whether a pair is at most radius_m away: by its chord, and by `meters` where the chord is within a few micrometres of the radius."""
    chord = 2 * math.sin(min(radius_m / (G.EARTH_KM * 2000), math.pi / 2))
    return (_chord2() <= (chord + 1e-12) ** 2) & ((_chord2() <= max(chord - 1e-12, 0.0) ** 2) | (_meters() <= radius_m))


def _km4() -> Column:
    """`meters` in km, rounded to 4 decimals, of a pair at most 200 km apart.

    The series of the arc from its chord errs by less than 1e-5 of the last decimal; near a tie the rounding is that of `meters`.
    """
    a = _chord2() / 4
    up = F.sqrt(a) * (a * (a * (3 / 40) + 1 / 6) + 1) * (2 * G.EARTH_KM * 10_000) + 0.5
    return F.when(F.abs(up - F.rint(up)) < 1e-4, F.round(_meters() / 1000, 4)).otherwise(F.floor(up) / F.lit(10_000.0))


def km_within(points: DataFrame, features: DataFrame, radius_m: float, fine: int = 3, some: int = 10_000) -> DataFrame:
    """`points` (point, p_lat, p_lng, ...) joined to `features` (f_lat, f_lng, ...) at most radius_m (200 km or less) away, with `km` to 4 decimals.

    For results of many pairs. Cells are small, so that fewer candidates are left out than pairs are kept, and a pair costs
    a few products and a root. Rows are sorted by cell: a cell's features are at hand for all its points, and go to disk if
    they are too many. Cells are dealt over a task for every `some` points, as bytes say nothing about the pairs they make.
    """
    tasks = max(4 * points.sparkSession.sparkContext.defaultParallelism, -(-points.count() // some))
    p = _in_cells(_unit(spread(points, "point", some), "p"), "p", radius_m, True, fine).repartition(tasks, "_r", "_c")
    f = _in_cells(_unit(features, "f"), "f", radius_m, False, fine).repartition(tasks, "_r", "_c")
    met = p.join(f.hint("merge"), ["_r", "_c"]).where(_reached(radius_m))
    return met.withColumn("km", _km4()).drop("_r", "_c", *[f"_{x}{i}" for x in "pf" for i in (1, 2, 3)])


def within(points: DataFrame, features: DataFrame, radius_m: float, salts: int = 1, around: str = "p") -> DataFrame:
    """`points` (p_lat, p_lng, ...) joined to `features` (f_lat, f_lng, ...) at most radius_m away, with `meters`.

    Equality on grid cells a radius wide, fewer to a row the nearer it is to a pole, and
    joined at 180 degrees; points visit the nine cells around theirs, so no pair beyond
    two cells is looked at. Null and invalid places match nothing. With `salts`, the
    features of a cell are dealt over so many tasks: for few points and few, large cells. With
    `around` "f" the features are sent to nine cells instead: for points that are many more.
    """
    p, f, keys = _in_cells(points, "p", radius_m, around == "p"), _in_cells(features, "f", radius_m, around == "f"), ["_r", "_c"]
    if salts > 1:
        p = p.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        f = f.withColumn("_s", F.pmod(F.xxhash64("f_lat", "f_lng"), F.lit(salts)).cast("int"))
        keys.append("_s")
    return p.join(f.hint("shuffle_hash"), keys).withColumn("meters", _meters()).where(F.col("meters") <= radius_m).drop(*keys)


def first_within(points: DataFrame, features: DataFrame, radius_m: float, order: list[str], some: int = 8) -> DataFrame:
    """(p_id, first): of points (p_id, p_lat, p_lng) with any feature at most radius_m away, the first of those features by `order`, as a struct.

    For crowds: a cell has its features and those of the cells around in order, and a point meets only the
    first `some` of its cell. The first of them within the radius is the one; points without one meet the next, eight times as many.
    """
    cells = _in_cells(features, "f", radius_m, True)
    most = cells.groupBy("_r", "_c").count().agg(F.max("count")).first()[0] or 0
    place = F.row_number().over(Window.partitionBy("_r", "_c").orderBy(*order))
    meters = G.distance_m(F.col("p_lat"), F.col("p_lng"), F.col("f_lat"), F.col("f_lng"))
    left, out, seen = _in_cells(points, "p", radius_m, False), None, 0
    while True:
        next_ = cells.withColumn("_k", place).where((F.col("_k") <= some) & (F.col("_k") > seen))
        met = left.join(next_.hint("shuffle_hash"), ["_r", "_c"]).where(meters <= radius_m)
        met = met.groupBy("p_id", "_r", "_c").agg(F.min("_k").alias("_k"))  # numbers, not structs, for which Spark would sort all pairs
        found = met.join(next_.hint("shuffle_hash"), ["_r", "_c", "_k"]).groupBy("p_id").agg(F.min(F.struct(*order)).alias("first"))
        found = found if some >= most else cut(found)
        out = found if out is None else out.unionByName(found)
        if some >= most:
            return out
        left = cut(left.join(found.select("p_id").hint("merge"), "p_id", "left_anti"))
        if left.isEmpty():
            return out
        seen, some = some, some * 8


class _Strips:
    """Features (lat, lng) sorted by strips of latitude and by longitude within, to be searched around points near `middle`, a longitude."""

    def __init__(self, lat: np.ndarray, lng: np.ndarray, radius_m: float, middle: float) -> None:
        self.r = radius_m / (G.EARTH_KM * 1000)
        self.high = math.degrees(self.r) * (1 + 1e-9) / min(max(int(math.sqrt(len(lat)) / 4), 4), 128)
        self.middle, self.low = middle, lat.min()
        at = np.floor((lat - self.low) / self.high) * 1000 + self.side(lng)
        self.order = np.argsort(at)
        self.at, steps = at[self.order], math.ceil(math.degrees(self.r) / self.high) + 1
        self.around = np.arange(-steps, steps + 1)

    def side(self, lng: np.ndarray) -> np.ndarray:
        return (lng - self.middle + 540) % 360  # the middle is at 180

    def reached(self, lat: np.ndarray, lng: np.ndarray) -> tuple[np.ndarray, ...]:
        """(begin, first, second, end): for each point and strip around it, places in the sorted features.

        Those from begin to end are all that may be at most the radius away; those from first to second, nearer in
        longitude than any place at the radius, surely are.
        """
        r, low, high = self.r, self.low, self.high
        lat, lng = lat[:, None], lng[:, None]
        s = np.floor((lat - low) / high) + self.around
        south, north = np.radians(low + s * high), np.radians(low + (s + 1) * high)
        y = np.radians(lat)
        near, far = np.maximum(np.maximum(south - y, y - north), 0), np.maximum(np.abs(south - y), np.abs(north - y))
        top = np.minimum(np.maximum(np.abs(south), np.abs(north)), math.pi / 2)
        base = np.where(south * north <= 0, 0, np.minimum(np.abs(south), np.abs(north)))
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (math.sin(r / 2) ** 2 * (1 + 1e-9) - np.sin(near / 2) ** 2) / (np.cos(y) * np.cos(top))
            inner = (math.sin(r / 2) ** 2 * (1 - 1e-9) - np.sin(far / 2) ** 2) / (np.cos(y) * np.cos(base))
        hit = np.nan_to_num(out, nan=1, posinf=1, neginf=-1) >= 0
        wide = np.degrees(2 * np.arcsin(np.sqrt(np.clip(np.nan_to_num(out, nan=1, posinf=1), 0, 1)))) + 1e-6
        sure = np.degrees(2 * np.arcsin(np.sqrt(np.clip(np.nan_to_num(inner, nan=0, posinf=0, neginf=0), 0, 1)))) - 1e-6
        x, key = self.side(lng), s * 1000
        turned = (x - wide < 0) | (x + wide >= 360)  # reaches round the world: the whole strip is measured
        sure = np.where(turned | ~hit | (sure < 0), -1, sure)
        find = lambda v: np.searchsorted(self.at, v)
        begin, end = find(np.where(turned, key, key + x - wide)), find(np.where(turned, key + 999, key + x + wide))
        begin, end = np.where(hit, begin, 0), np.where(hit, end, 0)
        return begin, np.where(sure < 0, end, find(key + x - sure)), np.where(sure < 0, end, find(key + x + sure)), end


def _strips_count(p: tuple, f: tuple, radius_m: float) -> Iterator[np.ndarray]:
    """For slices of points (lat, lng), how many of the features (lat, lng, n) are at most radius_m away.

    In a strip, features that are surely within are counted by two searches, those beyond left out, and only those between measured.
    """
    (p_lat, p_lng), (f_lat, f_lng, n) = p, f
    strips = _Strips(f_lat, f_lng, radius_m, p_lng[0])
    f_lat, f_lng, n = f_lat[strips.order], f_lng[strips.order], n[strips.order]
    before = np.concatenate([[0], np.cumsum(n)])
    for i in range(0, len(p_lat), 2000):
        lat, lng = p_lat[i : i + 2000], p_lng[i : i + 2000]
        begin, first, second, end = strips.reached(lat, lng)
        found = (before[second] - before[first]).sum(axis=1)
        who = np.broadcast_to(np.arange(len(lat))[:, None], begin.shape)
        starts, sizes = np.concatenate([begin.ravel(), second.ravel()]), np.concatenate([(first - begin).ravel(), (end - second).ravel()])
        who, sums = np.concatenate([who.ravel(), who.ravel()]), np.cumsum(sizes)
        for a in _cuts(sums, 2_000_000):
            pairs, w = _ranges(starts[a], sizes[a]), np.repeat(who[a], sizes[a])
            inside = _meters_of(lat[w], lng[w], f_lat[pairs], f_lng[pairs]) <= radius_m
            found = found + np.bincount(w[inside], weights=n[pairs[inside]], minlength=len(lat)).astype("int64")
        yield found


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _meters_of(lat: np.ndarray, lng: np.ndarray, f_lat: np.ndarray, f_lng: np.ndarray) -> np.ndarray:
    u, v = np.sin(np.radians(f_lat - lat) / 2), np.sin(np.radians(f_lng - lng) / 2)
    h = u * u + np.cos(np.radians(lat)) * np.cos(np.radians(f_lat)) * v * v
    return 2 * G.EARTH_KM * np.arctan2(np.sqrt(h), np.sqrt(1.0 - h)) * 1000


def _cuts(sums: np.ndarray, most: int) -> list[slice]:
    """Slices of about `most` by running sums."""
    ends = np.searchsorted(sums, np.arange(most, sums[-1] + most, most)) + 1
    edges = np.unique(np.minimum(np.concatenate([[0], ends]), len(sums)))
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _tile_of(lng: Column) -> Column:
    """Number of the column of tiles, of the `_n` of its row, counted on past 180 degrees."""
    return F.floor((lng + 180) / 360 * F.col("_n"))


def _tiles_in_row(tile: float) -> Column:
    top = F.least(F.abs(F.col("_r")), F.abs(F.col("_r") + 1)) * tile
    return F.greatest(F.floor(F.cos(F.radians(top)) * (360 / tile)), F.lit(1)).cast("long")


def _in_tile(df: DataFrame, x: str, tile: float) -> DataFrame:
    """Rows (`x`_lat, `x`_lng) with their tile (_r, _c): `tile` degrees high and about as far from side to side."""
    df = df.withColumn("_r", F.floor(F.col(f"{x}_lat") / tile)).withColumn("_n", _tiles_in_row(tile))
    return df.withColumn("_c", F.pmod(_tile_of(F.col(f"{x}_lng")), F.col("_n"))).drop("_n")


def _in_tiles_around(df: DataFrame, x: str, tile: float, reach: float) -> DataFrame:
    """Rows once for each tile with any place at most `reach` degrees, a tile or less, away."""
    lat, lng = F.col(f"{x}_lat"), F.col(f"{x}_lng")
    row = lambda lat: F.floor(lat / tile)
    share = F.lit(math.sin(min(math.radians(reach), math.pi) / 2)) / F.cos(F.radians(F.least(F.lit(90.0), F.abs(lat) + reach)))
    wide = F.when((share >= 0.999) | (F.abs(lat) + reach >= 90), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(share, F.lit(1.0)))) * 2 * 1.0001)
    df = df.withColumn("_w", wide).withColumn("_r", F.explode(F.array_distinct(F.array(row(lat - reach), row(lat), row(lat + reach))))).withColumn("_n", _tiles_in_row(tile))
    seen = F.transform(F.sequence(_tile_of(lng - F.col("_w")), _tile_of(lng + F.col("_w"))), lambda c: F.pmod(c, F.col("_n")))
    return df.withColumn("_c", F.explode(F.array_distinct(seen))).drop("_n", "_w")


def count_within(points: DataFrame, features: DataFrame, radius_m: float, most: int = 300_000) -> DataFrame:
    """(point, features): for points (point, p_lat, p_lng) with any, how many features are at most radius_m away; no pairs are made.

    Places are counted once, and sent to the tiles of a degree or more that they can reach; tiles with more than about
    `most` places or points are dealt over several groups, whose counts are added.
    """
    reach = math.degrees(radius_m / (G.EARTH_KM * 1000)) * 1.0001
    tile = max(1.0, reach)
    p = points.where(G.valid_latlng(F.col("p_lat"), F.col("p_lng")))
    f = cut(features.where(G.valid_latlng(F.col("f_lat"), F.col("f_lng"))).groupBy("f_lat", "f_lng").agg(F.count(F.lit(1)).alias("n")))

    def parts(df: DataFrame, x: str) -> int:
        in_tile = df.groupBy(F.floor(F.col(f"{x}_lat") / tile), F.floor(F.col(f"{x}_lng") / tile)).count()
        return max(1, -(-(in_tile.agg(F.max("count")).first()[0] or 1) // most))

    deal_p, deal_f = parts(p, "p"), parts(f, "f")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda x, n: F.pmod(F.xxhash64(f"{x}_lat", f"{x}_lng"), F.lit(n)).cast("int")
    p = _in_tile(p, "p", tile).withColumn("_p", F.pmod(F.xxhash64("point", "p_lat", "p_lng"), F.lit(deal_p)).cast("int")).withColumn("_f", every(deal_f))
    f = _in_tiles_around(f, "f", tile, reach).withColumn("_f", mine("f", deal_f)).withColumn("_p", every(deal_p))
    kind, keys = points.schema["point"].dataType.simpleString(), ["_r", "_c", "_p", "_f"]

    def count(here: pa.Table, there: pa.Table) -> pa.Table:
        found = np.zeros(here.num_rows, "int64")
        if here.num_rows and there.num_rows:
            arrays = [t.column(c).to_numpy() for t, c in ((here, "p_lat"), (here, "p_lng"), (there, "f_lat"), (there, "f_lng"), (there, "n"))]
            found = np.concatenate(list(_strips_count(tuple(arrays[:2]), tuple(arrays[2:]), radius_m)))
        return pa.table({"point": here.column("point"), "features": found})

    met = p.select("point", "p_lat", "p_lng", *keys).groupBy(*keys).cogroup(f.select("f_lat", "f_lng", "n", *keys).groupBy(*keys))
    counted = met.applyInArrow(count, f"point {kind}, features long")
    return counted.where("features > 0").groupBy("point").agg(F.sum("features").alias("features"))


def _ticks(d2: np.ndarray, meters) -> np.ndarray:
    """Km in ten thousandths, rounded as in `_km4`, of pairs with such squares of chords; `meters` gives those of some of them."""
    a = d2 / 4
    up = np.sqrt(a) * (a * (a * (3 / 40) + 1 / 6) + 1) * (2 * G.EARTH_KM * 10_000) + 0.5
    out = np.floor(up).astype(np.int64)
    ties = np.flatnonzero(np.abs(up - np.rint(up)) < 1e-4)
    km = meters(ties) / 1000
    out[ties] = [int(Decimal(x).scaleb(4).to_integral_value(ROUND_HALF_UP)) for x in map(repr, km.tolist())]
    return out


class _Near:
    """The features of a tile, (_lat, _lng) and `columns`, of which `batches` hold all, at hand for the tile's points."""

    def __init__(self, batches: list[pa.RecordBatch], columns: list[str], order: list[str] | None, radius_m: float, middle: float) -> None:
        rows = pa.Table.from_batches(batches).combine_chunks()
        if order is not None:
            rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
        lat, lng = (rows.column(c).to_numpy() for c in ("_lat", "_lng"))
        self.columns = [rows.column(c).combine_chunks() for c in columns]
        self.strips, self.ranked, self.radius_m = _Strips(lat, lng, radius_m, middle), order is not None, radius_m
        self.lat, self.lng, self.place = lat[self.strips.order], lng[self.strips.order], self.strips.order.astype(np.int64)
        self.at = _on_sphere(self.lat, self.lng)

    def pairs(self, points: pa.RecordBatch, most: int) -> Iterator[list[pa.Array]]:
        """Columns of the pairs of some points, about `most` rows at a time: point, those of the features, km and, if ranked, rank."""
        p_lat, p_lng = (points.column(c).to_numpy() for c in ("_lat", "_lng"))
        for i in range(0, len(p_lat), 2000):
            lat, lng = p_lat[i : i + 2000], p_lng[i : i + 2000]
            begin, _, _, end = self.strips.reached(lat, lng)
            for a in _cuts(np.cumsum((end - begin).sum(axis=1)), most):
                who, feature, ticks = self._within(lat[a], lng[a], begin[a], end[a] - begin[a])
                rank = None
                if self.ranked:
                    who, feature, ticks, rank = self._sorted(who, feature, ticks)
                for k in range(0, len(who), most):
                    some = slice(k, k + most)
                    found = [points.column("point").take(pa.array(who[some] + (i + a.start))), *[c.take(pa.array(feature[some])) for c in self.columns], pa.array(ticks[some] / 10_000.0)]
                    yield found if rank is None else [*found, pa.array(rank[some], pa.int32())]

    def _within(self, lat: np.ndarray, lng: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(point, feature, km in ten thousandths) of the pairs of these points with the features from `begin` on that are near enough."""
        who = np.repeat(np.arange(len(lat)), sizes.sum(axis=1))
        pairs = _ranges(begin.ravel(), sizes.ravel())
        d2 = sum((p[who] - f[pairs]) ** 2 for p, f in zip(_on_sphere(lat, lng), self.at, strict=True))
        meters = lambda x: _meters_of(lat[who[x]], lng[who[x]], self.lat[pairs[x]], self.lng[pairs[x]])
        chord = 2 * math.sin(self.radius_m / (G.EARTH_KM * 2000))
        near = d2 <= (chord + 1e-12) ** 2
        edge = np.flatnonzero(near & (d2 > max(chord - 1e-12, 0.0) ** 2))
        near[edge] = meters(edge) <= self.radius_m
        near = np.flatnonzero(near)
        who, pairs, d2 = who[near], pairs[near], d2[near]
        return who, self.place[pairs], _ticks(d2, meters)

    def _sorted(self, who: np.ndarray, feature: np.ndarray, ticks: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pairs by point, km and place in the features' order, with their rank: sorted as one number each."""
        bits = len(self.place).bit_length()
        km_bits = int(self.radius_m * 10 + 2).bit_length()
        keys = np.sort((who << (km_bits + bits)) | (ticks << bits) | feature)
        who = keys >> (km_bits + bits)
        first = np.flatnonzero(np.diff(who, prepend=-1))
        rank = np.arange(1, len(who) + 1) - np.repeat(first, np.diff(first, append=len(who)))
        return who, keys & ((1 << bits) - 1), (keys >> bits) & ((1 << km_bits) - 1), rank


def _on_sphere(lat: np.ndarray, lng: np.ndarray) -> tuple[np.ndarray, ...]:
    lat, lng = np.radians(lat), np.radians(lng)
    return np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)


def dealt(points: DataFrame, features: DataFrame, radius_m: float, most: int = 500_000, some: int = 50_000, alone: bool = False) -> tuple[DataFrame, DataFrame | None, int]:
    """(points and features by tile; points left to a join; number of rows): `features` go to the tiles that they reach, `points` to their own.

    Rows have a tile (_r, _c), a part of it (_p), _side (0: feature, 1: point), _lat, _lng and the columns of their side. Tiles are
    smaller where many features lie, and their points dealt over parts of about `some`. Points of tiles that still hold more
    than `most` features are left to a join; `alone`, so are those that share an id.
    """
    reach = math.degrees(radius_m / (G.EARTH_KM * 1000)) * 1.0001
    p, placed, tile, keys, apart = _placed(points.select("point", "p_lat", "p_lng"), "p"), _placed(features, "f"), max(2.0, reach), ["_r", "_c"], None
    while True:
        f = _in_tiles_around(placed, "f", tile, reach)
        held = cut(f.groupBy(*keys).agg(F.count(F.lit(1)).alias("_held")))
        n, largest = held.agg(F.sum("_held"), F.max("_held")).first()
        if (largest or 0) <= most or tile / 2 < reach:
            break
        tile /= 2
    p = _in_tile(p, "p", tile)
    shared = cut(points.groupBy("point").count().where("count > 1").select(F.col("point").alias("_shared"))) if alone else None
    if shared is not None and not shared.isEmpty():
        on = F.col("point").eqNullSafe(F.col("_shared"))
        apart, p = p.join(shared.hint("merge"), on, "left_semi"), p.join(shared.hint("merge"), on, "left_anti")
    if (largest or 0) > most:
        crowded = F.broadcast(held.where(F.col("_held") > most).select(*keys))
        left = p.join(crowded, keys, "left_semi")
        apart, p, f = left if apart is None else apart.unionByName(left), p.join(crowded, keys, "left_anti"), f.join(crowded, keys, "left_anti")
    large = cut(p.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / some).cast("int").alias("_parts")).where("_parts > 1"))
    if large.isEmpty():
        p, f = p.withColumn("_p", F.lit(0)), f.withColumn("_p", F.lit(0))
    else:
        parts, large = F.coalesce("_parts", F.lit(1)), F.broadcast(large)
        p = p.join(large, keys, "left").withColumn("_p", F.pmod(F.xxhash64("point", "p_lat", "p_lng"), parts).cast("int")).drop("_parts")
        f = f.join(large, keys, "left").withColumn("_p", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    own = lambda df, x, side: df.withColumnsRenamed({f"{x}_lat": "_lat", f"{x}_lng": "_lng"}).withColumn("_side", F.lit(side))
    return own(f, "f", 0).unionByName(own(p, "p", 1), allowMissingColumns=True), apart, n or 0


def near(points: DataFrame, features: DataFrame, radius_m: float, order: list[str] | None = None, most: int = 500_000, some: int = 50_000, rows: int = 250_000) -> DataFrame:
    """(point, the features' columns, km to 4 decimals): `points` (point, p_lat, p_lng) with all `features` (f_lat, f_lng, ...) at most radius_m (200 km or less) away.

    With `order`, also rank (from 1) among all of a point's features, by km, then `order`.

    For results of many pairs: a task makes and ranks those of a tile (see `dealt`), a few points at a time, so neither
    pairs nor copies of points are shuffled or stored. Where tiles are too crowded for that, or points share an id,
    pairs are those of `km_within`, ranked by a window that may go to disk.
    """
    both, apart, n = dealt(points, features, radius_m, most, some, order is not None)
    tile, columns = ["_r", "_c", "_p"], [c for c in features.columns if c not in ("f_lat", "f_lng")]
    tasks = max(4 * points.sparkSession.sparkContext.defaultParallelism, -(-n // rows))
    kinds = {f.name: f.dataType for f in both.schema.fields}
    fields = [T.StructField(c, kinds[c]) for c in ("point", *columns)] + [T.StructField("km", T.DoubleType())] + ([T.StructField("rank", T.IntegerType())] if order is not None else [])
    names = [f.name for f in fields]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, at_hand = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in (*tile, "_side")])
            edges = np.flatnonzero((np.diff(keys, prepend=keys[:, :1] - 1) != 0).any(axis=0))
            for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                part, side = batch.slice(a, b - a), keys[3, a]
                if here != tuple(keys[:3, a]):
                    here, held, at_hand = tuple(keys[:3, a]), [], None
                if side == 0:
                    held.append(part.select(["_lat", "_lng", *columns]))
                elif held:
                    at_hand = at_hand or _Near(held, columns, order, radius_m, part.column("_lng")[0].as_py())
                    for found in at_hand.pairs(part, rows):
                        yield pa.RecordBatch.from_arrays(found, names)

    out = both.repartition(tasks, *tile).sortWithinPartitions(*tile, "_side").mapInArrow(pairs, T.StructType(fields))
    if apart is not None:
        met = km_within(apart.select("point", "p_lat", "p_lng"), features, radius_m)
        if order is not None:
            met = met.withColumn("rank", F.row_number().over(Window.partitionBy("point").orderBy("km", *order)))
        out = out.unionByName(met.select(*names))
    return out


def _as_points(df: DataFrame) -> DataFrame:
    return df.where(G.valid_latlng(F.col("latitude"), F.col("longitude"))).select(F.col("id").alias("p_id"), F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lng"))


def _as_features(villages: DataFrame) -> DataFrame:
    return villages.where(G.valid_latlng(F.col("latitude"), F.col("longitude"))).select(F.col("id").alias("v_id"), F.col("name").alias("v_name"), "district_id", F.col("latitude").alias("f_lat"), F.col("longitude").alias("f_lng"))


def containing_village(points: DataFrame, villages: DataFrame) -> DataFrame:
    """(id, village): the first village by name, then id, within 1000 m; points without one are left out."""
    near = within(_as_points(points), _as_features(villages), CONTAINED_M)
    return near.groupBy(F.col("p_id").alias("id")).agg(F.min_by("v_id", F.struct("v_name", "v_id")).alias("village"))


def _spacing_m(features: DataFrame, k: int = 1) -> float:
    """A radius within which most features have a few more than `k` others.

    At first the side of a square that holds as many, over the degree cells that hold any;
    then it shrinks until a feature shares its cell, this radius wide, with few enough.
    """
    few = 2 + 0.6 * k
    cells = F.count_distinct(F.floor("f_lat"), F.floor("f_lng"))
    n, held = features.agg(F.count(F.lit(1)), cells).first()
    if not n:
        return _HALF_WORLD_M
    side = 111_000.0 * math.sqrt(held / n * few)
    while side > 1:
        in_cell = features.groupBy(*[F.floor(F.col(c) * (111_000.0 / side)).alias(c) for c in ("f_lat", "f_lng")]).count()
        shared = in_cell.agg(F.sum(F.col("count") * F.col("count")) / n).first()[0]
        if shared <= 1.5 * few:
            break
        side *= max(math.sqrt(few / shared), 0.1)
    return side


def nearest_few(points: DataFrame, features: DataFrame, k: int, radius_m: float, order: list[str]) -> DataFrame:
    """Of `within`, each point's first `k` features by km (4 decimals), then `order`: with km and rank. `points` have a column point.

    Places are counted in rounds of ever larger radii, the first from their density: a point
    with `k` features within a share of the radius needs none beyond it. Pairs are then made
    within that reach alone, so they grow with points and `k`, not with features. Of the
    features of one place only the first `k` can count.
    """
    one_place = Window.partitionBy("f_lat", "f_lng").orderBy(*order)
    f = features.where(G.valid_latlng(F.col("f_lat"), F.col("f_lng"))).withColumn("_k", F.row_number().over(one_place)).where(F.col("_k") <= k).drop("_k")
    f = cut(f)
    places = cut(f.groupBy("f_lat", "f_lng").agg(F.count(F.lit(1)).alias("_m")))
    shares, pairs, left, radius = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0), None, points, _spacing_m(places, k)
    while True:
        last = radius >= radius_m
        if last:
            settled, radius = left.withColumn("_reach", F.lit(radius_m)), radius_m
        else:
            held = [F.sum(F.when(F.col("meters") <= radius * x, F.col("_m")).otherwise(0)) for x in shares]
            reach = F.coalesce(*[F.when(h >= k, F.lit(radius * x + 0.2)) for h, x in zip(held, shares, strict=True)])  # more than the rounding of km
            reached = cut(within(left.select("point", "p_lat", "p_lng"), places, radius).groupBy("point").agg(reach.alias("_reach")).where("_reach is not null"))
            settled = left.join(reached.hint("merge"), "point")
            left = cut(left.join(reached.select("point").hint("merge"), "point", "left_anti"))
            last = left.isEmpty()
        met = within(settled, f, min(radius + 0.2, radius_m)).where(F.col("meters") <= F.col("_reach")).drop("_reach")
        pairs = met if pairs is None else pairs.unionByName(met)
        if last:
            break
        radius *= 2
    first = Window.partitionBy("point").orderBy("km", *order)
    return pairs.withColumn("km", F.round(F.col("meters") / 1000, 4)).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def _far(points: DataFrame, features: DataFrame, spacing_m: float) -> DataFrame:
    """(p_id, b): of each point (p_id, p_lat, p_lng) the nearest of all features, as in `_rounds`; for points far from any.

    Features lie in boxes of boxes, the largest a sixteenth of all wide, the next an eighth of that, down to their
    spacing. Of the boxes that a point has met, those no nearer than a feature that it knows of are left out, and the
    others opened, so its pairs grow with the depth, not with the features.
    """
    south, north, west, east = features.agg(F.min("f_lat"), F.max("f_lat"), F.min("f_lng"), F.max("f_lng")).first()
    finest = math.degrees(spacing_m / (G.EARTH_KM * 1000))
    widest = max((north - south) / 16, (east - west) / 16, finest)
    depth = max(0, math.ceil(math.log(widest / finest, 8)))
    inner = lambda x, low: F.floor((F.col(x) - low) / (widest / 8**depth))
    f = features.withColumns({"_r": inner("f_lat", south), "_c": inner("f_lng", west)})
    span = [g(x).alias(f"{x}_{n}") for x in ("f_lat", "f_lng") for n, g in (("low", F.min), ("high", F.max))]

    def boxes(level: int) -> DataFrame:
        own = [F.shiftright(c, 3 * level).alias(c) for c in ("_r", "_c")]
        parent = [F.shiftright(c, 3).alias(f"{c}p") for c in ("_r", "_c")]
        return f.groupBy(*own).agg(*span, F.min(F.struct("f_lat", "f_lng")).alias("one")).select("*", *parent)

    turn = lambda x: F.least(F.abs(F.col("p_lng") - F.col(x)), F.lit(360.0) - F.abs(F.col("p_lng") - F.col(x)))
    dlat = F.greatest(F.col("f_lat_low") - F.col("p_lat"), F.col("p_lat") - F.col("f_lat_high"), F.lit(0.0))
    dlng = F.when(F.col("p_lng").between(F.col("f_lng_low"), F.col("f_lng_high")), 0.0).otherwise(F.least(turn("f_lng_low"), turn("f_lng_high")))
    cosine = F.least(F.cos(F.radians("f_lat_low")), F.cos(F.radians("f_lat_high")))
    h = F.pow(F.sin(F.radians(dlat) / 2), 2) + F.cos(F.radians("p_lat")) * cosine * F.pow(F.sin(F.radians(dlng) / 2), 2)
    least = F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2000 * G.EARTH_KM * (1 - 1e-9)) - 1  # a metre for rounding, at the other end of the world
    known = G.distance_m(F.col("p_lat"), F.col("p_lng"), F.col("one.f_lat"), F.col("one.f_lng"))
    who = ["p_id", "p_lat", "p_lng"]

    top = F.broadcast(boxes(depth).drop("_rp", "_cp"))  # 17 x 17 at most
    bound = points.crossJoin(top).groupBy(*who).agg(F.min(known).alias("m"))
    held = bound.crossJoin(top).where(least <= F.col("m")).select(*who, "m", "_r", "_c")
    for level in range(depth - 1, -1, -1):
        parents = held.withColumnsRenamed({"_r": "_rp", "_c": "_cp"})
        met = parents.join(boxes(level).hint("merge"), ["_rp", "_cp"]).withColumn("_low", least).where(F.col("_low") <= F.col("m"))
        kept = met.groupBy(*who).agg(F.least(F.min("m"), F.min(known)).alias("m"), F.collect_list(F.struct("_low", "_r", "_c")).alias("_all"))
        held = kept.select(*who, "m", F.explode(F.filter("_all", lambda x: x["_low"] <= F.col("m"))).alias("x")).select(*who, "m", "x._r", "x._c")
    meters = G.distance_m(F.col("p_lat"), F.col("p_lng"), F.col("f_lat"), F.col("f_lng"))
    last = held.join(f.hint("merge"), ["_r", "_c"]).withColumn("meters", meters).where(F.col("meters") <= F.col("m"))
    return last.groupBy("p_id").agg(F.min(F.struct("meters", "v_name", "v_id", "district_id")).alias("b"))


def _rounds(points: DataFrame, villages: DataFrame, first_m: float | None = None, inside: bool = True) -> DataFrame:
    """(id, village, district_id, meters, contained) of the nearest village, and (if `inside`) the containing one.

    Two rounds of radii, the first from the villages' density: a point with any village within the radius is
    settled, since that round saw all of them. Points far from every village descend into boxes (see `_far`).
    Where villages are crowded, so that the radius is less than a containing village may be away, that one is found apart.
    """
    all_ = cut(_as_points(spread(points.select("id", "latitude", "longitude"), "id")))  # places may be costly to compute
    f = _as_features(villages)
    f = cut(f.groupBy("f_lat", "f_lng").agg(F.min(F.struct("v_name", "v_id", "district_id")).alias("v")).select("f_lat", "f_lng", "v.*"))
    spacing = min(first_m or _spacing_m(f), _HALF_WORLD_M)
    left, out, also = all_, None, CONTAINED_M if inside and spacing >= CONTAINED_M else -1
    for radius in (spacing, min(4 * spacing, _HALF_WORLD_M)):
        least = within(left, f, radius, around="f").groupBy("p_id").agg(F.min("meters").alias("_m"))  # numbers first, as structs make Spark sort all pairs
        met = within(left.join(least.hint("merge"), "p_id"), f, radius, around="f").where((F.col("meters") <= F.col("_m") + 1e-6) | (F.col("meters") <= also))
        best = F.min(F.struct("meters", "v_name", "v_id", "district_id")).alias("b")
        near = F.min(F.when(F.col("meters") <= also, F.struct("v_name", "v_id"))).alias("first")
        found = cut(met.groupBy("p_id").agg(best, near))
        out = found if out is None else out.unionByName(found)
        if radius >= _HALF_WORLD_M:
            break
        left = cut(left.join(found.select("p_id").hint("merge"), "p_id", "left_anti"))
        if left.isEmpty():
            break
    else:
        out = out.unionByName(_far(left, f, spacing), allowMissingColumns=True)
    if inside and spacing < CONTAINED_M:
        out = cut(out.drop("first"))
        close = all_.join(out.where(F.col("b.meters") <= CONTAINED_M).select("p_id").hint("merge"), "p_id", "left_semi")
        out = out.join(first_within(close, f, CONTAINED_M, ["v_name", "v_id"]).hint("merge"), "p_id", "left")
    return out.select(F.col("p_id").alias("id"), F.col("b.v_id").alias("village"), "b.district_id", "b.meters", F.col("first.v_id").alias("contained"))


def nearest_village(points: DataFrame, villages: DataFrame, first_m: float | None = None) -> DataFrame:
    """(id, village, district_id, meters) of the nearest village anywhere; ties by name, then id."""
    return _rounds(points, villages, first_m, inside=False).drop("contained")


def located(points: DataFrame, villages: DataFrame) -> DataFrame:
    """`points` with contained, nearest, nearest_district, nearest_m and state."""
    n = _rounds(points, villages).select("id", "contained", F.col("village").alias("nearest"), F.col("district_id").alias("nearest_district"), F.col("meters").alias("nearest_m"))
    both = points.join(n.hint("merge"), "id", "left")
    return both.withColumn("state", F.when(G.valid_latlng(F.col("latitude"), F.col("longitude")), G.containing_state(F.col("latitude"), F.col("longitude"))))


def validated(found: DataFrame) -> DataFrame:
    """`located` rows with raw confidence, valid, confidence (2 decimals) and warnings."""
    lat, lng = F.col("latitude"), F.col("longitude")
    good, inside = G.valid_latlng(lat, lng), G.in_country_bounds(lat, lng)
    far = F.col("contained").isNull() & (F.coalesce(F.col("nearest_m"), F.lit(float("inf"))) > LINKED_M)
    coarse = ~G.adequate_precision(lat, lng)
    raw = F.lit(1.0) - F.when(inside, 0.0).otherwise(0.3) - F.when(far, 0.2).otherwise(0.0) - F.when(coarse, 0.1).otherwise(0.0)
    raw = F.when(good, raw).otherwise(F.lit(0.0))
    notes = F.array_compact(F.array(
        F.when(~inside, F.lit("outside the country")),
        F.when(far, F.concat(F.round("nearest_m").cast("long").cast("string"), F.lit(" m from the nearest village"))),
        F.when(coarse, F.lit("too few decimals"))))
    return found.withColumns({"raw": raw, "warnings": F.when(good, notes).otherwise(F.array(F.lit("invalid coordinates")))}).withColumns({"valid": good & (F.col("raw") >= 0.7), "confidence": F.round("raw", 2)})


def linked(checked: DataFrame, villages: DataFrame) -> DataFrame:
    """Linkage of validated claims: village, district, state, confidence, accuracy, geofenced.

    The containing village, else the nearest within 2000 m at 0.8 of the confidence;
    a declared other village within 4000 m is kept at 0.9.
    """
    near = F.col("contained").isNull() & (F.col("nearest_m") <= LINKED_M)
    first = F.coalesce("contained", F.when(near, F.col("nearest")))
    c = checked.withColumns({"_first": first, "_c": F.col("confidence") * F.when(near, 0.8).otherwise(1.0)})
    v = villages.select(F.col("id").alias("village_id"), F.col("latitude").alias("_vlat"), F.col("longitude").alias("_vlng"))
    c = c.join(v.hint("merge"), "village_id", "left")
    gap = G.distance_m(F.col("latitude"), F.col("longitude"), F.col("_vlat"), F.col("_vlng"))
    declared = F.coalesce((F.col("_first") != F.col("village_id")) & (gap <= DECLARED_M), F.lit(False))
    return c.select(
        "id", F.when(declared, F.col("village_id")).otherwise(F.col("_first")).alias("linked_village"),
        F.col("nearest_district").alias("linked_district"), F.col("state").alias("linked_state"),
        F.round(F.when(declared, F.col("_c") * 0.9).otherwise(F.col("_c")), 6).alias("confidence"),
        G.spatial_accuracy_m(F.col("latitude"), F.col("longitude")).alias("accuracy"), F.lit(True).alias("geofenced"), declared.alias("declared"))


def spatial_report(claims: DataFrame, links: DataFrame, villages: DataFrame) -> DataFrame:
    """Per village of the claims: counts, linked ones, confidence bands, mean confidence, claims too far out."""
    c = claims.join(links.select("id", "linked_village", "confidence").hint("merge"), "id", "left")
    c = c.join(villages.select(F.col("id").alias("village_id"), F.col("latitude").alias("vlat"), F.col("longitude").alias("vlng")).hint("merge"), "village_id")
    gap = F.when(G.valid_latlng(F.col("latitude"), F.col("longitude")), G.distance_m(F.col("latitude"), F.col("longitude"), F.col("vlat"), F.col("vlng")))
    c = c.withColumn("gap", gap)
    issue = F.when(F.col("gap") > LINKED_M, F.concat("claim_id", F.lit(" "), F.round("gap").cast("long").cast("string")))
    return c.groupBy("village_id").agg(
        F.count(F.lit(1)).alias("claims"), F.count("linked_village").alias("linked"), F.count_if(F.col("confidence") > 0.8).alias("high"),
        F.count_if((F.col("confidence") < 0.7) & (F.col("confidence") > 0)).alias("low"), F.round(F.sum(F.coalesce("confidence", F.lit(0.0))) / F.count(F.lit(1)), 6).alias("mean_confidence"),
        F.array_join(F.array_sort(F.collect_list(issue)), ";").alias("issues"))
