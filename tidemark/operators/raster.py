"""Rasters as cell tables (r, c, value) and as tiles of such: reclassing, sampling, slope and line of sight."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.spatial import meet


def sample(points: DataFrame, cells: DataFrame, size: float, *values: str) -> DataFrame:
    """The cell under each point: one equi join."""
    at = points.withColumn("r", F.floor(F.col("y") / size).cast("int")).withColumn("c", F.floor(F.col("x") / size).cast("int"))
    return at.join(cells.select("r", "c", *values), ["r", "c"])


def slope(cells: DataFrame, size: float, value: str = "elev") -> DataFrame:
    """Horn's slope in degrees: each cell is sent to its eight neighbours, which sum it with weights. Cells without all
    eight neighbours have none."""
    # Horn's weights by offset (row, column), x and y.
    weights = [(dr, dc, (2 - abs(dr)) * dc, (2 - abs(dc)) * dr) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]
    parts = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(float(wx)).alias("wx"), F.lit(float(wy)).alias("wy")) for dr, dc, wx, wy in weights])
    sent = cells.select("r", "c", value, F.explode(parts).alias("k"))
    sums = sent.groupBy((F.col("r") - F.col("k.dr")).alias("r"), (F.col("c") - F.col("k.dc")).alias("c")).agg(
        F.count(value).alias("n"), (F.sum(F.col(value) * F.col("k.wx")) / (8 * size)).alias("gx"), (F.sum(F.col(value) * F.col("k.wy")) / (8 * size)).alias("gy")
    )
    deg = F.when(F.col("n") == 8, F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))))
    return cells.select("r", "c").join(sums.select("r", "c", deg.alias("slope")), ["r", "c"], "left")


def cells_within(observers: DataFrame, cells: DataFrame, size: float, radius: float) -> DataFrame:
    """Cells whose centre is within radius of an observer (x, y): both meet by blocks of cells, a fifth of the radius wide,
    and the pairs are made in the join; no disc is listed."""
    wide = max(1, int(radius // size) // 5)
    block = lambda v: F.floor(v / (size * wide)).cast("int")
    reach = lambda c: F.explode(F.sequence(block(F.col(c) - radius), block(F.col(c) + radius)))
    held = cells.withColumn("br", F.floor(F.col("r") / wide).cast("int")).withColumn("bc", F.floor(F.col("c") / wide).cast("int"))
    pairs = meet(observers.withColumn("br", reach("y")).withColumn("bc", reach("x")), held, ["br", "bc"]).drop("br", "bc")
    d = F.hypot((F.col("c") + 0.5) * size - F.col("x"), (F.col("r") + 0.5) * size - F.col("y"))
    return pairs.withColumn("distance", d).filter(F.col("distance") <= radius)


#: Cells a tile has on a side.
SIDE = 64
#: Metres to the middle of the earth; a view over no obstacle.
EARTH, OPEN = 6_371_000.0, -1.0e9


def tiles(cells: DataFrame, side: int = SIDE, **values: Column) -> DataFrame:
    """tr, tc, cells: the cells of each tile as an array of their place in it (row by row) and the values named; at most
    side * side of them, since a raster has one row a cell."""
    at = (F.pmod("r", F.lit(side)) * side + F.pmod("c", F.lit(side))).alias("at")
    keys = [F.floor(F.col("r") / side).cast("int").alias("tr"), F.floor(F.col("c") / side).cast("int").alias("tc")]
    return cells.select(*keys, F.struct(at, *[v.alias(k) for k, v in values.items()]).alias("cell")).groupBy("tr", "tc").agg(F.collect_list("cell").alias("cells"))


def windows(observers: DataFrame, tiled: DataFrame, size: float, radius: float, side: int = SIDE) -> DataFrame:
    """Observers (id, x, y) with each tile that their radius reaches: one equi join by tile."""
    reach = lambda c: F.sequence(F.floor((F.col(c) - radius - size) / (size * side)).cast("int"), F.floor((F.col(c) + radius + size) / (size * side)).cast("int"))
    return observers.withColumn("tr", F.explode(reach("y"))).withColumn("tc", F.explode(reach("x"))).join(tiled, ["tr", "tc"])


def _rays(x: float, y: float, eye: float, elev: np.ndarray, r: np.ndarray, c: np.ndarray, d: np.ndarray, r0: int, c0: int, size: float, drop) -> np.ndarray:
    """Which of the cells r, c at distance d are seen: rays are sampled once per cell length, all of them at once."""
    worst = np.full(len(r), -np.inf)
    tx, ty = (c + 0.5) * size - x, (r + 0.5) * size - y
    on, k = np.flatnonzero(d > size), 1
    while len(on):
        t = k * size / d[on]
        pr, pc = np.floor((y + t * ty[on]) / size).astype(np.int64), np.floor((x + t * tx[on]) / size).astype(np.int64)
        view = (elev[pr - r0, pc - c0] - drop(k * size) - eye) / (k * size)
        ok = ((pr != r[on]) | (pc != c[on])) & ~np.isnan(view)
        worst[on[ok]] = np.maximum(worst[on[ok]], view[ok])
        k += 1
        on = on[np.ceil(d[on] / size) - 1 >= k]
    with np.errstate(divide="ignore", invalid="ignore"):
        rise = (elev[r - r0, c - c0] - drop(d) - eye) / d
    return (d == 0) | (worst <= rise)


def _horizon(view: np.ndarray, n: int) -> np.ndarray:
    """Steepest view before each cell of a square of half-width n around the observer's: from ring to ring outwards, each
    cell takes it from the place where its line of sight crosses the ring before, between the two cells there."""
    before, upto = np.full(view.shape, OPEN), view.copy()
    upto[n, n] = OPEN
    for k in range(2, n + 1):
        side = np.arange(-k, k + 1)
        at = side * (k - 1) / k
        low = np.floor(at).astype(np.int64)
        part, high = at - low, np.minimum(low + 1, k - 1)
        for far in (-k, k):
            near = n + (far + 1 if far < 0 else far - 1)
            before[n + side, n + far] = (1 - part) * upto[n + low, near] + part * upto[n + high, near]
            before[n + far, n + side] = (1 - part) * upto[near, n + low] + part * upto[near, n + high]
        ring = np.concatenate([np.stack([n + side, np.full(2 * k + 1, n + far)]) for far in (-k, k)] + [np.stack([np.full(2 * k + 1, n + far), n + side]) for far in (-k, k)], axis=1)
        upto[ring[0], ring[1]] = np.maximum(view[ring[0], ring[1]], before[ring[0], ring[1]])
    return before


def _viewer(size: float, radius: float, eye: float, sweep: bool, earth: float | None, refraction: float, side: int):
    drop = (lambda d: (1 - refraction) * d * d / (2 * earth)) if earth else (lambda d: 0.0)
    n = int(radius // size) + 2

    def see(table: pa.Table) -> pa.Table:
        """The tiles of one observer -> id, r, c of the targets seen."""
        oid, x, y = (table.column(k)[0].as_py() for k in ("id", "x", "y"))
        row, col = int(np.floor(y / size)), int(np.floor(x / size))
        r0, c0 = row - n, col - n
        lists = table.column("cells").combine_chunks()
        cells, many = lists.flatten(), np.diff(np.asarray(lists.offsets))
        at = cells.field("at").to_numpy(zero_copy_only=False)
        r = np.repeat(table.column("tr").to_numpy(), many).astype(np.int64) * side + at // side
        c = np.repeat(table.column("tc").to_numpy(), many).astype(np.int64) * side + at % side
        inside = (np.abs(r - row) <= n) & (np.abs(c - col) <= n)
        r, c = r[inside], c[inside]
        elev = np.full((2 * n + 1, 2 * n + 1), np.nan)
        elev[r - r0, c - c0] = cells.field("elev").to_numpy(zero_copy_only=False)[inside]
        aim = cells.field("aim").fill_null(False).to_numpy(zero_copy_only=False)[inside]
        height = elev[n, n] + eye
        r, c = r[aim], c[aim]
        if sweep:
            side_ = np.arange(-n, n + 1) * size
            d = np.sqrt(side_[:, None] ** 2 + side_[None, :] ** 2)
            with np.errstate(divide="ignore", invalid="ignore"):
                view = (elev - drop(d) - height) / d
            before = _horizon(np.where(np.isnan(view), OPEN, view), n)
            d, seen = d[r - r0, c - c0], (view >= before)[r - r0, c - c0]
            seen |= d == 0
        else:
            dx, dy = (c + 0.5) * size - x, (r + 0.5) * size - y
            d = np.sqrt(dx * dx + dy * dy)
            r, c, d = r[d <= radius], c[d <= radius], d[d <= radius]
            seen = _rays(x, y, height, elev, r, c, d, r0, c0, size, drop)
        seen &= (d <= radius) & ~np.isnan(height) & ~np.isnan(elev[r - r0, c - c0])
        return pa.table({"id": pa.array([oid] * int(seen.sum()), table.schema.field("id").type), "r": pa.array(r[seen], pa.int32()), "c": pa.array(c[seen], pa.int32())})

    return see


def viewshed(observers: DataFrame, cells: DataFrame, size: float, radius: float, eye: float, targets: str, sweep: bool = False, earth: float | None = None, refraction: float = 0.13, side: int = SIDE) -> DataFrame:
    """observers: id (unique), x, y; cells: r, c, elev, ... -> id, r, c of the cells that satisfy ``targets`` and are seen.

    The raster is tiled once; each observer meets the tiles in its radius by an equi join, so that what a task holds at
    once is one window of (2 * radius / size) squared cells, however large the raster is and however many observers
    there are. Inside it nothing is a row: by default a ray to each target is sampled once per cell length (exact for
    this sampling, work: targets times ray length), with ``sweep`` the horizon goes from ring to ring and each cell is
    touched once (the observer stands in the middle of its cell). With ``earth`` (its radius) ground falls away with the
    square of the distance, less what refraction lifts. Cells without elevation hide nothing and are not seen;
    observers on them or off the raster see nothing. Rays do not end at the edge of the raster."""
    tiled = tiles(cells, side, elev=F.col("elev").cast("double"), aim=F.expr(targets))
    kind = observers.schema["id"].dataType.simpleString()
    return windows(observers.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), tiled, size, radius, side).groupBy("id").applyInArrow(_viewer(size, radius, eye, sweep, earth, refraction, side), f"id {kind}, r int, c int")


def line_of_sight(observers: DataFrame, cells: DataFrame, size: float, radius: float, eye: float, targets: str) -> DataFrame:
    """The same by rays, with planar ground."""
    return viewshed(observers, cells, size, radius, eye, targets)
