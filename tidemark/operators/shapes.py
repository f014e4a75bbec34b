"""Polygons of several parts with holes, as side tables, and point joins over a cover of grid cells.

A shape is key, parts: array of parts, each an array of rings (the outer one first, then its holes), each an array of
struct<x,y>, closed or not. Everything but the tidying of rings works on sides (key, part, ring, ax, ay, bx, by): one row
a side, so no row and no task grows with a shape. Inside is even-odd over all rings of a shape; its border is outside.

Cover. A cell of the grid is a border cell of a shape if a side comes near it, and carries just these sides and whether
its reference point is inside; it is an inner cell if no side does and that point is inside. Points in inner cells are
settled by the join alone. In border cells a point is inside as its cell's reference point is, turned by each side that
crosses the way between the two, which stays in the cell. Reference points come row by row from the sorted crossings of
one scan line a row; they lie a little off the middle, by two amounts whose ratio to each other and to 1 is irrational,
so that no side between round coordinates goes through one, whether upright, level or slanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.operators import spatial as S

#: Place of a cell's reference point along x and y, in cells: the middle and tenths of parts of the roots of 2 and 3.
OFF_X, OFF_Y = 0.5 + 0.041421356237309515, 0.5 + 0.07320508075688772
SIDE = ("ax", "ay", "bx", "by")


def tidy(shapes: DataFrame, parts: str = "parts") -> DataFrame:
    """Rings closed; rings of less than four vertices or no area go, a part goes with its outer ring, a shape with its
    last part. Null parts, rings and shapes go too."""
    closed = lambda ring: F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    sound = lambda ring: (F.size(ring) >= 4) & (S.area(ring) > 0)
    there = F.filter(F.transform(F.col(parts), lambda part: F.transform(F.filter(part, lambda r: F.size(r) > 0), closed)), lambda part: F.size(part) > 0)
    outer = F.filter(there, lambda part: sound(F.element_at(part, 1)))
    return shapes.withColumn(parts, F.transform(outer, lambda part: F.filter(part, sound))).filter(F.size(parts) > 0)


def explode_parts(shapes: DataFrame, key: str, parts: str = "parts") -> DataFrame:
    """key, part, rings. The outer form and a filter behind it, as here and below: for a plain explode Spark infers a
    filter on the array, which it writes out again in the steps before."""
    return shapes.select(key, F.posexplode_outer(parts).alias("part", "rings")).filter("rings is not null")


def sides(shapes: DataFrame, key: str, parts: str = "parts") -> DataFrame:
    rings = explode_parts(shapes, key, parts).select(key, "part", F.posexplode_outer("rings").alias("ring", "v")).filter("v is not null")
    return rings.select(key, "part", "ring", F.explode_outer(S.edges(F.col("v"))).alias("e")).filter("e is not null").select(key, "part", "ring", *[F.col(f"e.{c}").alias(c) for c in SIDE]).filter("ax <> bx or ay <> by")


def _moments(borders: DataFrame, key: str) -> DataFrame:
    """key, area, cx, cy and perimeter; holes count against their part, whichever way rings turn."""
    cross = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    mid = lambda a, b: F.sum((F.col(a) + F.col(b)) * cross)
    rings = borders.groupBy(key, "part", "ring").agg(F.sum(cross).alias("twice"), mid("ax", "bx").alias("mx"), mid("ay", "by").alias("my"), F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("length"))
    turn = F.when(F.col("ring") == 0, 1.0).otherwise(-1.0) * F.signum("twice")
    total = rings.groupBy(key).agg(*[F.sum(turn * F.col(c)).alias(c) for c in ("twice", "mx", "my")], F.sum("length").alias("perimeter"))
    return total.select(key, (F.col("twice") / 2).alias("area"), F.try_divide("mx", 3 * F.col("twice")).alias("cx"), F.try_divide("my", 3 * F.col("twice")).alias("cy"), "perimeter")


def measures(borders: DataFrame, key: str) -> DataFrame:
    return _moments(borders, key).select(key, "perimeter", "area")


def inside_points(borders: DataFrame, key: str) -> DataFrame:
    """key, x, y: the centroid if it is inside, else the middle of the widest chord on its level."""
    m = _moments(borders, key).select(key, "cx", "cy")
    at = borders.join(m, key).filter((F.col("ay") > F.col("cy")) != (F.col("by") > F.col("cy")))
    hits = at.select(key, "cx", "cy", (F.col("ax") + (F.col("cy") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))).alias("x"))
    line = Window.partitionBy(key).orderBy("x")
    chords = hits.withColumn("k", F.row_number().over(line)).withColumn("to", F.lead("x").over(line)).filter("k % 2 = 1 and to is not null")
    best = chords.groupBy(key).agg(F.max(F.when((F.col("cx") > F.col("x")) & (F.col("cx") < F.col("to")), F.col("cx"))).alias("own"), F.max(F.struct((F.col("to") - F.col("x")).alias("wide"), (-F.col("x")).alias("first"), ((F.col("to") + F.col("x")) / 2).alias("x"))).alias("best"), F.first("cy").alias("y"))
    return best.select(key, F.coalesce("own", "best.x").alias("x"), "y")


def cover(borders: DataFrame, key: str, size: float, halo: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Border cells (key, gx, gy, odd, sides) and inner cells (key, gx, gy) of all shapes."""
    ax, ay, bx, by = (F.col(c) for c in SIDE)
    rows = borders.withColumn("gy", F.explode(S.spread(F.least(ay, by) - halo, F.greatest(ay, by) + halo, size)))
    # the piece of the side that is in the row, and the cells beside it
    t = lambda y: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(y - ay, by - ay), F.lit(0.0))))
    t0, t1 = t(F.col("gy") * size - halo), F.when(by == ay, 1.0).otherwise(t((F.col("gy") + 1) * size + halo))
    x0, x1, slack = ax + t0 * (bx - ax), ax + t1 * (bx - ax), halo + size * 1e-9
    touched = rows.withColumn("gx", F.explode(S.spread(F.least(x0, x1) - slack, F.greatest(x0, x1) + slack, size)))
    border = touched.groupBy(key, "gx", "gy").agg(F.collect_list(F.struct(*SIDE)).alias("sides"))
    level = (F.col("gy") + OFF_Y) * size
    lines = borders.withColumn("gy", F.explode(S.spread(F.least(ay, by) - size, F.greatest(ay, by), size))).filter((ay > level) != (by > level))
    hits = lines.select(key, "gy", ((ax + (level - ay) * (bx - ax) / (by - ay)) / size - OFF_X).alias("at"))
    line = Window.partitionBy(key, "gy").orderBy("at")
    spans = hits.withColumn("k", F.row_number().over(line)).withColumn("to", F.lead("at").over(line)).filter("k % 2 = 1")
    spans = spans.select(key, "gy", F.ceil("at").alias("low"), F.floor("to").alias("high")).filter("low <= high")
    odd = spans.select(key, F.explode(F.sequence("low", "high")).alias("gx"), "gy", F.lit(1).alias("odd"))
    on = [key, "gx", "gy"]
    # exploded rows are merged, never broadcast
    return border.join(odd.hint("merge"), on, "left").select(*on, F.coalesce("odd", F.lit(0)).alias("odd"), "sides"), odd.join(border.select(*on).hint("merge"), on, "left_anti").select(*on)


def _in_border_cell(x: Column, y: Column, size: float, near: float | None, one: bool = False) -> Column:
    """one: cells of one side, whose coordinates are columns; the test of these is plain arithmetic."""
    rx, ry = (F.col("gx") + OFF_X) * size, (F.col("gy") + OFF_Y) * size

    def crosses(e: Column) -> Column:
        xc = e["ax"] + (y - e["ay"]) * F.try_divide(e["bx"] - e["ax"], e["by"] - e["ay"])
        yc = e["ay"] + (rx - e["ax"]) * F.try_divide(e["by"] - e["ay"], e["bx"] - e["ax"])
        along = ((e["ay"] > y) != (e["by"] > y)) & ((xc > x) != (xc > rx))
        up = ((e["ax"] > rx) != (e["bx"] > rx)) & ((yc > y) != (yc > ry))
        return F.coalesce(along, F.lit(False)).cast("int") + F.coalesce(up, F.lit(False)).cast("int")

    only = {c: F.col(c) for c in SIDE}
    some = lambda test: test(only) if one else F.exists("sides", test)
    odd = (F.col("odd") + crosses(only) if one else F.aggregate("sides", F.col("odd"), lambda acc, e: acc + crosses(e))) % 2 == 1
    cross = lambda e: (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
    on = some(lambda e: (cross(e) == 0) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])))
    if near is None:
        return odd & ~on
    return odd | some(lambda e: S.point_segment(x, y, *[e[c] for c in SIDE])[0] < near)


def points_in_shapes(points: DataFrame, borders: DataFrame, key: str, near: float | None = None, size: float = 500.0) -> DataFrame:
    """points: x, y, ... -> all pairs of a point and the key of a shape that it is inside of, or nearer to than ``near``."""
    border, inner = cover(borders, key, size, near or 0.0)
    border = G.written(border, "border")
    at = points.withColumn("gx", S.bucket(F.col("x"), size)).withColumn("gy", S.bucket(F.col("y"), size))
    x, y, on = F.col("x"), F.col("y"), ["gx", "gy"]
    one = border.filter(F.size("sides") == 1).select(key, *on, "odd", *[F.col("sides")[0][c].alias(c) for c in SIDE])
    tested = S.meet(at, one, on).filter(_in_border_cell(x, y, size, near, True)).drop("odd", *SIDE)
    mixed = S.meet(at, border.filter(F.size("sides") > 1), on).filter(_in_border_cell(x, y, size, near)).drop("odd", "sides")
    return S.meet(at, inner, on).unionByName(tested).unionByName(mixed).drop(*on)
