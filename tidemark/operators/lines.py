"""Linework: noding, splitting at points and merging into chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import connected
from tidemark.operators.spatial import crossings, points_near_segments


def crossing_places(lines: DataFrame, size: float) -> DataFrame:
    """id, t: where segments (id, ax, ay, bx, by) meet other segments; parallels do not meet."""
    others = lines.select(F.col("id").alias("other"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    return crossings(lines, others, size).filter("id <> other").select("id", F.round("t", 9).alias("t")).distinct()


def near_point_places(lines: DataFrame, points: DataFrame, tolerance: float, size: float | None = None) -> DataFrame:
    """id, t: where points (x, y) within the tolerance fall on segments, not counting their ends."""
    near = points_near_segments(points, lines, tolerance, size)
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return near.filter((F.col("t") * length > tolerance) & ((1 - F.col("t")) * length > tolerance)).select("id", F.round("t", 9).alias("t")).distinct()


def split_at(lines: DataFrame, places: DataFrame, least: float = 0.001) -> DataFrame:
    """Segments cut at their places; pieces shorter than ``least`` go, equal pieces of different segments stay once,
    under the smallest id."""
    breaks = places.groupBy("id").agg(F.collect_set("t").alias("t"))
    all_ = lines.join(breaks, "id", "left").withColumn("t", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("t", F.expr("cast(array() as array<double>)"))))))
    n = F.size("t") - 1
    cut = all_.withColumn("p", F.explode(F.zip_with(F.slice("t", 1, n), F.slice("t", 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    rx, ry = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    at = lambda base, step, t: F.round(F.col(base) + F.col(t) * step, 3)
    out = cut.select("id", at("ax", rx, "p.a").alias("ax"), at("ay", ry, "p.a").alias("ay"), at("ax", rx, "p.b").alias("bx"), at("ay", ry, "p.b").alias("by"))
    return out.filter(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) > least).groupBy("ax", "ay", "bx", "by").agg(F.min("id").alias("id")).select("id", "ax", "ay", "bx", "by")


def chains(edges: DataFrame) -> DataFrame:
    """id, u, v -> id and chain: edges that follow one another through nodes of exactly two edges share a chain (its
    smallest id), so that spacing along a line is not started again at each fragment."""
    ends = edges.select("id", F.explode(F.array("u", "v")).alias("node"))
    links = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("u"), F.max("id").alias("v")).filter("n = 2 and u <> v")
    labels = connected(links.select("u", "v", F.lit(1.0).alias("len")))
    return edges.join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("chain"))


def noded(lines: DataFrame, size: float, tolerance: float = 1e-6) -> DataFrame:
    """Linework without crossings and overlaps: segments cut where they cross others and where ends of others lie on them,
    so that what two segments share, in one direction or against it, becomes equal pieces; each stays once, from its
    smaller end (by x, then y), under the smallest id."""
    ends = lines.select(F.col("ax").alias("x"), F.col("ay").alias("y")).union(lines.select("bx", "by")).distinct()
    places = crossing_places(lines, size).unionByName(near_point_places(lines, ends, tolerance, size)).distinct()
    pieces = split_at(lines, places)
    turned = (F.col("bx") < F.col("ax")) | ((F.col("bx") == F.col("ax")) & (F.col("by") < F.col("ay")))
    end = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a)
    one = pieces.select("id", end("ax", "bx"), end("ay", "by"), end("bx", "ax"), end("by", "ay"))
    return one.groupBy("ax", "ay", "bx", "by").agg(F.min("id").alias("id")).select("id", "ax", "ay", "bx", "by")
