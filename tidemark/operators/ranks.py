"""Ranks, quantiles and running minima inside groups of any size, without a task that holds a group.

Distinct values of a group are counted first, with partial counts before the shuffle, so ties and frequent values cost
nothing. The counts are dealt by ranges of (group, value): each range is one part, in order. What is before a value is
what the parts before hold (a table of one row a part and group) and what its own part holds before it. So a group that
holds all rows runs in as many tasks as there are ranges. Groups may be null; null values have no rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import written


def join_by(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi join in which null keys meet; right's keys go."""
    names = {k: f"__{k}" for k in keys}
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right.withColumnsRenamed(names), reduce(lambda a, b: a & b, on), how).drop(*names.values()) if keys else left.join(F.broadcast(right), how=how)  # one row where there are no groups


def counted(df: DataFrame, value: str, *by: str) -> DataFrame:
    """by, value, n, before (rows of the group with smaller values), total, part: one row for each distinct value."""
    keys = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    dealt = written(counts.repartitionByRange(*keys, value).withColumn("part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy(*keys, "part").agg(F.sum("n").alias("held"))
    group = Window.partitionBy(*keys)
    earlier = F.coalesce(F.sum("held").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*keys, "part", earlier.alias("earlier"), F.sum("held").over(group).alias("total"))
    here = Window.partitionBy(*keys, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("here", F.coalesce(F.sum("n").over(here), F.lit(0)))
    full = join_by(own, parts, [*keys, "part"])
    return full.select(*keys, value, "n", (F.col("earlier") + F.col("here")).alias("before"), "total", "part")


def with_rank(df: DataFrame, value: str, name: str, *by: str, ties: str = "average") -> DataFrame:
    """df with the rank of a value in its group: the mean of its ties' places, or the first place ("min")."""
    place = {"average": F.col("before") + (F.col("n") + 1) / 2.0, "min": F.col("before") + 1}[ties]
    ranks = counted(df.select(*by, F.col(value).alias("__v")), "__v", *by).select(*by, F.col("__v").alias(value), place.alias(name))
    return join_by(df, ranks, [*by, value], "left")


def quantiles(df: DataFrame, value: str, probabilities: dict[str, float], *by: str) -> DataFrame:
    """by and a column for each named probability: exact, between neighbours in proportion (type 7)."""
    c = counted(df.select(*by, F.col(value).alias("__v")), "__v", *by)
    at = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("__v").cast("double")))
    h = {name: (F.col("total") - 1) * p for name, p in probabilities.items()}
    found = c.groupBy(*by).agg(F.max("total").alias("total"), *[x for name, k in h.items() for x in (at(F.floor(k)).alias(f"low_{name}"), at(F.ceil(k)).alias(f"high_{name}"))])
    part = lambda name: h[name] - F.floor(h[name])
    return found.select(*by, *[(F.col(f"low_{name}") + (F.col(f"high_{name}") - F.col(f"low_{name}")) * part(name)).alias(name) for name in probabilities])


def with_quantile(df: DataFrame, value: str, name: str, p: float, *by: str) -> DataFrame:
    """df with a quantile of its group: one row a group, joined back."""
    return join_by(df, quantiles(df, value, {name: p}, *by), list(by), "left")


def lowest_from(values: DataFrame, of: Column, name: str, value: str, *by: str) -> DataFrame:
    """values (from ``counted``) with the least ``of`` over this and all larger values of the group."""
    keys = list(by)
    marked = values.withColumn("__of", of)
    parts = marked.groupBy(*keys, "part").agg(F.min("__of").alias("least"))
    later = F.min("least").over(Window.partitionBy(*keys).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1))
    here = F.min("__of").over(Window.partitionBy(*keys, "part").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0))
    full = join_by(marked.withColumn("__here", here), parts.select(*keys, "part", later.alias("__later")), [*keys, "part"])
    return full.withColumn(name, F.least("__here", "__later")).drop("__of", "__here", "__later")


def adjusted(df: DataFrame, p: str, *by: str, name: str = "q", ties: str = "max") -> DataFrame:
    """df with Benjamini-Hochberg q-values of a family: p * n / rank, made monotone from the largest p down, 1 at most.
    Equal p take their last place ("max", as p.adjust in R) or their first ("min", as SQL's rank(): never smaller)."""
    c = counted(df.select(*by, F.col(p).alias("__v")), "__v", *by)
    place = F.col("before") + {"max": F.col("n"), "min": F.lit(1)}[ties]
    q = lowest_from(c, F.col("__v") * F.col("total") / place, "__q", "__v", *by)
    return join_by(df, q.select(*by, F.col("__v").alias(p), F.least(F.lit(1.0), "__q").alias(name)), [*by, p], "left")
