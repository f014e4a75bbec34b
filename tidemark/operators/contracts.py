"""Data-quality contracts: each returns a one-row or few-row report; ``require`` turns a report into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame, expected: int) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).select("rows", F.lit(expected).cast("long").alias("expected"), (F.col("rows") == expected).alias("ok"))


def unique_key(df: DataFrame, *keys: str) -> DataFrame:
    """Number of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_keys")).withColumn("ok", F.col("duplicate_keys") == 0)


def no_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and non-finite values by column, in one pass."""
    kinds = dict(df.dtypes)
    bad = lambda c: F.col(c).isNull() | (F.isnan(c) | (F.abs(F.col(c)) == float("inf")) if kinds[c] in ("double", "float") else F.lit(False))
    counts = df.agg(*[F.count_if(bad(c)).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "bad")


def in_set(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.agg(F.count_if(~F.coalesce(F.col(column).isin(allowed), F.lit(False))).alias("outside")).withColumn("ok", F.col("outside") == 0)


def in_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.filter(~F.col(column).between(low, high))


def same(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Largest absolute difference of each column and rows where only one side is null, over the full outer join."""
    pairs = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns]), keys, "full")
    out = pairs.agg(*[x for c in columns for x in (F.coalesce(F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))), F.lit(0.0)).alias(f"d_{c}"), F.count_if(F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull()).alias(f"n_{c}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"d_{c}").alias("max_difference"), F.col(f"n_{c}").alias("null_mismatches")) for c in columns]))
    return out.select(rows.alias("r")).select("r.*").withColumn("ok", (F.col("max_difference") <= tolerance) & (F.col("null_mismatches") == 0))


def require(report: DataFrame, ok: Column | None = None) -> None:
    bad = report.filter(~(F.col("ok") if ok is None else ok)).limit(5).collect()
    if bad:
        raise ValueError(f"contract broken: {bad}")


def sample_sizes(df: DataFrame, expected: dict[str, int]) -> DataFrame:
    """eligible, sites, expected, ok: the rows that each boolean column admits (null: no), against fixed sizes; one pass."""
    counts = df.agg(*[F.count_if(F.coalesce(k, F.lit(False))).alias(k) for k in expected])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("eligible"), F.col(k).alias("sites"), F.lit(n).cast("long").alias("expected")) for k, n in expected.items()]))
    return counts.select(rows.alias("r")).select("r.*").withColumn("ok", F.col("sites") == F.col("expected"))
