"""Column expressions: labels, dates, safe arithmetic, flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Site types as the models name them, seasons by month, times of day by hour.
SITE_TYPES = {"riverfront": "Riverfront", "beach": "Beach", "lakefront": "Lakefront", "coastal waterfront without beach": "Coastal waterfront"}
TYPE_ORDER = ["Beach", "Coastal waterfront", "Lakefront", "Riverfront"]
NEIGHBOUR = 1e-9


def steady(c: Column, digits: int = 6) -> Column:
    """Rounded so that both engines agree on ties: halves are nudged up first."""
    return F.round(c + F.lit(NEIGHBOUR), digits)


def hour_label(hour: Column) -> Column:
    two = lambda h: F.lpad(h.cast("string"), 2, "0")
    return F.concat(two(hour), F.lit(":00-"), two(hour + 1), F.lit(":00"))


def site_key(name: Column) -> Column:
    """Lower case, & as and, no line breaks, no closing bracketed suffix, letters and digits with single spaces."""
    plain = F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit("and")), r"[\r\n]+", " ")
    plain = F.regexp_replace(plain, r"\s*\([^)]*\)\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", " "), " +", " "))


def clean_id(c: Column) -> Column:
    return F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")


def squish(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def recode(c: Column, labels: dict[str, str]) -> Column:
    """Label of a code; codes without one stay."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[c], c)


def in_order(c: Column, order: list[str]) -> Column:
    """Place in a fixed order, unknown values last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), c), F.lit(0)), F.lit(len(order) + 1)).cast("int")


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring").when(month.isin(6, 7, 8), "Summer").otherwise("Fall")


def time_of_day(hour: Column) -> Column:
    return F.when(hour < 12, "Morning").when(hour < 17, "Afternoon").otherwise("Evening")


def day_type(period: Column) -> Column:
    return F.when(period == 0, "Weekday").when(period == 1, "Weekend")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, b)


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b within 0 and 1; 0 where b is 0 or null."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(a, b), F.lit(0.0))))


def row_sum(columns: list[Column]) -> Column:
    """Sum of what is there, null if nothing is."""
    some = reduce(lambda a, b: a | b, [c.isNotNull() for c in columns])
    return F.when(some, reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns]))


def row_mean(columns: list[Column]) -> Column:
    there = reduce(lambda a, b: a + b, [c.isNotNull().cast("double") for c in columns])
    return F.try_divide(row_sum(columns), there)


def percent_change(beta: Column) -> Column:
    return F.lit(100.0) * (F.exp(beta) - 1)


def p_text(p: Column) -> Column:
    """Report form of a p-value: three digits without the leading zero, or <.001."""
    return F.when(p < 0.001, "<.001").otherwise(F.regexp_replace(F.format_string("%.3f", p), "^0", ""))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def dummies(c: Column, levels: list[str], reference: str) -> dict[str, Column]:
    """One 0/1 column for each level but the reference."""
    return {level: F.when(c == level, 1.0).otherwise(0.0) for level in levels if level != reference}


def guarded(columns: list[str], flag: str = "hasdata") -> list[Column]:
    """Estimates are missing, not zero, where the flag is not 1."""
    return [F.when(F.col(flag) == 1, F.col(c)).alias(c) for c in columns]


def coverage_group(pct: Column) -> Column:
    return F.when(pct >= 90, ">=90%").when(pct >= 75, "75-<90%").when(pct >= 50, "50-<75%").otherwise("<50%")


def quadrant(x: Column, y: Column, mx: Column, my: Column) -> Column:
    """HH, HL, LH, LL against the medians; a tie is high."""
    return F.concat(F.when(x >= mx, "H").otherwise("L"), F.when(y >= my, "H").otherwise("L"))
