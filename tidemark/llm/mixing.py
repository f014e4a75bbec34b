"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, 2, ... and share the total size; no target exceeds
``most`` times its source's size, and what is above goes to the rest by weight. With the sources in order of size per
weight, this water level is read off running sums.

Sampling: every document of a source has target / source size expected copies. Along the source's documents, ordered by
size class, a hashed stripe, size and id, the prefix sum of expected copies is the rate times the rank. One offset drawn
from the seed is added, and a document is taken once for each integer boundary that its step crosses. The order by size
keeps the taken words near the target. Ranks need no window over a source: size classes and stripes split it into
groups, whose counts (a bounded table per source) are summed, and ranks run inside a group. The number of stripes follows
the number of rows (``ROWS`` to a stripe, powers of two), so that no group of a hot source outgrows a task. An id that
several rows hold, null among them, would be one stripe: its rows are dealt on by a hash of all their columns, and rows
that are equal in all columns one by one, for which they are stored apart and numbered in parts, from the counts of the
parts before. The order inside a group ends with that hash, so only rows that are equal in all columns can
change places, and a rerun over other files or another order takes the same rows.

Null texts and texts without words have size 0 and are never taken; a null source is a source; null or repeated ids and
repeated rows are documents like any other. Columns of docs named like the results (mix_size, mix_source_size,
mix_target, mix_copies, mix_taken) are replaced. An empty table gives an empty one. Reruns take the same documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import PARTS, Store, numbered

WORD = r"[^\x20\x09-\x0D]+"
MOST, STRIPES, SEED = 3, 64, "mix-1"
#: Rows of a table for which it gets a stripe, and the most stripes.
ROWS, MOST_STRIPES = 100_000, 1 << 16
RESULTS = ("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken")


def _md5_number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """sized: source_key, source, size -> source_key, source_size, target."""
    sums = sized.groupBy("source_key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sums.select("source_key", "source_size", (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).cast("double").alias("weight"))
    cap, level = F.col("source_size") * float(most), F.col("source_size") / F.col("weight")
    by_level = Window.orderBy(level, "source_key")
    ranked = weighed.select("source_key", "source_size", "weight", cap.alias("cap"), F.row_number().over(by_level).alias("place"), F.sum("source_size").over(Window.partitionBy()).alias("total"))
    by_place = Window.orderBy("place")
    before = F.coalesce(F.sum("cap").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_place.rowsBetween(0, Window.unboundedFollowing))
    tried = ranked.withColumn("share", (F.col("total") - before) / rest)
    share = F.min(F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct("place", "share"))).over(Window.partitionBy())["share"]
    return tried.select("source_key", "source_size", F.least("cap", F.col("weight") * share).alias("target"))


def _dealt(work: DataFrame, store: Store) -> DataFrame:
    """work with step: how many stripes further a row is dealt than its id says. 0 where no other row has the id; else by
    all its columns; rows that are equal in all columns are stored apart and numbered."""
    ids = store.put(work.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("many"), F.lit(True).alias("shared")), "ids")
    known = work.join(ids, F.col("id").eqNullSafe(F.col("many")), "left").drop("many")
    same = store.put(known.filter("shared").groupBy("whole").agg(F.count("*").alias("n")).filter("n > 1").select("whole"), "same")
    equal = known.join(same, "whole", "left_semi").withColumn("row", F.monotonically_increasing_id())
    equal = store.put(equal.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS))), "equal")
    equal = equal.join(numbered(equal.select("row", "whole", "part")).select("row", "number"), "row").drop("row", "part")
    all_ = known.join(same, "whole", "left_anti").withColumn("number", F.lit(0).cast("long")).unionByName(equal)
    return all_.withColumn("step", F.when(F.col("shared"), F.pmod("whole", F.lit(MOST_STRIPES)) + F.col("number")).otherwise(0)).drop("shared", "number")


def mix_sources(docs: DataFrame, most: int = MOST, stripes: int = STRIPES, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All columns of docs and mix_size, mix_source_size, mix_target (double), mix_copies, mix_taken (copies * size)."""
    store = Store(docs.sparkSession, "mixing")
    docs = docs.drop(*RESULTS)
    stripes = min(MOST_STRIPES, max(stripes, 1 << (docs.count() // ROWS).bit_length()))
    whole = F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes])
    work = docs.select(F.struct(*docs.columns).alias("doc"), whole.alias("whole"))
    size = F.coalesce(F.regexp_count(F.col(f"doc.{text_col}"), F.lit(WORD)), F.lit(0)).cast("long")
    work = work.select("doc", "whole", F.col(f"doc.{id_col}").alias("id"), F.col(f"doc.{source_col}").alias("source"), size.alias("size"))
    work = work.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    # classes of half an octave, by whole numbers: bits of the size, and whether its square passes the octave's middle
    bits = F.length(F.bin("size")).cast("long")
    middle = F.expr("shiftleft(1L, cast(2 * length(bin(size)) - 1 as int))")
    work = work.withColumn("band", F.when(F.col("size") == 0, -1).otherwise(2 * bits + F.when(F.col("size") * F.col("size") >= middle, 1).otherwise(0)).cast("int"))
    own = _md5_number(F.coalesce(F.col("id").cast("string"), F.lit("")), 4)
    work = _dealt(work, store).withColumn("stripe", F.pmod(own + F.col("step"), F.lit(stripes)).cast("int")).drop("step")
    groups = store.put(work.groupBy("source_key", "band", "stripe").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("source").alias("source")), "groups")
    goals = targets(groups)
    along = Window.partitionBy("source_key").orderBy("band", "stripe")
    counted = groups.withColumn("before", F.coalesce(F.sum(F.when(F.col("band") >= 0, F.col("n")).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = store.put(counted.select("source_key", "band", "stripe", "before").join(goals, "source_key"), "plan")
    rank = F.row_number().over(Window.partitionBy("source_key", "band", "stripe").orderBy("size", "id", "whole")) + F.col("before")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    offset = _md5_number(F.concat(F.lit(seed), "source_key"), 8) / float(1 << 32)
    placed = work.join(plan, ["source_key", "band", "stripe"]).withColumn("at", rank)
    copies = F.when(F.col("size") > 0, F.floor(rate * F.col("at") + offset) - F.floor(rate * (F.col("at") - 1) + offset)).otherwise(0).cast("long")
    return placed.withColumn("copies", copies).select(
        "doc.*", F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("copies").alias("mix_copies"), (F.col("copies") * F.col("size")).alias("mix_taken")
    )
