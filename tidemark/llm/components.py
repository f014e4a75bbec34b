"""Connected components of a link table by label spreading with pointer jumping, on checkpointed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import Store


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links: a long, b long, any direction, repeats allowed. Returns id, component (the smallest id reachable) for every
    id that occurs. Rounds: hook every root to the smallest root seen across a link, then jump to the root's root; a
    link whose ends have one root is dropped, so the tables shrink. No key is ever gathered: groupings are minima."""
    store = Store(links.sparkSession, name)
    edges = store.put(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0")
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    labels = store.put(ids.select("id", F.col("id").alias("component")), "labels-0")
    level = 0
    while edges.take(1):
        level += 1
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("to")).filter("to < a")
        hooks = store.put(hooks.select(F.col("a").alias("root"), "to"), f"hooks-{level}")
        jumping = True
        jumps = 0
        while jumping:  # every chain of hooks falls strictly, so doubling ends at its root
            up = hooks.select(F.col("root").alias("to"), F.col("to").alias("next"))
            further = store.put(hooks.join(up, "to", "left").select("root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), f"hooks-{level}-{jumps}")
            jumping = bool(further.filter("moved").take(1))
            store.drop(f"hooks-{level}" if jumps == 0 else f"hooks-{level}-{jumps - 1}")
            hooks, jumps = further.select("root", "to"), jumps + 1
        labels = store.put(labels.join(hooks.withColumnRenamed("root", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("component")), f"labels-{level}")
        to_a, to_b = hooks.select(F.col("root").alias("a"), F.col("to").alias("ta")), hooks.select(F.col("root").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")).filter("a <> b")
        edges = store.put(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"edges-{level}")
        store.drop(f"hooks-{level}-{jumps - 1}", f"labels-{level - 1}", f"edges-{level - 1}")
    store.drop(f"edges-{level}")
    return labels
