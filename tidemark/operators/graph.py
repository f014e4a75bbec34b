"""Street graphs: components, bounded shortest paths and catchments as loops of joins on written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary folder for local masters (tests) only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tidemark.loops", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-", dir="/tmp")
        spark.conf.set("spark.tidemark.loops", where)
    return where.rstrip("/")


class Rounds:
    """A table that each round of a loop writes anew; once a round is written, the one before is deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.stem, self.last = spark, f"{shared_dir(spark)}/{name}", None

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.stem}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        if self.last:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.last)
            old.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that loops have no lineage to lose."""
    return Rounds(df.sparkSession, name).put(df)


def undirected(edges: DataFrame) -> DataFrame:
    """u < v, zero lengths gone, the shorter of parallel edges."""
    tidy = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "len").filter("u <> v and len > 0")
    return tidy.groupBy("u", "v").agg(F.min("len").alias("len"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v", "len").union(edges.select("v", "u", "len"))


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): labels spread along edges and jump to their label's label."""
    links = written(both_ways(edges).select("u", "v"), "links")
    rounds = Rounds(edges.sparkSession, "labels")
    labels = rounds.put(links.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = links.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("low"))
        new = labels.join(near, F.col("node") == F.col("u"), "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("low", "component")).alias("component"))
        up = new.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = rounds.put(new.join(up, "component", "left").select("node", "old", F.least("component", F.coalesce("root", "component")).alias("component")))
        labels = new.select("node", "component")
        if not new.filter("old <> component").take(1):
            return labels


def shortcuts(ways: DataFrame, doublings: int, cutoff: float) -> DataFrame:
    """u, v, len with the least length of all ways of up to 2 ** doublings edges: each doubling joins the ways to
    themselves once, for all sources that will use them."""
    ways = written(ways.groupBy("u", "v").agg(F.min("len").alias("len")), "ways")
    for _ in range(doublings):
        on = ways.select(F.col("u").alias("v"), F.col("v").alias("to"), F.col("len").alias("more"))
        longer = ways.join(on, "v").filter("u <> to").select("u", F.col("to").alias("v"), (F.col("len") + F.col("more")).alias("len")).filter(F.col("len") <= cutoff)
        ways = written(ways.unionByName(longer).groupBy("u", "v").agg(F.min("len").alias("len")), "ways")
    return ways


def reach(sources: DataFrame, edges: DataFrame, cutoff: float, doublings: int = 2) -> DataFrame:
    """sources: source, node, dist; edges: u < v, len -> least distance of every node within cutoff of a source.

    All sources advance together; a round joins only what has improved and keeps what beats the known distance. A round
    steps along shortcuts of up to 2 ** doublings edges, so there are as many rounds as the longest path has of these."""
    ways = shortcuts(both_ways(edges), doublings, cutoff)
    knowns, fronts = Rounds(edges.sparkSession, "known"), Rounds(edges.sparkSession, "front")
    known = knowns.put(sources.groupBy("source", "node").agg(F.min("dist").alias("dist")))
    front = known
    while front.take(1):
        step = front.join(ways, F.col("node") == F.col("u")).select("source", F.col("v").alias("node"), (F.col("dist") + F.col("len")).alias("new")).filter(F.col("new") <= cutoff)
        step = step.groupBy("source", "node").agg(F.min("new").alias("new"))
        front = fronts.put(step.join(known, ["source", "node"], "left").filter("dist is null or new < dist").select("source", "node", F.col("new").alias("dist")))
        known = knowns.put(known.unionByName(front).groupBy("source", "node").agg(F.min("dist").alias("dist")))
    return known


def component_stats(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Length, edges, nodes and junctions (three edges or more) of each component."""
    by_edge = edges.join(labels, F.col("u") == F.col("node")).groupBy("component").agg(F.sum("len").alias("total_len"), F.count("*").alias("edge_count"))
    degree = both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))
    by_node = degree.join(labels, "node").groupBy("component").agg(F.count("*").alias("node_count"), F.count_if(F.col("degree") >= 3).alias("junction_count"))
    return by_edge.join(by_node, "component")


def reached_edges(distances: DataFrame, edges: DataFrame, cutoffs: list[tuple[int, float]]) -> DataFrame:
    """Edges of which both ends are within each cutoff: minutes, source, u, v."""
    at = lambda n, d: distances.select("source", F.col("node").alias(n), F.col("dist").alias(d))
    ends = edges.join(at("u", "du"), "u").join(at("v", "dv"), ["source", "v"])
    bands = F.explode(F.array(*[F.struct(F.lit(m).alias("minutes"), F.lit(float(c)).alias("cutoff")) for m, c in cutoffs]))
    return ends.withColumn("band", bands).filter(F.greatest("du", "dv") <= F.col("band.cutoff")).select("band.minutes", "source", "u", "v", *[c for c in edges.columns if c not in ("u", "v")])
