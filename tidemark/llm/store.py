"""Intermediate tables in the cluster's shared folder, so that lineage is cut durably."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts in which equal rows are numbered.
PARTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary folder for local masters (tests) only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.conf.get("spark.tidemark.shared", None)
        if not where:
            if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            where = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-", dir="/tmp")
            spark.conf.set("spark.tidemark.shared", where)
    return where.rstrip("/")


class Store:
    """Tables written once as Parquet and read back; ``drop`` removes one that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self._free_shuffles()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def _free_shuffles(self) -> None:
        """Shuffle files of a finished job go when the driver's garbage does; ask for that between large steps."""
        self.spark.sparkContext._jvm.System.gc()


def numbered(rows: DataFrame) -> DataFrame:
    """rows: row (unique), whole, part, stored -> row, whole, number from 0 among the rows of one whole. A whole that many
    rows hold is numbered part by part, from the counts of the parts before."""
    sizes = rows.groupBy("whole", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("whole").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.row_number().over(Window.partitionBy("whole", "part").orderBy("row")) - 1
    return rows.withColumn("here", here).join(sizes.select("whole", "part", before.alias("before")), ["whole", "part"]).select("row", "whole", (F.col("before") + F.col("here")).alias("number"))
