"""Cutting lineage in the folder that the driver and all executors share, and connected components on top of it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a session on one machine gets a temporary one; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, as Parquet in the shared folder: later plans read the files, whatever executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, *, rounds: int = 50) -> DataFrame:
    """node, label: the smallest node that each node of ``edges`` (a, b: of one type that can be ordered) is joined to. Loops count as nodes.

    Each round hooks every node's label to the smallest label around it and then follows labels of labels, so chains shorten by half or more; every
    round is stored. Minima are aggregated before they are shuffled, so a node with very many edges gathers nothing.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    now = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "component-labels")
    for _ in range(rounds):
        of = now.select(F.col("node").alias("b"), F.col("label").alias("low"))
        around = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        best = now.join(around, "node").select("node", "label", F.least("label", "low").alias("low"))
        hooked = best.groupBy(F.col("label").alias("node")).agg(F.min("low").alias("hook"))  # the label's own node takes what its followers see
        best = best.join(hooked, "node", "left").select("node", "label", F.least("low", F.coalesce("hook", "low")).alias("low"))
        jump = best.select(F.col("node").alias("low"), F.col("low").alias("next"))
        after = stored(best.join(jump, "low", "left").select("node", F.least("low", F.coalesce("next", "low")).alias("label"), F.col("label").alias("was")), "component-labels")
        settled = after.where("label <> was").isEmpty()
        now = after.select("node", "label")
        if settled:
            return now
    raise RuntimeError(f"components have not settled after {rounds} rounds")
