"""Connected components as joins, with tables cut off by checkpoints in the folder that a cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; only a local session that names none gets a temporary folder."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidecube-checkpoint-")
    return _local[context.applicationId]


def kept(df: DataFrame) -> DataFrame:
    """df computed once and cut from its lineage: a reliable checkpoint in the shared folder, which survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def components(links: DataFrame, keys=()) -> DataFrame:
    """(keys.., node, component) for each node of links(keys.., a, b); component is the smallest node it reaches, within its keys.

    Each node points at its smallest neighbour, pointers are followed to their ends by doubling, and the links between ends are what the
    next round works on: at most half as many nodes. Everything is an equi-join or a partial minimum; a count a step comes to the driver.
    """
    keys = list(keys)
    pairs = kept(links.where("a <> b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        both = pairs.union(pairs.select(*keys, "b", "a"))
        ends = both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("to"))
        while True:
            after = ends.select(*keys, F.col("node").alias("to"), F.col("to").alias("next"))
            ends = kept(ends.join(after, [*keys, "to"]).select(*keys, "node", F.col("next").alias("to"), (F.col("next") < F.col("to")).alias("moved")))
            moved = ends.where("moved").limit(1).count()
            ends = ends.select(*keys, "node", "to")
            if not moved:
                break
        if labels is None:
            labels = ends.select(*keys, "node", F.col("to").alias("component"))
        else:
            further = ends.select(*keys, F.col("node").alias("component"), "to")
            labels = kept(labels.join(further, [*keys, "component"], "left").select(*keys, "node", F.coalesce("to", "component").alias("component")))
        for side in "ab":
            pairs = pairs.join(ends.select(*keys, F.col("node").alias(side), F.col("to").alias(f"to_{side}")), [*keys, side])
        pairs = pairs.where("to_a <> to_b").select(*keys, F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        pairs = kept(pairs)
        if not pairs.limit(1).count():
            return labels
