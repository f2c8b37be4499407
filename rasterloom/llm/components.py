"""Connected components of links between 64-bit ids, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import common


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in a link; a component is named after its least id.

    Each round, every id takes the least label among its neighbours, and then the label of
    that label, until nothing changes; the rounds grow with the logarithm of a chain's length.
    Counting is combined before each shuffle, so an id of many links is no burden. Each
    round is stored, which cuts lineage and survives lost executors.
    """
    both = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    both = common.stored(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    # Every id starts with its least neighbour, or itself.
    labels = common.stored(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.min("src")).alias("label")), "labels")
    while True:
        offered = both.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("offer"))
        nearer = labels.join(offered, "id", "left").select("id", F.least("label", F.coalesce("offer", "label")).alias("label"), F.col("label").alias("old"))
        nearer = common.stored(nearer, "labels")
        jump = nearer.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = common.stored(nearer.join(jump, "label", "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label"), "old"), "labels")
        if new.where("label <> old").isEmpty():
            return new.select("id", F.col("label").alias("component"))
        labels = new.drop("old")
