"""Connected components of a link table by smallest labels and pointer jumping, in Spark joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``links`` (a, b): comp is the smallest node of the component.

    Each round a node takes the smallest label among its neighbours' and its own, then its label's label; chains halve,
    so long ones take a logarithm of their length in rounds, stars two. Labels are written once a round.
    """
    spark = links.sparkSession
    both = stored(spark, links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("_near"))
        own = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("_was"), F.least("comp", "_near").alias("comp"))
        up = labels.select(F.col("node").alias("_at"), F.col("comp").alias("_up"))
        new = own.join(up, F.col("comp") == F.col("_at"), "left").select("node", "_was", F.least("comp", F.coalesce("_up", "comp")).alias("comp"))
        new = stored(spark, new, "labels")
        if new.where("comp < _was").limit(1).count() == 0:
            return new.select("node", "comp")
        labels = new.select("node", "comp")
