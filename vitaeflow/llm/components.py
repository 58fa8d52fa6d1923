"""Connected components of links between numbered nodes, by contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeflow.llm.common import write_down


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``links (a, b)``; the component is its smallest node.

    Each round sends every node to its smallest neighbour and that one's, and draws the links again
    between the results, so that a star ends after one round and a path loses more than half its
    nodes. Every round is written to the shared folder, where a lost executor's work is found again.
    """
    pairs = write_down(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    label = write_down(nodes.withColumn("component", F.col("node")), "labels")
    while not pairs.isEmpty():
        both = pairs.union(pairs.select("b", "a"))
        near = write_down(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "near")
        beyond = near.select(F.col("a").alias("to"), F.col("to").alias("beyond"))
        moved = write_down(near.join(beyond, "to", "left").select(F.col("a").alias("was"), F.coalesce("beyond", "to").alias("now")), "moved")
        first = moved.select(F.col("was").alias("a"), F.col("now").alias("a2"))
        second = moved.select(F.col("was").alias("b"), F.col("now").alias("b2"))
        pairs = write_down(
            pairs.join(first, "a").join(second, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .where("a < b").distinct(), "links")
        component = moved.select(F.col("was").alias("component"), "now")
        label = write_down(
            label.join(component, "component", "left").select("node", F.coalesce("now", "component").alias("component")), "labels")
    return label
