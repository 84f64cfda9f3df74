"""Connected components by contraction, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.common import store


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of the links; nodes of one component share a root.

    Each round points every node at its smallest neighbour (or itself) and
    replaces the links by those between the nodes pointed at; the rounds' maps
    are then followed in turn.  Node ids should be hash-like longs: then about
    half of the linked nodes go in each round, whatever the shape.  Every round
    is stored; no link or node comes to the driver.
    """
    edges = store(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "links")
    maps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = store(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                   .select("node", F.least("node", "low").alias("to")), "round")
        maps.append(to)
        at = edges.join(to.withColumnsRenamed({"node": "a", "to": "x"}), "a")
        at = at.join(to.withColumnsRenamed({"node": "b", "to": "y"}), "b").where("x <> y")
        edges = store(at.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
    found = maps[0].select("node", F.col("to").alias("root"))
    for to in maps[1:]:
        step = to.select(F.col("node").alias("s_node"), F.col("to").alias("s_to"))
        found = found.join(step, F.col("root") == F.col("s_node"), "left").select(
            "node", F.coalesce("s_to", "root").alias("root"))
    return store(found, "components")
