"""Connected components of a graph given as edges, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteleaf.llm.common import hot_keys, spread_join, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b) of any orderable type -> (node, root): root is the least node of the component.

    Every round sends labels along edges (a node's least is taken map-side first), then replaces each label by its label's
    label, so long chains halve; each round is stored, and the last leaves no label changed. The edges of a hub, and the
    members of a large component that look up their root, are dealt over several tasks (spread_join). Edges are read as
    undirected; loops and repeated edges do no harm. No edges give no rows.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    hubs = hot_keys(both, "a")
    for _ in range(rounds):
        told = spread_join(both, labels.select(F.col("node").alias("a"), "root"), "a", hot=hubs)
        sent = told.groupBy(F.col("b").alias("node")).agg(F.min("root").alias("m"))
        near = stored(labels.join(sent, "node").select("node", F.least("root", "m").alias("root"), F.col("root").alias("was")), "labels-near")
        far = near.select(F.col("node").alias("root"), F.col("root").alias("far")).where("root <> far")
        least = F.coalesce(F.least("root", "far"), F.col("root"))
        now = stored(spread_join(near, far, "root", "left").select("node", least.alias("root"), (least != F.col("was")).alias("moved")), "labels")
        labels = now.select("node", "root")
        if now.where("moved").isEmpty():
            return labels
    raise RuntimeError("the graph's components were not found in the rounds allowed")
