"""Connected components of an edge table, by joins and grouped minima alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.common import discard, materialize


def _downward(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp: the least node that each node can reach; nodes without an edge come from ``nodes``.

    Every round each node hooks onto its least neighbour below it, a minimum that is aggregated
    before the shuffle, so a hub's links meet as one row a task. Hooks only lead down; halving
    their paths makes them single steps. A link that became a hook is done, which ends all links
    of a star in the round that finds it; the others are contracted to links of the roots. At
    least half of the nodes that have links go in a round. Each table is written to the shared
    folder and deleted when the next one is.
    """
    links = materialize(_downward(edges, a, b), "links")
    own = links.select(F.col("x").alias("node")).union(links.select(F.col("y").alias("node")))
    own = own.union(nodes.select(F.col(nodes.columns[0]).alias("node"))) if nodes is not None else own
    labels = materialize(own.distinct().withColumn("comp", F.col("node")), "labels")
    while not links.isEmpty():
        hooks = materialize(links.groupBy(F.col("x").alias("root")).agg(F.min("y").alias("to")), "hooks")
        done = hooks
        while True:  # paths of hooks become single steps
            up = hooks.select(F.col("root").alias("to"), F.col("to").alias("up"))
            if hooks.join(up, "to", "left_semi").isEmpty():
                break
            shorter = materialize(hooks.join(up, "to", "left").select("root", F.coalesce("up", "to").alias("to")), "hooks")
            if hooks is not done:
                discard(hooks)
            hooks = shorter
        top = hooks.select(F.col("root").alias("comp"), "to")
        relabelled = materialize(labels.join(top, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        rest = links.join(done.select(F.col("root").alias("x"), F.col("to").alias("y")), ["x", "y"], "left_anti")
        tx, ty = (hooks.select(F.col("root").alias(c), F.col("to").alias(f"{c}_to")) for c in ("x", "y"))
        rest = rest.join(tx, "x", "left").join(ty, "y", "left")
        rest = rest.select(F.coalesce("x_to", "x").alias("x"), F.coalesce("y_to", "y").alias("y"))
        contracted = materialize(_downward(rest, "x", "y"), "links")
        discard(labels, links, done, hooks)
        labels, links = relabelled, contracted
    discard(links)
    return labels
