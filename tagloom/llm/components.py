"""Connected components of a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagloom.sources.staging import stage

MOST_ROUNDS = 200


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Each round takes the smallest label among a node's neighbours and then the label of that label,
    which at least halves the distance to the smallest node in practice. Labels and links stay
    distributed; every round is written to the shared folder, which cuts the lineage and outlives
    executors. Minima are combined before each shuffle, so a node with very many links is no
    hot spot; only the number of changed labels comes to the driver. Nulls link nothing; repeated
    links count once; an empty table gives no rows.
    """
    links = links.select("a", "b").dropna().where("a <> b")
    both = stage(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    for _ in range(MOST_ROUNDS):
        heard = (
            both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("heard"))
        )
        near = labels.join(heard, labels.node == heard.a).select(
            "node", F.col("component").alias("old"), F.least("component", "heard").alias("component")
        )
        up = labels.select(F.col("node").alias("up"), F.col("component").alias("further"))
        nearer = near.join(up, near.component == up.up).select(
            "node", F.least("component", "further").alias("component"), "old"
        )
        nearer = stage(nearer)
        changed = nearer.where("component <> old").limit(1).count()
        labels = nearer.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {MOST_ROUNDS} rounds")
