"""Connected components of links too many for one machine.

Every node with a smaller neighbour points to its smallest one. That is a forest;
its roots are found by pointer jumping, the links are relabelled with the roots,
and what still joins two roots goes around again. At least half of the linked nodes
lose their label each time. Every round is written, so a lost executor costs a
task and not the rounds before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import written


def roots(parents: DataFrame) -> DataFrame:
    """``u, v`` with v < u, one row a node, followed up to the last node without a parent."""
    current = written(parents.select("u", "v"), "parents")
    while True:
        up = current.select(F.col("u").alias("v"), F.col("v").alias("up"))
        jumped = written(
            current.join(up, "v", "left").select(
                "u", F.coalesce("up", "v").alias("v"), F.col("up").isNotNull().alias("moved")
            ),
            "parents",
        )
        current = jumped.select("u", "v")
        if not jumped.filter("moved").take(1):
            return current


def relabel(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The links between labels instead of nodes, each once, none from a label to itself."""
    for side in ("u", "v"):
        names = labels.select(F.col("u").alias(side), F.col("v").alias("__to"))
        links = links.join(names, side, "left").withColumn(side, F.coalesce("__to", side)).drop("__to")
    return links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def compose(first: DataFrame | None, then: DataFrame) -> DataFrame:
    """Labels of ``first`` renamed by ``then``, and the nodes that only ``then`` has."""
    if first is None:
        return then
    names = then.select(F.col("u").alias("v"), F.col("v").alias("__to"))
    renamed = first.join(names, "v", "left").select("u", F.coalesce("__to", "v").alias("v"))
    return written(renamed.unionByName(then), "labels")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``u, v``: the smallest node reachable from u, for every node that is not it.

    ``links`` has columns u and v; ``known`` is the result for earlier links.
    Links that are repeated, reversed or from a node to itself change nothing.
    """
    links = links.select("u", "v")
    if known is not None:
        links = relabel(links, known)
    links = written(links.filter("u <> v").distinct(), "links")
    labels = known
    while links.take(1):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        found = roots(both.groupBy("u").agg(F.min("v").alias("v")).filter("v < u"))
        labels = compose(labels, found)
        links = written(relabel(links, found), "links")
    if labels is None:
        return links.limit(0)
    return labels
