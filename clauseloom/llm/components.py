"""Connected components of a link table, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.session import materialize


def _roots(parents: DataFrame) -> DataFrame:
    """(node, parent) forest to (node, parent = root): each pass doubles the length of a step."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = materialize(parents.join(up, "parent", "left").select(
            "node", F.coalesce("above", "parent").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "roots")
        parents = step.select("node", "parent")
        if step.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node in ``links`` (a, b); the label is the smallest node that links reach.

    A distributed union-find. In each round every set points to the smallest set that it touches, pointers are followed to their
    roots, and links are rewritten between roots; sets that touch others at least halve in number, so the rounds are few. Each
    round is stored in the shared folder. Both sides of each join are stored tables, so a hub's rows are split by adaptive
    execution. Null ends and self links name nodes without linking them; null nodes are left out.
    """
    links = links.select("a", "b")
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).where("node IS NOT NULL").distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("label")), "labels")
    open_links = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while not open_links.isEmpty():
        both = open_links.unionByName(open_links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        forest = materialize(nearest.select("node", F.least("node", "parent").alias("parent")), "forest")
        roots = _roots(forest)
        moved = roots.select(F.col("node").alias("label"), F.col("parent").alias("to"))
        labels = materialize(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        for end in ("a", "b"):
            renamed = roots.select(F.col("node").alias(end), F.col("parent").alias("to"))
            open_links = open_links.join(renamed, end).drop(end).withColumnRenamed("to", end)
        open_links = materialize(open_links.where("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return labels
