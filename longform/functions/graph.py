"""Connected components of an edge table, by contraction; every step is checkpointed in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longform.session import checkpoint_dir


def _flatten(parents: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, node, root)`` of a forest ``(keys, node, root)`` of parents: each step doubles the way looked up."""
    while True:
        up = parents.select(*keys, F.col("node").alias("root"), F.col("root").alias("_up"))
        parents = parents.join(up, [*keys, "root"], "left").select(
            *keys, "node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")).checkpoint()
        if parents.where("_moved").isEmpty():
            return parents.drop("_moved")
        parents = parents.drop("_moved")


def components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``nodes`` (``keys, node``) with ``root``, the smallest node that can be reached along ``edges`` (``keys, a, b``).

    Each round hooks every root to its smallest smaller neighbour, flattens the trees by pointer doubling and contracts the
    edges to the roots; roots with edges at least halve, so rounds grow with the logarithm of the nodes, as do the steps of
    a round. A hub costs one partial aggregate; the driver sees whether a table is empty.
    """
    checkpoint_dir(nodes.sparkSession)
    labels = nodes.select(*keys, "node", F.col("node").alias("root"))
    links = (edges.where(F.col("a") != F.col("b"))
             .select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint())
    while not links.isEmpty():
        hooks = links.groupBy(*keys, "b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node")
        roots = _flatten(hooks.checkpoint(), keys)
        of = {c: roots.select(*keys, F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in ("root", "a", "b")}
        labels = labels.join(of["root"], [*keys, "root"], "left").select(
            *keys, "node", F.coalesce("_root", "root").alias("root")).checkpoint()
        links = links.join(of["a"], [*keys, "a"], "left").join(of["b"], [*keys, "b"], "left").select(
            *keys, F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where(F.col("a") != F.col("b"))
        links = links.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    return labels
