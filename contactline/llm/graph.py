"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactline.runtime import materialise

#: Narrow rows of a file, about.
ROWS = 250_000


def written(df: DataFrame, name: str, rows: int) -> DataFrame:
    """``materialise`` for narrow tables of at most about ``rows`` rows, in as many files as these
    need: loops write many of them."""
    return materialise(df.coalesce(1 + rows // ROWS), name)


def _roots(parents: DataFrame, rows: int) -> DataFrame:
    """Pointer jumping: ``node, parent`` of a forest to ``node, parent`` with the root as parent."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        joined = written(
            parents.join(above, "parent", "left").select(
                "node", F.coalesce("_up", "parent").alias("parent"),
                F.col("_up").isNotNull().alias("moved")),
            "parents", rows)
        parents = joined.select("node", "parent")
        if joined.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` to ``node, component`` (the smallest node reachable) for all nodes of the edges.

    Each round, every node takes its smallest neighbour as parent if that is smaller, the trees are
    flattened by pointer jumping, and the edges between their roots go on. At least half of the nodes
    that still have edges are hooked each round. Edges with a null end or equal ends are left out.
    """
    edges = materialise(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(), "edges")
    rows = edges.count()
    labels = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().select(
        "node", F.col("node").alias("component"))
    while rows:
        hooks = edges.groupBy("u").agg(F.min("v").alias("parent"))
        trees = _roots(
            written(hooks.select(F.col("u").alias("node"), "parent"), "hooks", rows), rows)
        at = lambda c: trees.select(F.col("node").alias(c), F.col("parent").alias(f"_{c}"))  # noqa: E731,B023
        labels = written(
            labels.join(at("component"), "component", "left").select(
                "node", F.coalesce("_component", "component").alias("component")), "labels", 2 * rows)
        moved = edges.join(at("u"), "u", "left").select(
            F.coalesce("_u", "u").alias("u"), "v").join(at("v"), "v", "left").select(
            "u", F.coalesce("_v", "v").alias("v"))
        edges = written(
            moved.where("u <> v").select(
                F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
            "edges", rows)
        rows = edges.count()
    return labels
