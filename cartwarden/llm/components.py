"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over edges(a, b), a > b. Large-star ties larger neighbours to the least one, small-star the others.

    The least neighbour of a vertex is a map-side combined aggregate, so that a hub's edges never meet in one task.
    """
    if larger:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a")
    return (
        tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
        .where("a > b")
        .distinct()
    )


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of edges(a, b), longs or strings; component is the least node reachable.

    Loops and edges with a null end are left out. Each round is written to the shared folder, which cuts the lineage;
    rounds end when one changes nothing, after about log2 of the longest chain.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    mark = None
    while True:
        after = written(_stars(_stars(now, True), False), name)
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        now, mark = after, seen


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest that joins what the pairs (a, b) of int64 join: (member, least member) of each component.

    Min-label propagation with pointer jumping over arrays; used inside tasks, so that a group of copies leaves a task
    as one link a member instead of all its pairs.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]
