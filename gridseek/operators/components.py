"""Connected components of a graph given as an edge table (union-find closure, X6/X7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseek.plans.durable import discard, materialize

#: Edges of a task that are contracted together.
BATCH_EDGES = 1_000_000
_EDGE = "a long, b long"


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges that are not the least of their set, and the least of their set."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    a, b = place[: len(a)], place[len(a) :]
    while len(a):
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[a], root[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's edges as stars around the least node of each set, some edges at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch.to_numpy(dtype=np.int64))
        size += len(batch)
        if size >= BATCH_EDGES:
            yield pd.DataFrame(dict(zip("ab", local_roots(*np.concatenate(held).T))))
            held, size = [], 0
    if held:
        yield pd.DataFrame(dict(zip("ab", local_roots(*np.concatenate(held).T))))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them; edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least.hint("merge"), "a")
    return joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def _unsettled(edges: DataFrame) -> bool:
    """Whether a node is tied to two others, or to one that is tied itself."""
    ends = edges.select("a", F.lit(1).alias("up")).union(edges.select(F.col("b").alias("a"), F.lit(0).alias("up")).distinct())
    odd = ends.groupBy("a").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("ends")).where("ups > 1 OR ups > 0 AND ends > ups")
    return bool(odd.take(1))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label the nodes of ``edges`` (long integers) by the least node that they can reach.

    Each task first contracts the edges it has to stars, which is exact and leaves at most one edge of a
    node for each task, then large-star and small-star steps alternate until every node is tied to one
    root. They are aggregations by node and joins, so that no neighbour list is ever collected, and no
    side passes through the driver as a broadcast, whose sum would grow with the rounds; the
    joins of a hub are left to Spark's splitting of skewed joins. Each round is a table in the shared
    folder that replaces the one before. The number of rounds grows with the logarithm of the size.

    Returns ``(node, component)``, one row per node that has an edge to another node; self loops and null
    ends are ignored; no edges give no rows.
    """
    given = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    now = materialize(given.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).mapInPandas(_contract, _EDGE))
    while _unsettled(now):
        before, now = now, materialize(_small_star(_large_star(now)).mapInPandas(_contract, _EDGE))
        discard(before)
    tied = now.select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
    return tied.union(now.select("b", "b").distinct())
