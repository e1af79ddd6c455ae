"""Connected components of an edge table: by contraction, as joins and aggregations, until few edges are left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches, trimmed
from .store import materialize

FINISH = 200_000  # edges of at most so many are united in one task


def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All edges a, b to node, root; root is the smallest node of its component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            low, high = sorted((find(a), find(b)))
            root[high] = low
    nodes = list(root)
    yield pd.DataFrame({"node": np.array(nodes, np.int64), "root": np.array([find(n) for n in nodes], np.int64)})


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (long). Returns node, root for every node of an edge; root is the smallest node reachable.

    Each round every node points to its smallest neighbour (or itself), pointers are followed once more, edges move to
    where their ends point, and edges inside one node vanish. The graph at least halves a round. Aggregations combine
    before the shuffle, and joins on a hub are equi-joins that adaptive execution can split. Once ``FINISH`` edges or fewer are left, one
    task unites what they join.
    """
    small_batches(edges.sparkSession)
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    known = None
    while edges.count() > FINISH:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        parent = ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up"))
        parent = materialize(parent, "parents")
        twice = parent.alias("p").join(parent.select(F.col("node").alias("up"), F.col("up").alias("top")), "up")
        parent = materialize(twice.select("node", F.col("top").alias("up")), "parents")
        if known is None:
            known = parent.select("node", F.col("up").alias("root"))
        else:
            moved = known.join(parent.select(F.col("node").alias("root"), "up"), "root", "left")
            known = moved.select("node", F.coalesce("up", "root").alias("root"))
        known = materialize(known, "roots")
        at_a = edges.join(parent.select(F.col("node").alias("a"), F.col("up").alias("to_a")), "a")
        at_b = at_a.join(parent.select(F.col("node").alias("b"), F.col("up").alias("to_b")), "b")
        left = at_b.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = materialize(left.distinct(), "edges")
    last = materialize(edges.repartition(1).mapInPandas(trimmed(unite), "node long, root long"), "roots")
    if known is None:
        return last
    moved = known.join(last.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    return materialize(moved.select("node", F.coalesce("to", "root").alias("root")), "roots")
