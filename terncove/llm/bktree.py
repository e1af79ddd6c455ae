"""BK-trees over 64-bit fingerprints: all links within a radius, without comparing all pairs.

Fingerprints are cut into ``blocks`` blocks. What differs in at most ``radius`` bits agrees in ``blocks - radius`` of them at least, so
each fingerprint goes to one shard for every choice of so many blocks, named by the choice and its bits there, and every link lies
inside a shard. The number of blocks grows with the number of fingerprints (``choose_blocks``): with radius 3 a shard's name has
16 bits up to some millions, then 25, then 32, so that shards stay small. A shard's fingerprints form a BK-tree: the children of a
node are keyed by their Hamming distance to it, and a search for ``x`` at distance ``d`` from a node follows only the edges from
``d - radius`` to ``d + radius``. All shards of a batch are built and searched together, level by level, with vector operations. A
shard above ``SHARD`` fingerprints is dealt over pairs of sub-shards (tiles), each a tree of bounded size searched by the
fingerprints of the other; nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches, trimmed
from .store import materialize, slots

SHARD = 4096
BATCH = 32_768  # fingerprints that one search holds, unless a tile is larger
EXPECTED = 256  # fingerprints in a shard, were their bits random


def choose_blocks(n: int, radius: int, most: int = 16) -> int:
    """The fewest blocks with which shards of ``n`` random fingerprints hold ``EXPECTED`` or fewer."""
    for blocks in range(radius + 1, most):
        bits = 64 * (blocks - radius) // blocks
        if n <= EXPECTED << bits or comb(blocks + 1, radius) > 200:
            return blocks
    return most


class BkForest:
    """BK-trees of several groups of distinct values, stored as arrays."""

    def __init__(self, groups: np.ndarray, values: np.ndarray):
        """``groups`` ascending; the first value of a group is its root."""
        self.values = values
        self.group_ids, self.roots = np.unique(groups, return_index=True)
        waiting = np.setdiff1d(np.arange(len(values)), self.roots, assume_unique=True)
        at = self.roots[np.searchsorted(self.group_ids, groups[waiting])]
        keys, children = [], []
        while len(waiting):
            key = at * 128 + np.bitwise_count(values[waiting] ^ values[at])
            found, first, which = np.unique(key, return_index=True, return_inverse=True)
            keys.append(found)
            children.append(waiting[first])
            settled = np.zeros(len(waiting), bool)
            settled[first] = True
            at, waiting = children[-1][which][~settled], waiting[~settled]
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        self.children = np.concatenate(children) if children else np.empty(0, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.children = self.keys[order], self.children[order]

    def within(self, groups: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) index pairs of the same group whose values differ in at most ``radius`` bits."""
        place = np.searchsorted(self.group_ids, groups)
        has = (place < len(self.group_ids)) & (self.group_ids[np.minimum(place, len(self.group_ids) - 1)] == groups)
        query = np.flatnonzero(has)
        node, hits = self.roots[place[query]], []
        while len(query):
            d = np.bitwise_count(values[query] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            hits.append((query[near], node[near]))
            lo = np.searchsorted(self.keys, node * 128 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, node * 128 + d + radius, "right")
            n = hi - lo
            query = np.repeat(query, n)
            node = self.children[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        if not hits:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def _join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after uniting the labels of a[i] and b[i]; labels are indices of their smallest member."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        pairs = np.unique(np.minimum(x, y)[apart] * len(labels) + np.maximum(x, y)[apart])
        low, high = pairs // len(labels), pairs % len(labels)
        to = np.arange(len(labels))
        np.minimum.at(to, high, low)
        while (to[to] != to).any():
            to = to[to]
        labels = to[labels]


def _hits(groups: np.ndarray, values: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (asking value, value of the tree within the radius of it), in parts; ``groups`` ascending."""
    tree, queries = np.flatnonzero(in_tree), np.flatnonzero(asks)
    if len(tree):
        forest = BkForest(groups[tree], values[tree])
        sizes = np.bincount(np.searchsorted(forest.group_ids, groups[tree]))
        place = np.minimum(np.searchsorted(forest.group_ids, groups[queries]), len(sizes) - 1)
        work = np.cumsum(sizes[place])  # a search holds at most about this many pairs at a time
        for part in np.split(queries, np.searchsorted(work, np.arange(2_000_000, int(work[-1]) + 1 if len(work) else 0, 2_000_000))):
            q, t = forest.within(groups[part], values[part], radius)
            yield part[q], tree[t]


def stars(groups: np.ndarray, values: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, smallest-index member's value) of the components inside each group; ``groups`` ascending."""
    labels = np.arange(len(values))
    for q, t in _hits(groups, values, in_tree, asks, radius):
        labels = _join_labels(labels, q, t)
    other = np.flatnonzero(labels != np.arange(len(labels)))
    return values[other], values[labels[other]]


def direct(groups: np.ndarray, values: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each value with others within the radius in its group: itself and the first of those."""
    labels_q, labels_t = [], []
    for q, t in _hits(groups, values, in_tree, asks, radius):
        other = values[q] != values[t]
        q, t = q[other], t[other]
        order = np.lexsort((t, q))
        q, t = q[order], t[order]
        head = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        labels_q.append(q[head])
        labels_t.append(t[head])
    if not labels_q:
        return values[:0], values[:0]
    return values[np.concatenate(labels_q)], values[np.concatenate(labels_t)]


def _search(radius: int, find):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def emit(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = find(
                pdf["shard"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(np.uint64),
                pdf["in_tree"].to_numpy(bool), pdf["asks"].to_numpy(bool), radius,
            )
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        size = 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= BATCH:
                every = pd.concat(held, ignore_index=True)
                shard = every["shard"].to_numpy()
                whole = int(np.searchsorted(shard, shard[-1]))  # rows of shards that are complete
                if whole:
                    yield emit(every.iloc[:whole])
                held = [every.iloc[whole:]]
                size = len(held[0])
        if size:
            yield emit(pd.concat(held, ignore_index=True))

    return trimmed(run)


def near_links(fingerprints: DataFrame, radius: int = 3, blocks: int | None = None, shard: int = SHARD, whole: bool = True) -> DataFrame:
    """Edges a, b between values of the distinct column ``fp`` (long; materialised). ``whole``: edges that connect all values within
    ``radius`` bits of each other, else only pairs that are so near, at least one for each value that has any."""
    small_batches(fingerprints.sparkSession)
    blocks = blocks or choose_blocks(fingerprints.count(), radius)
    if blocks <= radius:
        raise ValueError("radius bits can change every block: use more blocks than the radius")
    bounds = [64 * b // blocks for b in range(blocks + 1)]

    def bits(b: int):
        return F.shiftrightunsigned("fp", bounds[b]).bitwiseAND(F.lit((1 << (bounds[b + 1] - bounds[b])) - 1))

    named = [F.xxhash64(F.lit(k), *[bits(b) for b in kept]) for k, kept in enumerate(combinations(range(blocks), blocks - radius))]
    banded = fingerprints.select("fp", F.explode(F.array(*named)).alias("shard"))
    large = materialize(
        banded.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > shard).select("shard", F.ceil(F.col("n") / shard).cast("int").alias("subs")),
        "large-shards",
    )
    sized = banded.join(large, "shard", "left") if not large.isEmpty() else banded.withColumn("subs", F.lit(None).cast("int"))
    sub = F.pmod(F.xxhash64("fp", F.lit(11)), F.col("subs")).cast("int")
    # tile (i, j), i <= j: a tree of sub-shard i, asked by sub-shard j
    tiles = F.transform(F.sequence(F.lit(0), F.col("subs") - 1), lambda o: F.struct(F.least(o, sub).alias("i"), F.greatest(o, sub).alias("j")))
    tiled = sized.withColumn("tile", F.explode(F.coalesce(tiles, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))))
    alone = F.col("subs").isNull()
    rows = tiled.select(
        F.when(alone, F.col("shard")).otherwise(F.xxhash64("shard", "tile.i", "tile.j")).alias("shard"),
        "fp",
        (alone | (sub == F.col("tile.i"))).alias("in_tree"),
        (alone | (sub == F.col("tile.j"))).alias("asks"),
    )
    n = slots(fingerprints.sparkSession)
    return rows.repartition(n, "shard").sortWithinPartitions("shard").mapInPandas(_search(radius, stars if whole else direct), "a long, b long")
