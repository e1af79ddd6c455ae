"""Which rows hang together: components of a graph given as pairs, without a group ever being collected."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut

#: Pairs of at most so many are united by one task, whatever they form.
ONE_TASK = 200_000
#: Pairs of at most so many (about) that are said to lie together are united in one group first.
LOCAL = 1_000_000


def united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs high, low to node, root; the root is the smallest node of its component."""
    above: dict[int, int] = {}

    def top(n: int) -> int:
        path = []
        while above.setdefault(n, n) != n:
            path.append(n)
            n = above[n]
        for p in path:
            above[p] = n
        return n

    for pdf in batches:
        for a, b in pdf[["high", "low"]].itertuples(index=False):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "root": pd.Series([top(n) for n in nodes], dtype="int64")})


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each node joins its larger neighbours to the smallest of its neighbourhood."""
    ends = pairs.select(F.col("high").alias("node"), F.col("low").alias("near")).union(pairs.select("low", "high"))
    least = ends.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("m"))
    return ends.where("near > node").join(least, "node").select(F.col("near").alias("high"), F.col("m").alias("low")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node joins itself and its smaller neighbours to the smallest of them."""
    least = pairs.groupBy("high").agg(F.min("low").alias("m"))
    moved = pairs.join(least, "high").where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
    return moved.union(least.select("high", "m")).distinct()


def components(pairs: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``pairs``: two columns of longs. node, root for every node; the root is the smallest node that can be reached.

    Alternating large and small stars until nothing moves: the number of rounds grows with the logarithm of a component's size. Minima are combined
    before the shuffle, and joins on a hub are equi-joins that adaptive execution may split. Few pairs are united in one task instead.
    """
    a, b = (F.col(c) for c in pairs.columns[:2])
    return _by_stars(cut(pairs.where(a != b).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()), one_task)


def _by_stars(now: DataFrame, one_task: int) -> DataFrame:
    told = now.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
    while told[0] > one_task:
        now = cut(_small_star(_large_star(now)))
        last, told = told, now.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if last == told:  # stars: every node is joined to its root
            return now.select(F.col("high").alias("node"), F.col("low").alias("root")).union(now.select("low", "low").distinct())
    return cut(now.repartition(1).mapInPandas(united, "node long, root long"))


def components_by(pairs: DataFrame, by: str, local: int = LOCAL, one_task: int = ONE_TASK) -> DataFrame:
    """``components`` of pairs whose column ``by`` says what mostly lies together: any value gives the same roots, a good one spares the rounds.

    Each value's pairs are united by themselves, in several groups if there are more than ``local``. Only nodes that several groups have, and those groups' roots, go through
    ``components``.
    """
    a, b = (F.col(c) for c in pairs.columns[:2])
    held = cut(pairs.where(a != b).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"), F.xxhash64(by).alias("by")))
    large = held.groupBy("by").agg(F.ceil(F.count("*") / max(local, 1)).alias("groups")).where("groups > 1")
    dealt = held.join(large, "by", "left").withColumn("nth", F.pmod(F.xxhash64("low"), F.coalesce("groups", F.lit(1))))
    kinds = "node long, root long"
    own = cut(dealt.groupBy("by", "nth").applyInPandas(lambda pdf: next(united(iter([pdf]))), kinds))
    several = own.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).where("n > 1").select("node")
    bridges = cut(own.join(several, "node", "left_semi"))
    if bridges.isEmpty():
        return own
    # a root that another group has as a node is such a node itself
    top = components(bridges, one_task).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return own.join(top, "root", "left").groupBy("node").agg(F.min(F.coalesce("top", "root")).alias("root"))
