"""Requests to hosts at the pace that politeness allows, from a table of what is to be asked for: when each one starts.

Within a host a request starts when it is ready and the gap after the one before is over: ``start = max(ready, start before + gap before)``. Such steps compose (each is a
shift and a least value, and so is any number of them in a row), so a host's queue is cut into blocks: every block is summed up as one step by tasks of their own, the few steps are
followed one after another, and each block is then filled in from where it begins. A host with half of all requests is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import cut

BLOCK = 10_000


def _blocks(requests: DataFrame, block: int) -> DataFrame:
    """``_n``: the number of a request in its host's queue (order of seq), and its ``_block`` of that queue; no host is ever numbered by one task.

    Slices of a queue are ranges of seq; how many requests each has tells where the next begins.
    """
    sliced = requests.withColumn("_slice", F.floor(F.col("seq") / block))
    counts = sliced.groupBy("host", "_slice").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("host").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("host", "_slice", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("host", "_slice").orderBy("seq"))
    numbered = sliced.withColumn("_i", inside).join(begins, ["host", "_slice"])
    return numbered.withColumn("_n", F.col("_before") + F.col("_i") - 1).withColumn("_block", F.floor(F.col("_n") / block)).drop("_slice", "_i", "_before")


def failure_streaks(requests: DataFrame, block: int = BLOCK) -> DataFrame:
    """requests: host, seq, failed. Adds ``streak``: how many requests up to this one failed in a row at its host, and ``_n``, ``_block``."""
    numbered = cut(_blocks(requests, block))
    own = Window.partitionBy("host", "_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    good = F.when(~F.coalesce(F.col("failed"), F.lit(False)), F.col("_n"))
    last = numbered.groupBy("host", "_block").agg(F.max(good).alias("_last"))
    carried = F.max("_last").over(Window.partitionBy("host").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    base = last.select("host", "_block", carried.alias("_carried"))
    both = numbered.withColumn("_good", F.max(good).over(own)).join(base, ["host", "_block"])
    return both.withColumn("streak", F.col("_n") - F.coalesce("_good", "_carried", F.lit(-1))).drop("_good", "_carried")


def start_times(requests: DataFrame, pause: float, backoff: float = 0.0, most: int = 6, block: int = BLOCK) -> DataFrame:
    """requests: host, seq (its place in the host's queue), ready (seconds), failed. Adds ``start`` (seconds).

    After a request its host rests for ``pause`` seconds; after the k-th failure in a row for ``backoff * 2 ** (k - 1)`` more, ``most`` doublings at most.
    """
    told = failure_streaks(requests, block)
    rest = F.when(F.col("streak") > 0, F.lit(backoff) * F.pow(F.lit(2.0), F.least(F.col("streak") - 1, F.lit(most)))).otherwise(0.0)
    gapped = cut(told.withColumn("_gap", F.lit(float(pause)) + rest))
    up = Window.partitionBy("host", "_block").orderBy("_n")
    # within a block: the sum of gaps before a request, and the start it would have if the block began at once
    shift = F.coalesce(F.sum("_gap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = gapped.withColumn("_shift", shift)
    placed = cut(placed.withColumn("_own", F.col("_shift") + F.max(F.col("ready") - F.col("_shift")).over(up.rowsBetween(Window.unboundedPreceding, 0))))
    # a block as one step: where the next block may begin is max(own, begin + whole)
    steps = placed.groupBy("host", "_block").agg(F.sum("_gap").alias("_whole"), F.max_by(F.col("_own") + F.col("_gap"), "_n").alias("_free"))
    before = Window.partitionBy("host").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("_whole").over(before), F.lit(0.0))
    steps = steps.withColumn("_sum", total)
    began = steps.withColumn("_begin", F.col("_sum") + F.max(F.col("_free") - F.col("_sum") - F.col("_whole")).over(before)).select("host", "_block", "_begin")
    start = F.greatest(F.col("_own"), F.coalesce(F.col("_begin") + F.col("_shift"), F.col("_own")))
    return placed.join(began, ["host", "_block"]).withColumn("start", start).select(*requests.columns, "start")
