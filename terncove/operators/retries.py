"""Queries that are tried again, at one mirror after another, from the table of their landed attempts: how each one ended.

A query starts at mirror 0. An answer ends it (``ok``; an empty one too). ``busy`` asks the same mirror again, ``tries`` times in all; ``broken`` leaves the mirror at once.
After the last mirror it has ``failed``; with no attempt left before that it is ``open``. What was landed after the end does not count.

An attempt is a step from each state to the next one, so steps in a row are one table: where each state leads and how many attempts that takes. Attempts are cut into slices of seq, every
slice becomes one table in a task of its own, and only these are followed in order. A query with half of all attempts is spread like any other.

Defined results: attempts need a seq that is unique in their query; those without query, seq or kind are passed over, as are unknown kinds; no attempts, no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.poi import response_status

SLICE = 10_000
KINDS = ["ok", "busy", "broken"]
BUSY = [429, 502, 503, 504]


def attempt_kind(http_status: Column, body: Column) -> Column:
    """What an attempt came to: an answer that reports an error of the server's run or its time is ``busy``, like the statuses of an overloaded server."""
    late = F.contains(body, F.lit("runtime error")) | F.contains(body, F.lit("timed out"))
    good = (http_status == 200) & (response_status(body) != "failed")
    return F.when(F.coalesce(good, F.lit(False)), "ok").when(F.coalesce(http_status.isin(BUSY) | ((http_status == 200) & late), F.lit(False)), "busy").otherwise("broken")


def transitions(mirrors: int, tries: int) -> list[list[int]]:
    """For each state the next one by kind. States: asking mirror m for the t-th time (``m * tries + t``), ended well at m (``mirrors * tries + m``), failed (the last one)."""
    asking, failed = mirrors * tries, mirrors * tries + mirrors
    steps = []
    for state in range(asking):
        mirror = state // tries
        left = (mirror + 1) * tries if mirror + 1 < mirrors else failed
        steps.append([asking + mirror, state + 1 if (state + 1) % tries else left, left])
    return steps + [[state] * len(KINDS) for state in range(asking, failed + 1)]


def outcomes(attempts: DataFrame, mirrors: int = 3, tries: int = 2, size: int = SLICE) -> DataFrame:
    """attempts: query, seq, kind. One row per query: query, outcome, attempts (that count), mirror (the last one asked or, while it is open, the next one)."""
    steps, asking = transitions(mirrors, tries), mirrors * tries
    table = F.array(*[F.array(*[F.lit(to) for to in row]) for row in steps])
    known = attempts.where(F.col("query").isNotNull() & F.col("seq").isNotNull() & F.col("kind").isin(KINDS))
    sliced = known.select("query", "seq", F.floor(F.col("seq") / size).alias("slice"), (F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1).cast("int").alias("kind"))
    listed = sliced.groupBy("query", "slice").agg(F.array_sort(F.collect_list(F.struct("seq", "kind"))).alias("of"))  # ``size`` entries at most

    def tried(states: Column, attempt: Column) -> Column:
        return F.transform(states, lambda x: F.struct(F.get(F.get(table, x["state"]), attempt["kind"]).alias("state"), (x["used"] + (x["state"] < asking).cast("long")).alias("used")))

    at_first = F.array(*[F.struct(F.lit(state).alias("state"), F.lit(0).cast("long").alias("used")) for state in range(len(steps))])
    tables = listed.select("query", "slice", F.aggregate("of", at_first, tried).alias("leads"))
    begin = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("used"))

    def followed(now: Column, one: Column) -> Column:
        to = F.get(one["leads"], now["state"])
        return F.struct(to["state"].alias("state"), (now["used"] + to["used"]).alias("used"))

    ends = tables.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("slice", "leads"))).alias("all"))
    ends = ends.select("query", F.aggregate("all", begin, followed).alias("end"))
    state = F.col("end.state")
    outcome = F.when(state < asking, "open").when(state < asking + mirrors, "ok").otherwise("failed")
    mirror = F.when(state < asking, F.floor(state / tries)).otherwise(F.least(state - asking, F.lit(mirrors - 1)))
    return ends.select("query", outcome.alias("outcome"), F.col("end.used").alias("attempts"), mirror.cast("int").alias("mirror"))
