"""Discovery of all due cities and categories as one plan: responses, lead rows, upsert, dedupe, sizes, run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import estimate_size
from ..operators.dedupe import dedupe
from ..operators.merge import new_id, upsert
from ..operators.stats import branch_counts, due_targets, failure_stops
from ..sources.poi import parse_responses, response_status
from .cut import cut


def imported(leads: DataFrame, raw: DataFrame, runs: DataFrame, now: Column, rerun_days: int = 21) -> tuple[DataFrame, DataFrame]:
    """(leads after the upsert of what was found, computed once; log rows of the pairs that succeeded), see ``discover``."""
    due = due_targets(raw.select("city", "category").distinct(), runs, now, rerun_days)
    answered = raw.join(due, ["city", "category"], "left_semi").withColumn("outcome", response_status(F.col("body")))
    if "seq" in raw.columns:
        stop = failure_stops(answered.select(F.lit(0).alias("run_id"), "seq", (F.col("outcome") != "failed").alias("ok")))  # one row at most
        answered = answered.join(F.broadcast(stop.select("stops_at")), F.col("seq") > F.col("stops_at"), "left_anti").drop("seq")
    found = parse_responses(answered.drop("outcome")).where("reject is null").drop("reject")
    found = found.groupBy("osm_id").agg(*[F.min_by(c, "category").alias(c) if c != "category" else F.min(c).alias(c) for c in found.columns if c != "osm_id"])
    merged = cut(upsert(leads, found))
    counts = merged.where("outcome <> 'same'").groupBy("city", "category").agg(F.count_if(F.col("outcome") == "new").alias("new_count"), F.count_if(F.col("outcome") == "updated").alias("updated_count"))
    log = answered.where("outcome <> 'failed'").select("city", "category").distinct().join(counts, ["city", "category"], "left").select(
        F.lit("discover").alias("kind"), "city", "category", now.alias("started_at"), now.alias("finished_at"),
        F.coalesce("new_count", F.lit(0)).alias("new_count"), F.coalesce("updated_count", F.lit(0)).alias("updated_count"),
    )
    return merged.withColumn("id", F.coalesce("id", new_id(F.col("osm_id")))).drop("outcome"), log


def discover(leads: DataFrame, raw: DataFrame, runs: DataFrame, now: Column, rerun_days: int = 21, scope: str = "global") -> tuple[DataFrame, DataFrame]:
    """raw: category, city, body and, where requests were made one after another, seq: after three failures in a row a run stops, and
    later answers do not count. (leads with ``size_estimate`` anew, log rows of the pairs that succeeded).

    Only pairs that are due are read; a pair whose response failed leaves no log row, so it stays due. Branches are counted after
    duplicates are gone.
    """
    merged, log = imported(leads, raw, runs, now, rerun_days)
    sized = branch_counts(dedupe(merged), scope)
    size = estimate_size(F.coalesce("raw_tags", F.create_map().cast("map<string,string>")), F.col("category"), F.col("branches"))
    return sized.withColumn("size_estimate", size["size"]).select(*leads.columns), log
