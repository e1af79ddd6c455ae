"""Counts over leads, stages, sources, calls and runs."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from . import segments as S


def totals(leads: DataFrame, now: Column, stale_days: int = 90) -> DataFrame:
    stale = F.col("last_verified_at") < now - F.make_dt_interval(days=F.lit(stale_days))
    return leads.agg(
        F.count("*").alias("total"), F.count("phone").alias("with_phone"), F.count("email").alias("with_email"),
        F.count("website").alias("with_site"), F.count("last_verified_at").alias("checked"), F.count_if(S.automated()).alias("automated"),
        F.count_if(S.hot()).alias("hot"), F.count_if(stale).alias("stale"),
    )


def by_city(leads: DataFrame) -> DataFrame:
    return leads.groupBy("city").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "city")


def by_category(leads: DataFrame) -> DataFrame:
    return leads.groupBy("category").agg(F.count("*").alias("n"), F.count("phone").alias("with_phone")).orderBy(F.desc("n"), "category")


def by_source(leads: DataFrame) -> DataFrame:
    return leads.groupBy("source").agg(F.count("*").alias("n"))


def by_site_state(leads: DataFrame) -> DataFrame:
    return leads.where(S.has_contact()).groupBy("website_status").agg(F.count("*").alias("n"))


def source_tags(leads: DataFrame) -> DataFrame:
    """Leads of each single source. Groups combine first, so the list is split once a combination, not once a lead."""
    split = by_source(leads).select(F.explode(F.split(F.coalesce("source", F.lit("")), ",")).alias("tag"), "n")
    return split.groupBy("tag").agg(F.sum("n").alias("n"))


def branch_counts(leads: DataFrame, scope: str = "global") -> DataFrame:
    """Leads with the number of leads of exactly the same name, everywhere or in the same city."""
    keys = ["name", "city"] if scope == "city" else ["name"]
    counts = leads.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("branches"))  # combines before the shuffle; a window would gather a common name's rows
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return leads.drop("branches").join(counts, same, "left").drop(*[f"_{k}" for k in keys])


def funnel(leads: DataFrame) -> DataFrame:
    """Every stage with its number of leads, also at 0; no stage means new."""
    counts = leads.groupBy(F.coalesce("crm_status", F.lit("new")).alias("stage")).agg(F.count("*").alias("n"))
    stages = leads.sparkSession.createDataFrame([(i, k, v) for i, (k, v) in enumerate(C.CRM_LABELS.items())], "pos int, stage string, label string")
    return F.broadcast(stages).join(counts, "stage", "left").select("pos", "stage", "label", F.coalesce("n", F.lit(0)).alias("n"))


def used_capacity(claims: DataFrame, now: Column, channel: str = "instagram") -> DataFrame:
    recent = (F.col("channel") == channel) & (F.col("claimed_at") >= now - F.expr("interval 24 hours")) & F.col("status").isin(C.CAPACITY_STATES)
    return claims.where(recent).agg(F.count("*").alias("used"))


def remaining_capacity(claims: DataFrame, now: Column, cap: int = 20, channel: str = "instagram") -> DataFrame:
    return used_capacity(claims, now, channel).select(F.greatest(F.lit(0), F.lit(cap) - F.col("used")).alias("remaining"))


def calls_by_month(calls: DataFrame) -> DataFrame:
    """calls: service, called_at, calls."""
    return calls.groupBy("service", F.date_format("called_at", "yyyy-MM").alias("period")).agg(F.sum("calls").alias("calls"))


def calls_left(calls: DataFrame, service: str, now: Column, budget: int = 500) -> DataFrame:
    """One row: what the month's budget of a paid service leaves."""
    this = calls_by_month(calls).where((F.col("service") == service) & (F.col("period") == F.date_format(now, "yyyy-MM")))
    return this.agg(F.greatest(F.lit(0), F.lit(budget) - F.coalesce(F.sum("calls"), F.lit(0))).alias("remaining"))


def last_runs(runs: DataFrame, keys: tuple[str, ...] = ("kind", "city", "category")) -> DataFrame:
    """The latest finished run of each kind, city and category."""
    row = F.struct("started_at", "id", "finished_at")
    done = runs.where(F.col("finished_at").isNotNull()).groupBy(*keys).agg(F.max(row).alias("r"))
    return done.select(*keys, F.col("r.id").alias("id"), F.col("r.started_at").alias("started_at"), F.col("r.finished_at").alias("finished_at"))


def due_targets(plan: DataFrame, runs: DataFrame, now: Column, rerun_days: int = 21) -> DataFrame:
    """Pairs of city and category that never finished or began so many days ago or more."""
    last = last_runs(runs, ("city", "category"))
    old = F.col("started_at").isNull() | (now - F.col("started_at") >= F.make_dt_interval(days=F.lit(rerun_days)))
    return plan.join(last.select("city", "category", "started_at"), ["city", "category"], "left").where(old).select("city", "category")


def pending(plan: DataFrame, runs: DataFrame) -> DataFrame:
    """Pairs of city and category that never finished: where a run that broke off goes on."""
    return plan.join(last_runs(runs, ("city", "category")).select("city", "category"), ["city", "category"], "left_anti")


def recent_runs(runs: DataFrame, limit: int) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def dimensions(leads: DataFrame) -> DataFrame:
    """The cities and categories there are, for choice lists."""
    return leads.select("city", "category").distinct().orderBy("city", "category")


def failure_stops(attempts: DataFrame, after: int = 3) -> DataFrame:
    """attempts: run_id, seq, ok. Where a run stops: the first attempt that ends so many failures in a row."""
    order = Window.partitionBy("run_id").orderBy("seq")
    islands = attempts.withColumn("island", F.sum(F.col("ok").cast("int")).over(order))
    streak = F.sum(F.when(~F.col("ok"), 1).otherwise(0)).over(Window.partitionBy("run_id", "island").orderBy("seq"))
    return islands.withColumn("streak", streak).where(F.col("streak") >= after).groupBy("run_id").agg(F.min("seq").alias("stops_at"))


def shared_phones(cards: DataFrame, least: int = 3) -> DataFrame:
    """cards: city, card_id, phones, email. Without phones that stand on so many cards of a city; every card counts once."""
    single = cards.select("city", "card_id", F.explode(F.array_distinct("phones")).alias("phone"))
    common = single.groupBy("city", "phone").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    marked = single.join(common, ["city", "phone"], "left_semi").groupBy("city", "card_id").agg(F.collect_set("phone").alias("_shared"))
    own = F.filter("phones", lambda p: ~F.array_contains(F.coalesce(F.col("_shared"), F.array().cast("array<string>")), p))
    email = F.when(~F.endswith(F.lower("email"), F.lit("@likarni.com")), F.col("email"))
    kept = cards.join(marked, ["city", "card_id"], "left").withColumns({"phones": own, "email": email})
    reachable = (F.size("phones") > 0) | (F.coalesce(F.col("email"), F.lit("")) != "")
    return kept.drop("_shared").withColumn("create_if_missing", reachable)
