"""The capped outreach queue and sales stages as tables of state: candidates, claims, results, history."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.rules import describe_automation
from ..functions.text import filled, normalize_instagram, strip, username
from . import segments as S
from .stats import remaining_capacity

CHANNEL = "instagram"


def candidates(leads: DataFrame, items: DataFrame, category=None, city=None, without_site: bool = False) -> DataFrame:
    """Leads with a profile that were not queued, are not closed, and whose handle is new; one lead a handle, the smallest id."""
    own = items.where(F.col("channel") == CHANNEL)
    open_stage = F.col("crm_status").isNull() | ~F.col("crm_status").isin(C.CLOSED_STAGES)
    found = leads.where(F.col("socials").isNotNull() & open_stage)
    for condition in [*([F.col("category") == category] if category else []), *([F.col("city") == city] if city else []), *([S.no_website()] if without_site else [])]:
        found = found.where(condition)
    found = found.join(own.select(F.col("business_id").alias("id")), "id", "left_anti")
    found = found.withColumn("handle", username(normalize_instagram(F.try_element_at("socials", F.lit(CHANNEL))))).where(F.col("handle").isNotNull())
    found = found.join(own.select("handle"), "handle", "left_anti")
    first = F.row_number().over(Window.partitionBy("handle").orderBy("id"))
    return found.withColumn("_n", first).where("_n = 1").drop("_n")


def enqueue(items: DataFrame, picked: DataFrame, now: Column) -> DataFrame:
    """New rows for picked leads (id, handle) that have none in the channel yet; ids are given by the writer."""
    new = picked.select(F.col("id").alias("business_id"), F.lit(CHANNEL).alias("channel"), "handle", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), now.alias("created_at"))
    return new.join(items.select("business_id", "channel"), ["business_id", "channel"], "left_anti").dropDuplicates(["business_id", "channel"])


def claimable(now: Column, ttl_minutes: int = 120) -> Column:
    """Queued, or claimed before the time limit (strictly)."""
    stale = (F.col("status") == "claimed") & (F.col("claimed_at") < now - F.make_dt_interval(mins=F.lit(ttl_minutes)))
    return (F.col("channel") == CHANNEL) & ((F.col("status") == "queued") | stale)


def claim(items: DataFrame, limit: int, now: Column, cap: int = 20, ttl_minutes: int = 120) -> DataFrame:
    """The table after a claim: the smallest claimable ids within the limit and what the day's cap leaves, marked in
    ``claimed_now``. One writer is assumed: Parquet has no compare-and-set."""
    budget = remaining_capacity(items, now, cap).select(F.least(F.lit(limit), F.col("remaining")).alias("budget"))
    first = items.where(claimable(now, ttl_minutes)).orderBy("id").limit(max(0, limit)).select("id")  # never more than the limit
    ranked = first.withColumn("_n", F.row_number().over(Window.orderBy("id"))).join(F.broadcast(budget), F.col("_n") <= F.col("budget"))  # the budget is one row
    marked = items.join(F.broadcast(ranked.select("id", F.lit(True).alias("_now"))), "id", "left")
    hit = F.coalesce(F.col("_now"), F.lit(False))
    return marked.withColumns({
        "status": F.when(hit, "claimed").otherwise(F.col("status")), "claimed_at": F.when(hit, now).otherwise(F.col("claimed_at")),
        "attempts": F.col("attempts") + hit.cast("int"), "claimed_now": hit,
    }).drop("_now")


def move_allowed(state: Column, to: Column) -> Column:
    return F.coalesce(reduce(or_, [(to == k) & state.isin(v) for k, v in C.QUEUE_MOVES.items()]), F.lit(False))


def apply_results(items: DataFrame, results: DataFrame) -> DataFrame:
    """results: id, seq, status, text, at. Each item's reports folded in order; what the table of moves forbids is refused.

    Adds ``refused`` (number of refused reports). The fold is one expression over an item's own few reports.
    """
    reports = results.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "status", "text", "at"))).alias("_reports"))
    start = F.struct(
        "status", F.col("message").alias("message"), F.col("reply").alias("reply"), F.col("error").alias("error"), F.col("sent_at").alias("sent_at"),
        F.col("replied_at").alias("replied_at"), F.lit(0).alias("refused"),
    )

    def step(acc: Column, r: Column) -> Column:
        ok, text = move_allowed(acc["status"], r["status"]), filled(strip(r["text"]))
        sent, replied = ok & (r["status"] == "sent"), ok & (r["status"] == "replied")
        failed = ok & r["status"].isin("failed", "skipped")
        return F.struct(
            F.when(ok, r["status"]).otherwise(acc["status"]).alias("status"),
            F.when(sent, text).otherwise(acc["message"]).alias("message"),
            F.when(replied, text).otherwise(acc["reply"]).alias("reply"),
            F.when(failed, text).when(sent, F.lit(None).cast("string")).otherwise(acc["error"]).alias("error"),
            F.when(sent, r["at"]).otherwise(acc["sent_at"]).alias("sent_at"),
            F.when(replied, r["at"]).otherwise(acc["replied_at"]).alias("replied_at"),
            (acc["refused"] + F.when(ok, 0).otherwise(1)).alias("refused"),
        )

    folded = F.when(F.col("_reports").isNull(), start).otherwise(F.aggregate("_reports", start, step))
    both = items.join(reports, "id", "left").withColumn("_f", folded)
    names = ["status", "message", "reply", "error", "sent_at", "replied_at"]
    return both.select(*[F.col(f"_f.{c}").alias(c) if c in names else F.col(c) for c in items.columns], F.col("_f.refused").alias("refused"))


def result_events(items: DataFrame, results: DataFrame, leads: DataFrame) -> DataFrame:
    """History rows of accepted reports: business_id, old_status, new_status, comment, created_at. The first message sent
    moves a new lead to in_progress."""
    joined = results.join(items.select("id", "business_id", "handle", F.col("status").alias("_state")), "id").join(
        leads.select(F.col("id").alias("business_id"), F.coalesce("crm_status", F.lit("new")).alias("_stage")), "business_id"
    )
    accepted = joined.where(move_allowed(F.col("_state"), F.col("status")))
    labels = F.create_map(*[F.lit(x) for k, v in C.QUEUE_LABELS.items() for x in (k, v.lower())])
    note = F.concat(F.lit("Instagram @"), F.col("handle"), F.lit(": "), labels[F.col("status")])
    moved = (F.col("status") == "sent") & (F.col("_stage") == "new")
    return accepted.select(
        "business_id", F.col("_stage").alias("old_status"), F.when(moved, "in_progress").otherwise(F.col("_stage")).alias("new_status"),
        F.concat_ws("\n", note, filled(strip(F.col("text")))).alias("comment"), F.col("at").alias("created_at"),
    )


def change_stages(leads: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests: id, seq, stage, comment, at. (leads with their last stage, history rows). A request for the present stage
    without a comment does nothing; with one it is history only."""
    order = Window.partitionBy("id").orderBy("seq")
    stage = leads.select("id", F.coalesce("crm_status", F.lit("new")).alias("_first"))
    r = requests.join(stage, "id").withColumn("old_status", F.coalesce(F.lag("stage").over(order), F.col("_first")))
    comment = filled(strip(F.col("comment")))
    told = r.where((F.col("old_status") != F.col("stage")) | comment.isNotNull())
    history = told.select(F.col("id").alias("business_id"), "old_status", F.col("stage").alias("new_status"), comment.alias("comment"), F.col("at").alias("created_at"))
    last = r.where(F.col("old_status") != F.col("stage")).groupBy("id").agg(F.max(F.struct("seq", "stage", "at")).alias("_l"))
    both = leads.join(last, "id", "left")
    new = both.withColumns({"crm_status": F.coalesce("_l.stage", "crm_status"), "crm_updated_at": F.coalesce("_l.at", "crm_updated_at")})
    return new.select(*leads.columns), history


def lead_context() -> Column:
    """What a writer needs to know of a lead."""
    return F.struct(
        "id", "name", "category", "city", F.coalesce(F.col("website_status") == "has_website", F.lit(False)).alias("has_website"), "website",
        describe_automation(F.col("automation")).alias("automation_summary"), "has_automation", F.col("size_estimate").alias("size"),
    )


def with_context(items: DataFrame, leads: DataFrame) -> DataFrame:
    """Items with what their writer needs to know (``lead``)."""
    known = leads.select(F.col("id").alias("business_id"), lead_context().alias("lead"))
    return items.join(known, "business_id")


def with_queue_status(leads: DataFrame, items: DataFrame) -> DataFrame:
    """All leads with ``item_status``: that of their last item in the channel, NULL if they have none."""
    last = items.where(F.col("channel") == CHANNEL).groupBy(F.col("business_id").alias("id")).agg(F.max(F.struct(F.col("id").alias("item"), "status")).alias("_last"))
    return leads.join(last, "id", "left").withColumn("item_status", F.col("_last.status")).drop("_last")


def newest_first(events: DataFrame, at: str = "created_at") -> DataFrame:
    return events.orderBy(F.desc_nulls_last(at), F.desc("id"))


def lead_events(events: DataFrame, leads: DataFrame) -> DataFrame:
    """The history of each of ``leads``, newest first, with the lead's name."""
    return newest_first(events.join(leads.select(F.col("id").alias("business_id"), "name"), "business_id"))
