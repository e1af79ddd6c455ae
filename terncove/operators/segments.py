"""Segments, orders and pages over the lead table. Three-valued flags stay three-valued: unknown is neither yes nor no."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C


def has_contact() -> Column:
    return F.col("phone").isNotNull() | F.col("email").isNotNull()


def hot() -> Column:
    """Checked, without automation, and reachable."""
    return (F.col("has_automation") == F.lit(False)) & F.col("last_verified_at").isNotNull() & has_contact()


def automated() -> Column:
    return F.col("has_automation") == F.lit(True)


def no_website() -> Column:
    return F.col("website_status").isin(C.NO_WEBSITE_STATES)


def website_is(state: str) -> Column:
    """``has``, ``none`` or ``unknown`` (never looked for, or the search failed)."""
    status = F.col("website_status")
    return {"has": status == "has_website", "none": no_website(), "unknown": status.isNull() | (status == "ddg_failed")}[state]


def email_usable() -> Column:
    return F.col("email").isNull() | (F.col("email_valid") == F.lit(True))


def stage_is(stage: str) -> Column:
    return F.coalesce(F.col("crm_status"), F.lit("new")) == stage


def text_search(query: str) -> Column:
    """Names in any case and phones; ``%`` and ``_`` of the query are wildcards."""
    pattern = f"%{query.strip()}%"
    return F.col("name").ilike(pattern) | F.col("phone").like(pattern)


def query(leads: DataFrame, city=None, category=None, status=None, contact=False, is_hot=False, is_automated=False, valid_email=False, without_site=False, limit: int | None = None) -> DataFrame:
    """All given conditions together, ordered by name; ids break ties."""
    conditions = [F.col(k) == v for k, v in (("city", city), ("category", category), ("status", status)) if v]
    conditions += [c() for wanted, c in ((contact, has_contact), (is_hot, hot), (is_automated, automated), (valid_email, email_usable), (without_site, no_website)) if wanted]
    for c in conditions:
        leads = leads.where(c)
    ordered = leads.orderBy("name", "id")
    return ordered.limit(limit) if limit else ordered


def ranked_list(leads: DataFrame, score: Column, limit: int) -> DataFrame:
    """The first ``limit`` by name, then by falling score: the limit comes first."""
    return leads.withColumn("contact_score", score).orderBy("name", "id").limit(limit).orderBy(F.desc("contact_score"), "name", "id")


def page_order() -> list[Column]:
    """Leads without a phone last, then by name."""
    return [F.col("phone").isNull(), F.col("name"), F.col("id")]


def page(leads: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page; for many deep ones take a ``paging.Snapshot`` in ``page_order``."""
    return leads.orderBy(*page_order()).offset(offset).limit(max(1, min(limit, 500)))


def crawl_targets(leads: DataFrame, now: Column, older_than_days: int | None = None, everything: bool = False, limit: int | None = None) -> DataFrame:
    """Leads with a site that was never checked, or not for so many days; those without a phone first."""
    due = F.col("last_verified_at").isNull()
    if older_than_days is not None:
        due = due | (F.col("last_verified_at") < now - F.make_dt_interval(days=F.lit(older_than_days)))
    found = leads.where(F.col("website").isNotNull() & (F.lit(True) if everything else due)).orderBy(F.col("phone").isNotNull(), "id")
    return found.limit(limit) if limit else found


def site_search_targets(leads: DataFrame, without_phone: bool = False) -> DataFrame:
    status, notes = F.col("website_status"), F.coalesce(F.col("notes"), F.lit(""))
    found = leads.where(F.col("website").isNull() & (status.isNull() | (status != "not_found")) & ~F.contains(notes, F.lit("ddg:none")))
    return found.where(F.col("phone").isNull()) if without_phone else found


def profile_search_targets(leads: DataFrame, limit: int) -> DataFrame:
    """Leads without a profile and without the mark of a fruitless search; those with a phone first."""
    missing = F.coalesce(F.try_element_at("socials", F.lit("instagram")), F.lit("")) == ""
    marked = F.contains(F.coalesce(F.col("notes"), F.lit("")), F.lit("ig:none"))
    return leads.where(missing & ~marked).orderBy(F.col("phone").isNull(), "id").limit(limit)


def needs_paid_lookup() -> Column:
    """Never looked up, and either checked but without a phone, or known to lack automation and reachable."""
    checked_silent = F.col("last_verified_at").isNotNull() & F.col("phone").isNull()
    promising = (F.col("has_automation") == F.lit(False)) & has_contact()
    return F.col("google_checked_at").isNull() & (checked_silent | F.coalesce(promising, F.lit(False)))


def mx_targets(leads: DataFrame, recheck: bool = False, limit: int | None = None) -> DataFrame:
    found = leads.where(F.col("email").isNotNull() & (F.lit(True) if recheck else F.col("email_valid").isNull())).orderBy("id")
    return found.limit(limit) if limit else found


def paid_limit(limit: int, left: int) -> int:
    """A lead may cost two calls."""
    return min(limit, max(left // 2, 1))


def paid_budget(limit: Column, left: Column) -> Column:
    """``paid_limit`` for columns."""
    return F.least(limit, F.greatest(F.floor(left / 2), F.lit(1)))
