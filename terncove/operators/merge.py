"""Writes that fill what is empty: discovery upsert, crawl and search results, paid lookups, status notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.rules import estimate_size, is_automated, merge_automation
from ..functions.text import filled, strip

FILLED = ["address", "lat", "lon", "phone", "website", "email", "raw_tags"]


def truthy(c: Column, kind: str) -> Column:
    """NULL in place of what counts as empty here: the empty string, zero, an empty map or list."""
    if kind == "string":
        return filled(c)
    return F.when(F.size(c) > 0, c) if kind.startswith(("map", "array")) else F.when(c != 0, c) if kind in ("double", "long", "bigint", "int") else c


def upsert(leads: DataFrame, found: DataFrame) -> DataFrame:
    """Leads with discovered rows: new ones inserted with a size estimate, known ones filled where empty. ``outcome`` is
    ``new``, ``updated`` (something changed) or ``same``; ids of new rows are NULL."""
    kinds = dict(leads.dtypes)
    own = [c for c in FILLED if c in leads.columns and c in found.columns]
    extra = [c for c in found.columns if c in leads.columns]
    n = found.select(*[F.col(c).alias(f"_{c}") for c in extra])
    both = leads.withColumn("_known", F.lit(True)).join(n, leads["osm_id"] == n["_osm_id"], "full")
    known, seen = F.col("_known").isNotNull(), F.col("_osm_id").isNotNull()
    new = {c: F.when(~known, F.col(f"_{c}")).otherwise(F.coalesce(truthy(F.col(c), kinds[c]), truthy(F.col(f"_{c}"), kinds[c]), F.col(c))) for c in own}
    changed = F.lit(False)
    for c in own:
        changed = changed | (truthy(F.col(c), kinds[c]).isNull() & truthy(F.col(f"_{c}"), kinds[c]).isNotNull())
    if "socials" in extra:
        empty = F.create_map().cast("map<string,string>")
        union = F.map_zip_with(F.coalesce("socials", empty), F.coalesce("_socials", empty), lambda _, a, b: F.coalesce(a, b))
        new["socials"] = F.when(F.size(union) > 0, union)
        changed = changed | (F.size(union) > F.coalesce(F.size("socials"), F.lit(0)))
    for c in extra:
        if c not in new:
            new[c] = F.when(known, F.col(c)).otherwise(F.col(f"_{c}"))
    if "website_status" in leads.columns and "website" in own:
        now_has = seen & truthy(new["website"], "string").isNotNull() & (~known | filled(F.col("website")).isNull())
        new["website_status"] = F.when(now_has, "has_website").otherwise(F.col("website_status"))
    if "size_estimate" in leads.columns and "raw_tags" in own:
        new["size_estimate"] = F.when(~known, estimate_size(F.col("_raw_tags"), F.col("_category"), F.lit(1))["size"]).otherwise(F.col("size_estimate"))
    outcome = F.when(~known, "new").when(seen & changed, "updated").otherwise("same")
    return both.withColumns(new | {"outcome": outcome}).select(*leads.columns, "outcome")


def apply_crawl(leads: DataFrame, crawls: DataFrame, now: Column) -> DataFrame:
    """crawls: id, phones, emails, socials, automation, error. A failed site counts as checked and not automated."""
    c = crawls.select(*[F.col(x).alias(f"_{x}") for x in ("id", "phones", "emails", "socials", "automation", "error")])
    both = leads.join(c, leads["id"] == c["_id"], "left")
    seen, failed = F.col("_id").isNotNull(), F.col("_error").isNotNull()
    got = seen & ~failed
    phone = F.coalesce(filled(F.col("phone")), F.when(got, F.try_element_at("_phones", F.lit(1))))
    email = F.coalesce(filled(F.col("email")), F.when(got, F.try_element_at("_emails", F.lit(1))))
    none, no_auto = F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,array<string>>")
    socials = F.map_zip_with(F.coalesce("socials", none), F.coalesce("_socials", none), lambda _, a, b: F.coalesce(a, b))
    automation = merge_automation(F.coalesce("automation", no_auto), F.coalesce("_automation", no_auto))
    automation = F.when(got, F.when(F.size(automation) > 0, automation)).otherwise(F.col("automation"))
    more = F.slice(F.filter(F.coalesce("_phones", F.array().cast("array<string>")), lambda p: p != phone), 1, 2)
    note = F.when(failed, F.concat(F.lit("[site:"), F.col("_error"), F.lit("]"))).when(F.size(more) > 0, F.concat(F.lit("доп.тел: "), F.array_join(more, ", ")))
    notes = F.when(seen & note.isNotNull() & ~F.coalesce(F.contains(F.col("notes"), note), F.lit(False)), F.trim(F.concat_ws(" ", "notes", note))).otherwise(F.col("notes"))
    return both.withColumns({
        "phone": phone, "email": email, "socials": F.when(got & (F.size(socials) > 0), socials).otherwise(F.col("socials")), "automation": automation,
        "has_automation": F.when(seen, is_automated(automation)).otherwise(F.col("has_automation")),
        "last_verified_at": F.when(seen, now).otherwise(F.col("last_verified_at")),
        "website_status": F.when(seen & failed & F.col("_error").isin("unreachable", "bad_url"), "site_down").when(got, "has_website").otherwise(F.col("website_status")),
        "notes": notes,
    }).select(*leads.columns)


def backfill_website_status(leads: DataFrame) -> DataFrame:
    """A site means ``has_website``; the mark of a fruitless search means ``not_found``; both only where nothing is known."""
    marked = F.contains(F.coalesce(F.col("notes"), F.lit("")), F.lit("[ddg:none]"))
    status = F.col("website_status")
    new = F.when(status.isNull() & filled(F.col("website")).isNotNull(), "has_website").when(status.isNull() & F.col("website").isNull() & marked, "not_found")
    return leads.withColumn("website_status", F.coalesce(new, status))


def apply_site_search(leads: DataFrame, hits: DataFrame) -> DataFrame:
    """hits: id, url, failed. A site found, none found (marked), or the search failed."""
    h = hits.select(F.col("id").alias("_id"), F.col("url").alias("_url"), F.col("failed").alias("_failed"))
    both = leads.join(h, leads["id"] == h["_id"], "left")
    seen, found = F.col("_id").isNotNull(), F.col("_url").isNotNull()
    nothing = seen & ~found & ~F.col("_failed")
    return both.withColumns({
        "website": F.when(seen & found, F.col("_url")).otherwise(F.col("website")),
        "website_status": F.when(seen & F.col("_failed"), "ddg_failed").when(seen & found, "has_website").when(nothing, "not_found").otherwise(F.col("website_status")),
        "notes": F.when(nothing, F.trim(F.concat_ws(" ", "notes", F.lit("[ddg:none]")))).otherwise(F.col("notes")),
    }).select(*leads.columns)


def apply_profile_search(leads: DataFrame, hits: DataFrame) -> DataFrame:
    """hits: id, url (NULL: none fit). The profile replaces an older one; the source is named once."""
    h = hits.select(F.col("id").alias("_id"), F.col("url").alias("_url"))
    both = leads.join(h, leads["id"] == h["_id"], "left")
    found, nothing = F.col("_url").isNotNull(), F.col("_id").isNotNull() & F.col("_url").isNull()
    kept = F.map_filter(F.coalesce("socials", F.create_map().cast("map<string,string>")), lambda k, _: k != "instagram")
    tags = F.split(F.coalesce("source", F.lit("")), ",")
    source = F.when(F.array_contains(tags, "ddg_instagram"), F.col("source")).otherwise(F.concat_ws(",", filled(F.col("source")), F.lit("ddg_instagram")))
    return both.withColumns({
        "socials": F.when(found, F.map_concat(kept, F.create_map(F.lit("instagram"), F.col("_url")))).otherwise(F.col("socials")),
        "source": F.when(found, source).otherwise(F.col("source")),
        "notes": F.when(nothing, F.trim(F.concat_ws(" ", "notes", F.lit("[ig:none]")))).otherwise(F.col("notes")),
    }).select(*leads.columns)


def apply_paid_lookup(leads: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """results: id, calls, phone, address. Every lead asked about is stamped; phone and address are filled where empty."""
    r = results.select(*[F.col(x).alias(f"_{x}") for x in ("id", "phone", "address")])
    both = leads.join(r, leads["id"] == r["_id"], "left")
    return both.withColumns({
        "google_checked_at": F.when(F.col("_id").isNotNull(), now).otherwise(F.col("google_checked_at")),
        "phone": F.coalesce(filled(F.col("phone")), F.col("_phone")), "address": F.coalesce(filled(F.col("address")), F.col("_address")),
    }).select(*leads.columns)


def set_status(leads: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: id, status, note. Notes are appended on a new line."""
    c = changes.select(F.col("id").alias("_id"), F.col("status").alias("_status"), F.col("note").alias("_note"))
    both = leads.join(c, leads["id"] == c["_id"], "left")
    notes = strip(F.concat_ws("\n", "notes", filled(F.col("_note"))))
    return both.withColumns({
        "status": F.coalesce("_status", "status"), "notes": F.when(filled(F.col("_note")).isNotNull(), notes).otherwise(F.col("notes")),
    }).select(*leads.columns)


def apply_sheet(leads: DataFrame, sheet: DataFrame, fields: list[str]) -> DataFrame:
    """sheet: id (text) and edited fields. Rows whose id is no number or unknown change nothing; empty cells change nothing."""
    s = sheet.select(F.col("id").try_cast("long").alias("_id"), *[filled(F.col(f)).alias(f"_{f}") for f in fields]).where("_id is not null")
    both = leads.join(s, leads["id"] == s["_id"], "left")
    return both.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).select(*leads.columns)


def new_id(osm_id: Column) -> Column:
    """An id that needs no global order: 62 bits of a hash of the map id."""
    return F.shiftrightunsigned(F.xxhash64(osm_id), 2)


def with_columns_of(df: DataFrame, schema) -> DataFrame:
    """``df`` in the shape of ``schema``: absent nullable columns become NULL, absent required ones are refused."""
    required = [f.name for f in schema if f.name not in df.columns and not f.nullable]
    if required:
        raise ValueError(f"required columns are missing: {', '.join(required)}")
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def categories(names: list[str]) -> dict[str, list[str]]:
    """Filters of the named categories and bundles in order of first mention; ``all`` means all; others are refused."""
    out: dict[str, list[str]] = {}
    for name in (n.strip().lower() for n in names):
        if name == "all":
            return dict(C.CATEGORY_FILTERS)
        members = C.BUNDLES.get(name) or ([name] if name in C.CATEGORY_FILTERS else None)
        if members is None:
            raise ValueError(f"unknown category {name!r}; known: {', '.join([*sorted(C.CATEGORY_FILTERS), *sorted(C.BUNDLES)])}")
        out |= {m: C.CATEGORY_FILTERS[m] for m in members}
    return out


def prioritize(selected: dict[str, list[str]]) -> dict[str, list[str]]:
    """Medical categories first, in their own order; the others keep theirs."""
    first = [n for n in C.BUNDLES["medical"] if n in selected]
    return {n: selected[n] for n in [*first, *(n for n in selected if n not in first)]}


def resolved(names: Column) -> Column:
    """``categories`` for a column of lists: the categories of names and bundles in order of first mention; NULL where a name is unknown."""
    every = {**{k: [k] for k in C.CATEGORY_FILTERS}, **C.BUNDLES, "all": list(C.CATEGORY_FILTERS)}
    members = F.create_map(*[x for k, v in every.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    clean = F.transform(names, lambda n: F.lower(strip(n)))
    found = F.array_distinct(F.flatten(F.transform(clean, lambda n: F.try_element_at(members, n))))  # NULL if one is NULL
    return F.when(F.array_contains(clean, "all"), F.array(*map(F.lit, C.CATEGORY_FILTERS))).otherwise(found)


def prioritized(selected: Column) -> Column:
    """``prioritize`` for a column of lists: medical categories first, in their own order; the others keep theirs."""
    medical = F.array(*map(F.lit, C.BUNDLES["medical"]))
    return F.concat(F.filter(medical, lambda m: F.array_contains(selected, m)), F.filter(selected, lambda c: ~F.array_contains(medical, c)))
