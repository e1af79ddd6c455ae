"""Rules over tags and pages: chains, public facilities, automation signals, size."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .text import filled, first_number, has_value, matches, strip, words_of


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def _plain(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def is_medical_chain(name: Column) -> Column:
    """Whether the first one to four words are a brand."""
    plain = F.translate(_plain(name), "’ʼ`", "'''")
    words = words_of(F.translate(plain, '«»"', "   "))
    starts = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    return F.arrays_overlap(starts, F.array(*map(F.lit, C.MEDICAL_BRANDS)))


def is_healthcare(tags: Column) -> Column:
    return _plain(tag(tags, "amenity")).isin(C.HEALTHCARE_AMENITIES) | (F.coalesce(tag(tags, "healthcare"), F.lit("")) != "")


def is_big_chain(tags: Column) -> Column:
    brand = F.translate(F.coalesce(filled(_plain(tag(tags, "brand"))), _plain(tag(tags, "name"))), "’ʼ`", "'''")
    medical = is_medical_chain(tag(tags, "brand")) | is_medical_chain(tag(tags, "name"))
    return (
        _plain(tag(tags, "shop")).isin(C.BIG_SHOPS)
        | _plain(tag(tags, "amenity")).isin(C.BIG_AMENITIES)
        | brand.isin(C.BIG_BRANDS)
        | (is_healthcare(tags) & medical)
    )


def is_public_name(name: Column) -> Column:
    return F.coalesce(matches(name, C.PUBLIC_NAME), F.lit(False))


def is_public_facility(tags: Column) -> Column:
    kind = F.coalesce(filled(_plain(tag(tags, "operator:type"))), _plain(tag(tags, "ownership")))
    text = F.concat_ws(" | ", *[F.coalesce(tag(tags, k), F.lit("")) for k in ("name", "name:uk", "official_name", "operator")])
    hospital = (_plain(tag(tags, "amenity")) == "hospital") | (_plain(tag(tags, "healthcare")) == "hospital")
    return (
        F.when(~is_healthcare(tags), False)
        .when(kind.isin(C.PRIVATE_OPERATORS), False)
        .when(kind.isin(C.PUBLIC_OPERATORS), True)
        .when(matches(text, C.PUBLIC_NAME), True)
        .otherwise(hospital & ~matches(text, C.PRIVATE_NAME))
    )


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def required_text(pattern: str) -> list[str] | None:
    """A text for each alternative of a pattern that whatever matches it contains; NULL where one has none of three letters or more."""
    out = []
    for alternative in re.split(r"\|(?![^(]*\))", pattern):
        plain = re.sub(r"\[[^\]]*\][*+?]?|\([^()]*\)[*+?]?|\\[wdsb][*+?]?|[^\\][?*]", "\0", alternative)
        runs = [re.sub(r"\\(.)", r"\1", r) for r in re.split(r"\0|(?<!\\)[.+]", plain)]
        out.append(max(runs, key=len))
    return out if all(len(r) >= 3 for r in out) else None


def detect_automation(html: Column) -> Column:
    """map<kind, vendors> of the signatures a page matches, in their order; a hint only where no booking vendor is known."""

    def hits(page: Column) -> Column:
        def matched(pattern: str) -> Column:
            texts = required_text(pattern)  # looking for a text is far cheaper than matching a pattern
            found = page.rlike(f"(?U){pattern}")
            return reduce(or_, [F.contains(page, F.lit(t)) for t in texts]) & found if texts else found

        flags = [F.when(matched(p), F.struct(F.lit(k).alias("kind"), F.lit(v).alias("vendor"))) for p, k, v in C.SIGNATURES]
        return F.filter(F.array(*flags), lambda h: h.isNotNull())

    def by_kind(found: Column, kinds: Column) -> Column:
        of = lambda k: F.array_distinct(F.transform(F.filter(found, lambda h: h["kind"] == k), lambda h: h["vendor"]))
        return F.map_from_arrays(kinds, F.transform(kinds, of))

    def with_hint(kinds: Column, found: Column, page: Column) -> Column:
        known = by_kind(found, kinds)
        hinted = F.map_concat(known, F.create_map(F.lit("booking_hint"), F.array(F.lit("custom_or_manual"))))
        return F.when(~F.array_contains(kinds, "booking") & page.rlike(f"(?U){C.BOOKING_HINT}"), hinted).otherwise(known)

    def of_page(page: Column) -> Column:
        return let(hits(page), lambda found: let(F.array_distinct(F.transform(found, lambda h: h["kind"])), lambda kinds: with_hint(kinds, found, page)))

    # patterns are in lower case, so is the page: cheaper than matching in any case
    return F.when(html.isNull(), F.create_map().cast("map<string,array<string>>")).otherwise(let(F.lower(html), of_page))


def merge_automation(mine: Column, theirs: Column) -> Column:
    """Union by kind, mine first."""
    empty = F.array().cast("array<string>")
    return F.map_zip_with(mine, theirs, lambda _, a, b: F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty))))


def is_automated(automation: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.map_keys(automation), F.array(*map(F.lit, C.STRONG_KINDS))), F.lit(False))


def describe_automation(automation: Column) -> Column:
    entries = F.array_sort(F.map_entries(automation))
    shown = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], "/"))), ", ")
    return F.coalesce(filled(shown), F.lit("—"))


def estimate_size(tags: Column, category: Column, branches: Column) -> Column:
    """struct<size, score, signals...> from category, number of branches and tags."""
    weights = F.create_map(*[F.lit(x) for kv in C.BASELINE.items() for x in kv])
    base = F.coalesce(F.try_element_at(weights, category), F.lit(1))
    n = F.greatest(F.coalesce(branches, F.lit(1)), F.lit(1))
    chain = F.filter(F.array(*map(F.lit, C.CHAIN_TAGS)), lambda t: has_value(F.try_element_at(tags, t)))
    web = has_value(tag(tags, "website")) | has_value(tag(tags, "contact:website"))
    email = has_value(tag(tags, "email")) | has_value(tag(tags, "contact:email"))
    sizes = [F.when(first_number(tag(tags, k)).isNotNull(), F.struct(F.lit(k).alias("key"), first_number(tag(tags, k)).alias("value"))) for k in C.CAPACITY_TAGS]
    room = F.coalesce(*sizes)
    always = F.coalesce(F.contains(tag(tags, "opening_hours"), F.lit("24/7")), F.lit(False))
    comfort = F.filter(
        F.array(
            F.when(tag(tags, "wheelchair") == "yes", F.lit("wheelchair")), F.when(has_value(tag(tags, "internet_access")), F.lit("internet_access"))
        ),
        lambda a: a.isNotNull(),
    )
    score = (
        base
        + F.when(n >= 4, 2).when(n > 1, 1).otherwise(0)
        + F.when(F.size(chain) > 0, 2).otherwise(0)
        + F.when(web & email, 1).otherwise(0)
        + F.when(room["value"] >= 50, 2).when(room["value"] >= 15, 1).otherwise(0)
        + F.when(always, 1).otherwise(0)
    )
    return F.struct(
        F.when(score >= 5, "medium").when(score >= 2, "small").otherwise("micro").alias("size"),
        score.cast("int").alias("score"),
        base.cast("int").alias("baseline_category"),
        F.when(n > 1, n).cast("long").alias("branches_same_name"),
        F.when(F.size(chain) > 0, chain).alias("chain_tags"),
        F.when(web & email, F.struct(web.alias("web"), email.alias("email"))).alias("digital_presence"),
        room.alias("capacity"),
        F.when(always, "24/7").alias("opening_hours"),
        F.when(F.size(comfort) > 0, comfort).alias("amenities"),
        F.lit("low").alias("confidence"),
    )


def contact_score(phone: Column, email: Column, website: Column, socials: Column) -> Column:
    """3 for a phone, 3 for an email, 1 for a site, 1 for each of at most three social networks."""
    some = lambda c: F.coalesce(c != "", F.lit(False))
    points = lambda c, n: F.when(some(c), n).otherwise(0)
    return points(phone, 3) + points(email, 3) + points(website, 1) + F.least(F.lit(3), F.greatest(F.lit(0), F.coalesce(F.size(socials), F.lit(0))))
