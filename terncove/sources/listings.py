"""Listing sites: card lists, sitemaps, cards as landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.harvest import listing_card, search_results
from ..functions.rules import is_medical_chain, is_public_name
from ..operators.stats import shared_phones
from ..plans.cut import cut

# Fixed value: a link to a card.
CARD_LINK = r'href="(?:https://likarni\.com)?(/clinic/[\w\-]+)"'


def card_paths(pages: DataFrame) -> DataFrame:
    """pages: city, seq, html. Card paths of each city in order of first appearance."""
    found = F.regexp_extract_all("html", F.lit(CARD_LINK))
    grouped = pages.groupBy("city").agg(F.array_sort(F.collect_list(F.struct("seq", found.alias("p")))).alias("l"))
    paths = F.array_distinct(F.flatten(F.transform("l", lambda x: x["p"])))
    return grouped.select("city", F.posexplode(paths).alias("pos", "path"))


def listing_crawl(landed: DataFrame, sections: list[str], most: int = 40) -> DataFrame:
    """landed: city, section, page (from 1), allowed, html. city, section, page, pos, path of the cards that a crawl sees.

    ``sections`` are read in turn. A section ends before its first page that robots forbid, that did not land, that shows no card not seen before, or that is page ``most`` + 1.
    What counts as seen are cards of pages that were read.
    """
    seen = None
    for section in sections:
        own = landed.where((F.col("section") == section) & (F.col("page") <= most) & F.col("html").isNotNull() & F.coalesce("allowed", F.lit(True)))
        links = own.select("city", "page", F.posexplode(F.regexp_extract_all("html", F.lit(CARD_LINK))).alias("pos", "path"))
        if seen is not None:
            links = links.join(seen.select("city", "path"), ["city", "path"], "left_anti")
        first = links.groupBy("city", "path").agg(F.min(F.struct("page", "pos")).alias("at")).select("city", "path", "at.page", "at.pos")
        fresh = first.groupBy("city", "page").agg(F.count("*").alias("new"))
        reached = own.select("city", "page").distinct().join(fresh, ["city", "page"], "left")
        place = F.row_number().over(Window.partitionBy("city").orderBy("page"))  # ``most`` rows a city
        ends = reached.withColumn("n", place).groupBy("city").agg(F.min(F.when((F.col("n") != F.col("page")) | F.col("new").isNull(), F.col("page"))).alias("end"))
        gap = reached.withColumn("n", place).where("n = page").groupBy("city").agg(F.max("page").alias("last"))
        read = first.join(ends, "city").join(gap, "city").where((F.col("page") <= F.col("last")) & (F.col("end").isNull() | (F.col("page") < F.col("end"))))
        kept = read.select("city", F.lit(section).alias("section"), "page", "pos", "path")
        seen = cut(kept if seen is None else seen.unionByName(kept))
    return seen


def sitemap_cards(xml: DataFrame) -> DataFrame:
    """xml: slug, body. URLs of the cards of the wanted city in the local language."""
    urls = F.regexp_extract_all("body", F.lit(r"<loc>(https://doc\.ua/ua/klinika/[\w\-]+/[^<]+)</loc>"))
    rows = xml.select("slug", F.posexplode(urls).alias("pos", "url"))
    return rows.where(F.regexp_extract("url", r"^https://doc\.ua/ua/klinika/([\w\-]+)/", 1) == F.col("slug"))


def likarni_cards(pages: DataFrame) -> DataFrame:
    """pages: city, path, html. The first described object of each card; cards of chains and public facilities yield none."""
    c = pages.withColumn("c", listing_card("html"))
    zipped = F.arrays_zip("c.types", "c.names", "c.phones", "c.emails", "c.streets", "c.has_address")
    telling = F.filter(
        zipped,
        lambda n: ~F.coalesce(n["types"].isin("BreadcrumbList", "Review"), F.lit(False)) & (n["names"] != "") & ((F.size(n["phones"]) > 0) | n["has_address"]),
    )
    one = c.withColumn("n", F.get(telling, 0)).where(F.col("n").isNotNull()).where(~is_medical_chain(F.col("n.names")) & ~is_public_name(F.col("n.names")))
    cards = one.select(
        F.lit("likarni").alias("source"), F.substring_index("path", "/", -1).alias("ext_id"), X.clean_listing_name(F.col("n.names"), F.col("city")).alias("name"),
        X.guess_category(F.col("n.names"), F.col("n.types")).alias("category"), "city", F.col("n.streets").alias("address"), F.col("n.phones").alias("phones"),
        F.col("n.emails").alias("email"), F.create_map(F.lit("listing"), F.array(F.lit("likarni"))).alias("automation"), F.col("path").alias("card_id"),
    )
    return shared_phones(cards).drop("card_id")


def doc_ua_cards(pages: DataFrame, add_new: bool = False) -> DataFrame:
    """pages: city, url, html. Named by the last breadcrumb."""
    c = pages.withColumn("c", listing_card("html")).where(F.col("c.breadcrumb") != "")
    good = c.where(~is_medical_chain(F.col("c.breadcrumb")) & ~is_public_name(F.col("c.breadcrumb")))
    return good.select(
        F.lit("doc_ua").alias("source"), X.username(F.col("url")).alias("ext_id"), X.clean_listing_name(F.col("c.breadcrumb"), F.col("city")).alias("name"),
        X.guess_category(F.col("c.breadcrumb"), F.lit("")).alias("category"), "city", F.col("c.address_line").alias("address"),
        F.array().cast("array<string>").alias("phones"), F.lit(None).cast("string").alias("email"),
        F.create_map(F.lit("listing"), F.array(F.lit("doc.ua"))).alias("automation"), F.lit(add_new).alias("create_if_missing"),
    )


def search_hits(raw: DataFrame) -> DataFrame:
    """raw: id, html. Unwrapped results in order, or one row that says why the search failed."""
    r = raw.withColumn("s", search_results("html"))
    rows = r.select("id", F.col("s.failed").alias("failed"), F.posexplode_outer("s.results").alias("pos", "r"))
    return rows.select("id", "failed", "pos", X.unwrap_result(F.col("r.href")).alias("url"), "r.title", "r.snippet").where("failed is not null or url is not null")


def official_sites(hits: DataFrame) -> DataFrame:
    """The first hit of each lead that is no aggregator, without its query."""
    good = hits.where(F.col("url").isNotNull() & ~X.is_aggregator(F.col("url")))
    first = good.groupBy("id").agg(F.min(F.struct("pos", "url")).alias("h")).select("id", F.substring_index("h.url", "?", 1).alias("url"))
    asked = hits.groupBy("id").agg(F.max(F.col("failed").isNotNull()).alias("failed"))
    return asked.join(first, "id", "left").select("id", "url", "failed")


PLACE_SEARCH = "struct<places: array<struct<id: string>>>"
PLACE = "struct<id: string, nationalPhoneNumber: string, internationalPhoneNumber: string, formattedAddress: string>"


def paid_lookups(raw: DataFrame) -> DataFrame:
    """raw: id, known_place, search_body, details_body (NULL: no response). The id search is made only where the place is not
    known yet; calls are counted only where a response came."""
    searched = F.col("known_place").isNull()
    place = F.coalesce("known_place", F.get(F.from_json("search_body", PLACE_SEARCH)["places"], 0)["id"])
    d = F.from_json("details_body", PLACE)
    asked = place.isNotNull()
    calls = (searched & F.col("search_body").isNotNull()).cast("int") + (asked & F.col("details_body").isNotNull()).cast("int")
    phone = X.normalize_phone(F.coalesce(d["internationalPhoneNumber"], d["nationalPhoneNumber"]))
    return raw.select("id", place.alias("place_id"), calls.alias("calls"), F.when(asked, phone).alias("phone"), F.when(asked, d["formattedAddress"]).alias("address"))
