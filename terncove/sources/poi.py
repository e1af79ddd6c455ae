"""Map points of interest: query text, landed responses, typed lead rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.geo import area_id, bbox_clause
from ..functions.rules import is_big_chain, is_public_facility, tag
from ..functions.text import filled, normalize_city, normalize_instagram, strip, tag_filter

ELEMENTS = (
    "struct<remark: string, elements: array<struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, "
    "tags: map<string,string>>>>"
)


def build_query(filters: DataFrame, timeout_s: int = 180) -> DataFrame:
    """filters: city, osm_type, osm_id, south, north, west, east, pos, spec. One query text for each city."""
    area = area_id(F.col("osm_type"), F.col("osm_id"))
    scope = F.when(area.isNotNull(), F.lit("(area.searchArea)")).otherwise(bbox_clause(*[F.col(c) for c in ("south", "west", "north", "east")]))
    line = F.concat(F.lit("  nwr"), tag_filter(F.col("spec")), scope, F.lit(";"))
    grouped = filters.groupBy("city", area.alias("area")).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    header = F.coalesce(F.concat(F.lit("area("), F.col("area").cast("string"), F.lit(")->.searchArea;")), F.lit(""))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return grouped.select("city", F.concat(F.lit(f"[out:json][timeout:{timeout_s}];\n"), header, F.lit("\n(\n"), body, F.lit("\n);\nout center tags;")).alias("query"))


def response_status(body: Column) -> Column:
    """``failed`` is not the same as an honest empty answer."""
    parsed = F.from_json(body, ELEMENTS)
    remark = F.coalesce(parsed["remark"], F.lit(""))
    broken = body.isNull() | F.try_parse_json(body).isNull() | F.contains(remark, F.lit("runtime error")) | F.contains(remark, F.lit("timed out"))
    return F.when(broken, "failed").when(F.coalesce(F.size(parsed["elements"]), F.lit(0)) <= 0, "empty").otherwise("ok")


def first_tag(tags: Column, keys: list[str]) -> Column:
    """The first key that is not empty, trimmed only after the choice."""
    return strip(F.coalesce(*[filled(tag(tags, k)) for k in keys]))


def address_of(tags: Column) -> Column:
    street = F.concat_ws(" ", filled(tag(tags, "addr:street")), filled(tag(tags, "addr:housenumber")))
    return F.coalesce(filled(F.concat_ws(", ", filled(street), filled(tag(tags, "addr:city")))), filled(tag(tags, "address")))


def parse_responses(raw: DataFrame, skip_chains: bool = True, skip_public: bool = True) -> DataFrame:
    """raw: category, city, body. Lead rows of responses that are ``ok``; ``reject`` tells nameless, chain or public ones."""
    good = raw.where(response_status(F.col("body")) == "ok")
    e = good.select("category", "city", F.explode(F.from_json("body", ELEMENTS)["elements"]).alias("e"))
    tags = F.coalesce(F.col("e.tags"), F.create_map().cast("map<string,string>"))
    name = F.coalesce(*[filled(tag(tags, k)) for k in ("name", "name:uk", "brand")])
    reject = F.when(name.isNull(), "nameless")
    reject = reject.when(is_big_chain(tags), "chain") if skip_chains else reject
    reject = reject.when(is_public_facility(tags), "public") if skip_public else reject
    found = {k: first_tag(tags, keys) for k, keys in C.SOCIAL_KEYS.items()}
    found["instagram"] = normalize_instagram(found["instagram"])
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), filled(v).alias("value")) for k, v in found.items()]), lambda x: x["value"].isNotNull())
    return e.select(
        F.concat_ws("/", "e.type", F.col("e.id").cast("string")).alias("osm_id"), F.col("e.type").alias("osm_type"), strip(name).alias("name"), "category", "city",
        address_of(tags).alias("address"), F.coalesce(F.when(F.col("e.lat") != 0, F.col("e.lat")), F.col("e.center.lat")).alias("lat"),
        F.coalesce(F.when(F.col("e.lon") != 0, F.col("e.lon")), F.col("e.center.lon")).alias("lon"),
        first_tag(tags, C.PHONE_KEYS).alias("phone"), first_tag(tags, C.WEBSITE_KEYS).alias("website"), first_tag(tags, C.EMAIL_KEYS).alias("email"),
        F.when(F.size(entries) > 0, F.map_from_entries(entries)).alias("socials"), tags.alias("raw_tags"), F.lit("osm").alias("source"), reject.alias("reject"),
    )


HITS = "array<struct<osm_type: string, osm_id: bigint, boundingbox: array<string>, display_name: string, lat: string, lon: string>>"


def geocode(raw: DataFrame) -> DataFrame:
    """raw: city, body. The first hit that is an area and whose numbers parse."""
    hits = F.slice(F.from_json("body", HITS), 1, 5)
    number = lambda c: c.try_cast("double")
    good = F.filter(
        hits,
        lambda h: h["osm_type"].isin("relation", "way") & h["osm_id"].isNotNull() & number(h["lat"]).isNotNull() & number(h["lon"]).isNotNull()
        & (F.size(h["boundingbox"]) == 4) & F.forall(h["boundingbox"], lambda b: number(b).isNotNull()),
    )
    p = raw.withColumn("p", F.get(good, 0)).where(F.col("p").isNotNull())
    box = lambda i: number(F.col("p.boundingbox")[i])
    return p.select(
        normalize_city(F.col("city")).alias("key"), F.col("city").alias("name"), "p.display_name", "p.osm_type", "p.osm_id", number(F.col("p.lat")).alias("lat"),
        number(F.col("p.lon")).alias("lon"), box(0).alias("south"), box(1).alias("north"), box(2).alias("west"), box(3).alias("east"),
    )


def cached_areas(cities: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cities with their cached area, cities to fetch)."""
    keyed = cities.withColumn("key", normalize_city(F.col("city")))
    return keyed.join(cache, "key"), keyed.join(cache, "key", "left_anti")
