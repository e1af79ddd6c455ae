"""Open health registry: legal entities and divisions as landed CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as X
from ..functions.rules import is_public_name

CHAIN_FROM = 10


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; ``NULL`` and the empty string are null; a byte order mark is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.select(*[F.when(~F.col(c).isin("NULL", ""), F.col(c)).alias(c) for c in df.columns])


def entities(legal: DataFrame, divisions: DataFrame) -> DataFrame:
    """Legal entities with ``reject``: public, emergency or chain; the first test that fails counts. Chains are counted over all
    divisions."""
    sizes = divisions.groupBy("legal_entity_id").agg(F.count("*").alias("n_divisions"))
    public = ~F.coalesce(F.col("property_type").isin(C.PRIVATE_PROPERTY), F.lit(False)) | is_public_name(F.col("legal_entity_name"))
    care = F.coalesce(F.col("care_type").isin(list(C.CARE_CATEGORY)), F.lit(False))
    reject = F.when(public, "public").when(~care, "emergency").when(F.col("n_divisions") >= CHAIN_FROM, "chain")
    return legal.join(sizes.hint("merge"), "legal_entity_id", "left").withColumn("reject", reject)  # see ``places``


def places(legal: DataFrame, divisions: DataFrame) -> DataFrame:
    """One row for each division of an accepted entity, and one for each accepted entity without any division.

    Both sides grow with the registry, so neither is ever sent to the driver, however small an estimate takes it to be.
    """
    good = entities(legal, divisions).where("reject is null").drop("reject", "n_divisions")
    d = divisions.select(
        "legal_entity_id", F.col("division_id").alias("ext_id"), F.col("division_type"), F.col("residence_settlement").alias("settlement"),
        F.col("residence_area").alias("area"), F.col("residence_addresses").alias("full_address"), F.col("lat").alias("place_lat"), F.col("lng").alias("place_lng"),
        F.col("division_phone").alias("own_phone"), F.col("division_email").alias("own_email"),
    )
    by_division = d.join(good.hint("merge"), "legal_entity_id")
    alone = good.join(divisions.select("legal_entity_id").hint("merge"), "legal_entity_id", "left_anti").select(
        "*", F.col("legal_entity_id").alias("ext_id"), F.lit(None).cast("string").alias("division_type"), F.col("registration_settlement").alias("settlement"),
        F.col("registration_area").alias("area"), F.col("registration_address").alias("full_address"), F.col("lat").alias("place_lat"), F.col("lng").alias("place_lng"),
        F.lit(None).cast("string").alias("own_phone"), F.lit(None).cast("string").alias("own_email"),
    )
    return by_division.unionByName(alone, allowMissingColumns=True)


def city_index(cities: DataFrame) -> DataFrame:
    """alias, city, region, excluded; the first city of the list owns an alias. cities: pos, name, region, ru, old, excluded."""
    names = F.concat(F.array("name", "ru"), F.coalesce("old", F.array().cast("array<string>")))
    alias = F.explode(F.array_distinct(F.transform(F.filter(names, lambda n: n.isNotNull()), X.normalize_city)))
    rows = cities.select("pos", F.col("name").alias("city_name"), "region", F.col("excluded").isNotNull().alias("excluded"), alias.alias("alias"))
    first = rows.where("alias <> ''").groupBy("alias").agg(F.min(F.struct("pos", "city_name", "region", "excluded")).alias("c"))
    return first.select("alias", "c.city_name", "c.region", "c.excluded")


def records(legal: DataFrame, divisions: DataFrame, cities: DataFrame, all_settlements: bool = False) -> DataFrame:
    """External records with ``reject`` (field station, other_city). A sole trader's tax id is never kept."""
    p = places(legal, divisions).withColumn("alias", X.normalize_city(F.col("settlement")))
    j = p.join(F.broadcast(city_index(cities)), "alias", "left")  # the city list is a fixed dimension
    ours = F.col("city_name").isNotNull() & X.same_region(F.col("area"), F.col("region"))
    city = F.when(ours, F.col("city_name"))
    reject = F.when(F.coalesce(F.col("division_type").isin(C.SKIPPED_DIVISIONS), F.lit(False)), "field_station")
    if not all_settlements:
        reject = reject.when(city.isNull() | F.coalesce(F.col("excluded"), F.lit(False)), "other_city")
    care = F.create_map(*[F.lit(x) for kv in C.CARE_CATEGORY.items() for x in kv])
    numbers = F.concat_ws(",", X.filled(F.col("own_phone")), X.filled(F.col("legal_entity_phone")))
    return j.select(
        F.lit("nszu").alias("source"), "ext_id", X.short_legal_name(F.col("legal_entity_name")).alias("name"), care[F.col("care_type")].alias("category"),
        F.coalesce(city, F.initcap(F.coalesce("settlement", F.lit("")))).alias("city"), X.street_address(F.col("full_address")).alias("address"),
        F.col("place_lat").try_cast("double").alias("lat"), F.col("place_lng").try_cast("double").alias("lon"),
        F.filter(F.transform(F.split(numbers, ","), X.strip), lambda x: x != "").alias("phones"),
        F.coalesce(X.filled(F.col("own_email")), F.col("legal_entity_email")).alias("email"), F.col("legal_entity_website").alias("website"),
        F.col("legal_entity_owner_name").alias("contact_person"), F.when(F.col("property_type") != "ФОП", F.col("legal_entity_edrpou")).alias("edrpou"),
        reject.alias("reject"),
    )


def select_cities(cities: DataFrame, only: list[str] | None = None, top: int | None = None, include_excluded: bool = False) -> DataFrame:
    """By any alias, excluded ones too (an unknown name is an error); else the list without excluded cities, its head of ``top``."""
    if only:
        named = cities.sparkSession.createDataFrame([(n,) for n in only], "asked string").select("asked", X.normalize_city(F.col("asked")).alias("alias"))
        found = named.join(city_index(cities), "alias", "left")
        missing = [r["asked"] for r in found.where("city_name is null").collect()]  # as many as were asked for
        if missing:
            raise ValueError(f"not in the list: {', '.join(missing)}")
        return cities.join(F.broadcast(found.select(F.col("city_name").alias("name"))), "name", "left_semi")
    picked = cities if include_excluded else cities.where("excluded is null")
    return picked.orderBy("pos").limit(top) if top else picked.orderBy("pos")


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of cities, or an object that holds it under ``cities``; larger ones first, else in order of the file."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("value").alias("body"))
    city = "array<struct<name: string, oblast: string, pop: double, ru: string, doc_ua: string, likarni: string, old: array<string>, excluded: string>>"
    listed = F.startswith(F.ltrim("body"), F.lit("["))
    rows = F.when(listed, F.from_json("body", city)).otherwise(F.from_json("body", f"struct<cities: {city}>")["cities"])
    c = raw.select(F.posexplode(rows).alias("file_pos", "c")).select("file_pos", "c.*").withColumnRenamed("oblast", "region")
    pos = F.row_number().over(_by_population()) - 1
    return c.withColumn("pos", pos).drop("file_pos")


def _by_population():
    from pyspark.sql import Window

    return Window.orderBy(F.desc_nulls_last("pop"), "file_pos")  # a list of cities is small
