"""Which search hit is a lead's own profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as X
from ..functions.harvest import profile_similarity_udf


def city_forms(city: Column) -> Column:
    """The name, its stem without an ending, both alphabets."""
    low = F.lower(X.strip(city))
    stem = F.substring(low, F.lit(1), F.greatest(F.lit(4), F.length(low) - 2))
    return F.filter(F.array(low, stem, X.transliterate(low), X.compact(low)), lambda v: v != "")


def score_profiles(hits: DataFrame) -> DataFrame:
    """hits: id, name, city, pos, url, title, snippet. Adds score (best of three spellings) and city_ok."""
    theirs = X.normalize_name(X.strip(F.regexp_replace("title", f"(?iU){C.PROFILE_TITLE_TAIL}", "")))
    ours, handle = X.normalize_name(F.col("name")), X.username(F.col("url"))
    spelled = hits.withColumns({"_o": ours, "_t": theirs, "_h": handle})
    score = F.greatest(
        profile_similarity_udf("_o", "_t"), profile_similarity_udf(X.transliterate(F.col("_o")), X.transliterate(F.col("_t"))),
        profile_similarity_udf(X.compact(F.col("_o")), X.compact(F.col("_h"))),
    )
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), "_h"))
    forms = F.array(hay, X.transliterate(hay), X.compact(hay))
    city_ok = F.exists(city_forms(F.col("city")), lambda v: F.exists(forms, lambda h: F.contains(h, v)))
    return spelled.withColumns({"score": score, "city_ok": F.coalesce(city_ok, F.lit(False))}).drop("_o", "_t", "_h")


def best_candidates(scored: DataFrame) -> DataFrame:
    """Without thresholds: the best by score, then city; the first of equals."""
    order = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("city_ok"), "pos")
    return scored.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def pick_profiles(scored: DataFrame, threshold: float = 0.84, require_city: bool = True) -> DataFrame:
    """The best by city, then score, among those good enough."""
    good = scored.where((F.col("score") >= threshold) & (F.col("city_ok") | F.lit(not require_city)))
    order = Window.partitionBy("id").orderBy(F.desc("city_ok"), F.desc("score"), "pos")
    return good.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
