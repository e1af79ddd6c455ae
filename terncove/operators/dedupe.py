"""One business seen as several map objects: near pairs of like names, greedy pairing, merge of the pair."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.harvest import aligned_similarity
from ..functions.rules import contact_score, is_automated, merge_automation
from ..functions.text import filled, normalize_name, plain_similarity
from ..plans.cut import cut
from .groups import components
from .similar import lengths_allow, ratio_bound

MERGED_FIELDS = ["address", "lat", "lon", "phone", "website", "raw_tags", "size_estimate", "size_signals", "google_place_id", "google_places_data"]
STAMPS = ["enriched_at", "last_verified_at", "google_checked_at"]


def near_pairs(leads: DataFrame, radius_m: float = 30.0, exact_cells: bool = True) -> DataFrame:
    """left_id < right_id of the same category within the radius.

    The right side is placed in its own cell, the left in its 3 x 3 neighbourhood: one equi-join on category and cell with the
    distance as a residual condition; no pair can meet twice. A cell is 1.5 radii high. ``exact_cells`` widens cells by the
    cosine of their latitude band so that none is narrower than the radius; without it far northern pairs can be missed.
    """
    size = geo.cell_size(radius_m)
    pts = leads.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("id", "category", "lat", "lon", normalize_name(F.col("name")).alias("norm"))
    cy = geo.cell(F.col("lat"), size)
    band = geo.cell(F.col("lat"), 1.0)

    def width(b: Column) -> Column:
        # the band's latitude farthest from the equator, and one degree more for neighbours beyond its edge
        return F.lit(size) / F.greatest(F.cos(F.radians(F.least(F.abs(b) + 2, F.lit(89)))), F.lit(0.01)) if exact_cells else F.lit(size)

    right = pts.select(
        F.col("id").alias("right_id"), "category", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("norm").alias("norm2"),
        band.alias("band"), cy.alias("cy"), geo.cell(F.col("lon"), width(band)).alias("cx"),
    )
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    left = pts.withColumn("dy", F.explode(steps)).withColumn("cy", cy + F.col("dy"))
    # a neighbouring row can lie in another band, where cells have another width
    bands = F.array_distinct(F.array(*[geo.cell(F.col("lat") + d * size, 1.0) for d in (-1, 0, 1)])) if exact_cells else F.array(band)
    left = left.withColumn("band", F.explode(bands)).withColumn("dx", F.explode(steps))
    left = left.withColumn("cx", geo.cell(F.col("lon"), width(F.col("band"))) + F.col("dx")).withColumnRenamed("id", "left_id")
    if not exact_cells:
        right, left = right.drop("band"), left.drop("band")
    keys = ["category", "cx", "cy", *(["band"] if exact_cells else [])]
    metres = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return (
        left.join(right, keys).where(F.col("left_id") < F.col("right_id")).withColumn("distance_m", metres)
        .where(F.col("distance_m") <= radius_m).select("left_id", "right_id", "category", "distance_m", "norm", "norm2")
    )


def duplicate_pairs(leads: DataFrame, radius_m: float = 30.0, threshold: float = 0.84, exact_cells: bool = True) -> DataFrame:
    """left_id, right_id, distance_m, similarity. Only names that are neither equal nor contained and have letters enough in common go to Python."""
    near = near_pairs(leads, radius_m, exact_cells).withColumn("plain", plain_similarity(F.col("norm"), F.col("norm2")))
    settled = near.where(F.col("plain").isNotNull()).withColumn("similarity", F.col("plain"))
    aligned = alignable(near, threshold).withColumn("similarity", aligned_similarity("norm", "norm2"))
    return settled.unionByName(aligned).where(F.col("similarity") >= threshold).select("left_id", "right_id", "distance_m", "similarity")


def alignable(near: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose similarity has to be aligned and can reach the threshold by their lengths and by their letters."""
    a, b = F.col("norm"), F.col("norm2")
    return near.where(F.col("plain").isNull() & lengths_allow(a, b, threshold)).where(ratio_bound(a, b) >= threshold - 1e-9)


def survivor_rank() -> Column:
    some = F.coalesce(F.size("automation") > 0, F.lit(False))
    score = contact_score(F.col("phone"), F.col("email"), F.col("website"), F.col("socials"))
    return F.struct(score.alias("score"), some.alias("auto"), F.coalesce(F.col("address") != "", F.lit(False)).alias("addr"), (-F.col("id")).alias("first"))


#: Pairs of at most so many are scanned by one task.
SCAN = 200_000


def _firsts(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs that come first at both of their ends, pairs that touch none of these). The scan takes the former, whatever else it takes."""
    ends = left.select(F.col("left_id").alias("node"), "edge").unionByName(left.select(F.col("right_id").alias("node"), "edge"))
    first = ends.groupBy("node").agg(F.min("edge").alias("first"))
    chosen = cut(
        left.join(first.select(F.col("node").alias("left_id"), F.col("first").alias("fl")), "left_id")
        .join(first.select(F.col("node").alias("right_id"), F.col("first").alias("fr")), "right_id")
        .where("edge = fl and edge = fr").select(*left.columns)
    )
    return chosen, cut(_untouched(left, chosen))


def _untouched(left: DataFrame, chosen: DataFrame) -> DataFrame:
    used = chosen.select(F.explode(F.array("left_id", "right_id")).alias("node"))
    return left.join(used.withColumnRenamed("node", "left_id"), "left_id", "left_anti").join(used.withColumnRenamed("node", "right_id"), "right_id", "left_anti").select(*left.columns)


def _scan(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rule itself: pairs in order, without those that touch a row that a taken pair has."""
    used: set[int] = set()
    taken = []
    pdf = pdf.sort_values(["left_id", "right_id"], ignore_index=True)
    for k, (a, b) in enumerate(zip(pdf["left_id"].tolist(), pdf["right_id"].tolist(), strict=True)):
        if a not in used and b not in used:
            used |= {a, b}
            taken.append(k)
    return pdf.iloc[taken]


def _scanned(left: DataFrame, group: str) -> DataFrame:
    kinds = ", ".join(f"`{c}` {k}" for c, k in left.dtypes if c != group)
    return left.groupBy(group).applyInPandas(lambda pdf: _scan(pdf.drop(columns=group)), kinds)


def greedy_pairs(pairs: DataFrame, scan: int = SCAN) -> DataFrame:
    """Pairs that a scan in order of (left_id, right_id) takes when it skips pairs that touch a taken row.

    1. Pairs that come first at both ends are taken at once and what touches them goes: most copies stand alone in twos, and stars end here.
    2. If ``scan`` pairs or fewer are left, one task scans them, chains and cliques alike. Else they are parted into components, which do not concern each
       other: each of at most ``scan`` pairs is scanned by a task of its own.
    3. Pairs of larger components are taken in consecutive ranges of about ``scan`` pairs in the order of the scan, without those that earlier ranges
       have used up; a range is treated as the whole is. So no task ever holds more than ``scan`` pairs.
    """
    taken, left = _firsts(cut(pairs.withColumn("edge", F.struct("left_id", "right_id"))))
    n = left.count()
    if n > scan:
        roots = components(left.select("left_id", "right_id"), scan)
        rooted = cut(left.join(roots.withColumnsRenamed({"node": "left_id", "root": "_root"}), "left_id"))
        sizes = cut(rooted.groupBy("_root").agg(F.count("*").alias("_n")))
        small = rooted.join(sizes.where(F.col("_n") <= scan).select("_root"), "_root", "left_semi")
        taken = taken.unionByName(cut(_scanned(small, "_root")))
        left = cut(rooted.join(sizes.where(F.col("_n") > scan).select("_root"), "_root", "left_semi").drop("_root"))
        n = left.count()
        edges = sorted(set(left.approxQuantile("left_id", [k * scan / n for k in range(1, -(-n // scan))], 0.1 * scan / n))) if n else []
        for low, high in zip([None, *edges], [*edges, None], strict=True):
            if n == 0:
                break
            part = left if low is None else left.where(F.col("left_id") > low)
            part = cut(_untouched(part if high is None else part.where(F.col("left_id") <= high), taken))
            while (m := part.count()) > scan:
                more, part = _firsts(part)
                taken = taken.unionByName(more)
            if m:
                taken = cut(taken.unionByName(_scanned(part.withColumn("_root", F.lit(0)), "_root")))
        n = 0
    if n:
        taken = taken.unionByName(_scanned(left.withColumn("_root", F.lit(0)), "_root"))
    return taken.drop("edge")


def with_survivors(leads: DataFrame, pairs: DataFrame) -> DataFrame:
    """keep_id and drop_id: the row with more contacts, then automation, then an address, then the smaller id, stays."""
    ranks = leads.select("id", survivor_rank().alias("rank"))
    both = pairs.join(ranks.withColumnsRenamed({"id": "left_id", "rank": "rl"}), "left_id").join(ranks.withColumnsRenamed({"id": "right_id", "rank": "rr"}), "right_id")
    first = F.col("rl") >= F.col("rr")
    keep, drop = F.when(first, F.col("left_id")).otherwise(F.col("right_id")), F.when(first, F.col("right_id")).otherwise(F.col("left_id"))
    return both.select(keep.alias("keep_id"), drop.alias("drop_id"), "distance_m", "similarity")


def latest(*stamps: str) -> Column:
    """The latest time that is known."""
    return F.greatest(*stamps)


def merge_pairs(leads: DataFrame, chosen: DataFrame) -> DataFrame:
    """Leads after each chosen drop row gave its keep row what that lacks; all columns stay, drop rows go."""
    others = leads.select(*[F.col(c).alias(f"_{c}") for c in leads.columns]).join(chosen.select(F.col("drop_id").alias("_id"), "keep_id"), "_id")
    both = leads.join(others, leads["id"] == others["keep_id"], "left").drop("keep_id")
    paired = F.col("_id").isNotNull()
    kinds = dict(leads.dtypes)
    own = [c for c in MERGED_FIELDS if c in leads.columns]
    present = lambda c, k: filled(F.col(c)) if k == "string" else F.col(c)  # noqa: E731  zero is a value here, the empty string is not
    new = {c: F.coalesce(present(c, kinds[c]), present(f"_{c}", kinds[c]), F.col(c)) for c in own}
    move = paired & (F.coalesce(F.col("email"), F.lit("")) == "") & (F.coalesce(F.col("_email"), F.lit("")) != "")
    new["email"], new["email_valid"] = F.when(move, F.col("_email")).otherwise(F.col("email")), F.when(move, F.col("_email_valid")).otherwise(F.col("email_valid"))
    empty_map = F.create_map().cast("map<string,array<string>>")
    union = merge_automation(F.coalesce("automation", empty_map), F.coalesce("_automation", empty_map))
    merged = F.when(paired & F.coalesce(F.size("_automation") > 0, F.lit(False)), union).otherwise(F.col("automation"))
    new["automation"] = merged
    known = F.col("has_automation").isNotNull() | F.col("_has_automation").isNotNull()
    new["has_automation"] = F.when(paired & known, is_automated(merged)).otherwise(F.col("has_automation"))
    plain_map = F.create_map().cast("map<string,string>")
    both_socials = F.map_zip_with(F.coalesce("socials", plain_map), F.coalesce("_socials", plain_map), lambda _, a, b: F.coalesce(a, b))
    new["socials"] = F.when(paired & F.coalesce(F.size("_socials") > 0, F.lit(False)), both_socials).otherwise(F.col("socials"))
    tags = F.array_sort(F.array_distinct(F.filter(F.concat(F.split(F.coalesce("source", F.lit("")), ","), F.split(F.coalesce("_source", F.lit("")), ",")), lambda s: s != "")))
    new["source"] = F.when(paired, F.array_join(tags, ",")).otherwise(F.col("source"))
    ids = F.array().cast("array<string>")
    every = F.concat(F.coalesce("merged_ids", ids), F.array("_osm_id"), F.coalesce("_merged_ids", ids))
    new["merged_ids"] = F.when(paired, F.array_sort(F.array_distinct(every))).otherwise(F.col("merged_ids"))
    notes = F.trim(F.concat(F.coalesce("notes", F.lit("")), F.lit(" "), F.col("_notes")))
    new["notes"] = F.when(paired & (F.coalesce(F.col("_notes"), F.lit("")) != ""), notes).otherwise(F.col("notes"))
    new |= {c: latest(c, f"_{c}") for c in STAMPS if c in leads.columns}
    if "website" in leads.columns and "website_status" in leads.columns:
        copied = paired & (F.coalesce(F.col("website"), F.lit("")) == "") & filled(F.col("_website")).isNotNull()
        new["website_status"] = F.when(copied, "has_website").otherwise(F.col("website_status"))
    result = both.withColumns(new).select(*leads.columns)
    return result.join(chosen.select(F.col("drop_id").alias("id")), "id", "left_anti").select(*leads.columns)


def dedupe(leads: DataFrame, radius_m: float = 30.0, threshold: float = 0.84, passes: int = 3, exact_cells: bool = True) -> DataFrame:
    """Up to ``passes`` rounds of greedy choice and merge. Not a transitive closure: names stay those of survivors.

    What decides about a pair, names, categories and places, no merge changes; so pairs are found once, and a round goes on with those
    whose rows are both still there.
    """
    pairs = cut(duplicate_pairs(leads, radius_m, threshold, exact_cells))
    for _ in range(passes):
        if pairs.isEmpty():
            break
        chosen = cut(with_survivors(leads, greedy_pairs(pairs)))
        leads = cut(merge_pairs(leads, chosen))
        gone = chosen.select("drop_id")
        pairs = cut(pairs.join(gone, pairs["left_id"] == gone["drop_id"], "left_anti").join(gone, pairs["right_id"] == gone["drop_id"], "left_anti"))
    return leads


def one_per_handle(leads: DataFrame, handle: Column) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("_handle").orderBy("id"))
    return leads.withColumn("_handle", handle).where(F.col("_handle").isNotNull()).withColumn("_n", first).where("_n = 1").drop("_n", "_handle")
