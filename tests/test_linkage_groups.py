"""Linkage over components of candidates against one fold over everything."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from terncove.functions.harvest import similarity
from terncove.operators import linkage, similar

LEAD = "id long, osm_id string, name string, city string, address string, lat double, lon double, phone string, merged_ids array<string>, external_ids map<string,string>"
RECORD = "pos long, source string, ext_id string, name string, category string, city string, address string, lat double, lon double, phones array<string>, email string, website string, create_if_missing boolean"
WORDS = ["слон", "левандо", "дентал", "арт", "смайлік", "плюс", "медікавер", "к", "ок", "центрздоровя", "яблуко🙂"]


def name(r):
    base = " ".join(r.choices(WORDS, k=r.randint(1, 3)))
    kind = r.random()
    return base if kind < 0.5 else None if kind < 0.52 else base[: r.randint(1, len(base))] + r.choice("абвгд") + base[r.randint(1, len(base)) :]


def tables(seed, n_leads, n_records, cities):
    r = random.Random(seed)

    def place():
        at = r.random()
        lat = None if at < 0.2 else 50.0 + r.random() * 0.02
        address = r.choice([None, "вул. Шевченка, 5", "вул. Франка, 7", "вул. Нова, 1", ""])
        return r.choice(cities), address, lat, None if at > 0.97 else 30.0 + r.random() * 0.02

    phone = lambda: f"+38067{r.randint(0, n_leads):07}" if r.random() < 0.3 else None
    leads = []
    for i in range(n_leads):
        city, address, lat, lon = place()
        leads.append((i, f"node/{i}", name(r), city, address, lat, lon, phone(), [f"node/{n_leads + i}"] if i % 9 == 0 else None, {"nszu": f"x{r.randint(0, 60)}"} if i % 5 == 0 else None))
    records = []
    for i in range(n_records):
        city, address, lat, lon = place()
        records.append((i, r.choice(["nszu", "docua"]), f"x{r.randint(0, 900)}", name(r), "clinic", city, address, lat, lon, [p for p in (phone(), phone()) if p], None, None, r.random() < 0.6))
    return leads, records


@pytest.mark.parametrize("seed, cities", [(1, ["Київ"] * 9 + ["Львів"]), (2, ["Київ", "Львів", "Одеса", "Дніпро"])])
def test_components_give_the_fold_of_everything(spark, monkeypatch, seed, cities):
    monkeypatch.setattr(linkage, "TOGETHER", 10)
    leads, records = tables(seed, 500, 400, cities)
    lead, rec = spark.createDataFrame(leads, LEAD), spark.createDataFrame(records, RECORD)
    got = sorted((r.pos, r.outcome, r.lead_id, r.created_by) for r in linkage.link(lead, rec).collect())
    keys = F.array().cast("array<string>")
    whole_leads = lead.select(
        "id", "osm_id", "city", "phone", "lat", "lon", linkage.X.normalize_name(F.col("name")).alias("norm"), linkage.X.address_house(F.col("address")).alias("house"),
        linkage.X.address_stems(F.col("address")).alias("stems"), F.coalesce("merged_ids", keys).alias("merged_keys"),
        F.coalesce(F.transform(F.map_entries("external_ids"), lambda e: F.concat_ws("/", e["key"], e["value"])), keys).alias("own_keys"),
    ).toPandas()
    plain = lambda d: d.astype(object).where(d.notna(), None)
    whole = linkage.fold(plain(whole_leads.assign(created_by=None)), plain(linkage.prepared(rec).toPandas())).astype(object)
    want = sorted(map(tuple, whole.where(whole.notna(), None).values.tolist()))
    assert [tuple(w) for w in want] == got
    assert {w[1] for w in want} == {"matched", "merged", "new", "skipped"}


def test_nearly_equal_names_are_all_found(spark):
    r = random.Random(4)
    norms = sorted({(name(r) or "x").lower() for _ in range(260)} | {"к", "ок", "а"})
    rows = [("c", n, i, i % 2 == 0) for i, n in enumerate(norms)]
    df = spark.createDataFrame(rows, "place string, norm string, id long, asked boolean").withColumn("ls", similar.letters(F.col("norm")))
    got = {(p.x, p.y) for p in similar.similar_names(df, 0.95).collect()}
    want = {(i, j) for _, a, i, asked in rows for _, b, j, _ in rows if asked and i != j and similarity(a, b) >= 0.95}
    assert want <= got and len(got) < 2 * len(want) + 20


@pytest.mark.parametrize("busy", [0, 10**6])
def test_similar_names_of_a_place_are_all_found(spark, monkeypatch, busy):
    monkeypatch.setattr(similar, "BUSY", busy)
    r = random.Random(5)
    norms = sorted({(name(r) or "x").lower() for _ in range(160)})
    rows = [(k % 3, n, i) for k in range(3) for i, n in enumerate(norms)]
    df = spark.createDataFrame(rows, "place long, norm string, id long").withColumn("ls", similar.letters(F.col("norm")))
    pairs = [(i, j) for i, a in enumerate(norms) for j, b in enumerate(norms) if i != j and (a in b or b in a)]
    got = {(p.x, p.y) for p in similar.similar_at_places(df, df, spark.createDataFrame(pairs, "x long, y long"), 0.8).where("place = 1").collect()}
    assert {(i, j) for i, a in enumerate(norms) for j, b in enumerate(norms) if similarity(a, b) >= 0.8} <= got
    assert len(got) < len(norms) ** 2 / 3


def test_bound_is_never_below_the_ratio(spark):
    from difflib import SequenceMatcher

    r = random.Random(6)
    pairs = [(name(r) or "", name(r) or "") for _ in range(300)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    for row in df.select("i", similar.ratio_bound(F.col("a"), F.col("b")).alias("bound")).collect():
        a, b = pairs[row.i]
        assert row.bound == pytest.approx(SequenceMatcher(None, a, b).quick_ratio())


def test_a_hot_name_does_not_hang_a_city_together(spark):
    """A third of all leads share one name; records of that name concern their neighbours only."""
    leads = [(i, f"node/{i}", "Аптека" if i % 3 else f"щось {i} зовсім", "Київ", None, 50.0 + i * 0.01, 30.0, None, None, None) for i in range(300)]
    records = [(i, "nszu", f"r{i}", "Аптека", "clinic", "Київ", None, 50.0 + i * 0.01, 30.0, [], None, None, True) for i in range(0, 300, 5)]
    lead, rec = spark.createDataFrame(leads, LEAD), spark.createDataFrame(records, RECORD)
    got = {r.pos: (r.outcome, r.lead_id) for r in linkage.link(lead, rec).collect()}
    assert got == {i: ("matched", i) if i % 3 else ("new", None) for i in range(0, 300, 5)}
    shaped = [df.withColumn("name_id", linkage._node("name", F.col("city"), F.col("norm"))).withColumn("ls", similar.letters(F.col("norm"))) for df in (
        lead.select("osm_id", "city", "phone", "lat", "lon", linkage.X.normalize_name(F.col("name")).alias("norm"), F.lit(None).cast("string").alias("house"), F.array().cast("array<string>").alias("stems"), F.array().cast("array<string>").alias("own_keys"), F.array().cast("array<string>").alias("merged_keys"), F.col("id").alias("node")),
        linkage.prepared(rec).withColumn("node", -F.col("pos") - 1))]
    roots = linkage.components(linkage.candidate_edges(*shaped)[0]).groupBy("root").count()
    assert roots.agg(F.max("count")).first()[0] < 30
