"""Tables with several writers: deltas in proportion to changes, reopened tables, conflicts by key, and claims at once."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from terncove.operators import merge, versions
from terncove.operators.versions import Conflict, VersionedTable, claim_from, upsert_into

LEAD = "id long, osm_id string, name string, category string, city string, phone string, website string, website_status string"
ITEM = "id long, business_id long, channel string, handle string, status string, attempts int, claimed_at timestamp"
now = lambda: F.lit("2024-06-01 12:00:00").cast("timestamp")


def size(path) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def leads(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("node/"), "id").alias("osm_id"), F.sha2(F.col("id").cast("string"), 512).alias("name"), *[F.lit(v).alias(c) for c, v in (("category", "x"), ("city", "y"))], *[F.lit(None).cast("string").alias(c) for c in ("phone", "website", "website_status")])


def found(spark, ids, phone):
    rows = [(f"node/{i}", f"n{i}", "x", "y", phone, None) for i in ids]
    return spark.createDataFrame(rows, "osm_id string, name string, category string, city string, phone string, website string")


def test_changes_cost_what_they_are(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "osm_id")
    table.create(leads(spark, 20_000))
    before = size(tmp_path)
    made = upsert_into(table, found(spark, [*range(50), *range(30_000, 30_050)], "+1"))
    assert {r.outcome: r["count"] for r in made.groupBy("outcome").count().collect()} == {"new": 50, "updated": 50}
    assert size(tmp_path) - before < before / 20
    assert upsert_into(table, found(spark, range(50), "+2")).count() == 0 and table.version() == 1
    want = merge.upsert(leads(spark, 20_000), found(spark, [*range(50), *range(30_000, 30_050)], "+1"))
    shown = ["osm_id", "phone", "website_status"]
    reopened = VersionedTable(spark.newSession(), f"file://{tmp_path}/t", "osm_id").read()
    assert sorted(map(tuple, reopened.select(*shown).collect()), key=str) == sorted(map(tuple, want.select(*shown).collect()), key=str)
    assert table.read(0).where("phone is not null").count() == 0  # an older version stays readable


def test_deltas_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(VersionedTable.compact, "__defaults__", (3,))
    table = VersionedTable(spark, f"file://{tmp_path}/t", "osm_id")
    table.create(leads(spark, 30))
    for i in range(7):
        upsert_into(table, found(spark, [i, 100 + i], f"+{i}"))
    assert len(table.manifest(table.version())["deltas"]) < 3 and table.version() == 9
    assert {r.osm_id: r.phone for r in table.read().where("phone is not null").collect()} == {f"node/{n}": f"+{i}" for i in range(7) for n in (i, 100 + i)}
    assert table.read().count() == 37


def test_conflicts_by_key(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "osm_id")
    table.create(leads(spark, 10))
    row = lambda i, name: leads(spark, 10).where(F.col("id") == i).withColumn("name", F.lit(name))
    assert table.commit(row(1, "a"), 0) == 1
    assert table.commit(row(2, "b"), 0) == 2  # another key: rebased
    with pytest.raises(Conflict):
        table.commit(row(1, "c"), 0)
    with pytest.raises(Conflict):
        table.commit(row(3, "d"), 1, rebase=False)
    with pytest.raises(Conflict):
        table.create(leads(spark, 1))
    assert {r.id: r.name for r in table.read().where("length(name) = 1").collect()} == {1: "a", 2: "b"}
    assert VersionedTable(spark, f"file://{tmp_path}/none", "id").version() == -1


def test_two_agents_share_no_item_and_keep_the_cap(spark, tmp_path, monkeypatch):
    rows = [(i, i, "instagram", f"h{i}", "queued", 0, None) for i in range(60)]
    VersionedTable(spark, f"file://{tmp_path}/q", "id").create(spark.createDataFrame(rows, ITEM))
    meet, commit, lost = threading.Barrier(2, timeout=60), VersionedTable.commit, []

    def together(self, *args, **kwargs):  # the first commits of both come from the same version
        if not lost and not meet.broken:
            meet.wait()
        try:
            return commit(self, *args, **kwargs)
        except Conflict:
            lost.append(1)
            raise

    monkeypatch.setattr(VersionedTable, "commit", together)
    got: dict[int, list[int]] = {}

    def agent(k):
        table = VersionedTable(spark.newSession(), f"file://{tmp_path}/q", "id")
        got[k] = [r.id for r in claim_from(table, 15, now(), cap=20).collect()]

    agents = [threading.Thread(target=agent, args=(k,)) for k in range(2)]
    for a in agents:
        a.start()
    for a in agents:
        a.join()
    assert len(lost) == 1 and sorted(got[0] + got[1]) == list(range(20))
    after = VersionedTable(spark, f"file://{tmp_path}/q", "id").read()
    assert after.where("status = 'claimed' and attempts = 1").count() == 20 and after.count() == 60
    assert claim_from(VersionedTable(spark, f"file://{tmp_path}/q", "id"), 15, now(), cap=20).count() == 0


def test_a_writer_gives_up_at_last(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "osm_id")
    table.create(leads(spark, 3))

    def never(*_a, **_k):
        raise Conflict("taken")

    monkeypatch.setattr(VersionedTable, "commit", never)
    with pytest.raises(Conflict):
        versions.decided(table, lambda rows: rows, rebase=True, tries=2)
