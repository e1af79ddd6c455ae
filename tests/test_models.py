"""Iterative and folded operators against plain sequential models."""

import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from terncove.functions.harvest import similarity
from terncove.operators import dedupe, linkage, merge, queue
from terncove.streaming import results


def test_greedy_pairs_equal_a_scan(spark):
    rnd = random.Random(3)
    pairs = sorted({tuple(sorted(rnd.sample(range(60), 2))) for _ in range(150)})
    used, want = set(), []
    for a, b in pairs:
        if a not in used and b not in used:
            want.append((a, b))
            used |= {a, b}
    df = spark.createDataFrame([(a, b, 1.0, 1.0) for a, b in pairs], "left_id long, right_id long, distance_m double, similarity double")
    assert sorted((r.left_id, r.right_id) for r in dedupe.greedy_pairs(df).collect()) == want


def test_near_pairs_equal_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice("ab"), f"n{i}", rnd.choice([0.0, 50.45, 59.9999, 60.0]) + rnd.uniform(-6e-4, 6e-4), rnd.uniform(-6e-4, 6e-4)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, category string, name string, lat double, lon double")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and linkage._metres(a[3], a[4], b[3], b[4]) <= 30}
    got = [(r.left_id, r.right_id) for r in dedupe.near_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_names_align_like_difflib():
    for a, b in (("tide", "diet"), ("слон", "клон"), ("ab", "abcd"), ("", "x")):
        want = 0.0 if not a or not b else 1.0 if a == b else 0.95 if a in b or b in a else SequenceMatcher(None, a, b).ratio()
        assert similarity(a, b) == want


LEAD = "id long, osm_id string, name string, city string, address string, lat double, lon double, phone string, merged_ids array<string>, external_ids map<string,string>"
RECORD = "pos long, source string, ext_id string, name string, category string, city string, address string, lat double, lon double, phones array<string>, email string, website string, create_if_missing boolean"


def test_linkage_rules_in_order(spark):
    leads = spark.createDataFrame([
        (1, "node/1", "Слон", "Ужгород", "вул. А, 1", 48.62, 22.30, "+380671111111", ["node/9"], {"nszu": "x1"}),
        (2, "node/2", "Лев", "Ужгород", "вул. Шевченка, 5", 48.63, 22.31, None, None, None),
        (3, "node/3", "Тигр", "Київ", None, None, None, None, None, None),
    ], LEAD)
    records = spark.createDataFrame([
        (0, "nszu", "x1", "Інше", "clinic", "Київ", None, None, None, [], None, None, True),  # key, across cities
        (1, "nszu", "x2", "Інше", "clinic", "Ужгород", None, None, None, ["0671111111"], None, None, True),  # phone
        (2, "nszu", "x3", "Лев", "clinic", "Ужгород", "ул. Шевченка 5", None, None, [], None, None, True),  # name and address
        (3, "nszu", "x4", "Тигр", "clinic", "Київ", None, None, None, [], None, None, True),  # unique name
        (4, "nszu", "x5", "Новий", "clinic", "Київ", None, None, None, ["0672222222"], None, None, True),
        (5, "nszu", "x6", "Філія", "clinic", "Київ", None, None, None, ["0672222222"], None, None, True),  # of the batch
        (6, "nszu", "x7", "Ніхто", "clinic", "Київ", None, None, None, [], None, None, False),
    ], RECORD)
    got = {r.pos: (r.outcome, r.lead_id, r.created_by) for r in linkage.link(leads, records).collect()}
    assert got == {0: ("matched", 1, None), 1: ("matched", 1, None), 2: ("matched", 2, None), 3: ("matched", 3, None), 4: ("new", None, 4), 5: ("merged", None, 4), 6: ("skipped", None, None)}


def test_candidates_miss_no_match():
    """The indexed fold against a scan of all leads of a city, with one city that holds nine tenths of them."""
    r = random.Random(7)
    words = ["слон", "лев", "дентал", "арт", "смайл", "плюс", "медік", "к", "ок", "центр здоров"]

    def name():
        base = " ".join(r.choices(words, k=r.randint(1, 3)))
        return base if r.random() < 0.6 else base[: r.randint(1, len(base))] + r.choice("абвгд") + base[r.randint(1, len(base)) :]

    def place(i):
        house = r.choice([None, "1", "2", "3"])
        where = {"lat": r.choice([None, 50.0 + r.random() * 0.01]), "lon": 30.0 + r.random() * 0.01, "house": house, "stems": r.sample(["шевче", "франк", "нова"], r.randint(0, 2))}
        return {"city": "Київ" if r.random() < 0.9 else "Львів", "norm": r.choice([name(), name(), ""]), "phone": None, **where}

    leads = [{"id": i, "osm_id": f"node/{i}", "merged_keys": [], "own_keys": [], "created_by": None, **place(i)} for i in range(400)]
    records = [{"pos": i, "key": f"n/{i}", "raw_key": f"n/{i}", "phones": [], "create_if_missing": r.random() < 0.5, **place(i)} for i in range(300)]
    frames = lambda rows: pd.DataFrame(rows).astype(object).where(lambda d: d.notna(), None)
    got = linkage.fold(frames(leads), frames(records)).astype(object)
    every = linkage.Places.candidates
    try:
        linkage.Places.candidates = lambda self, rec, stems: self.rows
        want = linkage.fold(frames(leads), frames(records)).astype(object)
    finally:
        linkage.Places.candidates = every
    assert got.where(got.notna(), None).values.tolist() == want.where(want.notna(), None).values.tolist()
    assert {"matched", "merged", "new", "skipped"} == set(got["outcome"])


def test_fill_takes_only_what_is_missing(spark):
    leads = spark.createDataFrame(
        [(1, "node/1", "Слон", "Ужгород", None, None, None, "+380671111111", None, None, None, None, True, None, None, None, "osm", None)],
        LEAD + ", website string, email string, email_valid boolean, contact_person string, edrpou string, notes string, source string, automation map<string,array<string>>",
    )
    records = spark.createDataFrame(
        [(0, "nszu", "x1", "Слон", "clinic", "Ужгород", "вул. А, 1", 1.0, 2.0, ["0671111111", "0672222222"], "A@b.ua", "slon.ua", True, "Іван", "1", {"listing": ["likarni"]})],
        RECORD + ", contact_person string, edrpou string, automation map<string,array<string>>",
    )
    links = spark.createDataFrame([(0, "matched", 1, None)], linkage.LINKS)
    r = linkage.fill(leads, records, links).first()
    assert (r.address, r.phone, r.email, r.email_valid, r.website, r.source) == ("вул. А, 1", "+380671111111", "a@b.ua", None, "https://slon.ua", "osm,nszu")
    assert r.notes == "доп.тел(nszu): +380672222222" and r.external_ids == {"nszu": "x1"} and r.automation == {"listing": ["likarni"]}


def test_refused_moves_change_nothing(spark):
    items = spark.createDataFrame([(1, "queued"), (2, "claimed")], "id long, status string")
    items = items.selectExpr("*", *[f"cast(null as string) {c}" for c in ("message", "reply", "error")], *[f"cast(null as timestamp) {c}" for c in ("sent_at", "replied_at")])
    reports = spark.createDataFrame([(1, 1, "sent", "x"), (2, 1, "sent", "hi"), (2, 2, "replied", "yo"), (2, 3, "failed", "no")], "id long, seq int, status string, text string").withColumn("at", F.lit(None).cast("timestamp"))
    got = {r.id: (r.status, r.message, r.reply, r.refused) for r in queue.apply_results(items, reports).collect()}
    assert got == {1: ("queued", None, None, 1), 2: ("replied", "hi", "yo", 1)}


def test_categories():
    assert list(merge.categories(["horeca", "cafe", "vet"])) == ["cafe", "restaurant", "bar", "bakery", "vet"]
    with pytest.raises(ValueError):
        merge.categories(["nope"])


def test_stream_of_reports_equals_the_batch_fold(spark, tmp_path):
    schema = "id long, seq long, status string"
    for n, batch in enumerate([[(1, 1, "sent"), (2, 1, "replied")], [(1, 2, "replied"), (2, 2, "failed"), (2, 3, "sent")]]):
        pd.DataFrame(batch, columns=["id", "seq", "status"]).to_parquet(tmp_path / f"{n}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    q = results.item_states(stream).writeStream.outputMode("update").format("memory").queryName("states").start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("states").groupBy("id").agg(F.max(F.struct(F.expr("accepted + refused"), "status", "refused")).alias("s")).collect()
    assert {r.id: (r.s.status, r.s.refused) for r in last} == {1: ("replied", 0), 2: ("failed", 2)}


def test_capacity_windows_on_a_stream(spark, tmp_path):
    spark.sql("select timestamp '2024-01-01 10:30:00' claimed_at, 'instagram' channel, 'sent' status union all select timestamp '2024-01-01 11:30:00', 'instagram', 'queued'").write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema("claimed_at timestamp, channel string, status string").parquet(str(tmp_path / "c"))
    q = results.claims_by_window(stream).writeStream.outputMode("update").format("memory").queryName("caps").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("caps").count() == 24 and spark.table("caps").agg(F.max("used")).first()[0] == 1


def test_csv_and_json_sinks(spark, tmp_path):
    from terncove.operators import export

    df = spark.createDataFrame([("1", "Слон, \"А\"")], "id string, name string").coalesce(1)
    export.write_csv(df, str(tmp_path / "c"))
    export.write_json(df, str(tmp_path / "j"))
    text = next((tmp_path / "c").glob("part-*")).read_text("utf-8-sig")
    assert text.startswith("id,name") and "Слон" in text
    assert "Слон" in next((tmp_path / "j").glob("part-*")).read_text("utf-8")


def test_registry_csv(spark, tmp_path):
    from terncove.sources import registry

    (tmp_path / "r.csv").write_text("﻿a,b\n1,NULL\n,x\n", encoding="utf-8")
    assert [tuple(r) for r in registry.read_csv(spark, str(tmp_path / "r.csv")).collect()] == [("1", None), (None, "x")]


def test_city_list(spark, tmp_path):
    from terncove.sources import registry

    (tmp_path / "c.json").write_text('{"cities": [{"name": "А", "pop": 1}, {"name": "Б", "pop": 5, "excluded": "x"}]}', encoding="utf-8")
    assert [(r.pos, r.name) for r in registry.read_cities(spark, str(tmp_path / "c.json")).orderBy("pos").collect()] == [(0, "Б"), (1, "А")]


def test_import_as_one_step(spark):
    more = ", website string, email string, email_valid boolean, contact_person string, edrpou string, notes string, source string, automation map<string,array<string>>"
    leads = spark.createDataFrame([(1, "node/1", "Слон", "Ужгород", None, None, None, "+380671111111", None, None, None, None, True, None, None, None, "osm", None)], LEAD + more)
    rows = [
        (0, "nszu", "x1", "Слон", "clinic", "Ужгород", "вул. А, 1", None, None, ["0671111111"], "a@b.ua", None, True, None, None, None),
        (1, "nszu", "x2", "Лев", "clinic", "Ужгород", None, None, None, ["0673333333"], None, None, True, None, None, None),
        (2, "likarni", "x3", "Лев плюс", "clinic", "Ужгород", "вул. Б, 2", None, None, ["0673333333"], "lev@b.ua", None, True, None, None, None),
        (3, "doc", "x4", "Тигр", "clinic", "Ужгород", None, None, None, [], None, None, False, None, None, None),
    ]
    records = spark.createDataFrame(rows, RECORD + ", contact_person string, edrpou string, automation map<string,array<string>>")
    after, counted = linkage.apply_records(leads, records)
    assert after.columns == leads.columns
    got = {r.osm_id: r for r in after.collect()}
    assert len(got) == 2 and got["node/1"].address == "вул. А, 1" and got["node/1"].email == "a@b.ua"
    lion = got["nszu/x2"]
    assert lion.id > 1 and lion.phone == "+380673333333" and lion.address == "вул. Б, 2" and lion.email == "lev@b.ua" and lion.external_ids == {"nszu": "x2", "likarni": "x3"}
    assert {r.outcome: r.n for r in counted.collect()} == {"matched": 1, "new": 1, "merged": 1, "skipped": 1}


def test_mail_verdicts_from_dns(spark):
    from terncove.operators import mail

    answers = [("A.ua", "ok", ["mx.a.ua"], None), ("b.ua", "ok", [], "ok"), ("c.ua", "no_answer", None, "ok"), ("d.ua", "nxdomain", None, "nxdomain"), ("e.ua", "timeout", None, "ok"), ("e.ua", "timeout", None, None)]
    got = mail.verdicts(spark.createDataFrame(answers, "domain string, mx_status string, mx array<string>, a_status string"))
    assert {r.domain: r.ok for r in got.collect()} == {"a.ua": True, "b.ua": False, "c.ua": True, "d.ua": False, "e.ua": False}


def test_crawl_reads_home_then_contact_pages(spark):
    from terncove.sources import pages

    link = lambda *paths: "".join(f'<a href="{p}">{t}</a>' for p, t in paths)
    fetched = [
        ("https://a.ua", None, True, 200, "text/html", "<p>0671234567</p>" + link(("/about", "про нас"), ("/contacts", "контакти"), ("/kontakt2", "контакт"), ("/contact3", "contact"))),
        ("https://a.ua/contacts", None, True, 200, "text/html", "<p>a@a.ua</p>"), ("https://a.ua/kontakt2", None, True, 500, "text/html", None),
        ("https://a.ua/contact3", None, False, 200, "text/html", "<p>0502222222</p>"), ("https://a.ua/about", None, True, 200, "text/html", "<p>0503333333</p>"),
        ("https://b.ua", None, False, 200, "text/html", "x"), ("https://c.ua", None, True, 404, "text/html", None), ("https://d.ua", None, True, 200, "image/png", None), ("https://e.ua", None, True, 200, "text/html", None),
    ]
    df = spark.createDataFrame(fetched, "url string, final_url string, allowed boolean, status int, content_type string, html string")
    sites = spark.createDataFrame([(1, "a.ua"), (2, "b.ua"), (3, "c.ua"), (4, "d.ua"), (5, "e.ua"), (6, "x"), (7, "f.ua")], "id long, url string")
    got = {r.id: r for r in pages.crawl(sites, df).collect()}
    assert {i: r.error for i, r in got.items()} == {1: None, 2: "robots_disallow", 3: "unreachable", 4: "not_html", 5: "crashed", 6: "bad_url", 7: "unreachable"}
    assert got[1].pages_visited == 2 and got[1].phones == ["+380671234567"] and got[1].emails == ["a@a.ua"] and got[2].pages_visited == 0
    assert pages.crawl(sites, df, max_pages=1).where("id = 1").first().emails == []


def test_sheet_sync_pulls_before_it_pushes(spark, tmp_path):
    import json

    from terncove.operators import export

    leads = spark.createDataFrame([(2, "new", "b"), (1, "new", "a")], "id long, status string, name string")
    sheet = spark.createDataFrame([("2", "contacted"), ("x", "lost")], "id string, status string")
    pulled, pushed = export.sync(leads, sheet, ["status"], ["id", "status"])
    assert [tuple(r) for r in pushed.collect()] == [(1, "new"), (2, "contacted")] and pulled.columns == leads.columns
    export.write_json_array(pushed, str(tmp_path / "j"))
    assert json.loads(next((tmp_path / "j").glob("part-*")).read_text()) == [{"id": 1, "status": "new"}, {"id": 2, "status": "contacted"}]


def test_calls_left_of_the_month(spark):
    from terncove.operators import stats

    calls = spark.sql("select 'places' service, timestamp '2024-05-03 00:00:00' called_at, 490 calls union all select 'places', timestamp '2024-05-09 00:00:00', 30 union all select 'places', timestamp '2024-04-09 00:00:00', 30")
    left = lambda at: stats.calls_left(calls, "places", F.lit(at).cast("timestamp")).first().remaining
    assert (left("2024-05-20 00:00:00"), left("2024-04-20 00:00:00"), left("2024-06-20 00:00:00")) == (0, 470, 500)


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    from pyspark import SparkContext

    from terncove.plans import cut

    monkeypatch.setattr(SparkContext, "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(spark.sparkContext, "master", "yarn")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    monkeypatch.setattr(spark.sparkContext, "getConf", dict)  # a session without any setting
    with pytest.raises(ValueError):
        cut.cut(spark.range(1))


def test_discovery_stops_after_three_failures(spark):
    from terncove.plans import catalogue, discover

    t = catalogue.Tables(spark, "/root/testdata/sf0.001")
    leads = t.spark.createDataFrame([], "id long, osm_id string, name string, category string, city string, lat double, lon double, phone string")
    more = {"address": "string", "website": "string", "email": "string", "website_status": "string", "source": "string", "notes": "string", "size_estimate": "string", "email_valid": "boolean", "has_automation": "boolean",
            "socials": "map<string,string>", "raw_tags": "map<string,string>", "automation": "map<string,array<string>>", "merged_ids": "array<string>", "last_verified_at": "timestamp"}
    leads = leads.withColumns({k: F.lit(None).cast(v) for k, v in more.items()})
    runs = spark.createDataFrame([], "id long, kind string, city string, category string, started_at timestamp, finished_at timestamp")
    body = lambda i: '{"elements": [{"type": "node", "id": %d, "lat": 50.%d, "lon": 30.1, "tags": {"name": "Слон%d"}}]}' % (i, i, i)  # noqa: E731, UP031
    raw = [("beauty", "c1", body(1), 1), ("beauty", "c2", "<html>", 2), ("beauty", "c3", body(3), 3), ("beauty", "c4", None, 4), ("beauty", "c5", "<x>", 5), ("beauty", "c6", "", 6), ("beauty", "c7", body(7), 7)]
    found, log = discover.discover(leads, spark.createDataFrame(raw, "category string, city string, body string, seq long"), runs, t.now)
    assert sorted(r.osm_id for r in found.collect()) == ["node/1", "node/3"] and sorted(r.city for r in log.collect()) == ["c1", "c3"]


def test_history_reads_back_whole(spark, tmp_path):
    for n in range(3):
        pd.DataFrame({"business_id": [n], "new_status": [f"s{n}"]}).to_parquet(tmp_path / f"{n}.parquet")
    stream = spark.readStream.schema("business_id long, new_status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    q = results.history(stream, str(tmp_path / "h"), str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.new_status for r in spark.read.parquet(str(tmp_path / "h")).collect()) == ["s0", "s1", "s2"]


def test_chains_of_near_copies_merge_pass_by_pass(spark):
    """Three and more copies of one place: a pass takes disjoint pairs only, so a chain of five needs three."""
    schema = "id long, osm_id string, name string, category string, city string, lat double, lon double, phone string, email string, website string, address string, source string, notes string, email_valid boolean, has_automation boolean, website_status string"
    rows = [(i, f"node/{i}", "Слон", "cafe", "c", 50.0 + i * 1e-5, 30.0, f"+{i}" if i == 3 else None, None, None, None, f"s{i}", None, None, None, None) for i in range(5)]
    leads = spark.createDataFrame(rows, schema).withColumns({"socials": F.lit(None).cast("map<string,string>"), "automation": F.lit(None).cast("map<string,array<string>>"), "merged_ids": F.lit(None).cast("array<string>")})
    for passes, left in ((1, 3), (2, 2), (3, 1)):
        got = dedupe.dedupe(leads, passes=passes).collect()
        assert len(got) == left and sum(1 + len(r.merged_ids or []) for r in got) == 5
    assert got[0].id == 3 and got[0].phone == "+3"
