"""Every operator as a query over the driver's tables, with the same question in DuckDB's SQL.

The driver's tables hold no business leads, so relational queries run on a view ``leads`` derived from customer and nation,
the same text in both engines. Bodies, pages and single values are made from customers: each key is written into forms, and the SQL says what each form must give.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import geo, phones, rules
from ..functions import text as X
from ..functions.harvest import aligned_similarity, harvest
from ..operators import dedupe, export, linkage, mail, merge, pace, profiles, queue, retries, stats
from ..operators import segments as S
from ..operators.paging import Snapshot
from ..operators.versions import VersionedTable, claim_from, upsert_into
from ..sources import listings, pages, poi, registry
from . import discover
from .cut import shared_folder, spread

NOW = "2024-06-01 00:00:00"

LEADS = """
base as (
  select c.c_custkey as k, n.n_name as city, lower(c.c_mktsegment) as category
  from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey),
pts as (
  select k, city, category, 0 as copy from base
  union all
  select k, city, category, 1 as copy from base where k % 10 = 0),
leads as (
  select k * 2 + copy as id, k, copy,
    case when copy = 0 then 'node/' else 'way/' end || cast(k as string) as osm_id,
    'Salon ' || substr(md5(cast(k as string)), 1, 8) || case when copy = 1 then ' dup' else '' end as name,
    category, city,
    cast(50.40 as double) + (k % 97) * cast(0.0002 as double) + copy * cast(0.00005 as double) as lat,
    cast(30.50 as double) + (k % 89) * cast(0.0003 as double) + copy * cast(0.00005 as double) as lon,
    case when k % 3 <> 0 then '+38067' || lpad(cast(k % 500 as string), 7, '0') end as phone,
    case when k % 4 = 0 then 'info@s' || cast(k % 50 as string) || '.example' end as email,
    case when k % 5 in (0, 1) then 'https://s' || cast(k % 700 as string) || '.example' end as website,
    case when k % 5 in (0, 1) then 'has_website' when k % 5 = 2 then 'not_found'
         when k % 15 = 3 then 'site_down' when k % 15 = 8 then 'ddg_failed' end as website_status,
    case k % 4 when 0 then true when 1 then false end as has_automation,
    case when k % 4 in (0, 1) then timestamp '2024-01-01 00:00:00' + (k % 180) * interval '1' day end as last_verified_at,
    case k % 11 when 1 then 'in_progress' when 2 then 'interested' when 3 then 'lost' when 4 then 'won' end as crm_status,
    case when k % 7 = 0 then 'osm,nszu' when k % 7 = 1 then 'osm,website_scrape' else 'osm' end as source,
    case when k % 6 < 2 then k % 6 = 0 end as email_valid,
    case when k % 8 = 0 then 'site [ddg:none]' when k % 8 = 1 then 'seen [ig:none]' end as notes,
    case when k % 9 in (0, 4) then 'h' || cast(k % 300 as string) end as handle,
    case when k % 13 = 0 then 'new' else 'enriched' end as status,
    case when k % 2 = 0 then 'вул. Шевченка, ' || cast(k % 40 as string) end as address,
    case when k % 14 = 0 then timestamp '2024-03-01 00:00:00' end as google_checked_at
  from pts)
"""
#: Outreach items and the like, made from the event stream.
ITEMS = """
items as (
  select event_id as id, user_id * 2 as business_id,
    case when event_id % 10 = 0 then 'telegram' else 'instagram' end as channel,
    'h' || cast(user_id % 300 as string) as handle,
    case event_id % 5 when 0 then 'queued' when 1 then 'claimed' when 2 then 'sent' when 3 then 'failed' else 'skipped' end as status,
    cast(event_id % 3 as int) as attempts,
    case when event_id % 5 <> 0 then ts end as claimed_at
  from {events})
"""
RUNS = """
runs as (
  select o_orderkey as id, 'discover' as kind, 'city' || cast(o_custkey % 20 as string) as city, lower(o_orderpriority) as category,
    o_orderdate as started_at, case when o_orderstatus <> 'P' then o_orderdate + interval '1' day end as finished_at
  from {orders})
"""
VIEWS = {"leads": LEADS, "items": ITEMS, "runs": RUNS}
TABLES = ("customer", "nation", "events", "orders", "supplier", "lineitem", "part", "region", "pages", "documents")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The driver's tables and the views, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            used = [t for t in TABLES if "{" + t + "}" in VIEWS[name]]
            view = self.spark.sql(f"with {VIEWS[name]} select * from {name}", **{t: getattr(self, t) for t in used})
            return with_maps(view) if name == "leads" else view
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        raise AttributeError(name)

    @property
    def now(self):
        return F.lit(NOW).cast("timestamp")


def with_maps(leads: DataFrame) -> DataFrame:
    url = F.concat(F.lit("https://instagram.com/"), F.col("handle"))
    socials = F.when(F.col("handle").isNotNull(), F.create_map(F.lit("instagram"), url))
    auto = F.when(F.col("has_automation"), F.create_map(F.lit("chat"), F.array(F.lit("tawk"), F.lit("tidio")), F.lit("booking"), F.array(F.lit("fresha"))))
    auto = auto.when(~F.col("has_automation"), F.create_map(F.lit("platform"), F.array(F.lit("wix"))))
    return leads.withColumns({"socials": socials, "automation": auto, "crm_updated_at": F.lit(None).cast("timestamp")})


def add(name: str, run: Callable[[Tables], DataFrame], sql: str | None = None, views: str = "leads") -> None:
    QUERIES[name] = lambda spark, sf_dir: run(Tables(spark, sf_dir))
    if sql is not None:
        parts = [VIEWS[v] for v in views.split() if v]
        text = f"with {', '.join(parts)} {sql}" if parts and not sql.lstrip().startswith(",") else (f"with {', '.join(parts)}{sql}" if parts else sql)
        for t in TABLES:
            text = text.replace("{" + t + "}", t)
        ORACLE[name] = text


def quoted(value) -> str:
    return "null" if value is None else str(value).lower() if isinstance(value, bool) else f"'{value.replace(chr(39), chr(39) * 2)}'" if isinstance(value, str) else repr(value)


def literal(value, kind: str, key):
    """A value in which ``{k}`` stands for the row's key, inside strings, lists and maps."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(value, str):
        return F.replace(F.lit(value), F.lit("{k}"), key) if "{k}" in value else F.lit(value)
    if isinstance(value, dict):
        return F.create_map(*[literal(x, "string", key) for kv in value.items() for x in kv]).cast(kind)
    if isinstance(value, list):
        return F.array(*[literal(x, "string", key) for x in value]).cast(kind)
    return F.lit(value).cast(kind)


def formed(t: Tables, schema: str, rows: list[tuple], every: bool = False) -> DataFrame:
    """k of each customer and the columns of ``schema``: one of ``rows``, in turn by k, or ``every`` one of them, with the key written into it."""
    fields = [f.split(" ", 1) for f in re.split(r", (?![^<]*>)", schema)]
    key = F.col("k").cast("string")
    made = F.array(*[F.struct(*[literal(v, kind, key).alias(name) for v, (name, kind) in zip(r, fields, strict=True)]) for r in rows])
    keys = spread(t.customer.select(F.col("c_custkey").alias("k")), "k")  # a key becomes whole pages
    row = F.explode(made) if every else F.get(made, (F.col("k") % len(rows)).cast("int"))
    return keys.select("k", row.alias("r")).select("k", "r.*")


def told(columns: str, rows: list[tuple], forms: int = 0) -> str:
    """SQL of what has to come out: ``rows`` begin with the number of the form that they come from (of ``forms``; 0: all rows for every customer), with the key in
    place of ``{k}``."""
    names = [c.split(" ", 1) for c in columns.split(", ")]
    values = ", ".join("(" + ", ".join(quoted(x) for x in r) + ")" for r in rows)
    shown = ", ".join(f"replace({n}, '{{k}}', c_custkey::varchar) as {n}" if kind == "varchar" else f"cast({n} as {kind}) as {n}" for n, kind in names)
    return f"select c_custkey as k, {shown} from customer join (values {values}) v(form, {', '.join(n for n, _ in names)}) on " + (f"c_custkey % {forms} = form" if forms else "true")


def cases(name: str, schema: str, rows: list[tuple], result, kind: str = "varchar") -> None:
    """rows: inputs and, last, the expected result, for each customer one of them in turn. ``result`` makes the column from those named in ``schema``."""

    def run(t: Tables) -> DataFrame:
        data = formed(t, schema, [r[:-1] for r in rows])
        return data.select("k", result(data).alias("result"))

    add(name, run, told(f"result {kind}", [(i, r[-1]) for i, r in enumerate(rows)], len(rows)), "")


IDS = "select id from leads where "
HOT = "has_automation = false and last_verified_at is not null and (phone is not null or email is not null)"
ids = lambda df: df.select("id")

# --- predicates (P) ---
add("p05_lead_query", lambda t: S.query(t.leads, city="NATION_11", category="machinery", contact=True, valid_email=True).select("id", "name"),
    "select id, name from leads where city = 'NATION_11' and category = 'machinery' and (phone is not null or email is not null) and (email is null or email_valid)")
add("p06_hot_leads", lambda t: ids(t.leads.where(S.hot())), IDS + HOT)
add("p07_no_website", lambda t: ids(t.leads.where(S.no_website())), IDS + "website_status in ('not_found', 'site_down')")
add("p08_website_unknown", lambda t: ids(t.leads.where(S.website_is("unknown"))), IDS + "website_status is null or website_status = 'ddg_failed'")
add("p09_crm_new", lambda t: ids(t.leads.where(S.stage_is("new"))), IDS + "coalesce(crm_status, 'new') = 'new'")
add("p10_text_search", lambda t: ids(t.leads.where(S.text_search(" sALON 1_ "))), IDS + "name ilike '%sALON 1_%' or phone like '%sALON 1_%'")
add("p11_crawl_targets", lambda t: S.crawl_targets(t.leads, t.now, 90, limit=200).select("id"),
    f"select id from leads where website is not null and (last_verified_at is null or last_verified_at < timestamp '{NOW}' - interval 90 day) order by phone is not null, id limit 200")
add("p12_site_search_targets", lambda t: ids(S.site_search_targets(t.leads, True)),
    IDS + "website is null and (website_status is null or website_status <> 'not_found') and (notes is null or notes not like '%ddg:none%') and phone is null")
add("p13_profile_targets", lambda t: S.profile_search_targets(t.leads, 100).select("id"),
    "select id from leads where handle is null and (notes is null or notes not like '%ig:none%') order by phone is null, id limit 100")
add("p14_paid_gate", lambda t: ids(t.leads.where(S.needs_paid_lookup())),
    IDS + "google_checked_at is null and ((last_verified_at is not null and phone is null) or coalesce(has_automation = false and (phone is not null or email is not null), false))")
add("p15_mx_targets", lambda t: S.mx_targets(t.leads, limit=50).select("id"), "select id from leads where email is not null and email_valid is null order by id limit 50")
PLAN = "select distinct city, category from runs union select 'nowhere', 'none'"
add("p16_due_targets", lambda t: stats.due_targets(t.runs.select("city", "category").distinct().union(t.spark.sql("select 'nowhere', 'none'")), t.runs, F.lit("1998-07-01").cast("timestamp")),
    f"select p.city, p.category from ({PLAN}) p left join (select city, category, max(started_at) s from runs where finished_at is not null group by 1, 2) l using (city, category) where l.s is null or timestamp '1998-07-01' - l.s >= interval 21 day", "runs")
CITIES = [(0, "Київ", None, "Киев", [], None), (1, "Харків", "Харківська", "Харьков", [], None), (2, "Дніпро", "Дніпропетровська", "Днепр", ["Дніпропетровськ"], None),
          (3, "Донецьк", "Донецька", "Донецк", [], "occupied"), (4, "Кам'янське", "Дніпропетровська", "Каменское", ["Дніпродзержинськ"], None)]
CITY_SCHEMA = "pos int, name string, region string, ru string, old array<string>, excluded string"
cities = lambda t: t.spark.createDataFrame(CITIES, CITY_SCHEMA)
nations = lambda t: t.nation.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("region"), F.concat(F.lit("град "), "n_name").alias("ru"), F.array(F.concat(F.lit("Old  "), "n_name")).alias("old"), F.when(F.col("n_nationkey") % 5 == 0, "occupied").alias("excluded"))
add("p17_city_selection", lambda t: registry.select_cities(nations(t), top=12).select("name").unionByName(registry.select_cities(nations(t), only=["м. nation_5", "OLD NATION_3"]).select("name")),
    "(select n_name as name from nation where n_nationkey % 5 <> 0 order by n_nationkey limit 12) union all select n_name from nation where n_name in ('NATION_5', 'NATION_3')", "")
cases("p18_email_accepted", "e string", [("a{k}@b.ua", True), ("noreply@b{k}.ua", False), ("poweruser@company{k}.com", True), ("user@company.com", False), ("logo{k}@2x.png", False), ("info{k}@sitewest.com.ua", True)],
      lambda d: X.email_accepted(F.col("e")), "boolean")
add("p21_aggregators", lambda t: t.pages.select("page_id", X.is_aggregator(F.regexp_replace("url", r"example\.(com|net)", "olx.ua")).alias("hit")),
    r"select page_id, host = 'olx.ua' or ends_with(host, '.olx.ua') as hit from (select page_id, regexp_replace(lower(regexp_extract(regexp_replace(url, 'example\.(com|net)', 'olx.ua'), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') as host from pages)", "")
SCORE = "3 * cast(phone is not null as int) + 3 * cast(email is not null as int) + cast(website is not null as int) + cast(handle is not null as int)"
score = lambda: rules.contact_score(F.col("phone"), F.col("email"), F.col("website"), F.col("socials"))
add("p22_contact_score", lambda t: t.leads.select("id", score().cast("int").alias("score"), rules.describe_automation(F.col("automation")).alias("automation")),
    f"select id, cast({SCORE} as int) as score, case when has_automation then 'booking:fresha, chat:tawk/tidio' when not has_automation then 'platform:wix' else '—' end as automation from leads")
TAGS = "tags map<string,string>"
cases("p01_big_chain", TAGS, [({"shop": "supermarket", "name": "{k}"}, True), ({"shop": "convenience", "brand": "Сільпо", "addr": "{k}"}, True), ({"amenity": "clinic", "name": "«Сінево» пункт забору {k}"}, True), ({"shop": "beauty", "name": "Оберіг {k}"}, False), ({"amenity": "clinic", "name": "Ділова клініка {k}"}, False)],
      lambda d: rules.is_big_chain(F.col("tags")), "boolean")
cases("p02_public_facility", TAGS, [({"amenity": "clinic", "name": "КНП ЦПМСД №{k}"}, True), ({"amenity": "hospital", "name": "Лікарня {k}"}, True), ({"amenity": "hospital", "name": "Клініка Здоров'я {k}"}, False), ({"amenity": "clinic", "name": "КНП", "operator:type": "private"}, False), ({"shop": "beauty", "name": "КНП"}, False), ({"amenity": "clinic", "name": "КПІ-Мед {k}"}, False)],
      lambda d: rules.is_public_facility(F.col("tags")), "boolean")
cases("p03_medical_chain", "name string", [("Сінево пункт забору {k}", True), ("csd lab центр {k}", True), ("ділова {k}", False), ("Бажаємо здоров’я {k}", True), (None, False)], lambda d: F.coalesce(rules.is_medical_chain(F.col("name")), F.lit(False)), "boolean")
cases("p04_public_name", "name string", [("Обласна клінічна лікарня {k}", True), ("МІСЬКА ПОЛІКЛІНІКА №{k}", True), ("Дентал Арт {k}", False), (None, False)], lambda d: rules.is_public_name(F.col("name")), "boolean")

# --- orders and pages (O) ---
add("o01_by_name", lambda t: S.query(t.leads, limit=50).select("id", "name"), "select id, name from leads order by name, id limit 50")
add("o02_ranked_list", lambda t: S.ranked_list(t.leads, score().cast("int"), 100).select("id", "contact_score"), f"select id, cast({SCORE} as int) as contact_score from (select * from leads order by name, id limit 100)")
add("o03_page", lambda t: S.page(t.leads, 100, 50).select("id"), "select id from leads order by phone is null, name, id limit 50 offset 100")
add("o03_deep_page", lambda t: Snapshot.take(t.leads.select("id", "name", "phone"), S.page_order(), range_rows=400).page(1200, 80).select("id"), "select id from leads order by phone is null, name, id limit 80 offset 1200")
add("o06_recent_runs", lambda t: ids(stats.recent_runs(t.runs, 20)), "select id from runs order by started_at desc, id desc limit 20", "runs")
PICKS = [(["cafe", "clinic", "bar", "dentist"], "dentist,clinic,cafe,bar"), (["horeca", "cafe", "vet", "lab"], "lab,cafe,restaurant,bar,bakery,vet"), (["hospital", " Dentist ", "vet", "medical"], "dentist,clinic,doctors,lab,rehab,cosmetology,hospital,vet"), ([], "")]
cases("o08_priority", "names array<string>", PICKS, lambda d: F.array_join(merge.prioritized(merge.resolved(F.col("names"))), ","))
add("o10_paid_limit", lambda t: t.customer.select(F.col("c_custkey").alias("k"), S.paid_budget(F.col("c_custkey") % 97, F.col("c_custkey") % 150).alias("n")),
    "select c_custkey as k, least(c_custkey % 97, case when c_custkey % 150 < 4 then 1 else (c_custkey % 150) // 2 end) as n from customer", "")

# --- aggregates (A) ---
add("a01_totals", lambda t: stats.totals(t.leads, t.now),
    f"select count(*) total, count(phone) with_phone, count(email) with_email, count(website) with_site, count(last_verified_at) checked, count(*) filter (has_automation) automated, count(*) filter ({HOT}) hot, count(*) filter (last_verified_at < timestamp '{NOW}' - interval 90 day) stale from leads")
add("a02_by_city", lambda t: stats.by_city(t.leads), "select city, count(*) n from leads group by city")
add("a02_by_category", lambda t: stats.by_category(t.leads), "select category, count(*) n, count(phone) with_phone from leads group by category")
add("a02_by_source", lambda t: stats.by_source(t.leads), "select source, count(*) n from leads group by source")
add("a02_by_site_state", lambda t: stats.by_site_state(t.leads), "select website_status, count(*) n from leads where phone is not null or email is not null group by website_status")
add("a03_source_tags", lambda t: stats.source_tags(t.leads), "select tag, count(*) n from (select unnest(string_split(source, ',')) tag from leads) group by tag")
add("a04_branches", lambda t: stats.branch_counts(t.leads.withColumn("name", F.substring("name", 1, 7)), "city").select("id", "branches"), "select id, count(*) over (partition by substr(name, 1, 7), city) branches from leads")
CARDS = "select l_suppkey % 5 as c, l_orderkey * 10 + l_linenumber as card, l_partkey as p from lineitem"


def _cards(t: Tables) -> DataFrame:
    c = t.lineitem.selectExpr("cast(l_suppkey % 5 as string) city", "l_orderkey * 10 + l_linenumber as card_id", "array(cast(l_partkey as string)) phones", "cast(null as string) email")
    return stats.shared_phones(c).select("card_id", F.size("phones").alias("kept"), "create_if_missing")


add("a06_shared_phones", _cards,
    f"select card as card_id, cast(case when n >= 3 then 0 else 1 end as int) as kept, n < 3 as create_if_missing from (select *, count(*) over (partition by c, p) n from ({CARDS}))", "")
add("a07_funnel", lambda t: stats.funnel(t.leads).select("stage", "n"),
    "select s.stage, coalesce(c.n, 0) n from (values ('new'), ('in_progress'), ('no_answer'), ('interested'), ('demo_done'), ('won'), ('lost')) s(stage) left join (select coalesce(crm_status, 'new') stage, count(*) n from leads group by 1) c using (stage)")
add("a08_dimensions", lambda t: stats.dimensions(t.leads), "select distinct city, category from leads")
add("a09_filtered_total", lambda t: t.leads.where(S.has_contact()).agg(F.count("*").alias("n")), "select count(*) n from leads where phone is not null or email is not null")
AT = "2024-01-15 00:00:00"
add("a10_rolling_capacity", lambda t: stats.used_capacity(t.items, F.lit(AT).cast("timestamp")),
    f"select count(*) used from items where channel = 'instagram' and claimed_at >= timestamp '{AT}' - interval 24 hour and status in ('claimed', 'sent', 'replied', 'failed')", "items")
add("a11_calls_by_month", lambda t: stats.calls_by_month(t.events.select(F.col("event_type").alias("service"), F.col("ts").alias("called_at"), F.lit(1).alias("calls"))),
    "select event_type service, strftime(ts, '%Y-%m') period, cast(count(*) as bigint) calls from events group by 1, 2", "")
add("a12_latest_stamp", lambda t: t.leads.select("id", dedupe.latest("last_verified_at", "google_checked_at").alias("at")), "select id, greatest(last_verified_at, google_checked_at) as at from leads")
add("a14_dry_run", lambda t: stats.by_city(t.leads.where("source = 'osm'")), "select city, count(*) n from leads where source = 'osm' group by city")
add("a15_verdict_tally", lambda t: mail.tally(t.leads), "select count(*) filter (email_valid) good, count(*) filter (not email_valid) bad from leads")
add("w01_last_runs", lambda t: stats.last_runs(t.runs).select("city", "category", "id"),
    "select city, category, id from (select *, row_number() over (partition by kind, city, category order by started_at desc, id desc) n from runs where finished_at is not null) where n = 1", "runs")
add("w05_one_per_handle", lambda t: ids(dedupe.one_per_handle(t.leads, F.col("handle"))), "select min(id) id from leads where handle is not null group by handle")
add("w09_failure_stops", lambda t: stats.failure_stops(t.events.select((F.col("user_id") % 50).alias("run_id"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))),
    "select run_id, min(seq) stops_at from (select run_id, seq, sum(cast(not ok as int)) over (partition by run_id, island order by seq) streak from (select *, sum(cast(ok as int)) over (partition by run_id order by seq) island from (select user_id % 50 run_id, event_id seq, event_type <> 'error' ok from events))) where streak >= 3 group by 1", "")

# --- joins (J) ---
PAIRS = """, p as (select l.id as left_id, r.id as right_id, l.category,
  2 * 6371000 * asin(sqrt(pow(sin(radians(r.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lon - l.lon) / 2), 2))) as d
  from leads l join leads r on l.category = r.category and l.id < r.id and abs(l.lat - r.lat) < 0.001 and abs(l.lon - r.lon) < 0.001) """
add("j01_near_pairs", lambda t: dedupe.near_pairs(t.leads).select("left_id", "right_id", F.round("distance_m", 3).alias("metres")), PAIRS + "select left_id, right_id, round(d, 3) as metres from p where d <= 30")
add("j01_contained_pairs", lambda t: dedupe.near_pairs(t.leads).where(X.plain_similarity(F.col("norm"), F.col("norm2")) >= 0.95).select("left_id", "right_id"),
    PAIRS + ", q as (select p.*, lower(replace(l.name, 'Salon ', '')) a, lower(replace(r.name, 'Salon ', '')) b from p join leads l on l.id = left_id join leads r on r.id = right_id where d <= 30) select left_id, right_id from q where a = b or contains(a, b) or contains(b, a)")
add("j04_upsert_lookup", lambda t: merge.upsert(t.leads.where("copy = 0"), t.leads.select("osm_id", "name", "category", "city", "lat", "lon", "phone", "website")).select("osm_id", "id", "outcome"),
    "select osm_id, case when copy = 0 then id end as id, case when copy = 0 then 'same' else 'new' end as outcome from leads")
OPEN = "(crm_status is null or crm_status not in ('won', 'lost'))"
add("j08_q01_candidates", lambda t: queue.candidates(t.leads, t.items).select("id", "handle"),
    f"select min(id) id, handle from leads where handle is not null and {OPEN} and id not in (select business_id from items where channel = 'instagram') and handle not in (select handle from items where channel = 'instagram') group by handle", "leads items")
add("j10_queue_status", lambda t: queue.with_queue_status(t.leads, t.items).select("id", "item_status"),
    "select l.id, s.status as item_status from leads l left join (select business_id, status from (select *, row_number() over (partition by business_id order by id desc) n from items where channel = 'instagram') where n = 1) s on s.business_id = l.id", "leads items")
add("j11_claimed_context", lambda t: queue.with_context(t.items.where("status = 'claimed'"), t.leads.withColumn("size_estimate", F.lit("small"))).select(F.col("id").alias("item"), "lead.name", "lead.has_website"),
    "select i.id as item, l.name, coalesce(l.website_status = 'has_website', false) as has_website from items i join leads l on l.id = i.business_id where i.status = 'claimed'", "leads items")
add("j12_lead_events", lambda t: queue.lead_events(t.items.withColumn("created_at", F.col("claimed_at")), t.leads).select("business_id", "id", "name"), "select i.business_id, i.id, l.name from items i join leads l on l.id = i.business_id", "leads items")
VERDICTS = "select distinct split_part(email, '@', 2) as domain, length(email) % 2 = 0 as ok from leads where email is not null and k % 50 < 30"


def _verdicts(t: Tables) -> DataFrame:
    return t.leads.where("email is not null and k % 50 < 30").select(X.email_domain(F.col("email")).alias("domain"), (F.length("email") % 2 == 0).alias("ok")).distinct()


add("j13_email_verdicts", lambda t: mail.apply_verdicts(t.leads, _verdicts(t)).select("id", "email_valid"), f", v as ({VERDICTS}) select id, case when email is not null then coalesce(v.ok, false) end as email_valid from leads left join v on v.domain = split_part(email, '@', 2)")
add("j13_domains_to_ask", lambda t: mail.domains_to_ask(t.leads, _verdicts(t)), f", v as ({VERDICTS}) select distinct split_part(email, '@', 2) as domain from leads where email is not null and split_part(email, '@', 2) not in (select domain from v)")
add("j14_sheet_pull", lambda t: merge.apply_sheet(t.leads, t.leads.select(F.when(F.col("k") % 5 == 0, "x").otherwise(F.col("id").cast("string")).alias("id"), F.when(F.col("k") % 2 == 0, "contacted").alias("status")), ["status"]).select("id", "status"),
    "select id, case when k % 5 <> 0 and k % 2 = 0 then 'contacted' else status end as status from leads")


# --- writes (U) and queue (Q) ---
def _found(t: Tables) -> DataFrame:
    shifted = t.leads.where("k % 3 = 0").select("osm_id", "name", "category", "city", "lat", "lon", F.concat(F.lit("+3"), F.col("id").cast("string")).alias("phone"), F.lit("https://new.example").alias("website"))
    fresh = t.leads.where("k % 17 = 0").select(F.concat(F.lit("new/"), "osm_id").alias("osm_id"), "name", "category", "city", "lat", "lon", "phone", F.lit(None).cast("string").alias("website"))
    return shifted.unionByName(fresh)


UPSERTED = """, f as (select osm_id, '+3' || cast(id as string) as phone, 'https://new.example' as website from leads where k % 3 = 0 union all select 'new/' || osm_id, phone, null from leads where k % 17 = 0)
    select {shown}, coalesce(l.phone, f.phone) as phone, coalesce(l.website, f.website) as website,
      case when l.website is null and f.website is not null then 'has_website' else l.website_status end as website_status
    from leads l full join f on l.osm_id = f.osm_id"""
OUTCOME = "case when l.osm_id is null then 'new' when f.osm_id is not null and ((l.phone is null and f.phone is not null) or (l.website is null and f.website is not null)) then 'updated' else 'same' end as outcome"
add("u03_upsert", lambda t: merge.upsert(t.leads, _found(t)).select("osm_id", "phone", "website", "website_status", "outcome"), UPSERTED.format(shown=f"coalesce(l.osm_id, f.osm_id) as osm_id, {OUTCOME}"))


def _mergeable(t: Tables) -> DataFrame:
    return t.leads.withColumn("merged_ids", F.lit(None).cast("array<string>"))


def _dups(t: Tables) -> DataFrame:
    return t.leads.where("copy = 1").select((F.col("k") * 2).alias("keep_id"), F.col("id").alias("drop_id"))


add("u07_merge_pairs", lambda t: dedupe.merge_pairs(_mergeable(t).withColumn("phone", F.when(F.col("copy") == 1, F.coalesce("phone", F.lit("+1")))), _dups(t)).select("id", "phone", "source", F.array_join("merged_ids", ",").alias("merged")),
    "select k * 2 as id, case when k % 10 = 0 then coalesce(phone, '+1') end as phone, array_to_string(list_sort(string_split(source, ',')), ',') as source, case when k % 10 = 0 then 'way/' || cast(k as varchar) end as merged from leads where copy = 0".replace("array_to_string(list_sort(string_split(source, ',')), ',') as source", "case when k % 10 = 0 then array_to_string(list_sort(string_split(source, ',')), ',') else source end as source"))
add("u08_crawl_results", lambda t: merge.apply_crawl(t.leads, t.leads.where("k % 4 = 2").select("id", F.array(F.lit("+380501112233")).alias("phones"), F.array().cast("array<string>").alias("emails"), F.create_map().cast("map<string,string>").alias("socials"), F.create_map().cast("map<string,array<string>>").alias("automation"), F.when(F.col("k") % 8 == 2, "unreachable").alias("error")), t.now).select("id", "phone", "has_automation", "website_status", "last_verified_at"),
    f"select id, case when k % 4 = 2 and k % 8 <> 2 then coalesce(phone, '+380501112233') else phone end as phone, case when k % 4 = 2 then false else has_automation end as has_automation, case when k % 8 = 2 then 'site_down' when k % 4 = 2 then 'has_website' else website_status end as website_status, case when k % 4 = 2 then timestamp '{NOW}' else last_verified_at end as last_verified_at from leads")
add("u09_status_backfill", lambda t: merge.backfill_website_status(t.leads.withColumn("website_status", F.when(F.col("k") % 2 == 1, F.col("website_status")))).select("id", "website_status"),
    "select id, coalesce(case when k % 2 = 1 then website_status end, case when website is not null then 'has_website' when notes like '%[ddg:none]%' then 'not_found' end) as website_status from leads")
add("u10_site_search", lambda t: merge.apply_site_search(t.leads, t.leads.where("k % 5 = 3").select("id", F.when(F.col("k") % 2 == 0, F.lit("https://f.example")).alias("url"), (F.col("k") % 3 == 0).alias("failed"))).select("id", "website", "website_status", "notes"),
    "select id, case when k % 5 = 3 and k % 2 = 0 then 'https://f.example' else website end as website, case when k % 5 <> 3 then website_status when k % 3 = 0 then 'ddg_failed' when k % 2 = 0 then 'has_website' else 'not_found' end as website_status, case when k % 5 = 3 and k % 2 = 1 and k % 3 <> 0 then trim(concat_ws(' ', notes, '[ddg:none]')) else notes end as notes from leads")
add("u11_profile_result", lambda t: merge.apply_profile_search(t.leads, t.leads.where("k % 4 = 1").select("id", F.when(F.col("k") % 8 == 1, F.lit("https://instagram.com/n")).alias("url"))).select("id", F.try_element_at("socials", F.lit("instagram")).alias("instagram"), "source", "notes"),
    "select id, case when k % 8 = 1 then 'https://instagram.com/n' else 'https://instagram.com/' || handle end as instagram, case when k % 8 = 1 then source || ',ddg_instagram' else source end as source, case when k % 8 = 5 then trim(concat_ws(' ', notes, '[ig:none]')) else notes end as notes from leads")
add("u12_paid_result", lambda t: merge.apply_paid_lookup(t.leads, t.leads.where("k % 6 = 0").select("id", F.lit(1).alias("calls"), F.lit("+380440000000").alias("phone"), F.lit("a").alias("address")), t.now).select("id", "phone", "google_checked_at"),
    f"select id, case when k % 6 = 0 then coalesce(phone, '+380440000000') else phone end as phone, case when k % 6 = 0 then timestamp '{NOW}' else google_checked_at end as google_checked_at from leads")
add("u13_enqueue", lambda t: queue.enqueue(t.items, queue.candidates(t.leads, t.items.where("1 = 0")), t.now).select("business_id", "handle"),
    f", c as (select min(id) id, handle from leads where handle is not null and {OPEN} group by handle) select id as business_id, handle from c where id not in (select business_id from items where channel = 'instagram')", "leads items")
add("u14_set_status", lambda t: merge.set_status(t.leads, t.leads.where("k % 10 = 1").select("id", F.lit("rejected").alias("status"), F.lit("no").alias("note"))).select("id", "status", "notes"),
    "select id, case when k % 10 = 1 then 'rejected' else status end as status, case when k % 10 = 1 then concat_ws(chr(10), notes, 'no') else notes end as notes from leads")


def _stage_requests(t: Tables) -> DataFrame:
    return t.items.select(F.col("business_id").alias("id"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "interested").otherwise("won").alias("stage"), F.when(F.col("id") % 3 == 0, F.lit(" hm ")).alias("comment"), t.now.alias("at"))


STAGES = ", r as (select i.business_id as id, i.id as seq, case when i.id % 2 = 0 then 'interested' else 'won' end as stage, i.id % 3 = 0 as said, coalesce(l.crm_status, 'new') as first from items i join leads l on l.id = i.business_id), o as (select *, coalesce(lag(stage) over (partition by id order by seq), first) as old from r) "
add("u15_stage_events", lambda t: queue.change_stages(t.leads, _stage_requests(t))[1].select("business_id", "old_status", "new_status", "comment"),
    STAGES + "select id as business_id, old as old_status, stage as new_status, case when said then 'hm' end as comment from o where old <> stage or said", "leads items")
add("u15_stages", lambda t: queue.change_stages(t.leads, _stage_requests(t))[0].select("id", "crm_status"),
    STAGES + ", n as (select id, arg_max(stage, seq) as stage from o where old <> stage group by id) select l.id, coalesce(n.stage, crm_status) as crm_status from leads l left join n using (id)", "leads items")
add("q02_claimable", lambda t: ids(t.items.where(queue.claimable(F.lit(AT).cast("timestamp")))),
    f"select id from items where channel = 'instagram' and (status = 'queued' or (status = 'claimed' and claimed_at < timestamp '{AT}' - interval 120 minute))", "items")
def _claim_sql(cap: int, limit: int) -> str:
    used = f"channel = 'instagram' and claimed_at >= timestamp '{AT}' - interval 24 hour and status in ('claimed', 'sent', 'replied', 'failed')"
    open_ = f"channel = 'instagram' and (status = 'queued' or (status = 'claimed' and claimed_at < timestamp '{AT}' - interval 120 minute))"
    return f", u as (select greatest(0, {cap} - count(*)) as left_ from items where {used}) select id, cast(attempts + 1 as int) as attempts from (select *, row_number() over (order by id) n from items where {open_}) where n <= least({limit}, (select left_ from u))"


for name, cap, limit in (("q03_claim", 10**9, 150), ("q03_claim_capped", 3400, 15)):
    add(name, lambda t, cap=cap, limit=limit: queue.claim(t.items, limit, F.lit(AT).cast("timestamp"), cap=cap).where("claimed_now").select("id", "attempts"), _claim_sql(cap, limit), "items")


def _table(t: Tables, rows: DataFrame, key: str) -> VersionedTable:
    table = VersionedTable(t.spark, f"{shared_folder(t.spark)}/table-{uuid.uuid4().hex}", key)
    table.create(rows)
    return table


def _claimed_twice(t: Tables, cap: int, limit: int) -> DataFrame:
    """Two claims from one table of items, the second after the first."""
    table, at = _table(t, t.items, "id"), F.lit(AT).cast("timestamp")
    return claim_from(table, limit, at, cap).unionByName(claim_from(table, limit, at, cap))


add("q03_claims_in_turn", lambda t: _claimed_twice(t, 3400, 15).select("id", "attempts"), _claim_sql(3400, 30), "items")


def _upserted(t: Tables) -> DataFrame:
    """The table after its discovered rows came in three parts, with a base of its own leads only."""
    leads = t.leads.select("id", "osm_id", "name", "category", "city", "lat", "lon", "phone", "website", "website_status")
    table, found = _table(t, leads, "osm_id"), _found(t)
    for part in range(3):
        upsert_into(table, found.where(F.pmod(F.crc32("osm_id"), F.lit(3)) == part))
    return table.read()


add("u03_incremental", lambda t: _upserted(t).select("osm_id", "phone", "website", "website_status"), UPSERTED.format(shown="coalesce(l.osm_id, f.osm_id) as osm_id"))


def _reports(t: Tables) -> DataFrame:
    r = t.items.select("id", F.lit(1).alias("seq"), F.when(F.col("id") % 2 == 0, "sent").otherwise("failed").alias("status"), F.lit(" t ").alias("text"), t.now.alias("at"))
    return r.unionByName(r.select("id", F.lit(2).alias("seq"), F.lit("replied").alias("status"), F.lit("ok").alias("text"), "at"))


def _full_items(t: Tables) -> DataFrame:
    return t.items.withColumns({c: F.lit(None).cast("string") for c in ("message", "reply", "error")} | {c: F.lit(None).cast("timestamp") for c in ("sent_at", "replied_at")})


FOLD = ", s as (select *, case when status = 'claimed' then case when id % 2 = 0 then 'replied' else 'failed' end when status = 'sent' then 'replied' else status end as last from items) "
add("q04_results", lambda t: queue.apply_results(_full_items(t), _reports(t)).select("id", "status", "message", "reply", "error"),
    FOLD + "select id, last as status, case when status = 'claimed' and id % 2 = 0 then 't' end as message, case when last = 'replied' then 'ok' end as reply, case when status = 'claimed' and id % 2 = 1 then 't' end as error from s", "items")
add("q04_result_events", lambda t: queue.result_events(t.items, _reports(t).where("seq = 1"), t.leads).select("business_id", "old_status", "new_status", "comment"),
    "select l.id as business_id, coalesce(crm_status, 'new') as old_status, case when i.id % 2 = 0 and coalesce(crm_status, 'new') = 'new' then 'in_progress' else coalesce(crm_status, 'new') end as new_status, 'Instagram @' || i.handle || ': ' || case when i.id % 2 = 0 then 'надіслано' else 'не вдалося' end || chr(10) || 't' as comment from items i join leads l on l.id = i.business_id where i.status = 'claimed'", "leads items")
add("q07_pending", lambda t: stats.pending(t.runs.select("city", "category").distinct().union(t.spark.sql("select 'nowhere', 'none'")), t.runs),
    "select distinct city, category from runs union select 'nowhere', 'none' except select city, category from runs where finished_at is not null", "runs")

# --- functions (F) on forms filled with the keys of customers ---
one = lambda f: f(F.col("x"))
PHONE_CODES = [*(code for code, _, _ in phones.PLANS.values()), "995"]  # the last has no plan of its own
PHONE_PLAN = "plan(code, begins, n) as (values " + ", ".join(f"('{c}', '{b}', {n})" for c, b, n in phones.rows()) + ")"
NUMBERS = f"""
numbers as (
  select k, form, code, national, case form when 0 then '+' || code || ' ' || national when 1 then '00' || code || '-' || national
      else case when code = '380' and substr(national, 1, 1) <> '0' then '0' || national else '+' || code || ' (' || substr(national, 1, 2) || ') ' || substr(national, 3) end end as raw
  from (select c_custkey as k, cast(floor(c_custkey / 60) as bigint) % 3 as form, case c_custkey % {len(PHONE_CODES)} {" ".join(f"when {i} then '{c}'" for i, c in enumerate(PHONE_CODES))} end as code,
      lpad(cast((c_custkey * 7368787) % cast(pow(10, 8 + cast(floor(c_custkey / 15) as bigint) % 4) as bigint) as string), cast(8 + cast(floor(c_custkey / 15) as bigint) % 4 as int), '0') as national
    from {{customer}}))
"""
PHONE_SQL = f"""{NUMBERS}, {PHONE_PLAN},
longest as (
  select k, max(length(begins)) as b from numbers join plan on numbers.code = plan.code and starts_with(national, begins) group by k),
valid as (
  select distinct k from numbers join plan on numbers.code = plan.code and starts_with(national, begins) and n = length(national) join longest using (k) where length(begins) = b
  union select k from numbers where code = '995'),
told as (
  select k, raw, case when valid.k is not null then '+' || code || national end as e164 from numbers left join valid using (k))
"""
sized = lambda t: t.spark.sql(f"with {NUMBERS} select * from numbers", customer=spread(t.customer.select("c_custkey"), "c_custkey"))
add("f01_phone", lambda t: sized(t).select("k", X.normalize_phone(F.col("raw")).alias("phone")),
    f"with {PHONE_SQL} select k, coalesce(e164, case when length(regexp_replace(raw, '[^0-9]', '', 'g')) >= 9 then raw end) as phone from told", "")
add("f02_find_phones", lambda t: sized(t).select("k", F.array_join(X.find_phones(F.concat(F.lit("tel. "), "raw", F.lit(", order 1234567890123456, fax "), "raw", F.lit(" or +380 44 123-45-67;"))), ",").alias("phones")),
    f"with {PHONE_SQL} select k, concat_ws(',', e164, '+380441234567') as phones from told where e164 is distinct from '+380441234567'", "")
cases("f03_tel_links", "x string", [('<a href="tel:+38067123{k}">', "+38067123{k}"), ("<a href='tel:%2B38050'> tel:{k}", "+38050,{k}")], lambda d: F.array_join(X.tel_links(F.col("x")), ","))
cases("f04_emails", "x string", [('<a href="mailto:Me{k}@B.UA?x">a@c.com noreply@c.com me{k}@b.ua', "me{k}@b.ua,a@c.com"), ("a1@x.ua a2@x.ua a3@x.ua a4@x.ua a5@x.ua a6@x.ua", "a1@x.ua,a2@x.ua,a3@x.ua,a4@x.ua,a5@x.ua")], lambda d: F.array_join(X.find_emails(F.col("x")), ","))
cases("f05_instagram", "x string", [("https://www.instagram.com/Salon.Kyiv/?hl=uk", "https://instagram.com/salon.kyiv"), ("@salon{k}", "https://instagram.com/salon{k}"), ("salon_{k}", "https://instagram.com/salon_{k}"), ("https://instagram.com/p/abc", None), ("https://facebook.com/x", None), ("a b", None)], lambda d: one(X.normalize_instagram))
PAGE = '<body><a href="https://www.instagram.com/Me{k}/">i</a><a href="/contacts/{k}">Контакти</a><a href="/about">Про нас</a><p>made by <a href="https://t.me/dev">dev</a></p><a href="https://t.me/me?x=1">t</a><script>x</script> hi {k}</body>'
H = lambda: harvest("x", F.lit("https://s.ua/"))
cases("f06_socials", "x string", [(PAGE, "instagram=https://instagram.com/me{k},telegram=https://t.me/me")], lambda d: F.array_join(F.transform(F.array_sort(F.map_entries(H()["socials"])), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))
cases("f08_contact_pages", "x string", [(PAGE, "https://s.ua/contacts/{k},https://s.ua/about")], lambda d: F.array_join(H()["contact_pages"], ","))
cases("f09_visible_text", "x string", [(PAGE, "i Контакти Про нас made by dev t hi {k}")], lambda d: H()["visible_text"])
cases("f11_json_ld", "x string", [('<script type="application/ld+json">{"@graph":[{"telephone":["0671234567"],"email":"A{k}@b.ua"}]}</script><script type="application/ld+json">{bad</script>', "0671234567|a{k}@b.ua")], lambda d: F.concat_ws("|", F.array_join(H()["ld_phones"], ","), F.array_join(H()["ld_emails"], ",")))
cases("f12_url", "x string", [("example{k}.com", "https://example{k}.com"), (" http://a.ua;b.ua ", "http://a.ua"), ("www.x{k}.ua y", "https://www.x{k}.ua"), ("localhost", None), ("", None)], lambda d: one(X.normalize_url))
AUTO = ['<script src="https://widget.tawk.to/{k}"></script> https://n12.yclients.com', "Записатися ОНЛАЙН {k}", "nothing {k}", "calendly.com dikidi.net"]
cases("f14_signals", "x string", list(zip(AUTO, ["booking:yclients, chat:tawk", "booking_hint:custom_or_manual", "—", "booking:dikidi/calendly"], strict=True)), lambda d: rules.describe_automation(rules.detect_automation(F.col("x"))))
cases("f15_is_automated", "x string", list(zip(AUTO, [True, False, False, True], strict=True)), lambda d: rules.is_automated(rules.detect_automation(F.col("x"))), "boolean")
cases("f17_normalize_name", "x string", [("Тату-студія «Слон-{k}»", "слон {k}"), ("Салон краси", "салон краси"), ("Ёлка BAR & Co", "елка co"), ("", "")], lambda d: one(X.normalize_name))
cases("f18_similarity", "a string, b string", [("слон {k}", "слон {k}", 1.0), ("слон {k}", "слон {k} на подолі", 0.95), ("", "x", 0.0), ("tide", "diet", 0.25), ("diet", "tide", 0.5)],
      lambda d: F.coalesce(X.plain_similarity(F.col("a"), F.col("b")), aligned_similarity("a", "b")), "double")
add("f19_distance", lambda t: t.leads.select("id", F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(50.45), F.lit(30.52)), 3).alias("metres")),
    "select id, round(2 * 6371000 * asin(sqrt(pow(sin(radians(50.45 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(50.45)) * pow(sin(radians(30.52 - lon) / 2), 2))), 3) as metres from leads")
cases("f20_cell", "x double", [(1.7, 3), (-1.7, -3), (0.0, 0)], lambda d: geo.cell(F.col("x"), 0.5), "bigint")
cases("f21_city", "x string", [("ІВАНО-ФРАНКІВСЬК", "івано-франківськ"), ("м. Івано-Франківськ", "івано-франківськ"), ("Кам’янське", "кам'янське"), ("місто  Орёл", "орел"), (None, "")], lambda d: one(X.normalize_city))
cases("f22_aliases", "a string, b string", [("Дніпро {k}", "Дніпро  {k}", "дніпро {k}"), ("Київ {k}", "м. Киев {k}", "київ {k},киев {k}")], lambda d: F.array_join(X.city_aliases(F.col("a"), F.col("b")), ","))
cases("f24_same_address", "a string, b string", [("вул. Велика Васильківська, {k}", "ул. Большая Васильковская {k}", True), ("вул. Шевченка, 1{k}", "вул. Шевченка, 2{k}", False), ("вул. Шевченка, 1", None, False)], lambda d: X.same_address(F.col("a"), F.col("b")), "boolean")
cases("f25_listing_name", "a string, c string", [("Медікавер {k} (Medicover), медичний центр в Ужгороді", "Ужгород", "Медікавер {k} (Medicover)"), ("Клініка Смайл {k} в Ужгороді", "Ужгород", "Клініка Смайл {k}"), ("Ужгород", "Ужгород", "Ужгород")], lambda d: X.clean_listing_name(F.col("a"), F.col("c")))
cases("f26_record_key", "x string", [("a{k}", "nszu/a{k}"), ("x" * 41, "nszu/9dc0da3613af850c")], lambda d: X.record_key(F.lit("nszu"), F.col("x")))
cases("f28_legal_name", "x string", [('ТОВАРИСТВО З ОБМЕЖЕНОЮ ВІДПОВІДАЛЬНІСТЮ "МЕДІКС {k}"', "ТОВ «МЕДІКС {k}»"), ("Фізична особа-підприємець Іваненко {k} І.І.", "ФОП Іваненко {k} І.І."), ('КЛІНІКА "А{k}"', "КЛІНІКА А{k}")], lambda d: one(X.short_legal_name))
cases("f29_street", "x string", [("ХМЕЛЬНИЦЬКА область, місто ІЗЯСЛАВ, вулиця Шевченка, {k}", "вулиця Шевченка, {k}"), ("Україна, 29000", None)], lambda d: one(X.street_address))
add("f30_float", lambda t: t.customer.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, F.concat("c_custkey", F.lit("x"))).otherwise(F.concat("c_custkey", F.lit(".25"))).try_cast("double").alias("result")),
    "select c_custkey as k, case when c_custkey % 3 <> 0 then c_custkey + 0.25::double end as result from customer", "")
cases("f31_category", "x string", [("Стоматологія {k}", "dentist"), ("Лабораторія аналізів {k}", "lab"), ("Центр Здоров'я {k}", "clinic")], lambda d: X.guess_category(F.col("x"), F.lit("MedicalClinic")))
cases("f32_translit", "x string", [("Посмішка {k}", "posmishka {k}"), ("Щука-{k}", "shchuka-{k}"), ("об’єкт", "obiekt")], lambda d: one(X.transliterate))
cases("f33_profile_similarity", "a string, b string", [("дент", "dentalpro", 0.0), ("abc", "abcdef", 0.6666666666666666), ("abcd{k}", "abcd{k}ef", 0.95)], lambda d: profiles.profile_similarity_udf("a", "b"), "double")
cases("f35_search_name", "x string", [("SILVERDENT {k} – стоматологічний центр", "SILVERDENT {k}"), ("«Арт{k}», студія", "Арт{k}"), ("(x", "(x")], lambda d: one(X.search_name))
cases("f35_unwrap", "x string", [("//duckduckgo.com/l/?uddg=https%3A%2F%2Fa{k}.ua%2F&rut=1", "https://a{k}.ua/"), ("https://b{k}.ua", "https://b{k}.ua"), ("javascript:x", None)], lambda d: one(X.unwrap_result))
cases("f36_domain", "x string", [("a@B{k}.ua", "b{k}.ua"), ("nobody", None)], lambda d: one(X.email_domain))
add("f37_area", lambda t: t.customer.select(F.col("c_custkey").alias("k"), geo.area_id(F.element_at(F.array(F.lit("relation"), F.lit("way"), F.lit("node")), (F.col("c_custkey") % 3 + 1).cast("int")), F.col("c_custkey")).alias("result")),
    "select c_custkey as k, case c_custkey % 3 when 0 then 3600000000 + c_custkey when 1 then 2400000000 + c_custkey end as result from customer", "")
cases("f38_present", "x string", [("yes {k}", True), (" No ", False), ("", False), (None, False)], lambda d: one(X.has_value), "boolean")
cases("f39_number", "x string", [("approx 120 seats", 120), ("50", 50), ("no. 7, {k}", 7), ("none", None)], lambda d: one(X.first_number), "bigint")
cases("f40_size", "tags map<string,string>, c string, b int", [
    ({}, "hairdresser", 1, "micro:0"), ({"brand": "X", "website": "a", "email": "b"}, "cafe", 4, "medium:6"), ({"capacity": "20 seats"}, "cafe", 1, "small:2"), ({"internet_access": "no", "opening_hours": "24/7"}, "clinic", 2, "medium:5"), ({"brand": "no"}, "unknown", 1, "micro:1"),
], lambda d: F.concat_ws(":", rules.estimate_size(F.col("tags"), F.col("c"), F.col("b"))["size"], rules.estimate_size(F.col("tags"), F.col("c"), F.col("b"))["score"].cast("string")))
cases("f41_label", "x string", [(None, "Новий"), ("won", "Закрито (угода)")], lambda d: F.create_map(*[F.lit(v) for kv in stats.C.CRM_LABELS.items() for v in kv])[F.coalesce("x", F.lit("new"))])

# --- functions over whole tables, each with an SQL of its own ---
STOP_SQL = "[" + ", ".join(quoted(w) for w in C.NAME_STOP_WORDS) + "]"
add("f17_document_names", lambda t: t.documents.select("doc_id", X.normalize_name(F.substring("text", 1, 200)).alias("name")),
    rf"""select doc_id, array_to_string(case when len(told) > 0 then told else words end, ' ') as name from (
      select doc_id, words, list_filter(words, lambda w: not list_contains({STOP_SQL}, w)) as told from (
        select doc_id, list_filter(string_split_regex(regexp_replace(replace(lower(substr(text, 1, 200)), 'ё', 'е'), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '') as words from documents))""", "")
add("f39_document_numbers", lambda t: t.documents.select("doc_id", X.first_number(F.col("text")).alias("n")), r"select doc_id, try_cast(regexp_extract(text, '(\d+)', 1) as bigint) as n from documents", "")
add("f04_page_emails", lambda t: t.pages.select("page_id", F.array_join(X.find_emails(F.col("html")), ",").alias("emails")),
    f"""select page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:5], ',') as emails from (
      select page_id, list_filter(list_transform(regexp_extract_all(html, {quoted(C.EMAIL)}), lambda m: lower(m)), lambda m: not regexp_matches(m, {quoted("(?i)" + C.EMAIL_BLOCKED)})) as l from pages)""", "")
add("f12_page_urls", lambda t: t.pages.select("page_id", X.normalize_url(F.concat(F.lit(" //"), F.regexp_replace("url", "^https?://", ""), F.lit(";http://b.ua"))).alias("url")),
    r"select page_id, 'https://' || regexp_replace(url, '^https?://', '') as url from pages", "")
add("f20_lead_cells", lambda t: t.leads.select("id", geo.cell(F.col("lat") - 50.41, 0.003).alias("cy")), "select id, cast(trunc((lat - 50.41) / 0.003) as bigint) as cy from leads")
add("f05_lead_handles", lambda t: t.leads.select("id", X.normalize_instagram(F.when(F.col("k") % 2 == 0, F.concat(F.lit("@"), F.upper("handle"))).otherwise(F.concat(F.lit("https://www.instagram.com/"), F.upper("handle"), F.lit("/?hl=uk")))).alias("profile")),
    "select id, 'https://instagram.com/' || handle as profile from leads")
add("f26_lead_keys", lambda t: t.leads.select("id", X.record_key(F.lit("nszu"), F.when(F.col("k") % 2 == 0, F.repeat("osm_id", 8)).otherwise(F.col("osm_id"))).alias("key")),
    "select id, 'nszu/' || case when k % 2 = 1 then osm_id when length(osm_id) * 8 <= 40 then repeat(osm_id, 8) else substr(sha1(repeat(osm_id, 8)), 1, 16) end as key from leads")
add("f21_nation_names", lambda t: t.nation.select("n_nationkey", X.normalize_city(F.concat(F.lit(" м.  "), "n_name", F.lit("  ё ’Y"))).alias("city")), "select n_nationkey, lower(n_name) || ' е ''y' as city from nation", "")
SIZE_TAGS = {"brand": "k % 3 = 0", "website": "k % 2 = 0", "contact:email": "k % 4 = 0", "capacity": "k % 5 = 0", "opening_hours": "k % 7 = 0"}


def _sized(t: Tables) -> DataFrame:
    values = {"brand": F.lit("X"), "website": F.lit("a"), "contact:email": F.lit("b"), "capacity": F.concat(F.lit("approx "), (F.col("k") % 90).cast("string")), "opening_hours": F.lit("Mo 24/7")}
    tags = F.map_filter(F.create_map(*[x for k, c in SIZE_TAGS.items() for x in (F.lit(k), F.when(F.expr(c), values[k]))]), lambda _, v: v.isNotNull())
    kind = F.element_at(F.array(*[F.lit(c) for c in ("hotel", "dentist", "cafe", "nails", "unknown")]), (F.col("k") % 5 + 1).cast("int"))
    return t.leads.select("id", rules.estimate_size(tags, kind, (F.col("k") % 6).cast("int")).alias("s")).select("id", "s.size", "s.score")


add("f40_lead_sizes", _sized,
    """select id, case when score >= 5 then 'medium' when score >= 2 then 'small' else 'micro' end as size, cast(score as int) as score from (
      select id, case k % 5 when 0 then 3 when 1 then 2 when 2 then 1 when 3 then 0 else 1 end + case when k % 6 >= 4 then 2 when k % 6 > 1 then 1 else 0 end + case when k % 3 = 0 then 2 else 0 end
        + case when k % 2 = 0 and k % 4 = 0 then 1 else 0 end + case when k % 5 <> 0 then 0 when k % 90 >= 50 then 2 when k % 90 >= 15 then 1 else 0 end + case when k % 7 = 0 then 1 else 0 end as score from leads)""")

# --- sources (S) on bodies made from the keys of customers ---
BODY = json.dumps({"elements": [
    {"type": "node", "id": 76543211, "lat": 50.1, "lon": 30.1, "tags": {"name": " Слон {k} ", "phone": "0671234567", "addr:street": "Хрещатик", "addr:housenumber": "{k}", "contact:instagram": "@slon{k}"}},
    {"type": "way", "id": 76543212, "center": {"lat": 50.2, "lon": 30.2}, "tags": {"brand": "Лев {k}", "contact:phone": "", "phone": " {k} "}}, {"type": "node", "id": 76543213, "tags": {"shop": "x"}},
    {"type": "node", "id": 76543214, "tags": {"name": "Ашан", "shop": "supermarket"}}]}).replace("7654321", "1{k}")
LANDED = [("beauty", "Київ {k}", BODY), ("beauty", "Львів {k}", '{"elements": []}'), ("beauty", "Одеса {k}", '{"elements": [], "remark": "runtime error: timed out"}'), ("beauty", "Рівне {k}", "<html>{k}")]
raw = lambda t, forms=4: formed(t, "category string, city string, body string", LANDED[:forms])
ASKED = "city string, osm_type string, south double, north double, west double, east double, pos int, spec string"
asked = lambda t: formed(t, ASKED, [("Київ {k}", "relation", None, None, None, None, 0, "shop=beauty][beauty=nails"), ("Київ {k}", "relation", None, None, None, None, 1, "craft{k}=*")], every=True).withColumn("osm_id", F.col("k"))
add("s02_query_text", lambda t: poi.build_query(asked(t)),
    "select 'Київ ' || c_custkey as city, '[out:json][timeout:180];' || chr(10) || 'area(' || (3600000000 + c_custkey) || ')->.searchArea;' || chr(10) || '(' || chr(10) || '  nwr[\"shop\"=\"beauty\"][\"beauty\"=\"nails\"](area.searchArea);' || chr(10) || '  nwr[\"craft' || c_custkey || '\"](area.searchArea);' || chr(10) || ');' || chr(10) || 'out center tags;' as query from customer", "")
cases("s03_tag_filter", "x string", [("shop=beauty][beauty=nails{k}", '["shop"="beauty"]["beauty"="nails{k}"]'), ("craft{k}=*", '["craft{k}"]'), ("k~a|b", '["k"~"a|b"]')], lambda d: one(X.tag_filter))
add("s04_response_status", lambda t: raw(t).select("k", "city", poi.response_status(F.col("body")).alias("status")), told("city varchar, status varchar", [(0, "Київ {k}", "ok"), (1, "Львів {k}", "empty"), (2, "Одеса {k}", "failed"), (3, "Рівне {k}", "failed")], 4), "")
add("s05_poi_rows", lambda t: poi.parse_responses(raw(t)).select("osm_id", "name", "address", "lat", "phone", F.try_element_at("socials", F.lit("instagram")).alias("instagram"), "reject"),
    "select osm_id, name, address, lat, phone, instagram, reject from (" + told("osm_id varchar, name varchar, address varchar, lat double, phone varchar, instagram varchar, reject varchar", [(0, "node/1{k}1", "Слон {k}", "Хрещатик {k}", 50.1, "0671234567", "https://instagram.com/slon{k}", None),
        (0, "way/1{k}2", "Лев {k}", None, 50.2, "{k}", None, None), (0, "node/1{k}3", None, None, None, None, None, "nameless"), (0, "node/1{k}4", "Ашан", None, None, None, None, "chain")], 4) + ")", "")
GEO = json.dumps([{"osm_type": "node", "osm_id": 1, "lat": "1", "lon": "1", "boundingbox": ["1", "2", "3", "4"]}, {"osm_type": "relation", "osm_id": 987654321, "lat": "50.4", "lon": "30.5", "boundingbox": ["50.2", "50.6", "30.2", "30.8"], "display_name": "Київ"}]).replace("987654321", "{k}")
add("s08_geocode", lambda t: poi.geocode(formed(t, "city string, body string", [("м. Київ {k}", GEO), ("Луцьк {k}", "[]")])).select("key", "osm_id", "lat", "south", "east"), "select 'київ ' || c_custkey as key, c_custkey as osm_id, 50.4::double as lat, 50.2::double as south, 30.8::double as east from customer where c_custkey % 2 = 0", "")
add("s09_area_cache", lambda t: poi.cached_areas(formed(t, "city string", [("КИЇВ  {k}",), ("м. Рівне {k}",)]), t.customer.where("c_custkey % 4 <> 0").select(F.concat(F.lit("київ "), "c_custkey").alias("key"), F.col("c_custkey").alias("osm_id")))[1].select("key"),
    "select case when c_custkey % 2 = 0 then 'київ ' else 'рівне ' end || c_custkey as key from customer where c_custkey % 4 = 0 or c_custkey % 2 = 1", "")
LEGAL = "legal_entity_id legal_entity_edrpou legal_entity_name care_type property_type legal_entity_email legal_entity_website legal_entity_phone legal_entity_owner_name registration_area registration_settlement registration_address lat lng".split()
DIV = "legal_entity_id division_id division_name division_type division_phone division_email residence_area residence_settlement residence_addresses lat lng".split()


def _registry(t: Tables) -> tuple[DataFrame, DataFrame]:
    def legal(i, name="ТОВ Медікс", care="Первинна", kind="Приватна (без ФОП)", city="КИЇВ"):
        return (i, "123", name, care, kind, None, None, "0671234567, 0501112233", "Іван", "М.КИЇВ", city, "вул. А, 1", "50.4", "x")

    def div(i, d, kind=None, city="КИЇВ", area="М.КИЇВ"):
        return (i, d, "n", kind, "0441112233", None, area, city, "місто КИЇВ, вул. Б, 2", "50.5", "30.5")

    rows = [legal("a"), legal("b", name="КНП Лікарня"), legal("c", kind="ФОП"), legal("d", care="Екстрена"), legal("e"), legal("f"), legal("g", city="Жовква")]
    divs = [div("a", "a1"), div("a", "a2", city="ХАРКІВ", area="ОДЕСЬКА"), div("e", "e1", kind="ФАП"), *[div("f", f"f{n}") for n in range(10)]]
    schema = lambda names: ", ".join(f"{n} string" for n in names)
    own = lambda rows, parts: [tuple(f"{{k}}{v}" if at < parts else v for at, v in enumerate(r)) for r in rows]
    return formed(t, schema(LEGAL), own(rows, 1), every=True).drop("k"), formed(t, schema(DIV), own(divs, 2), every=True).drop("k")


#: Entities from customers, each with as many divisions as its key leaves by 13; the SQL has only keys and the rules.
NATIONAL = "select c_custkey as k, cast(c_custkey as varchar) as e, case when c_custkey % 5 = 0 then 'public' when c_custkey % 7 = 0 then 'emergency' when c_custkey % 13 >= 10 then 'chain' end as reject, c_custkey % 13 as n from customer"
TOWNS = [("М. КИЇВ", "М.КИЇВ"), ("Днепр", "ДНІПРОПЕТРОВСЬКА"), ("Дніпродзержинськ", "ДНІПРОПЕТРОВСЬКА"), ("Кам’янське", "ОДЕСЬКА"), ("Жовква", "ЛЬВІВСЬКА"), ("донецьк", "ДОНЕЦЬКА")]


def _national(t: Tables) -> tuple[DataFrame, DataFrame]:
    null = F.lit(None).cast("string")
    k = F.col("c_custkey")
    given = {
        "legal_entity_id": k.cast("string"), "legal_entity_name": F.when(k % 5 == 0, "КНП Лікарня").otherwise("ТОВ Медікс"), "care_type": F.when(k % 7 == 0, "Екстрена").otherwise("Первинна"),
        "property_type": F.lit("Приватна (без ФОП)"), "registration_settlement": _town(k, 0), "registration_area": _town(k, 1),
    }
    legal = t.customer.select(*[given.get(c, null).alias(c) for c in LEGAL])
    nth = t.customer.where(k % 13 > 0).withColumn("d", F.explode(F.sequence(F.lit(1), (k % 13).cast("int"))))
    parts = {"legal_entity_id": k.cast("string"), "division_id": F.concat_ws("-", k, "d"), "residence_settlement": _town(k + F.col("d"), 0), "residence_area": _town(k + F.col("d"), 1)}
    return legal, nth.select(*[parts.get(c, null).alias(c) for c in DIV])


def _town(k, part: int):
    return F.element_at(F.array(*[F.lit(t[part]) for t in TOWNS]), (k % len(TOWNS) + 1).cast("int"))


TOWN = f"(case (k + d) % 6 when 0 then 'Київ' when 1 then 'Дніпро' when 2 then 'Кам''янське' when 3 then 'Кам’янське' when 4 then 'Жовква' else 'Донецьк' end)"
add("a05_chains", lambda t: registry.entities(*_national(t)).select("legal_entity_id", F.coalesce("n_divisions", F.lit(0)).alias("n"), "reject"), f"select e as legal_entity_id, n, reject from ({NATIONAL})", "")
add("j05_division_entity", lambda t: registry.places(*_national(t)).where("ext_id <> legal_entity_id").select("ext_id", "legal_entity_id"),
    f"select e || '-' || d as ext_id, e as legal_entity_id from (select *, unnest(range(1, n + 1)) as d from ({NATIONAL}) where reject is null)", "")
add("j06_entities_alone", lambda t: registry.places(*_national(t)).where("ext_id = legal_entity_id").select("ext_id"), f"select e as ext_id from ({NATIONAL}) where reject is null and n = 0", "")
add("j07_city_lookup", lambda t: registry.records(*_national(t), cities(t)).select("ext_id", "city", "reject"),
    f"select case when n = 0 then e else e || '-' || d end as ext_id, {TOWN} as city, case when (k + d) % 6 >= 3 then 'other_city' end as reject from (select *, unnest(case when n = 0 then [0] else range(1, n + 1) end) as d from ({NATIONAL}) where reject is null)", "")
add("p19_entity_rejects", lambda t: registry.entities(*_registry(t)).select("legal_entity_id", "reject"),
    "select legal_entity_id, reject from (" + told("legal_entity_id varchar, reject varchar", [(0, "{k}a", None), (0, "{k}b", "public"), (0, "{k}c", None), (0, "{k}d", "emergency"), (0, "{k}e", None), (0, "{k}f", "chain"), (0, "{k}g", None)]) + ")", "")
cases("p20_same_region", "a string, r string", [("ХАРКІВСЬКА {k}", "Харківська", True), ("ОДЕСЬКА", "Харківська", False), ("М.КИЇВ", None, True)], lambda d: X.same_region(F.col("a"), F.col("r")), "boolean")
add("s13_s14_u01_registry", lambda t: registry.records(*_registry(t), cities(t)).select("ext_id", "city", "category", F.array_join("phones", ",").alias("phones"), "address", "lat", "lon", "edrpou", "reject"),
    "select ext_id, city, category, phones, address, lat, lon, edrpou, reject from (" + told("ext_id varchar, city varchar, category varchar, phones varchar, address varchar, lat double, lon double, edrpou varchar, reject varchar", [
        (0, "{k}a1", "Київ", "doctors", "0441112233,0671234567,0501112233", "вул. Б, 2", 50.5, 30.5, "123", None), (0, "{k}a2", "Харків", "doctors", "0441112233,0671234567,0501112233", "вул. Б, 2", 50.5, 30.5, "123", "other_city"),
        (0, "{k}e1", "Київ", "doctors", "0441112233,0671234567,0501112233", "вул. Б, 2", 50.5, 30.5, "123", "field_station"), (0, "{k}c", "Київ", "doctors", "0671234567,0501112233", "вул. А, 1", 50.4, None, None, None),
        (0, "{k}g", "Жовква", "doctors", "0671234567,0501112233", "вул. А, 1", 50.4, None, "123", "other_city")]) + ")", "")
CARD = '<script type="application/ld+json">{"@type":"MedicalClinic","name":"Смайл {k}, центр в Києві","telephone":"0671234567","address":{"streetAddress":" вул. А, 1, "},"description":"a\nb"}</script>'
#: Listing pages from crawled pages: two sections of each of seven towns, cards that repeat more and more, some pages forbidden or not landed.
LISTED = """listed as (
  select 'town' || cast(page_id % 7 as string) as city, case when floor(page_id / 7) % 2 = 0 then 'kliniki' else 'clinics' end as section,
    cast(floor(page_id / 14) as bigint) + 1 as page, page_id % 97 <> 50 as allowed, page_id % 61 <> 33 as landed,
    '/clinic/a' || cast(cast(floor(page_id / 14) * 3 as bigint) % 40 as string) as one, '/clinic/b' || cast(cast(floor(page_id / 30) as bigint) % 50 as string) as two from {pages})
"""


def _listed(t: Tables) -> DataFrame:
    rows = t.spark.sql(f"with {LISTED} select * from listed", pages=t.pages)
    html = F.when(F.col("landed"), F.concat(F.lit('<a href="'), "one", F.lit('"></a><a href="https://likarni.com'), "two", F.lit('">')))
    return listings.listing_crawl(rows.withColumn("html", html), ["kliniki", "clinics"], 200)


add("s15_listing_crawl", lambda t: _listed(t).select("city", "section", "page", "path"),
    f"""with recursive {LISTED.replace("{pages}", "pages")},
    queue as (select *, row_number() over (partition by city order by section desc, page) as n from listed),
    walk as (
      select city, 0::bigint as n, '' as section, 0::bigint as page, []::varchar[] as seen, []::varchar[] as fresh, false as done from (select distinct city from listed)
      union all
      select q.city, q.n, q.section, q.page,
        case when (w.done and w.section = q.section) or not (q.landed and q.allowed) or q.page <> (case when w.section = q.section then w.page else 0 end) + 1 or q.page > 200 then w.seen
          else list_concat(w.seen, list_filter([q.one, q.two], lambda p: not list_contains(w.seen, p))) end,
        case when (w.done and w.section = q.section) or not (q.landed and q.allowed) or q.page <> (case when w.section = q.section then w.page else 0 end) + 1 or q.page > 200 then []
          else list_filter([q.one, q.two], lambda p: not list_contains(w.seen, p)) end,
        (w.done and w.section = q.section) or not (q.landed and q.allowed) or q.page <> (case when w.section = q.section then w.page else 0 end) + 1 or q.page > 200
          or len(list_filter([q.one, q.two], lambda p: not list_contains(w.seen, p))) = 0
      from walk w join queue q on q.city = w.city and q.n = w.n + 1)
    select city, section, page, unnest(fresh) as path from walk where len(fresh) > 0""", "")

#: Requests from events: half of all go to one host.
REQUESTS = """requests as (
  select case when event_id % 2 = 0 then 'hot' else 'h' || cast(user_id % 40 as string) end as host, event_id as seq,
    cast(floor(event_id / 7) as double) * 1.5 as ready, event_type = 'error' as failed from {events})
"""
add("s30_start_times", lambda t: pace.start_times(t.spark.sql(f"with {REQUESTS} select * from requests", events=t.events), 1.0, 4.0, 3).select("host", "seq", F.round("start", 3).alias("start")),
    f"""with {REQUESTS.replace("{events}", "events")},
    ranked as (select *, row_number() over (partition by host order by seq) as n from requests),
    streaked as (select *, n - coalesce(max(case when not failed then n end) over (partition by host order by n), 0) as streak from ranked),
    gapped as (select *, 1.0 + case when streak > 0 then 4.0 * pow(2, least(streak - 1, 3)) else 0 end as gap from streaked),
    shifted as (select *, coalesce(sum(gap) over (partition by host order by n rows between unbounded preceding and 1 preceding), 0) as shift from gapped)
    select host, seq, round(shift + max(ready - shift) over (partition by host order by n), 3) as start from shifted""", "")
#: Attempts from events: a third of all belong to one query.
ATTEMPTS = """attempts as (
  select case when event_id % 3 = 0 then 'hot' else 'q' || cast(user_id as string) || '-' || cast(cast(floor(event_id / 500) as bigint) as string) end as query, event_id as seq,
    case when event_type = 'error' then 'broken' when event_type = 'purchase' then 'ok' else 'busy' end as kind from {events})
"""
add("s04_retries", lambda t: retries.outcomes(t.spark.sql(f"with {ATTEMPTS} select * from attempts", events=t.events), 3, 2),
    f"""with recursive {ATTEMPTS.replace("{events}", "events")},
    ranked as (select *, row_number() over (partition by query order by seq) as n from attempts),
    walk as (select distinct query, cast(0 as bigint) as n, 0 as mirror, 0 as tries, 'open' as outcome from attempts union all
      select query, n, case when outcome = 'ok' or stays then mirror else least(mirror + 1, 2) end, case when stays then tries + 1 else 0 end,
        case when outcome = 'ok' then 'ok' when not stays and mirror = 2 then 'failed' else 'open' end
      from (select w.query, a.n, w.mirror, w.tries, case when a.kind = 'ok' then 'ok' else 'open' end as outcome, a.kind = 'busy' and w.tries + 1 < 2 as stays
        from walk w join ranked a on a.query = w.query and a.n = w.n + 1 where w.outcome = 'open'))
    select query, arg_max(outcome, n) as outcome, max(n) as attempts, arg_max(mirror, n) as mirror from walk group by query""", "")
add("s15_card_paths", lambda t: listings.card_paths(formed(t, "city string, seq int, html string", [("Київ {k}", 1, '<a href="/clinic/b{k}"><a href="https://likarni.com/clinic/a">'), ("Київ {k}", 2, '<a href="/clinic/b{k}"><a href="/clinic/c">')], every=True)).select("city", "pos", "path"),
    "select city, pos, path from (" + told("city varchar, pos int, path varchar", [(0, "Київ {k}", 0, "/clinic/b{k}"), (0, "Київ {k}", 1, "/clinic/a"), (0, "Київ {k}", 2, "/clinic/c")]) + ")", "")
add("s16_s18_cards", lambda t: listings.likarni_cards(formed(t, "city string, path string, html string", [("Київ {k}", "/clinic/smile{k}", CARD), ("Київ {k}", "/clinic/x{k}", CARD.replace("Смайл {k}, центр", "Сінево"))], every=True)).select("ext_id", "name", "category", "address", "create_if_missing"),
    "select 'smile' || c_custkey as ext_id, 'Смайл ' || c_custkey as name, 'clinic' as category, 'вул. А, 1' as address, true as create_if_missing from customer", "")
add("s19_sitemap", lambda t: listings.sitemap_cards(formed(t, "slug string, body string", [("kiev", "<loc>https://doc.ua/ua/klinika/kiev/a{k}</loc><loc>https://doc.ua/klinika/kiev/a{k}</loc><loc>https://doc.ua/ua/klinika/lvov/b{k}</loc>")])).select("url"), "select 'https://doc.ua/ua/klinika/kiev/a' || c_custkey as url from customer", "")
CRUMB = '<script type="application/ld+json">{"@type":"BreadcrumbList","itemListElement":[{"item":{"name":"Київ"}},{"item":{"name":"Abbe {k} Optic — центр"}}]}</script><span class="address__name">вул. Б, {k}</span>'
add("s20_s21_cards", lambda t: listings.doc_ua_cards(formed(t, "city string, url string, html string", [("Київ", "https://doc.ua/ua/klinika/kiev/abbe{k}/", CRUMB)])).select("ext_id", "name", "address", "create_if_missing"), "select 'abbe' || c_custkey as ext_id, 'Abbe ' || c_custkey || ' Optic' as name, 'вул. Б, ' || c_custkey as address, false as create_if_missing from customer", "")
cases("s22_crawl_outcome", "u string, a boolean, s int, c string", [("x{k}", True, 200, "text/html", "bad_url"), ("a{k}.ua", False, 200, "text/html", "robots_disallow"), ("a{k}.ua", True, 500, "text/html", "unreachable"), ("a.ua", True, 200, "image/png", "not_html"), ("a.ua", True, 200, "text/html; charset=utf-8", None)],
      lambda d: pages.outcome(F.col("u"), F.col("a"), F.col("s"), F.col("c")))
add("s25_robots", lambda t: pages.robots_allow(formed(t, "url string", [("https://a{k}.ua/x",), ("https://a{k}.ua/admin/1",), ("https://b{k}.ua/admin",)], every=True), formed(t, "origin string, body string", [("https://a{k}.ua", "User-agent: *\nDisallow: /admin")]).drop("k"), "terncove").select("url", "allowed"),
    "select url, allowed from (" + told("url varchar, allowed boolean", [(0, "https://a{k}.ua/x", True), (0, "https://a{k}.ua/admin/1", False), (0, "https://b{k}.ua/admin", True)]) + ")", "")
SERP = '<div class="result"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fprom.ua%2F">P</a></div><div class="result"><a class="result__a" href="https://slon{k}.ua/?a=1">Slon</a><a class="result__snippet">hi</a></div>'
serp = lambda t: listings.search_hits(formed(t, "html string", [(SERP,), ("anomaly-modal {k}",), (None,)]).withColumnRenamed("k", "id"))
add("s26_search_hits", lambda t: serp(t).select("id", "failed", "url", "title"), "select k as id, failed, url, title from (" + told("failed varchar, url varchar, title varchar", [(0, None, "https://prom.ua/", "P"), (0, None, "https://slon{k}.ua/?a=1", "Slon"), (1, "challenge", None, None), (2, "no response", None, None)], 3) + ")", "")
add("w08_official_site", lambda t: listings.official_sites(serp(t)), "select k as id, url, failed from (" + told("url varchar, failed boolean", [(0, "https://slon{k}.ua/", False), (1, None, True), (2, None, True)], 3) + ")", "")
HITS = [("Стоматологія Посмішка", "Харків", 0, "https://instagram.com/posmishka", "Посмішка (@posmishka) • Instagram photos", "у Харкові {k}"), ("Стоматологія Посмішка", "Харків", 1, "https://instagram.com/other{k}", "Other", "Харків"), ("Лев", "Київ", 0, "https://instagram.com/lev.kyiv", "Лев", "блог {k}")]
SHOWN = "name string, city string, pos int, url string, title string, snippet string"
scored = lambda t: profiles.score_profiles(formed(t, SHOWN, HITS[:2], every=True).where("k % 2 = 0").unionByName(formed(t, SHOWN, HITS[2:]).where("k % 2 = 1")).withColumnRenamed("k", "id"))
add("f34_w07_profiles", lambda t: profiles.pick_profiles(scored(t)).select("id", "url", "score", "city_ok"), "select k as id, url, score, city_ok from (" + told("url varchar, score double, city_ok boolean", [(0, "https://instagram.com/posmishka", 1.0, True), (1, "https://instagram.com/lev.kyiv", 1.0, True)], 2) + ")", "")
add("a16_best_candidate", lambda t: profiles.best_candidates(scored(t)).select("id", "url"), "select k as id, url from (" + told("url varchar", [(0, "https://instagram.com/posmishka"), (1, "https://instagram.com/lev.kyiv")], 2) + ")", "")
add("f13_a13_site_contacts", lambda t: pages.site_contacts(formed(t, "seq int, url string, html string", [(0, "https://s.ua/", PAGE + " тел. 0671234567 tawk.to"), (1, "https://s.ua/contacts", '<a href="tel:0501112233">a{k}@s.ua tidio.co')], every=True).withColumnRenamed("k", "id")).select("id", F.array_join("phones", ",").alias("phones"), F.array_join("emails", ",").alias("emails"), rules.describe_automation(F.col("automation")).alias("automation")),
    "select c_custkey as id, '+380671234567,+380501112233' as phones, 'a' || c_custkey || '@s.ua' as emails, 'chat:tawk/tidio' as automation from customer", "")
add("k01_export", lambda t: export.export_rows(t.leads).select("id", "phone", "has_automation", "automation", "contact_score", "crm_status", "notes", "last_verified_at"),
    f"select cast(id as varchar) as id, coalesce(phone, '') as phone, coalesce(cast(cast(has_automation as int) as varchar), '') as has_automation, case when has_automation then 'booking:fresha, chat:tawk/tidio' when not has_automation then 'platform:wix' else '—' end as automation, cast({SCORE} as varchar) as contact_score, case coalesce(crm_status, 'new') when 'new' then 'Новий' when 'in_progress' then 'В роботі' when 'interested' then 'Зацікавлений' when 'lost' then 'Відмова' else 'Закрито (угода)' end as crm_status, coalesce(notes, '') as notes, coalesce(strftime(last_verified_at, '%Y-%m-%dT%H:%M:%S'), '') as last_verified_at from leads")


def _signals_sql() -> str:
    """Signatures over lower-cased pages by DuckDB's own expressions."""
    hit = lambda p: f"regexp_matches(h, {quoted(p)})"
    kinds = list(dict.fromkeys(k for _, k, _ in C.SIGNATURES))
    of = {k: "list_filter([" + ", ".join(f"case when {hit(p)} then '{v}' end" for p, kind, v in C.SIGNATURES if kind == k) + "], lambda x: x is not null)" for k in kinds}
    shown = ", ".join(f"case when len({of[k]}) > 0 then '{k}:' || array_to_string({of[k]}, '/') end" for k in kinds)
    hint = f"case when len({of['booking']}) = 0 and {hit(C.BOOKING_HINT)} then 'booking_hint:custom_or_manual' end"
    strong = " or ".join(f"len({of[k]}) > 0" for k in C.STRONG_KINDS)
    mails = f"list_distinct(list_filter(list_transform(regexp_extract_all(html, {quoted(C.EMAIL)}), lambda m: lower(m)), lambda m: not regexp_matches(m, {quoted('(?i)' + C.EMAIL_BLOCKED)})))"
    listed = f"array_to_string(list_sort(list_filter([{shown}, {hint}], lambda x: x is not null)), ', ')"
    return f"select page_id, {strong} as automated, case when {listed} = '' then '—' else {listed} end as automation, cast(least(5, len({mails})) as int) as n_emails from (select page_id, html, lower(html) as h from pages)"


add("pages_signals", lambda t: t.pages.select("page_id", rules.detect_automation(F.col("html")).alias("a"), F.size(X.find_emails(F.col("html"))).alias("n_emails"))
    .select("page_id", rules.is_automated(F.col("a")).alias("automated"), rules.describe_automation(F.col("a")).alias("automation"), "n_emails"), _signals_sql(), "")
add("pages_contacts", lambda t: pages.site_contacts(t.pages.select(F.col("page_id").alias("id"), F.lit(0).alias("seq"), "url", "html")).select("id", F.size("phones").alias("phones"), F.size("emails").alias("emails")))
add("pages_hosts", lambda t: t.pages.select("page_id", X.host_of(F.col("url")).alias("host")), r"select page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') as host from pages", "")
BLOCKS = """select a.c_custkey as left_id, b.c_custkey as right_id from customer a join customer b on floor(a.c_custkey / 10) = floor(b.c_custkey / 10)
  and (b.c_custkey = a.c_custkey + 1 or (b.c_custkey > a.c_custkey and floor(a.c_custkey / 10) % 2 = 0))
  union all select a.c_custkey, a.c_custkey + 1 from customer a where a.c_custkey % 10 = 9 and floor(a.c_custkey / 10) % 20 <> 19"""


def _blocks(t: Tables) -> DataFrame:
    """Keys in tens: chains and cliques in turn, each chained to the next, twenty at a time."""
    t.customer.createOrReplaceTempView("customer")
    return t.spark.sql(BLOCKS)


add("w03_greedy_chains", lambda t: dedupe.greedy_pairs(_blocks(t)).select("left_id", "right_id"),
    f"""with recursive e as ({BLOCKS}), nodes as (select distinct left_id as id from e union select right_id from e),
    firsts as (select left_id, min(right_id) as r1, list(right_id order by right_id) as rs, floor(left_id / 200) as g from e group by left_id),
    numbered as (select *, row_number() over (partition by g order by left_id) as n from firsts),
    walk as (
      select g, n, left_id, r1 as taken, [left_id, r1] as used from numbered where n = 1
      union all
      select m.g, m.n, m.left_id, case when list_contains(w.used, m.left_id) then null else list_filter(m.rs, lambda r: not list_contains(w.used, r))[1] end,
        case when list_contains(w.used, m.left_id) then w.used else list_concat(list_filter(w.used, lambda u: u > m.left_id), [m.left_id, list_filter(m.rs, lambda r: not list_contains(w.used, r))[1]]) end
      from walk w join numbered m on m.g = w.g and m.n = w.n + 1)
    select left_id, taken as right_id from walk where taken is not null""", "")
add("w02_w03_dedupe", lambda t: dedupe.dedupe(_mergeable(t)).select("id", "osm_id", F.array_join("merged_ids", ",").alias("merged")),
    "select id, osm_id, case when k % 10 = 0 then 'way/' || cast(k as varchar) end as merged from leads where copy = 0")


def _link(t: Tables) -> DataFrame:
    """Records of known leads by phone, by their name a little changed near by or at the address, of places that are new, told of twice
    (the second time with another phone, number and address), and of places that may not be created."""
    leads = t.leads.withColumns({"merged_ids": F.lit(None).cast("array<string>"), "external_ids": F.lit(None).cast("map<string,string>")})
    none = F.array().cast("array<string>")
    nszu = F.lit("nszu").alias("source")
    own = ["category", "city", "address", "lat", "lon"]
    near = F.when(F.col("k") % 4 == 1, F.concat("name", F.lit("a"))).otherwise(F.col("name")).alias("name")
    known = t.leads.where("k % 3 = 1").select(
        F.col("id").alias("pos"), nszu, F.concat(F.lit("k"), "id").alias("ext_id"), near, *own,
        F.when(F.col("k") % 2 == 0, F.array("phone")).otherwise(none).alias("phones"), "email", "website", (F.col("k") % 5 != 0).alias("create_if_missing"),
    )
    coded = F.translate(F.md5(F.concat(F.lit("x"), "k")), "0123456789", "ghijklmnop")

    def place(first: int, ext: str, street: str):
        phone = F.concat(F.lit("+38050"), F.lpad(F.col("k").cast("string"), 7, "0"))
        return t.leads.where("copy = 0 and k % 3 = 2").select(
            (F.col("id") + F.lit(first)).alias("pos"), nszu, F.concat(F.lit(ext), "id").alias("ext_id"), coded.alias("name"), "category", "city", F.lit(street).alias("address"),
            (F.col("lat") + 1).alias("lat"), F.col("lon"), (F.array(phone) if first < 2 * 10**9 else none).alias("phones"), "email", "website", (F.col("k") % 2 == 0).alias("create_if_missing"),
        )

    return linkage.link(leads, known.unionByName(place(10**9, "f", "вул. Нова, 1")).unionByName(place(2 * 10**9, "g", "вул. Інша, 7")))


LINKED = """select id as pos, 'matched' as outcome, case when k % 2 = 0 then first else id end as lead_id, cast(null as bigint) as created_by
  from (select *, min(id) over (partition by city, phone) as first from leads) where k % 3 = 1
  union all select id + 1000000000, case when k % 2 = 0 then 'new' else 'skipped' end, null, case when k % 2 = 0 then id + 1000000000 end from leads where copy = 0 and k % 3 = 2
  union all select id + 2000000000, case when k % 2 = 0 then 'merged' else 'skipped' end, null, case when k % 2 = 0 then id + 1000000000 end from leads where copy = 0 and k % 3 = 2"""
add("j02_j03_u06_linkage", lambda t: _link(t).select("pos", "outcome", "lead_id", "created_by"), LINKED)
add("u06_counters", lambda t: linkage.counters(_link(t)), f"select outcome, count(*) as n from ({LINKED}) group by 1")


def _foreign(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Records of which every second one belongs to a lead, and their links."""
    r = t.leads.where("copy = 0").select(
        F.col("id").alias("pos"), F.lit("nszu").alias("source"), F.col("k").cast("string").alias("ext_id"), "name", F.lit("clinic").alias("category"), "city",
        F.lit("вул. Нова, 1").alias("address"), "lat", "lon", F.array(F.lit("0441112233"), F.lit("0671112233")).alias("phones"), F.lit("N@X.ua").alias("email"),
        F.lit("x.ua").alias("website"), F.lit("Іван").alias("contact_person"), F.lit("1").alias("edrpou"),
        F.create_map(F.lit("listing"), F.array(F.lit("doc.ua"))).alias("automation"), F.lit(True).alias("create_if_missing"),
    )
    matched = F.col("pos") % 4 == 0
    links = r.select("pos", F.when(matched, "matched").otherwise("new").alias("outcome"), F.when(matched, F.col("pos")).alias("lead_id"), F.when(~matched, F.col("pos")).alias("created_by"))
    return r, links


def _fillable(t: Tables) -> DataFrame:
    return t.leads.withColumns({"external_ids": F.lit(None).cast("map<string,string>"), "contact_person": F.lit(None).cast("string"), "edrpou": F.lit(None).cast("string")})


add("u04_fill", lambda t: linkage.fill(_fillable(t), *_foreign(t)).select("id", "address", "phone", "email", "email_valid", "website", "contact_person", "source", F.try_element_at("external_ids", F.lit("nszu")).alias("ext")),
    """select id, case when m then coalesce(address, 'вул. Нова, 1') else address end as address, case when m then coalesce(phone, '+380441112233') else phone end as phone,
      case when m then coalesce(email, 'n@x.ua') else email end as email, case when m and email is null then null else email_valid end as email_valid,
      case when m then coalesce(website, 'https://x.ua') else website end as website, case when m then 'Іван' end as contact_person,
      case when m and not contains(source, 'nszu') then source || ',nszu' else source end as source, case when m then cast(k as varchar) end as ext
    from (select *, copy = 0 and id % 4 = 0 as m from leads)""")
add("u05_created", lambda t: linkage.created(*_foreign(t)).select("pos", "osm_id", "phone", "notes", "website", "size_estimate"),
    "select id as pos, 'nszu/' || cast(k as varchar) as osm_id, '+380441112233' as phone, 'доп.тел: +380671112233' as notes, 'https://x.ua' as website, 'small' as size_estimate from leads where copy = 0 and id % 4 <> 0")
add("o07_events", lambda t: ids(queue.newest_first(t.items, "claimed_at")), "select id from items order by claimed_at desc nulls last, id desc", "items")
add("j15_branches_joined", lambda t: stats.branch_counts(t.leads.withColumn("name", F.substring("name", 1, 7))).groupBy("name").agg(F.max("branches").alias("n")), "select substr(name, 1, 7) as name, count(*) as n from leads group by 1")
add("k05_sheet_order", lambda t: export.sheet_rows(t.leads, ["id", "status"]), "select id, status from leads order by id")
add("k07_api_usage", lambda t: stats.calls_by_month(t.items.select("channel", "claimed_at", F.col("attempts").alias("calls")).withColumnsRenamed({"channel": "service", "claimed_at": "called_at"}).where("called_at is not null")),
    "select channel as service, strftime(claimed_at, '%Y-%m') as period, cast(sum(attempts) as bigint) as calls from items where claimed_at is not null group by 1, 2", "items")
add("k08_lead_context", lambda t: t.leads.withColumn("size_estimate", F.lit("small")).select("id", queue.lead_context().alias("c")).select("id", "c.has_website", "c.automation_summary", "c.size"),
    "select id, coalesce(website_status = 'has_website', false) as has_website, case when has_automation then 'booking:fresha, chat:tawk/tidio' when not has_automation then 'platform:wix' else '—' end as automation_summary, 'small' as size from leads")
cases("u02_categories", "names array<string>", [(["horeca", "cafe", "vet"], "cafe,restaurant,bar,bakery,vet"), (["vet", " HORECA "], "vet,cafe,restaurant,bar,bakery"), (["unknown {k}"], None), (["all"], ",".join(C.CATEGORY_FILTERS)), (["lab", "medical"], "lab,dentist,clinic,doctors,rehab,cosmetology,hospital")],
      lambda d: F.array_join(merge.resolved(F.col("names")), ","))
add("u16_migrated", lambda t: merge.with_columns_of(t.leads.select("id", "name"), t.leads.select("id", "name", "phone", "has_automation").schema).agg(F.count("id").alias("n"), F.count("phone").alias("phones")), "select count(*) as n, cast(0 as bigint) as phones from leads")
BILLED = [(None, '{"places": [{"id": "p{k}"}]}', '{"nationalPhoneNumber": "067 123 45 67", "formattedAddress": "a {k}"}'), ("q{k}", None, None), (None, None, None), (None, "{}", None)]
add("s27_paid_lookups", lambda t: listings.paid_lookups(formed(t, "known_place string, search_body string, details_body string", BILLED).withColumnRenamed("k", "id")),
    "select k as id, place_id, calls, phone, address from (" + told("place_id varchar, calls int, phone varchar, address varchar", [(0, "p{k}", 2, "+380671234567", "a {k}"), (1, "q{k}", 0, None, None), (2, None, 0, None, None), (3, None, 1, None, None)], 4) + ")", "")


def _discovered(t: Tables, run: Callable = discover.discover) -> tuple[DataFrame, DataFrame]:
    leads = formed(t, "osm_id string, name string, category string, city string, lat double, lon double, phone string", [("node/1{k}1", "Слон {k}", "beauty", "Київ {k}", None, None, None)])
    leads = leads.where("k % 8 <> 4").withColumnRenamed("k", "id")
    more = {"address": "string", "website": "string", "email": "string", "website_status": "string", "source": "string", "notes": "string", "size_estimate": "string", "email_valid": "boolean", "has_automation": "boolean",
            "socials": "map<string,string>", "raw_tags": "map<string,string>", "automation": "map<string,array<string>>", "merged_ids": "array<string>", "last_verified_at": "timestamp"}
    leads = leads.withColumns({k: F.lit(None).cast(v) for k, v in more.items()})
    runs = formed(t, "kind string, city string, category string", [("discover", "Київ {k}", "beauty")]).where("k % 16 = 0").withColumnRenamed("k", "id").withColumns({"started_at": t.now, "finished_at": t.now})
    # a kilometre from key to key, so that no two are copies
    spot = lambda shift: ((F.col("k") % 12_000) * 0.01 - 60 + shift).cast("decimal(9,3)").cast("string")
    east = (F.floor(F.col("k") / 12_000) * 0.02 + 1).cast("decimal(9,3)").cast("string")
    body = F.col("body")
    for old, new in [("50.1", F.lit("<north>")), ("50.2", F.lit("<upper>")), ("30.1", F.lit("<east>")), ("30.2", F.lit("<east>")), ("<north>", spot(0)), ("<upper>", spot(0.005)), ("<east>", east)]:
        body = F.replace(body, F.lit(old), new)
    return run(leads, raw(t, 2).withColumn("body", body).drop("k"), runs, t.now)


KNOWN = "select c_custkey as k, c_custkey % 2 = 0 and c_custkey % 16 <> 0 as read, c_custkey % 8 <> 4 as known from customer"
add("q08_discover", lambda t: _discovered(t)[0].select("osm_id", "name", "phone"),
    f"select 'node/1' || k || '1' as osm_id, 'Слон ' || k as name, case when read then '0671234567' end as phone from ({KNOWN}) where read or known union all select 'way/1' || k || '2', 'Лев ' || k, k::varchar from ({KNOWN}) where read", "")
add("q07_run_log", lambda t: _discovered(t, discover.imported)[1].select("city", "new_count", "updated_count"),
    f"select case when k % 2 = 0 then 'Київ ' else 'Львів ' end || k as city, case when read and known then 1 when read then 2 else 0 end::bigint as new_count, case when read and known then 1 else 0 end::bigint as updated_count from ({KNOWN}) where k % 16 <> 0", "")
add("entry_hot_by_category", lambda t: hot_by_category(t.leads), f"select category, count(*) as n, sum(cast(phone is not null as int)) as with_phone, sum(cast(email is not null as int)) as with_email from leads where {HOT} group by category")


def hot_by_category(leads: DataFrame) -> DataFrame:
    return leads.where(S.hot()).groupBy("category").agg(F.count("*").alias("n"), F.count("phone").alias("with_phone"), F.count("email").alias("with_email"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot leads of each category with how many can be called or written to."""
    return hot_by_category(Tables(spark, sf_dir).leads)
