"""External records to leads: by key, by phone within the city, by name and place, by a unique name."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.harvest import similarity_from
from ..functions.rules import estimate_size, merge_automation
from ..plans.cut import cut, spread
from .groups import components, components_by  # noqa: F401
from .merge import new_id, with_columns_of
from .similar import letters, similar_at_places, similar_names

NEAR_M = 150.0
NAME_LEAST, NAME_ALONE = 0.80, 0.95
LINKS = "pos long, outcome string, lead_id long, created_by long"


def prepared(records: DataFrame) -> DataFrame:
    """Records with normalised phones, URL and email and with the forms that matching compares."""
    phones = F.array_distinct(F.filter(F.transform("phones", lambda p: X.normalize_phone(p)), lambda p: p.isNotNull()))
    clean = records.withColumns({
        "phones": F.coalesce(phones, F.array().cast("array<string>")), "website": X.normalize_url(F.col("website")),
        "email": X.filled(F.lower(X.strip(F.col("email")))),
    })
    return clean.withColumns({
        "key": X.record_key(F.col("source"), F.col("ext_id")), "raw_key": F.concat_ws("/", "source", "ext_id"),
        "norm": X.normalize_name(F.col("name")), "house": X.address_house(F.col("address")), "stems": X.address_stems(F.col("address")),
    })


def _metres(a: float, b: float, c: float, d: float) -> float:
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(math.sqrt(h))


def _letter_mask(name: str) -> int:
    """256 bits, each letter with its occurrence turning one over: at least as many letters of two names are apart as bits differ."""
    mask, seen = 0, {}
    for c in name:
        n = seen[c] = seen.get(c, -1) + 1
        mask ^= 1 << (((ord(c) * 64 + n) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 40) % 256
    return mask


class Places:
    """The leads of a city in order of their arrival, and which of them a record's name and place can match at all.

    Nearly equal names (``NAME_ALONE``) are found by letter triples: a text that differs in few letters has one of the rarest triples, a longer
    one has all, a shorter one is one of its pieces. Other names count only nearby (cells of ``NEAR_M``) or at the same address.
    """

    SIZE = NEAR_M / 111_000

    def __init__(self):
        self.rows: list[dict] = []
        self.triples: dict[str, list[int]] = {}
        self.names: dict[str, list[int]] = {}
        self.sizes: set[int] = set()
        self.cells: dict[tuple[int, int], list[int]] = {}
        self.addresses: dict[tuple[str, str], list[int]] = {}

    @classmethod
    def column(cls, row: int, lon: float) -> int:
        """Cells of a row are as wide as the distance is there at least."""
        return math.floor(lon / (cls.SIZE / max(math.cos(math.radians(min((abs(row) + 2) * cls.SIZE, 89.0))), 0.01)))

    def add(self, row: dict) -> None:
        n, name = len(self.rows), row["norm"] or ""
        self.rows.append(row)
        row["mask"] = _letter_mask(name)
        for t in {name[i : i + 3] for i in range(len(name) - 2)}:
            self.triples.setdefault(t, []).append(n)
        if name:
            self.names.setdefault(name, []).append(n)
            self.sizes.add(len(name))
        if _located(row):
            cy = math.floor(row["lat"] / self.SIZE)
            self.cells.setdefault((cy, self.column(cy, row["lon"])), []).append(n)
        if row["house"]:
            for stem in row["stems"]:
                self.addresses.setdefault((row["house"], stem), []).append(n)

    def candidates(self, rec: dict, stems: set[str]) -> list[dict]:
        name, found = rec["norm"] or "", set()
        if not name:
            return []
        if len(name) < 3:
            return self.rows
        # at most so many letters of both differ if the ratio is NAME_ALONE; each spoils three triples at most
        differ = int((1 - NAME_ALONE) * len(name) * (1 + (2 - NAME_ALONE) / NAME_ALONE) + 1e-9)
        own = {name[i : i + 3] for i in range(len(name) - 2)}
        for t in sorted(own, key=lambda t: len(self.triples.get(t, ())))[: 3 * differ + 1]:
            found.update(self.triples.get(t, ()))
        for size in self.sizes:
            for i in range(len(name) - size + 1):
                found.update(self.names.get(name[i : i + size], ()))
        if _located(rec):
            cy = math.floor(rec["lat"] / self.SIZE)
            for y in (cy - 1, cy, cy + 1):
                cx = self.column(y, rec["lon"])
                for x in (cx - 1, cx, cx + 1):
                    found.update(self.cells.get((y, x), ()))
        if rec["house"]:
            for stem in stems:
                found.update(self.addresses.get((rec["house"], stem), ()))
        return [self.rows[n] for n in sorted(found)]


def _located(row: dict) -> bool:
    return all(row[c] is not None and row[c] == row[c] for c in ("lat", "lon"))


def fold(leads: pd.DataFrame, records: pd.DataFrame) -> pd.DataFrame:
    """Sequential matching of one component: a record may match a lead that an earlier record of the batch created."""
    known = leads.sort_values("id").to_dict("records")
    by_key: dict[str, dict] = {}
    by_phone: dict[tuple, dict] = {}
    by_city: dict[str, Places] = {}

    def add(row: dict) -> None:
        by_key[row["osm_id"]] = row
        for m in row["merged_keys"]:
            by_key.setdefault(m, row)
        for e in row["own_keys"]:
            by_key[e] = row
        if row["phone"]:
            by_phone.setdefault((row["city"], row["phone"]), row)
        by_city.setdefault(row["city"], Places()).add(row)

    for row in known:
        row["stems"] = set(row["stems"])
        add(row)
    out = []
    for rec in records.sort_values("pos").to_dict("records"):
        row = by_key.get(rec["key"]) or by_key.get(rec["raw_key"])
        if row is None:
            row = next((by_phone[rec["city"], p] for p in rec["phones"] if (rec["city"], p) in by_phone), None)
        if row is None:
            best, best_score, alone = None, 0.0, []
            stems = set(rec["stems"])
            name, mask = rec["norm"] or "", _letter_mask(rec["norm"] or "")
            for other in by_city[rec["city"]].candidates(rec, stems) if rec["city"] in by_city else ():
                theirs = other["norm"] or ""
                if (mask ^ other["mask"]).bit_count() > (1 - NAME_LEAST) * (len(name) + len(theirs)) + 1e-9 and name not in theirs and theirs not in name:
                    continue  # too many letters are apart even for neighbours
                near = _located(rec) and _located(other) and _metres(rec["lat"], rec["lon"], other["lat"], other["lon"]) <= NEAR_M
                same = bool(rec["house"]) and rec["house"] == other["house"] and bool(stems & other["stems"])
                least = NAME_LEAST if near or same else NAME_ALONE  # elsewhere only nearly equal names count
                score = similarity_from(rec["norm"], other["norm"], least)
                if score < least:
                    continue
                if score >= NAME_ALONE:
                    alone.append(other)
                if score > best_score and (near or same):
                    best, best_score = other, score
            row = best or (alone[0] if len(alone) == 1 and not rec.get("crowded") else None)  # a crowded name's leads are not all here
        if row is not None:
            out.append((rec["pos"], "matched" if row["created_by"] is None else "merged", row["id"], row["created_by"]))
        elif not rec["create_if_missing"]:
            out.append((rec["pos"], "skipped", None, None))
        else:
            new = {**{k: rec[k] for k in ("city", "lat", "lon", "norm", "house")}, "id": None, "osm_id": rec["key"], "merged_keys": [], "own_keys": [rec["raw_key"]]}
            new |= {"phone": rec["phones"][0] if len(rec["phones"]) else None, "stems": set(rec["stems"]), "created_by": rec["pos"]}
            add(new)
            out.append((rec["pos"], "new", None, rec["pos"]))
    frame = pd.DataFrame(out, columns=["pos", "outcome", "lead_id", "created_by"])
    return frame.astype({"lead_id": "Int64", "created_by": "Int64"})


def _node(kind: str, *cols) -> Column:
    """A node of the graph of candidates. That two nodes ever share a number makes a group larger, never wrong."""
    return F.xxhash64(F.lit(kind), *cols)


def _named() -> dict[str, Column]:
    """A name of a city as a node, and the name's letters."""
    return {"name_id": _node("name", F.col("city"), F.col("norm")), "ls": letters(F.coalesce("norm", F.lit("")))}


def _places(df: DataFrame, probe: bool) -> DataFrame:
    """place, id, ls, node: where a name is at home (its cell, its address), or where its neighbours are (nine cells, its address)."""
    size = Places.SIZE
    row = F.floor(F.col("lat") / size)
    column = lambda r: F.floor(F.col("lon") / (F.lit(size) / F.greatest(F.cos(F.radians(F.least((F.abs(r) + 2) * size, F.lit(89.0)))), F.lit(0.01))))
    around = (-1, 0, 1) if probe else (0,)
    cells = F.array(*[_node("cell", F.col("city"), row + dy, column(row + dy) + dx) for dy in around for dx in around])
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    none = F.array().cast("array<long>")
    addresses = F.when(F.col("house").isNotNull(), F.transform("stems", lambda s: _node("address", F.col("city"), F.col("house"), s))).otherwise(none)
    every = F.concat(F.when(located, cells).otherwise(none), addresses)
    return df.where("norm <> ''").select(F.explode(every).alias("place"), F.col("name_id").alias("id"), "norm", "ls", "city", "node")


def candidate_edges(lead: DataFrame, rec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, city: edges of a graph in which a record hangs together with all that can decide about it; x: ids of crowded names).

    Keys, phones and names are nodes themselves, so what shares one is a star and not all its pairs. A name is crowded if two leads or more of its city have
    nearly the same: then no lead is its only one, whatever else is found, and only neighbours count. Other names hang together with all nearly equal ones of their city.
    """
    asked = rec.select("city", "node", F.explode(F.concat(F.transform(F.array("key", "raw_key"), lambda k: _node("key", k)), F.transform("phones", lambda p: _node("phone", F.col("city"), p)))).alias("token"))
    keys = F.concat(F.array("osm_id"), F.col("own_keys"), F.col("merged_keys"))
    told = lead.select("city", "node", F.explode(F.concat(F.transform(keys, lambda k: _node("key", k)), F.array(_node("phone", F.col("city"), F.col("phone"))))).alias("token"))
    tokens = cut(asked.unionByName(told.join(asked.select("token").distinct(), "token", "left_semi").select("city", "node", "token")))
    tokens = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "token", "left_semi")  # what one row has joins nothing
    own = ["city", "norm", "ls", "name_id", "node"]
    named = lead.select(*own, F.lit(1).alias("lead")).unionByName(rec.select(*own, F.lit(0).alias("lead"))).where("norm <> ''")
    by_name = named.groupBy(F.col("name_id").alias("id"), F.col("city").alias("place"), "norm")
    names = cut(by_name.agg(F.sum("lead").alias("leads"), (F.min("lead") == 0).alias("asked"), F.first("ls").alias("ls")))
    pairs = cut(similar_names(names, NAME_ALONE))
    beside = pairs.join(names.select(F.col("id").alias("y"), "leads"), "y").groupBy(F.col("x").alias("id")).agg(F.sum("leads").alias("more"))
    load = cut(names.where("asked").join(beside, "id", "left").select("id", (F.col("leads") + F.coalesce("more", F.lit(0)) > 1).alias("crowded")))
    crowded, free = load.where("crowded").select(F.col("id").alias("x")), load.where("not crowded").select(F.col("id").alias("x"))
    alone = pairs.join(free, "x", "left_semi")
    attached = free.union(alone.select("y")).distinct()
    members = named.join(attached.withColumnRenamed("x", "name_id"), "name_id", "left_semi").select("city", "node", F.col("name_id").alias("token"))
    probes, homes = _places(rec, True), _places(lead, False).unionByName(_places(rec, False))
    homes = homes.join(probes.select("place").distinct(), "place", "left_semi")
    distinct = lambda df: df.groupBy("place", "id").agg(F.first("norm").alias("norm"), F.first("ls").alias("ls"))
    met = cut(similar_at_places(cut(distinct(probes)), cut(distinct(homes)), pairs, NAME_LEAST))
    # who asks for a name at a place and who is at home there under it meet anyway, so both are one node
    at = lambda name: _node("at", F.col("place"), F.col(name))
    town = names.select(F.col("id").alias("x"), F.col("place").alias("city"))
    near = met.where("x <> y").join(town, "x").select("city", at("x").alias("node"), at("y").alias("token"))
    askers = probes.join(met.select("place", F.col("x").alias("id")).distinct(), ["place", "id"], "left_semi").select("city", "node", at("id").alias("token"))
    dwellers = homes.join(met.select("place", F.col("y").alias("id")).distinct(), ["place", "id"], "left_semi").select("city", "node", at("id").alias("token"))
    edges = tokens
    for more in (members, alone.join(town, "x").select("city", F.col("x").alias("node"), F.col("y").alias("token")), near, askers, dwellers):
        edges = edges.unionByName(more.select("city", "node", "token"))
    return edges.select(F.col("node").alias("a"), F.col("token").alias("b"), "city"), crowded


#: Rows that one task folds, unless a group is larger.
TOGETHER = 5_000


def link(leads: DataFrame, records: DataFrame) -> DataFrame:
    """One row a record: pos, outcome (matched, merged, new, skipped), lead_id, created_by (position of the creating record).

    leads: id, osm_id, name, city, address, lat, lon, phone, merged_ids, external_ids. records: pos, source, ext_id, name, category,
    city, address, lat, lon, phones, email, website, create_if_missing.

    A record may match a lead that an earlier record created, so records are folded in order, but only within components of the graph of
    ``candidate_edges``; components are dealt over all tasks, some thousand rows a task. Leads that no record can concern are not read further.
    """
    recs = prepared(spread(records, "pos"))
    keys = F.array().cast("array<string>")
    own = ["id", "osm_id", "name", "city", "address", "phone", "lat", "lon", "merged_ids", "external_ids"]
    lead = cut(spread(leads.select(*own), "id").select(
        "id", "osm_id", "city", "phone", "lat", "lon", X.normalize_name(F.col("name")).alias("norm"), X.address_house(F.col("address")).alias("house"),
        X.address_stems(F.col("address")).alias("stems"), F.coalesce("merged_ids", keys).alias("merged_keys"),
        F.coalesce(F.transform(F.map_entries("external_ids"), lambda e: F.concat_ws("/", e["key"], e["value"])), keys).alias("own_keys"), _node("lead", F.col("id")).alias("node"),
    ).withColumns(_named()))
    rec = recs.select("pos", "city", "key", "raw_key", "phones", "norm", "house", "stems", "lat", "lon", "create_if_missing", _node("record", F.col("pos")).alias("node"))
    rec = cut(rec.withColumns(_named()))
    edges, crowded = candidate_edges(lead, rec)
    roots = cut(components_by(edges, "city"))
    parts = slots(leads) + rec.count() // TOGETHER
    part = lambda root: F.pmod(F.xxhash64(root), F.lit(parts))
    rooted = roots.select("node", part("root").alias("part"))
    asked = rec.join(rooted, "node", "left").withColumn("part", F.coalesce("part", part("node"))).join(crowded.select(F.col("x").alias("name_id"), F.lit(True).alias("crowded")), "name_id", "left").drop("node", "name_id", "ls")
    known = lead.join(rooted, "node").join(asked.select("part").distinct(), "part", "left_semi").drop("node", "name_id", "ls").withColumnRenamed("part", "own_part")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.assign(created_by=None).astype(object)
        return fold(left.where(left.notna(), None), right.astype(object).where(right.notna(), None))

    return known.groupBy("own_part").cogroup(asked.groupBy("part")).applyInPandas(run, LINKS)


def slots(df: DataFrame) -> int:
    """Number of shuffle partitions that the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def counters(links: DataFrame) -> DataFrame:
    return links.groupBy("outcome").agg(F.count("*").alias("n"))


def apply_records(leads: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Import as one step: (leads after it, counters). Records are linked; matched leads are filled, places that may be created become
    leads with ids of their own, and records that match those fill them in turn."""
    links = cut(link(leads, records))
    filled = fill(leads, records, links)
    fresh = created(records, links)
    fresh = cut(fresh.withColumn("id", new_id(F.col("osm_id"))))
    like = with_columns_of(fresh, [f for f in leads.schema if f.name in fresh.columns])
    shaped = like.select(*[F.col(c) for c in like.columns], *[F.lit(None).cast(f.dataType).alias(f.name) for f in leads.schema if f.name not in like.columns])
    ids = fresh.select(F.col("pos").alias("created_by"), F.col("id").alias("lead_id"))
    again = links.where("outcome = 'merged'").drop("lead_id").join(ids, "created_by").withColumn("outcome", F.lit("matched"))
    return filled.unionByName(fill(shaped.select(*leads.columns), records, again)), counters(links)


def fill(leads: DataFrame, records: DataFrame, links: DataFrame) -> DataFrame:
    """Matched leads with what their records add, in order of position: empty fields, phone, email with its verdict unset,
    further phones in the notes, external ids, automation, source tags."""
    recs = prepared(records).join(links.where("outcome = 'matched'").select("pos", "lead_id"), "pos")
    row = F.struct("pos", "source", "ext_id", "address", "lat", "lon", "website", "contact_person", "edrpou", "phones", "email", F.map_entries("automation").alias("auto"))
    grouped = recs.groupBy(F.col("lead_id").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("_recs"))
    both = leads.join(grouped, "id", "left")
    telling = lambda kind: lambda v: v.isNotNull() & ((v != "") if kind == "string" else (v != 0))
    first = lambda f, kind: F.get(F.filter(F.transform("_recs", lambda r: r[f]), telling(kind)), 0)
    kinds = dict(leads.dtypes)
    new: dict[str, Column] = {}
    for c in ("address", "lat", "lon", "website", "contact_person", "edrpou", "email"):
        mine = X.filled(F.col(c)) if kinds[c] == "string" else F.when(F.col(c) != 0, F.col(c))
        new[c] = F.coalesce(mine, first(c, kinds[c]), F.col(c))
    got_email = X.filled(F.col("email")).isNull() & first("email", "string").isNotNull()
    new["email_valid"] = F.when(~F.coalesce(got_email, F.lit(False)), F.col("email_valid"))
    phone = F.coalesce(X.filled(F.col("phone")), F.get(F.filter(F.flatten(F.transform("_recs", lambda r: r["phones"])), lambda p: p != ""), 0))
    new["phone"] = phone

    def noted(acc: Column, r: Column) -> Column:
        more = F.filter(r["phones"], lambda p: (p != phone) & ~F.contains(acc, p))
        line = F.concat(acc, F.lit(" доп.тел("), r["source"], F.lit("): "), F.array_join(F.slice(more, 1, 2), ", "))
        return F.when(F.size(more) > 0, F.trim(line)).otherwise(acc)

    new["notes"] = F.when(F.col("_recs").isNull(), F.col("notes")).otherwise(X.filled(F.aggregate("_recs", F.coalesce("notes", F.lit("")), noted)))
    ids = F.aggregate(
        "_recs", F.coalesce("external_ids", F.create_map().cast("map<string,string>")),
        lambda acc, r: F.map_concat(F.map_filter(acc, lambda k, _: k != r["source"]), F.create_map(r["source"], r["ext_id"])),
    )
    new["external_ids"] = F.coalesce(ids, F.col("external_ids"))
    none = F.create_map().cast("map<string,array<string>>")
    auto = F.aggregate("_recs", F.coalesce("automation", none), lambda acc, r: merge_automation(acc, F.coalesce(F.map_from_entries(r["auto"]), none)))
    new["automation"] = F.when(F.size(auto) > 0, auto).otherwise(F.col("automation"))
    tags = F.array_distinct(F.concat(F.split(F.coalesce("source", F.lit("")), ","), F.transform("_recs", lambda r: r["source"])))
    new["source"] = F.coalesce(F.array_join(F.filter(tags, lambda t: t != ""), ","), F.col("source"))
    return both.withColumns(new).select(*leads.columns)


def created(records: DataFrame, links: DataFrame) -> DataFrame:
    """New leads: the record that created each, projected; ids are given by the writer in order of ``pos``."""
    recs = prepared(records).join(links.where("outcome = 'new'").select("pos"), "pos")
    size = estimate_size(F.create_map().cast("map<string,string>"), F.col("category"), F.lit(1))
    more = F.slice("phones", 2, 2)
    return recs.select(
        "pos", F.col("key").alias("osm_id"), F.col("source").alias("osm_type"), "name", "category", "city", "address", "lat", "lon",
        F.try_element_at("phones", F.lit(1)).alias("phone"), "email", "website", "contact_person", "edrpou", F.create_map("source", "ext_id").alias("external_ids"),
        F.when(F.size("automation") > 0, F.col("automation")).alias("automation"),
        F.when(F.size(more) > 0, F.concat(F.lit("доп.тел: "), F.array_join(more, ", "))).alias("notes"), "source", size["size"].alias("size_estimate"),
    )
