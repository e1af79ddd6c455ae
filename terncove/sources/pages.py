"""Crawled business pages: outcome of a crawl, what robots allow, contacts and signals of each site."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.harvest import harvest
from ..functions.rules import detect_automation


def outcome(url: Column, allowed: Column, status: Column, content_type: Column) -> Column:
    """NULL for a page that could be read, else why not."""
    bad = X.normalize_url(url).isNull()
    ok = F.coalesce((status >= 200) & (status < 400), F.lit(False))
    html = F.coalesce(F.contains(F.lower(content_type), F.lit("html")), F.lit(False))
    return F.when(bad, "bad_url").when(~F.coalesce(allowed, F.lit(True)), "robots_disallow").when(~ok, "unreachable").when(~html, "not_html")


def robots_allow(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """urls: url. Adds ``allowed``; robots: origin, body. A site without robots.txt allows everything."""

    @F.pandas_udf("boolean")
    def allowed(url: pd.Series, body: pd.Series) -> pd.Series:
        parsers: dict[str, RobotFileParser] = {}
        out = []
        for u, b in zip(url, body, strict=True):
            if b is None:
                out.append(True)
                continue
            if b not in parsers:
                parsers[b] = RobotFileParser()
                parsers[b].parse(b.splitlines())
            out.append(parsers[b].can_fetch(agent, u))
        return pd.Series(out)

    origin = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    return urls.withColumn("origin", origin).join(robots, "origin", "left").withColumn("allowed", allowed("url", "body")).drop("origin", "body")


def crawl(sites: DataFrame, fetched: DataFrame, max_pages: int = 4) -> DataFrame:
    """What a crawl of each site gives from landed responses: the home page, then its contact pages in order of rank while the budget of
    ``max_pages`` lasts. A page that cannot be read costs nothing and stops nothing; a home page that cannot be read is the outcome.

    sites: id, url. fetched: url, final_url, allowed, status, content_type, html. One row a site: id, error (``bad_url``, ``robots_disallow``,
    ``unreachable``, ``not_html``, ``crashed`` for a page whose text could not be decoded, or NULL), pages_visited and the columns of ``site_contacts``.
    """
    got = fetched.dropDuplicates(["url"]).select(
        F.col("url").alias("_asked"), F.coalesce("final_url", "url").alias("_final"), "allowed", "status", "content_type", "html"
    )
    asked = sites.select("id", "url", X.normalize_url(F.col("url")).alias("_asked"))
    home = asked.join(got, "_asked", "left").withColumn("error", outcome(F.col("url"), F.col("allowed"), F.col("status"), F.col("content_type")))
    home = home.withColumn("error", F.coalesce("error", F.when(F.col("html").isNull(), "crashed")))
    first = home.where("error is null").select("id", F.lit(0).alias("seq"), F.col("_final").alias("url"), "html")
    linked = first.select("id", F.posexplode(F.slice(harvest("html", "url")["contact_pages"], 1, max_pages - 1)).alias("at", "_asked"))
    more = linked.join(got, "_asked").where(outcome(F.col("_asked"), F.col("allowed"), F.col("status"), F.col("content_type")).isNull() & F.col("html").isNotNull())
    pages = first.unionByName(more.select("id", (F.col("at") + 1).alias("seq"), F.col("_final").alias("url"), "html"))
    visited = pages.groupBy("id").agg(F.count("*").cast("int").alias("pages_visited"))
    result = home.select("id", "error").join(visited, "id", "left").join(site_contacts(pages), "id", "left")
    return result.withColumn("pages_visited", F.coalesce("pages_visited", F.lit(0)))


def site_contacts(pages: DataFrame, phones: int = 5) -> DataFrame:
    """pages: id, seq, url, html. One row a site: phones, emails, socials, automation, in order of pages and of kinds of evidence."""
    h = pages.withColumns({"h": harvest("html", "url"), "automation": detect_automation(F.col("html"))})
    known = lambda a: F.filter(F.transform(a, lambda p: X.normalize_phone(p)), lambda p: p.isNotNull())
    ld_mail = F.filter("h.ld_emails", lambda m: X.email_accepted(m) & m.rlike(r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,24}$"))
    found = h.select(
        "id", "seq", F.concat(known(X.tel_links(F.col("html"))), known(F.col("h.ld_phones")), X.find_phones(F.col("h.visible_text"), phones)).alias("phones"),
        F.concat(ld_mail, X.find_emails(F.col("html"))).alias("emails"), F.col("h.socials").alias("socials"), "automation", F.col("h.contact_pages").alias("contact_pages"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("seq", "phones", "emails", F.map_entries("socials").alias("s"), F.map_entries("automation").alias("a"))))
    site = found.groupBy("id").agg(ordered.alias("p"))
    flat = lambda f: F.flatten(F.transform("p", lambda x: x[f]))

    def first_wins(entries: Column) -> Column:
        keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(entries, lambda e: e["key"] == k)[0]["value"]))

    def union(entries: Column) -> Column:
        keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        values = lambda k: F.array_distinct(F.flatten(F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"])))
        return F.map_from_arrays(keys, F.transform(keys, values))

    return site.select(
        "id", F.array_distinct(flat("phones")).alias("phones"), F.array_distinct(flat("emails")).alias("emails"), first_wins(flat("s")).alias("socials"),
        union(flat("a")).alias("automation"),
    )
