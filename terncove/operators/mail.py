"""Whether an address's domain takes mail: verdicts are a table by domain, asked once a domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import email_domain


def verdicts(answers: DataFrame) -> DataFrame:
    """domain, ok from landed DNS answers: domain, mx_status (``ok``, ``no_answer``, ``nxdomain``, ``timeout``, ...), mx (host names), a_status.

    Mail goes to MX hosts, or to the domain's address if it has no MX record at all; a timeout confirms nothing. Of several answers for a
    domain one that confirms is enough.
    """
    direct = (F.col("mx_status") == "ok") & (F.coalesce(F.size("mx"), F.lit(0)) > 0)
    fallback = F.col("mx_status").isin("no_answer", "nxdomain") & (F.col("a_status") == "ok")
    ok = F.coalesce(direct | fallback, F.lit(False))
    return answers.groupBy(F.lower("domain").alias("domain")).agg(F.max(ok).alias("ok"))


def domains_to_ask(leads: DataFrame, verdicts: DataFrame) -> DataFrame:
    domains = leads.select(email_domain(F.col("email")).alias("domain")).where("domain is not null").distinct()
    return domains.where(~F.col("domain").isin(C.KNOWN_MAIL_DOMAINS)).join(verdicts, "domain", "left_anti")


def apply_verdicts(leads: DataFrame, verdicts: DataFrame) -> DataFrame:
    """verdicts: domain, ok. email_valid becomes true, false (also where a verdict is missing), or stays NULL without an @."""
    both = leads.withColumn("domain", email_domain(F.col("email"))).join(verdicts, "domain", "left")
    ok = F.when(F.col("domain").isin(C.KNOWN_MAIL_DOMAINS), True).otherwise(F.coalesce("ok", F.lit(False)))
    return both.withColumn("email_valid", F.when(F.col("domain").isNotNull(), ok)).select(*dict.fromkeys([*leads.columns, "email_valid"]))


def tally(leads: DataFrame) -> DataFrame:
    return leads.agg(F.count_if(F.col("email_valid")).alias("good"), F.count_if(~F.col("email_valid")).alias("bad"))
