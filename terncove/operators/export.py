"""Lead rows for people and programs: a flat projection, CSV, JSON, append-only logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.rules import contact_score, describe_automation
from ..functions.text import strip
from .merge import apply_sheet

PRIMARY = ["instagram", "facebook", "telegram"]


def export_rows(leads: DataFrame) -> DataFrame:
    """29 text columns in a fixed order; NULL is the empty string, flags are 0 and 1, notes are one line."""
    have = set(leads.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    flag = lambda c: F.coalesce(F.col(c).cast("int").cast("string"), F.lit("")) if c in have else F.lit("")
    socials = F.col("socials") if "socials" in have else F.lit(None).cast("map<string,string>")
    social = lambda k: F.coalesce(F.try_element_at(socials, F.lit(k)), F.lit(""))
    other = F.transform(F.map_entries(F.map_filter(socials, lambda k, _: ~k.isin(PRIMARY))), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    labels = F.create_map(*[F.lit(x) for kv in C.CRM_LABELS.items() for x in kv])
    special: dict[str, Column] = {
        "email_valid": flag("email_valid"), "has_automation": flag("has_automation"), **{k: social(k) for k in PRIMARY},
        "other_socials": F.coalesce(F.array_join(other, ", "), F.lit("")),
        "automation": describe_automation(F.col("automation") if "automation" in have else F.lit(None).cast("map<string,array<string>>")),
        "contact_score": contact_score(F.col("phone"), F.col("email"), F.col("website"), socials).cast("string"),
        "crm_status": labels[F.coalesce("crm_status", F.lit("new"))],
        "merged_ids": F.coalesce(F.array_join("merged_ids", ", "), F.lit("")) if "merged_ids" in have else F.lit(""),
        "last_verified_at": F.coalesce(F.date_format("last_verified_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")),
        "notes": strip(F.replace(text("notes"), F.lit("\n"), F.lit(" "))),
    }
    return leads.select(*[special.get(c, text(c)).alias(c) for c in C.EXPORT_COLUMNS])


def write_csv(rows: DataFrame, path: str) -> None:
    """A directory of CSV parts, each with a header that begins with a byte order mark, for spreadsheet programs."""
    marked = rows.withColumnRenamed(rows.columns[0], "﻿" + rows.columns[0])
    marked.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line; other scripts stay readable."""
    rows.write.mode("overwrite").json(path)


def append(rows: DataFrame, path: str) -> None:
    """Run logs, events and call counts are appended and summed when read."""
    rows.write.mode("append").parquet(path)


def sheet_rows(leads: DataFrame, fields: list[str]) -> DataFrame:
    """What a sheet is overwritten with: all leads in order of their ids."""
    return leads.orderBy("id").select(*fields)


def sync(leads: DataFrame, sheet: DataFrame, edited: list[str], fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pull, then push: leads with what was edited in the sheet, and the rows that the sheet is overwritten with."""
    pulled = apply_sheet(leads, sheet, edited)
    return pulled, sheet_rows(pulled, fields)


def write_json_array(rows: DataFrame, path: str) -> None:
    """One pretty JSON array as one text file, for people: the rows of one export, gathered in one task."""
    texts = rows.select(F.to_json(F.struct(*rows.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).coalesce(1)

    def joined(batches):
        yield pd.DataFrame({"value": ["["]})
        before = None
        for pdf in batches:
            for value in pdf["value"]:
                if before is not None:
                    yield pd.DataFrame({"value": [before + ","]})
                before = value
        yield pd.DataFrame({"value": ([] if before is None else [before]) + ["]"]})

    texts.mapInPandas(joined, "value string").write.mode("overwrite").text(path)


def snapshot(rows: DataFrame, path: str) -> None:
    rows.orderBy("id").write.mode("overwrite").parquet(path)
