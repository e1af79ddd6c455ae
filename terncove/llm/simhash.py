"""SimHash near-dedup with BK-trees.

A document's fingerprint has bit b set if more than half of its shingles' hashes have it. Two fingerprints link at
``radius`` or fewer differing bits; linked documents form components. Links are found by BK-trees over shards of the
fingerprints (``bktree``). The method's usual broadcast of shard trees would grow with the corpus; here a tree lives in the task
that owns the shard and the fingerprints that can have links there are shuffled to it instead, which has no size limit.

A shard reports its components as stars, at most one edge a fingerprint, and ``components`` joins these across shards. Equal
fingerprints are one node, so copies never multiply links.

``drop_near`` keeps one document of each group of near copies: there trees over fingerprints of five-word shingles name pairs, which
count if the shingle sets are similar, and ``jaccard`` looks for the similar pairs that lie beyond the trees' radius.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link like any other; fewer
words than a shingle make one shingle; rows with a null doc_id get a component whose id is the least non-null doc_id in
it (null if none); repeated rows link to each other; an empty table gives an empty result; other columns are ignored by
``near_duplicates`` and passed through by ``drop_near``, which of rows that repeat both id and text keeps all or none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append
from .bktree import near_links
from .components import components
from .fingerprints import simhash
from .jaccard import near_sets
from .store import decide, materialize
from .units import forget


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, fp (long), component_id, class_id (smallest fingerprint), and the ``keep`` columns."""

    base = docs.select(F.col(id_col).alias("doc_id"), *[F.col(k).alias(f"keep_{k}") for k in keep], F.col(text_col).alias("text"))
    adds = [("fp", T.LongType(), pa.int64())]

    def run(texts: list[str | None]) -> dict[str, list]:
        forget()
        return {"fp": simhash(texts, words).view(np.int64)}

    rows = materialize(append(base, run, ["text"], adds, drop=("text",)), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(near_links(distinct, radius))
    rooted = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(first, "root").select("fp", "component_id", F.col("root").alias("class_id"))
    classes = materialize(classes, "components")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id", "class_id", *[F.col(f"keep_{k}").alias(k) for k in keep])


def drop_near(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies (``jaccard.near_sets``), the one with the smallest id, with all its columns."""
    rows = materialize(near_sets(docs, words, id_col, text_col), "near-classes")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_fp").alias("fp"))
    first = rows.groupBy("class_id").agg(F.min(order).alias("first"))
    stays = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_fp").alias("fp")).eqNullSafe(F.col("first"))
    gone = materialize(rows.join(first, "class_id").where(~stays).select("_id", "_fp").distinct(), "near-gone")
    return decide(docs, gone, "left_anti", id_col, text_col)


def op2_simhash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
