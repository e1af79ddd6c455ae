"""Filter interaction audit: what each filter removes in every order of application, from one histogram of failure masks a part.

1. Each document gets a mask, one bit a filter that it fails, computed once over its whole text by built-in functions.
2. Masks are counted by part: all documents, those labelled good, those labelled toxic. That is all a filter order can depend on.
3. The three histograms of every part are stacked as rows of an integer matrix and multiplied by matrices with one row a mask (32 for
   five filters) and one column a step of an order (5! x 5 = 600): kept, removed, redundant and unique outcomes. Removed, summed over
   the columns of a filter, gives its Shapley count.

Equal texts: rows are reduced to (digest, part, mask) with counts and the smallest doc_id before digests meet in a shuffle, so a text
that a third of all rows share leaves each task as one row a part. Texts are never shuffled; SHA-256 stands for a text.

Defined results: a null text counts as empty; a null part is the empty string, together with parts that are empty; a null doc_id is
neither smaller nor larger than another, so its row never fails the copy filter and has no labels; rows that repeat a doc_id count each,
and none is a copy of the other; a document is good (toxic) if any of its label rows says 1; labels of unknown documents are ignored;
an empty table has no parts and gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts whose histograms are multiplied at once.
STACK = 64
OUTCOMES = ("kept", "removed", "redundant", "unique")
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def capitals(text: Column) -> Column:
    """Number of characters A to Z."""
    return F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))


def few_words(text: Column) -> Column:
    return F.size(words(text)) < 50


def repetitive(text: Column) -> Column:
    return 100 * F.size(F.array_distinct(words(text))) < 65 * F.size(words(text))


def shouting(text: Column) -> Column:
    return 100 * capitals(text).cast("long") > 5 * F.length(text).cast("long")


def symbols(text: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: Letter of a filter and its failure condition; None stands for being identical to the text of a smaller doc_id.
FILTERS: dict[str, Callable[[Column], Column] | None] = {"A": few_words, "B": repetitive, "C": shouting, "D": symbols, "E": None}


def orders(letters: str) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


def outcome_matrices(letters: str) -> dict[str, np.ndarray]:
    """For each outcome a 0/1 matrix: one row a mask (bit i: fails ``letters[i]``), one column a step of an order, orders first."""
    masks = np.arange(1 << len(letters))[:, None, None]
    bits = np.array([[1 << letters.index(c) for c in order] for order in orders(letters)])
    before = np.cumsum(bits, axis=1) - bits  # the filters of earlier steps
    fails, gone = (masks & bits) != 0, (masks & before) != 0
    made = {"kept": ~(fails | gone), "removed": fails & ~gone, "redundant": fails & gone, "unique": (masks == bits) & (bits > 0)}
    return {k: np.ascontiguousarray(m.reshape(len(masks), -1).astype(np.int64)) for k, m in made.items()}


def shapley_matrix(letters: str, removed: np.ndarray) -> np.ndarray:
    """``removed`` summed over all columns of the same filter, in each of them."""
    at = np.array([letters.index(c) for order in orders(letters) for c in order])
    same = (at[:, None] == np.arange(len(letters))).astype(np.int64)
    return removed @ same @ same.T


def mask_histograms(
    docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """Columns part, mask, n, good, toxic: how many documents of a part fail exactly the filters of ``mask``."""
    if sum(f is None for f in filters.values()) > 1:
        raise ValueError("only one filter can stand for copies")
    bit = {letter: 1 << i for i, letter in enumerate(filters)}
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    own = F.lit(0)
    for letter, fails in filters.items():
        if fails is not None:
            own = own + F.when(fails(F.col("text")), bit[letter]).otherwise(0)
    narrow = base.select(
        "doc_id", "part", own.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("sha"),
        F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0).alias("salt"),  # rows without an id are spread
    )
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = known.withColumn("salt", F.lit(0).cast("long"))
    rows = narrow.join(known, ["doc_id", "salt"], "left")
    count = [F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")]
    copies = next((bit[letter] for letter, fails in filters.items() if fails is None), None)
    if copies is None:
        return rows.groupBy("part", "mask").agg(*count)
    by_id = rows.groupBy("doc_id", "salt", "sha", "part", "mask").agg(*count)  # partitioned by the join already
    named = F.col("doc_id").isNotNull().alias("named")
    by_text = by_id.groupBy("sha", "part", "mask", named).agg(
        *[F.sum(c).alias(c) for c in ("n", "good", "toxic")], F.min(F.struct("doc_id", "n", "good", "toxic")).alias("first")
    )
    least = F.min(F.when(F.col("named"), F.col("first.doc_id"))).over(Window.partitionBy("sha"))  # a row a part and text
    entry = lambda mask, of: F.struct(mask.alias("mask"), *[of(c).cast("long").alias(c) for c in ("n", "good", "toxic")])
    mask, zero = F.col("mask"), F.lit(0)
    spares = lambda c: F.when(F.col("first.doc_id") == F.col("least"), F.col(f"first.{c}")).otherwise(zero)
    whole = F.array(entry(mask, F.col))
    parted = F.array(entry(mask, spares), entry(mask.bitwiseOR(F.lit(copies)), lambda c: F.col(c) - spares(c)))
    spread = by_text.withColumn("least", least).select("part", F.explode(F.when(F.col("named"), parted).otherwise(whole)).alias("e"))
    return spread.select("part", "e.*").groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def interactions(histograms: DataFrame, letters: str) -> DataFrame:
    """One row per part, filter_order and step (``RESULT``) from ``mask_histograms``."""
    stacked = histograms.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 2 ** filters at most

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_outcome = outcome_matrices(letters)
        wide = np.hstack([*(by_outcome[k] for k in OUTCOMES), shapley_matrix(letters, by_outcome["removed"])])
        columns = wide.shape[1] // 5
        steps = np.tile(np.arange(1, len(letters) + 1, dtype=np.int32), columns // len(letters))
        named = np.repeat(np.array(orders(letters), object), len(letters))
        for pdf in batches:
            for at in range(0, len(pdf), STACK):
                piece = pdf.iloc[at : at + STACK]
                h = np.zeros((3, len(piece), 1 << len(letters)), np.int64)
                for i, counts in enumerate(piece["counts"]):
                    for c in counts:
                        h[:, i, c["mask"]] += (c["n"], c["good"], c["toxic"])
                made = (h.reshape(-1, h.shape[2]) @ wide).reshape(3, len(piece), 5, columns)
                kept, removed, redundant, unique, shapley = made[0].transpose(1, 0, 2)
                yield pd.DataFrame({
                    "part": np.repeat(piece["part"].to_numpy(object), columns), "filter_order": np.tile(named, len(piece)), "step": np.tile(steps, len(piece)),
                    "kept": kept.ravel(), "removed": removed.ravel(), "redundant": redundant.ravel(), "unique_fails": unique.ravel(),
                    "good_lost": made[1, :, 1].ravel(), "toxic_lost": made[2, :, 1].ravel(), "shapley": shapley.ravel(),
                })

    return stacked.mapInPandas(multiply, RESULT)


def audit(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Kept, removed, redundant, unique, good and toxic counts of each step of every order of ``filters``, part by part."""
    return interactions(mask_histograms(docs, labels, filters, id_col, text_col, part_col), "".join(filters))


def op11_filter_audit(spark, sf_dir):
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
with recursive orders(filter_order) as (
  select '' union all
  select filter_order || f from orders, (select unnest(['A', 'B', 'C', 'D', 'E']) as f) where not contains(filter_order, f)),
steps as (
  select filter_order, s as step, substr(filter_order, s, 1) as letter, substr(filter_order, 1, s - 1) as earlier
  from orders, (select unnest([1, 2, 3, 4, 5]) as s) where length(filter_order) = 5),
texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
judged as (
  select part, doc_id,
         case when len(words) < 50 then 'A' else '' end ||
         case when 100 * len(list_distinct(words)) < 65 * len(words) then 'B' else '' end ||
         case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) then 'C' else '' end ||
         case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end ||
         case when doc_id > min(doc_id) over (partition by text) then 'E' else '' end as fails
  from texts),
marked as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
counted as (
  select part, fails, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
  from judged left join marked using (doc_id) group by part, fails),
met as (
  select part, filter_order, step, letter, n, good, toxic, contains(fails, letter) as fails_it, fails = letter as only_it,
         regexp_matches(fails, '[' || earlier || '_]') as gone
  from counted, steps),
told as (
  select part, filter_order, step, letter,
         sum(case when fails_it or gone then 0 else n end)::bigint as kept,
         sum(case when fails_it and not gone then n else 0 end)::bigint as removed,
         sum(case when fails_it and gone then n else 0 end)::bigint as redundant,
         sum(case when only_it then n else 0 end)::bigint as unique_fails,
         sum(case when fails_it and not gone then good else 0 end)::bigint as good_lost,
         sum(case when fails_it and not gone then toxic else 0 end)::bigint as toxic_lost
  from met group by part, filter_order, step, letter)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, letter))::bigint as shapley
from told
"""
