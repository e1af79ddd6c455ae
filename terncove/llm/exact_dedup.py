"""Exact dedup with counting quotient filters.

1. One pass gives each row a persisted narrow record: row number, doc_id, 64-bit fingerprint, SHA-256 of the text.
2. Each partition builds a counting quotient filter of its fingerprints for every segment (the top bits of a fingerprint). The next
   bits (quotient) choose the slot, the remaining bits (remainder) are kept sorted inside it, with a count. What leaves the task are
   used slots, run lengths, remainders cut to their bytes, and counts; never whole fingerprints.
3. Filters of one segment merge without loss, two at a time: their remainders are sorted, so equal ones meet and counts add up.
4. Fingerprints with a count above one route to byte verification: whole texts that a fixed-size filter of these fingerprints
   lets pass (``store.sift``) are grouped by their bytes (partial aggregation first, so a text that half the rows share leaves each task once).
5. The verified groups join the narrow records; all other rows stand for themselves.

Defined results: a null text equals the empty one; the row with the largest doc_id of a group stays (nulls last); if that
doc_id and text are repeated, one of these rows stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches, trimmed
from .store import decide, materialize, sieve, sift, unused

SEGMENT_KEYS = 250_000
LOAD = 4  # remainders of a slot of a full segment, on average
FLUSH = 1_000_000  # fingerprints of a filter that leaves a task
ROW = "segment int, slots binary, runs binary, remainders binary, counts binary"


def _squash(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned integers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _restore(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


class CountingQuotientFilter:
    """The fingerprints of one segment: ``slots`` in use (ascending quotients), the length of each one's run, the remainders, sorted inside
    their slot, and how often each occurs. ``segment_bits`` top bits are the segment's, ``slot_bits`` the quotient's."""

    def __init__(self, segment_bits: int, slot_bits: int, slots: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.segment_bits, self.slot_bits = segment_bits, slot_bits
        self.slots, self.runs, self.remainders, self.counts = slots, runs, remainders, counts

    @classmethod
    def of(cls, segment_bits: int, slot_bits: int, keys: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """``keys``: ascending distinct uint64 without the segment's bits."""
        rest = np.uint64(64 - segment_bits - slot_bits)
        slots, runs = np.unique(keys >> rest, return_counts=True) if slot_bits else (np.zeros(min(1, len(keys)), np.uint64), np.array([len(keys)][: len(keys)]))
        return cls(segment_bits, slot_bits, slots, runs.astype(np.uint64), keys & np.uint64((1 << int(rest)) - 1), counts.astype(np.uint64))

    @property
    def width(self) -> int:
        """Bytes of a remainder."""
        return -(-(64 - self.segment_bits - self.slot_bits) // 8)

    def keys(self) -> np.ndarray:
        """Quotients and remainders put together again, ascending."""
        if not self.slot_bits:
            return self.remainders
        return np.repeat(self.slots, self.runs.astype(np.int64)) << np.uint64(64 - self.segment_bits - self.slot_bits) | self.remainders

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """The fingerprints of both with their counts added, by merging two sorted runs."""
        mine, theirs = self.keys(), other.keys()
        if not len(mine) or not len(theirs):
            return self if len(mine) else other
        at = np.searchsorted(mine, theirs)
        met = mine[np.minimum(at, len(mine) - 1)] == theirs
        counts = self.counts.copy()
        counts[at[met]] += other.counts[met]
        keys, counts = np.insert(mine, at[~met], theirs[~met]), np.insert(counts, at[~met], other.counts[~met])
        return self.of(self.segment_bits, self.slot_bits, keys, counts)

    def repeated(self) -> np.ndarray:
        return self.keys()[self.counts > 1]

    def row(self) -> tuple[bytes, bytes, bytes, bytes]:
        gaps = np.diff(self.slots, prepend=np.uint64(0))
        return _squash(gaps, 4), _squash(self.runs, 4), _squash(self.remainders, self.width), _squash(self.counts, 8)

    @classmethod
    def read(cls, segment_bits: int, slot_bits: int, slots: bytes, runs: bytes, remainders: bytes, counts: bytes) -> CountingQuotientFilter:
        width = -(-(64 - segment_bits - slot_bits) // 8)
        return cls(segment_bits, slot_bits, np.cumsum(_restore(slots, 4), dtype=np.uint64), _restore(runs, 4), _restore(remainders, width), _restore(counts, 8))


def partition_filters(fingerprints: np.ndarray, segment_bits: int, slot_bits: int) -> list[tuple]:
    """``fingerprints``: uint64, repeats allowed. (segment, *row) of the filter of each segment that has any."""
    keys, counts = np.unique(fingerprints, return_counts=True)
    segments = (keys >> np.uint64(64 - segment_bits)).astype(np.int64) if segment_bits else np.zeros(len(keys), np.int64)
    heads = np.flatnonzero(np.r_[True, segments[1:] != segments[:-1]]) if len(keys) else []
    inner = keys & np.uint64((1 << (64 - segment_bits)) - 1)
    rows = []
    for lo, hi in zip(heads, np.r_[heads[1:], len(keys)] if len(heads) else [], strict=True):
        rows.append((int(segments[lo]), *CountingQuotientFilter.of(segment_bits, slot_bits, inner[lo:hi], counts[lo:hi]).row()))
    return rows


def merged(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
    while len(filters) > 1:
        filters = [a.merge(b) for a, b in zip(filters[::2], filters[1::2], strict=False)] + ([filters[-1]] if len(filters) % 2 else [])
    return filters[0]


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """Column ``fp`` (long) of values that occur more than once in column ``fp`` of the input."""
    small_batches(fingerprints.sparkSession)
    segment_bits = max(0, int(np.ceil(np.log2(max(1, rows / SEGMENT_KEYS)))))
    slot_bits = max(0, int(np.log2(max(1, min(rows, SEGMENT_KEYS) / LOAD))))
    names = [c.split()[0] for c in ROW.split(", ")]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for pdf in batches:
            held.append(pdf["fp"].to_numpy(np.int64).view(np.uint64))
            if sum(map(len, held)) >= FLUSH:
                yield pd.DataFrame(partition_filters(np.concatenate(held), segment_bits, slot_bits), columns=names)
                held.clear()
        if held:
            yield pd.DataFrame(partition_filters(np.concatenate(held), segment_bits, slot_bits), columns=names)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        one = merged([CountingQuotientFilter.read(segment_bits, slot_bits, *r[1:]) for r in pdf[names].itertuples(index=False)])
        top = np.uint64(int(pdf["segment"].iloc[0]) << (64 - segment_bits) if segment_bits else 0)
        return pd.DataFrame({"fp": (one.repeated() | top).view(np.int64)})

    return fingerprints.select("fp").mapInPandas(trimmed(build), ROW).groupBy("segment").applyInPandas(merge, "fp long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    narrow = materialize(
        base.select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            F.xxhash64("text").alias("fp"),
            F.unhex(F.sha2("text", 256)).alias("sha"),
        ),
        "exact-rows",
    )
    repeated = materialize(repeated_fingerprints(narrow, narrow.count()), "exact-repeated")
    marked = sieve(repeated, F.col("fp"))
    suspects = sift(base.select(F.xxhash64("text").alias("fp"), "text"), marked, F.col("fp"))
    same_bytes = suspects.groupBy("fp", "text").agg(F.count("*").alias("group_size")).where("group_size > 1")
    verified = same_bytes.select(F.unhex(F.sha2("text", 256)).alias("sha"), "group_size")
    top = sift(narrow, marked, F.col("fp")).groupBy("sha").agg(F.max(F.struct(F.col("doc_id"), "rid")).alias("top"))
    groups = materialize(
        verified.join(top, "sha").select("sha", "group_size", F.col("top.doc_id").alias("keep_id"), F.col("top.rid").alias("keep_rid")),
        "exact-groups",
    )
    joined = narrow.join(groups, "sha", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    groups = materialize(exact_groups(docs, id_col, text_col).where("group_size > 1"), "exact-decisions")
    # a group's rows share the text hash; those that repeat the kept id as well need a choice between equal rows
    keys = groups.groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_fp")).agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    keys = materialize(keys, "exact-keys")
    gone, twice = keys.where("not stays or n > 1").select("_id", "_fp"), keys.where("stays and n > 1").select("_id", "_fp")
    sha = lambda text: F.sha2(F.coalesce(text, F.lit("")), 256)
    rest = decide(docs, gone, "left_anti", id_col, text_col, sha)
    if twice.isEmpty():
        return rest
    key_id, key_fp = unused(docs, "_key_id", "_key_fp")
    equal = decide(docs, twice, "inner", id_col, text_col, sha).withColumns({key_id: F.col(id_col), key_fp: sha(F.col(text_col))})
    return rest.unionByName(equal.dropDuplicates([key_id, key_fp]).drop(key_id, key_fp))


def op8_exact_dedup(spark, sf_dir):
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
select doc_id,
       max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id is not distinct from max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""
