"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring. A row's key falls into the arc before a point and belongs to that point's
shard. A shard has a fixed number of places; keys for which it has none continue clockwise to the next point whose shard
has one. With places that add up to the number of rows (``rows // shards`` each, one more for the first
``rows % shards`` shards) every shard ends up exactly full, so counts differ by one at most (law ``rows``).

How it is distributed: which key of an arc stays and which moves on depends only on the key's rank within the arc, and
how many move only on the arcs' counts. So one aggregation counts keys by (arc, slice of the arc), the driver walks the
ring over those counts (``shards * vnodes * SLICES`` numbers, whatever the input size), and each row finds its place from
its rank within its slice and a broadcast table of that same fixed size. Only ids, sizes and checksums are shuffled, never
texts, and a slice holds about ``1 / (shards * vnodes * SLICES)`` of all rows because keys are hashed.

Defined results: a null text has size 1 and checksum 0 like an empty one; a null ``doc_id`` is a key of its own; rows that
repeat a ``doc_id`` are spread by their checksum and get distinct slots; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64
RING_BITS = 52
CELL_BITS = 9


def _position(*cols):
    """A point of the ring in [0, 2**52) from the md5 of the joined strings."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *cols)), 1, 13), 16, 10).cast("long")


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of each virtual node in clockwise order."""
    import hashlib

    return sorted(
        (int(hashlib.md5(f"shard/{s}/{v}".encode()).hexdigest()[:13], 16), s) for s in range(shards) for v in range(vnodes)
    )


def cell_arcs(points: list[int]) -> list[tuple[int, int, int, int]]:
    """(cell, from, to, arc): for each of the ring's equal cells the stretches [from, to) of the arcs that cross it.

    Arc a ends at point a; what lies after the last point belongs to arc 0.
    """
    width, out = 1 << (RING_BITS - CELL_BITS), []
    stretches = [(lo, hi, a % len(points)) for a, (lo, hi) in enumerate(zip([0, *(p + 1 for p in points)], [*(p + 1 for p in points), 1 << RING_BITS], strict=True))]
    for lo, hi, arc in stretches:
        out += [(c, max(lo, c * width), min(hi, (c + 1) * width), arc) for c in range(lo // width, (hi - 1) // width + 1) if lo < hi]
    return out


def walk_ring(counts: list[int], owners: list[int], places: list[int]) -> list[list[tuple[int, int]]]:
    """For each arc the (shard, number of keys) it fills, in the order in which its keys are dealt.

    Round by round each arc offers what is left of its keys to the next point clockwise, beginning with its own; within a
    round arcs are served in ring order.
    """
    free, left, n = list(places), list(counts), len(counts)
    out: list[list[tuple[int, int]]] = [[] for _ in counts]
    waiting = [a for a in range(n) if left[a]]
    for step in range(n):
        if not waiting:
            break
        for a in waiting:
            shard = owners[(a + step) % n]
            if took := min(left[a], free[shard]):
                out[a].append((shard, took))
                left[a] -= took
                free[shard] -= took
        waiting = [a for a in waiting if left[a]]
    return out


def shard_documents(docs: DataFrame, shards: int = 16, vnodes: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _position(F.lit("key"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("_pos"),
    )
    points = ring_points(shards, vnodes)
    arcs_by_cell = F.broadcast(spark.createDataFrame(cell_arcs([p for p, _ in points]), "_cell int, _from long, _to long, _arc int"))
    keyed = keyed.withColumn("_cell", F.shiftright("_pos", RING_BITS - CELL_BITS).cast("int")).join(arcs_by_cell, "_cell")
    keyed = keyed.where((F.col("_pos") >= F.col("_from")) & (F.col("_pos") < F.col("_to"))).drop("_cell", "_from", "_to")
    fine = F.xxhash64(F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.lit(7))  # rows that repeat an id spread too
    keyed = keyed.withColumn("_slice", F.pmod(fine, F.lit(SLICES)).cast("int"))
    counted = {
        (r["_arc"], r["_slice"]): r["n"] for r in keyed.groupBy("_arc", "_slice").agg(F.count("*").alias("n")).collect()
    }  # at most shards * vnodes * SLICES rows
    total = sum(counted.values())
    places = [total // shards + (s < total % shards) for s in range(shards)]
    arcs = [sum(counted.get((a, s), 0) for s in range(SLICES)) for a in range(len(points))]
    dealt = walk_ring(arcs, [s for _, s in points], places)
    used = [0] * shards
    segments = []
    for a, parts in enumerate(dealt):
        bounds, at = [], 0
        for shard, n in parts:
            bounds.append((at, at + n, shard, used[shard]))
            used[shard] += n
            at += n
        at = 0
        for s in range(SLICES):
            n = counted.get((a, s), 0)
            for lo, hi, shard, base in bounds:  # the part of this slice that the segment covers
                if (first := max(lo, at)) < (last := min(hi, at + n)):
                    segments.append((a, s, first - at, last - at, shard, base + first - lo))
            at += n
    table = spark.createDataFrame(segments, "_arc int, _slice int, _lo long, _hi long, shard int, _base long")
    ranked = keyed.withColumn(
        "_rank",
        F.row_number().over(Window.partitionBy("_arc", "_slice").orderBy("_pos", "doc_id", "text_crc32", "size")) - 1,
    )
    inside = (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    joined = ranked.join(F.broadcast(table), ["_arc", "_slice"]).where(inside)
    return joined.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_base") + F.col("_rank") - F.col("_lo")).cast("long").alias("slot")
    )


def op3_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
