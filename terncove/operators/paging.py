"""Pages of a long sorted list without sorting it for each: a snapshot in ranges of the order, and how many rows each range has.

The snapshot is one sort: ranges of the order are written by tasks of their own, sorted inside, into folders named by range. The counts are a few numbers, so a page knows which ranges
hold it, and reads these folders only, however deep it is.
"""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.cut import shared_folder

#: Rows of a range, about.
RANGE_ROWS = 100_000


class Snapshot:
    """``rows`` in the order of ``order`` (columns of ``rows`` made by ``keys``), kept at ``path``."""

    def __init__(self, spark: SparkSession, path: str, counts: list[int], keys: list[str], schema: StructType):
        self.spark, self.path, self.counts, self.keys, self.schema = spark, path, counts, keys, schema

    @classmethod
    def take(cls, rows: DataFrame, order: list[Column], path: str | None = None, range_rows: int = RANGE_ROWS) -> Snapshot:
        spark = rows.sparkSession
        path = path or f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
        keys = [f"_key{k}" for k in range(len(order))]
        keyed = rows.withColumns(dict(zip(keys, order, strict=True)))
        n = max(1, -(-rows.count() // range_rows))
        ranged = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id())
        ranged.write.partitionBy("_range").parquet(path)
        written = spark.read.schema(ranged.schema).parquet(path)
        told = {r["_range"]: r["n"] for r in written.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # a number a range
        return cls(spark, path, [told.get(k, 0) for k in range(n)], keys, keyed.schema)

    def total(self) -> int:
        return sum(self.counts)

    def ranges_of(self, offset: int, limit: int) -> list[tuple[int, int]]:
        """(range, number of rows before it) of the ranges that the rows offset to offset + limit lie in."""
        before = [0, *accumulate(self.counts)]
        return [(k, before[k]) for k, n in enumerate(self.counts) if n and before[k] < offset + limit and before[k] + n > offset]

    def page(self, offset: int, limit: int) -> DataFrame:
        """The rows offset to offset + limit of the list, in order. The key columns make the order; equal keys keep no order of their own."""
        held = self.ranges_of(max(0, offset), max(0, limit))
        shown = [F.col(c) for c in self.schema.names if c not in self.keys]
        if not held:
            return self.spark.createDataFrame([], self.schema).select(*shown)
        part = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/_range={k}" for k, _ in held])
        return part.orderBy(*self.keys).offset(max(0, offset) - held[0][1]).limit(limit).select(*shown)
