"""Leads and queue items as tables that several writers change: a base, small deltas by key, and one manifest for each version.

A change writes only its own rows, as a delta; a reader takes the newest row of each key, and of the base the keys that no delta has. A version exists
when its manifest does. Manifests are put only where none is (a hard link on one machine, an exclusive rename elsewhere), so of two writers that start from the
same version one loses: it rebases if the other changed other keys and its own change holds whatever they are, else it must decide anew.

Files are never changed; deltas are folded into a new base once ``FAN_IN`` have gathered. The folder has to be one that all writers share, on a file system whose
rename refuses an existing target (HDFS does; plain object stores do not).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import cut
from .merge import new_id, upsert
from .queue import claim

FAN_IN = 8


class Conflict(Exception):
    """Another writer was first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *[p for p in parts if p]]))

    # --- manifests
    def version(self) -> int:
        """The newest version; -1 where there is no table."""
        if not self._fs.exists(self._path("log")):
            return -1
        return max((int(f.getPath().getName().split(".")[0]) for f in self._fs.listStatus(self._path("log")) if f.getPath().getName().endswith(".json")), default=-1)

    def manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path("log", f"{version:012}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, version: int, manifest: dict) -> None:
        """Make ``version`` exist with this content, or find that it does already."""
        waiting, final = self._path("log", f"{uuid.uuid4().hex}.waiting"), self._path("log", f"{version:012}.json")
        stream = self._fs.create(waiting, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        try:
            if self._fs.getScheme() == "file":
                local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(local(final), local(waiting))
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                options = self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context.rename(waiting, final, options)
        except Exception as error:
            if self._fs.exists(final):
                raise Conflict(f"version {version} exists") from error
            raise
        finally:
            self._fs.delete(waiting, False)

    # --- rows
    def _write(self, rows: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def create(self, rows: DataFrame) -> int:
        self._put(0, {"base": self._write(rows), "deltas": [], "schema": rows.schema.json()})
        return 0

    def _rows(self, manifest: dict, name: str) -> DataFrame:
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(manifest["schema"]))).parquet(f"{self.path}/{name}")

    def _newest(self, manifest: dict) -> DataFrame | None:
        """The newest row of each key that a delta has."""
        parts = [self._rows(manifest, name).withColumn("_at", F.lit(at)) for at, name in enumerate(manifest["deltas"])]
        if not parts:
            return None
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        columns = [c for c in every.columns if c != "_at"]
        return every.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*columns), "_at").alias("_row")).select("_row.*")

    def read(self, version: int | None = None) -> DataFrame:
        manifest = self.manifest(self.version() if version is None else version)
        base, newest = self._rows(manifest, manifest["base"]), self._newest(manifest)
        if newest is None:
            return base
        # Spark broadcasts the keys of the deltas as long as they are few, and sorts both sides beyond
        return base.join(newest.select(self.key), self.key, "left_anti").select(*newest.columns).unionByName(newest)

    def commit(self, changes: DataFrame, read_version: int, rebase: bool = True) -> int:
        """Add ``changes`` (whole rows, one a key) that were decided on ``read_version``. With ``rebase`` versions in between do not matter unless they
        changed one of the same keys; without, any does."""
        schema = self.manifest(read_version)["schema"]
        name = self._write(changes.select(*[f["name"] for f in json.loads(schema)["fields"]]))
        seen = read_version
        while True:
            now = self.version()
            if now > seen:
                between = self.manifest(now)["deltas"][len(self.manifest(read_version)["deltas"]) :] if rebase else None
                folded = self.manifest(now)["base"] != self.manifest(read_version)["base"]
                if between is None or folded or self._overlap(name, between, self.manifest(now)):
                    self._fs.delete(self._path(name), True)
                    raise Conflict(f"version {read_version} is not the newest")
                seen = now
            latest = self.manifest(seen)
            try:
                self._put(seen + 1, latest | {"deltas": [*latest["deltas"], name]})
                return seen + 1
            except Conflict:
                continue  # look at what came in between

    def _overlap(self, name: str, others: list[str], manifest: dict) -> bool:
        mine = self._rows(manifest, name).select(self.key)
        return any(not mine.join(self._rows(manifest, o).select(self.key), self.key, "left_semi").isEmpty() for o in others)

    def compact(self, fan_in: int = FAN_IN) -> int:
        """A new base once ``fan_in`` deltas have gathered; a writer that comes first wins, and compaction is left to the next."""
        version = self.version()
        manifest = self.manifest(version)
        if len(manifest["deltas"]) < fan_in:
            return version
        name = self._write(self.read(version))
        try:
            self._put(version + 1, manifest | {"base": name, "deltas": []})
            return version + 1
        except Conflict:
            self._fs.delete(self._path(name), True)
            return version


def decided(table: VersionedTable, change: Callable[[DataFrame], DataFrame], rebase: bool, tries: int = 50) -> DataFrame:
    """Commit ``change(rows of the table)``; decided anew on newer rows after each conflict. Returns the rows that were written."""
    for _ in range(tries):
        version = table.version()
        rows = cut(change(table.read(version)))
        if rows.isEmpty():
            return rows
        try:
            table.commit(rows, version, rebase)
            table.compact()
            return rows
        except Conflict:
            continue
    raise Conflict(f"lost against other writers {tries} times")


def upsert_into(table: VersionedTable, found: DataFrame) -> DataFrame:
    """``merge.upsert`` of discovered rows into a table of leads (key osm_id): only leads that are new or get something are written. Returns these, with ``outcome``."""
    outcomes: list[DataFrame] = []

    def change(leads: DataFrame) -> DataFrame:
        touched = leads.join(found.select("osm_id").distinct(), "osm_id", "left_semi").select(*leads.columns)
        merged = upsert(touched, found).where("outcome <> 'same'").withColumn("id", F.coalesce("id", new_id(F.col("osm_id"))))
        outcomes[:] = [cut(merged)]
        return outcomes[0].drop("outcome")

    decided(table, change, rebase=True)
    return outcomes[0]


def claim_from(table: VersionedTable, limit: int, now, cap: int = 20, ttl_minutes: int = 120) -> DataFrame:
    """``queue.claim`` on a table of items (key id) that several writers claim from at once. The cap concerns all items, so whoever is not first decides anew.
    Returns the claimed items."""
    return decided(table, lambda items: claim(items, limit, now, cap, ttl_minutes).where("claimed_now").drop("claimed_now"), rebase=False)
