"""Substring dedup with a log-structured fingerprint index.

A window is ``size`` consecutive words of one document. The index holds, for every window fingerprint seen so far, the
smallest doc_id and the place where it starts, as immutable runs: fingerprints ascending, cut into segments by their top bits. A
batch of documents becomes sorted runs of the same form, one per block of documents and segment, and each segment
merge-joins them with the index's. A window whose fingerprint starts in a document with a smaller doc_id is a claim (place, earlier
place). What the index lacks of the batch is written as one new run of level 0; when ``FAN_IN`` runs of a level have gathered they
are compacted into one of the next, so a fingerprint is rewritten once a level, as often as the logarithm of the history. The number
of segments follows the number of windows: rows of runs written with fewer segments are split as they are read, and stay so
when they are compacted.

Claims are verified by digests of the words themselves before any word is removed. A claim that fails means that two different
windows have one fingerprint. Then the true repeats among the windows concerned are found by their words, over all texts.

Sizes: a block holds about ``BLOCK_WORDS`` words, and within a block only windows that do not already start in an earlier
document of it leave the task, so a passage that half the documents share sends one window a block. Runs are packed:
fingerprints as differences, about 10 bytes a window in all. A batch shuffles its own windows and the packed index, and writes its own.

Defined results: a null text counts as empty; documents shorter than a window and rows with a null doc_id lose nothing;
rows that repeat a doc_id claim nothing from each other, and a stretch is removed from each of them that has the verified
words at that place; documents judged in earlier batches stay as they were judged; an empty table gives an empty result; other
columns are passed on by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append, small_batches, trimmed
from .store import delete, fresh_path, free_shuffles, materialize, sieve, sift, unused

SIZE = 13
BLOCK_WORDS = 1_000_000
SEGMENT_WINDOWS = 1_500_000
FAN_IN = 3
BATCHES = 3  # of a table that is deduplicated as a whole
REPAIR_KEYS = 500_000  # fingerprints of failed claims that one pass over the texts looks for
LAST = np.iinfo(np.int64).max  # stands for a null doc_id

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


class _Powers:
    """Powers of a number modulo 2**64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.table = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            more = np.full(max(n, 1 << 16) * 2, self.base, np.uint64)
            more[0] = 1
            self.table = np.cumprod(more, dtype=np.uint64)
        return self.table


_UP, _DOWN = _Powers(_MULTIPLIER), _Powers(_INVERSE)
_BYTE = np.frombuffer(hashlib.shake_256(b"window index bytes").digest(256 * 8), np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def split_words(text: str | None) -> list[bytes]:
    """Words are runs of bytes other than ASCII white space, which is what ``bytes.split`` splits at."""
    return text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []


def window_hashes(words: list[bytes], size: int, bits: int = 64) -> np.ndarray:
    """A fingerprint (uint64 with only ``bits`` top bits) of each window's space-joined bytes, from prefix sums of one polynomial."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _UP.upto(len(data))[: len(data)], dtype=np.uint64, out=sums[1:])
    first, last = starts[: len(words) - size + 1], ends[size - 1 :]
    found = _mix((sums[last] - sums[first]) * _DOWN.upto(len(data) + 1)[first] + (last - first).astype(np.uint64))
    return found if bits == 64 else found >> np.uint64(64 - bits) << np.uint64(64 - bits)


def _squash(values: np.ndarray) -> bytes:
    """64-bit integers byte plane by byte plane, compressed: planes that hold little cost little."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _restore(data: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pack(ascending: np.ndarray) -> bytes:
    return _squash(np.diff(ascending, prepend=np.uint64(0)))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_restore(data, np.uint64), dtype=np.uint64)


RUN = "segment int, block string, kind string, keys binary, docs binary, doc_of binary, at binary, from_doc binary, from_at binary"
RUN_COLUMNS = [c.split()[0] for c in RUN.split(", ")]


def _block_runs(size: int, bits: int, block_words: int, batch: int, fingerprint_bits: int):
    """Batches of (doc_id, text) to the runs of blocks, and the claims that a block settles on its own."""

    def emit(held: list[tuple[int, int, np.ndarray]], name: str) -> pd.DataFrame:
        held.sort(key=lambda h: h[0])
        doc_ids = np.array([h[0] for h in held], np.int64)
        lens = [len(h[2]) for h in held]
        keys = np.concatenate([h[2] for h in held])
        doc = np.repeat(np.arange(len(held)), lens)
        at = np.concatenate([np.arange(h[1], h[1] + n) for h, n in zip(held, lens, strict=True)])
        order = np.argsort(keys, kind="stable")  # within equal keys: by doc_id, then position
        keys, doc, at = keys[order], doc[order], at[order]
        head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        first = np.repeat(head, np.diff(np.r_[head, len(keys)]))
        later = doc_ids[doc] > doc_ids[doc[first]]
        rows = []
        c = np.flatnonzero(later)
        if len(c):
            source = first[c]
            packed = (doc_ids.tobytes(), _squash(doc[c]), _squash(at[c]), doc_ids[doc[source]].tobytes(), _squash(at[source]))
            rows.append((int(keys[c[0]] >> np.uint64(40)) & ((1 << bits) - 1), name, "claim", b"", *packed))
        out = np.flatnonzero(~later)
        seg = (keys[out] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(out), np.int64)
        bounds = np.searchsorted(seg, np.arange((1 << bits) + 1))
        for s in range(1 << bits):
            part = out[bounds[s] : bounds[s + 1]]
            if len(part):
                docs, doc_of = np.unique(doc[part], return_inverse=True)
                rows.append((s, name, "run", _pack(keys[part]), doc_ids[docs].tobytes(), _squash(doc_of), _squash(at[part]), b"", b""))
        return pd.DataFrame(rows, columns=RUN_COLUMNS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, block = [], 0, 0
        from pyspark import TaskContext

        task = TaskContext.get()
        prefix = f"{batch}-{task.partitionId() if task else 0}"
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                keys = window_hashes(split_words(text), size, fingerprint_bits)
                # a very long text is dealt over several blocks
                for lo in range(0, len(keys), block_words):
                    held.append((doc_id, lo, keys[lo : lo + block_words]))
                    n += len(held[-1][2])
                    if n >= block_words:
                        yield emit(held, f"{prefix}-{block}")
                        held, n, block = [], 0, block + 1
        if n:
            yield emit(held, f"{prefix}-{block}")

    return trimmed(run)


def _expand(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, doc_ids, positions) of a packed run."""
    return _unpack(row.keys), np.frombuffer(row.docs, np.int64)[_restore(row.doc_of)], _restore(row.at)


def _packed(segment: int, name: str, kind: str, keys: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple:
    docs, doc_of = np.unique(doc, return_inverse=True)
    return segment, name, kind, _pack(keys), docs.tobytes(), _squash(doc_of), _squash(at), b"", b""


def _split(bits: int):
    """Rows of runs with fewer segments, each cut into its segments of ``bits`` bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                keys, doc, at = _expand(row)
                of = (keys >> np.uint64(64 - bits)).astype(np.int64)
                head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                for lo, hi in zip(head, np.r_[head[1:], len(of)], strict=True):
                    rows.append(_packed(int(of[lo]), "", "index", keys[lo:hi], doc[lo:hi], at[lo:hi]))
            yield pd.DataFrame(rows, columns=RUN_COLUMNS)

    return trimmed(run)


def _merge_segment(remember: bool):
    """All runs of one segment merged: claims per block of the batch, and, if ``remember``, one row with what the index lacked of the
    batch, or, without a batch, with all of the index."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(r) for r in pdf[pdf["kind"] == "claim"].itertuples(index=False)]
        runs = list(pdf[pdf["kind"] != "claim"].itertuples(index=False))
        if not runs:
            return pd.DataFrame(rows, columns=RUN_COLUMNS)
        parts = [_expand(r) for r in runs]
        sizes = [len(p[0]) for p in parts]
        keys, doc, at = (np.concatenate([p[i] for p in parts]) for i in range(3))
        del parts
        order = np.lexsort((at, doc, keys)) if len(runs) > 1 else np.arange(len(keys))
        keys = keys[order]
        head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        source = order[np.repeat(head, np.diff(np.r_[head, len(keys)]))]
        later = doc[order] > doc[source]
        claimed, source = order[later], source[later]
        ends = np.cumsum(sizes)
        block = np.searchsorted(ends, claimed, "right")
        segment = int(pdf["segment"].iloc[0])
        for b in np.unique(block):
            if runs[b].kind == "index":
                continue
            c, s = claimed[block == b], source[block == b]
            docs, doc_of = np.unique(doc[c], return_inverse=True)
            rows.append((segment, runs[b].block, "claim", b"", docs.tobytes(), _squash(doc_of), _squash(at[c]), doc[s].tobytes(), _squash(at[s])))
        if remember:
            first = order[head]
            old = np.array([r.kind == "index" for r in runs])
            lacked = ~old[np.searchsorted(ends, first, "right")] if not old.all() else np.ones(len(first), bool)
            if lacked.any():
                rows.append(_packed(segment, "", "index", keys[head[lacked]], doc[first[lacked]], at[first[lacked]]))
        return pd.DataFrame(rows, columns=RUN_COLUMNS)

    return run


DIGESTS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("digest", pa.binary())]))


def stretch_digest(words: list[bytes], start: int, n: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start : start + n]), digest_size=16).digest()


STRETCH = "doc_id long, start long, length long, from_doc long, from_start long"


def _stretches(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's claimed windows as stretches of windows that follow each other in both documents."""
    doc = np.concatenate([np.frombuffer(r.docs, np.int64)[_restore(r.doc_of)] for r in pdf.itertuples()])
    at, from_at = (np.concatenate([_restore(x) for x in pdf[c]]) for c in ("at", "from_at"))
    from_doc = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["from_doc"]])
    order = np.lexsort((at, doc))
    doc, at, from_doc, from_at = doc[order], at[order], from_doc[order], from_at[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (from_doc[1:] != from_doc[:-1]) | (from_at[1:] != from_at[:-1] + 1)]
    head = np.flatnonzero(new)
    return pd.DataFrame(
        {"doc_id": doc[head], "start": at[head], "length": np.diff(np.r_[head, len(doc)]), "from_doc": from_doc[head], "from_start": from_at[head]}
    )


@dataclass(frozen=True)
class Run:
    """One immutable run: where it lies, its level, the bits that name its segments, how many windows it was made from at most."""

    path: str
    level: int
    bits: int
    windows: int


class WindowIndex:
    """The index below ``path``: its runs, and a manifest for each state it was in. ``claims`` judges a batch of documents against it and makes
    the batch part of it."""

    def __init__(self, spark: SparkSession, path: str | None = None, size: int = SIZE, segment_windows: int | None = None, block_words: int | None = None, fingerprint_bits: int = 64):
        self.spark, self.size, self.fingerprint_bits = spark, size, fingerprint_bits
        self.segment_windows, self.block_words = segment_windows or SEGMENT_WINDOWS, block_words or BLOCK_WORDS
        self.path = path or fresh_path(spark, "window-index")
        self.runs: list[Run] = []
        self.version = 0
        self.rewritten = 0  # windows written by compactions so far

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> WindowIndex:
        """The index that was left at ``path``, in its last state."""
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-*/_SUCCESS")
        found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
        versions = [int(f.getPath().getParent().getName().split("-")[1]) for f in found]
        index = cls(spark, path)
        if versions:
            state = json.loads(spark.read.text(f"{path}/manifest-{max(versions)}").first()["value"])
            index.size, index.fingerprint_bits, index.version, index.rewritten = (state[k] for k in ("size", "fingerprint_bits", "version", "rewritten"))
            index.runs = [Run(**r) for r in state["runs"]]
        return index

    def _commit(self, runs: list[Run]) -> None:
        """The index consists of ``runs`` from now on; a reader sees the state before or this one."""
        gone = [r for r in self.runs if r not in runs]
        self.runs, self.version = runs, self.version + 1
        state = {"size": self.size, "fingerprint_bits": self.fingerprint_bits, "version": self.version, "rewritten": self.rewritten, "runs": [asdict(r) for r in runs]}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.version}")
        for r in gone:
            delete(self.spark, r.path)

    def _bits(self, windows: int) -> int:
        return max([0, int(np.ceil(np.log2(max(1, windows / self.segment_windows)))), *[r.bits for r in self.runs]])

    def _rows(self, runs: list[Run], bits: int) -> DataFrame | None:
        found = None
        for r in runs:
            rows = self.spark.read.schema(RUN).parquet(r.path)
            rows = rows if r.bits == bits else rows.mapInPandas(_split(bits), RUN)
            found = rows if found is None else found.unionByName(rows)
        return found

    def claims(self, docs: DataFrame, remember: bool = True) -> DataFrame:
        """``docs``: doc_id, text. Packed rows of the windows that also start in an earlier document of the batch or the index, not verified."""
        small_batches(self.spark)
        size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        windows = size // 6 + 1
        bits = self._bits(sum(r.windows for r in self.runs) + windows)
        batch = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text")
        rows = batch.mapInPandas(_block_runs(self.size, bits, self.block_words, self.version, self.fingerprint_bits), RUN)
        old = self._rows(self.runs, bits)
        merged = (rows if old is None else rows.unionByName(old)).groupBy("segment").applyInPandas(_merge_segment(remember), RUN)
        path = f"{self.path}/batch-{self.version}" if remember else fresh_path(self.spark, "window-claims")
        merged.withColumn("of", F.col("kind")).write.partitionBy("of").parquet(path)
        for kind in ("claim", "index")[: 1 + remember]:  # a folder for each, also where a batch has no rows of the kind
            self.spark.createDataFrame([], RUN).write.mode("append").parquet(f"{path}/of={kind}")
        found = self.spark.read.schema(RUN).parquet(f"{path}/of=claim")
        if remember:
            self._commit([*self.runs, Run(f"{path}/of=index", 0, bits, windows)])
            self._compact()
        return found

    def _compact(self) -> None:
        while full := [level for level in {r.level for r in self.runs} if sum(r.level == level for r in self.runs) >= FAN_IN]:
            level = min(full)
            old = [r for r in self.runs if r.level == level]
            bits, windows, path = max(r.bits for r in self.runs), sum(r.windows for r in old), f"{self.path}/run-{self.version}"
            self._rows(old, bits).groupBy("segment").applyInPandas(_merge_segment(True), RUN).write.parquet(path)
            self.rewritten += windows
            self._commit([*[r for r in self.runs if r.level != level], Run(path, level + 1, bits, windows)])

    def verified(self, docs: DataFrame, claims: DataFrame, *earlier: DataFrame) -> DataFrame:
        """doc_id, start, length, digest of what the claims (packed) name and the words confirm. ``docs`` and ``earlier``: where the texts of
        all documents can be read that are or were part of the index."""
        claims = materialize(claims.groupBy("block").applyInPandas(_stretches, STRETCH), "claims")
        sides = claims.select("doc_id", "start", "length").union(claims.select("from_doc", "from_start", "length")).distinct()
        texts = docs.select("doc_id", "text")
        for more in earlier:
            texts = texts.union(more.select("doc_id", "text"))
        digests = materialize(self._digests(texts, sides), "digests")
        a = digests.withColumnRenamed("digest", "own")
        b = digests.select(F.col("doc_id").alias("from_doc"), F.col("start").alias("from_start"), "length", F.col("digest").alias("other"))
        both = claims.join(a, ["doc_id", "start", "length"]).join(b, ["from_doc", "from_start", "length"])
        both = materialize(both.select("doc_id", "start", "length", F.col("own").alias("digest"), (F.col("own") == F.col("other")).alias("same")).distinct(), "compared")
        # rows that repeat a doc_id have several digests for a place: it failed if none agrees
        good = both.where("same").select("doc_id", "start", "length", "digest").distinct()
        failed = both.groupBy("doc_id", "start", "length").agg(F.max("same").alias("same")).where("not same").drop("same")
        failed = materialize(failed, "failed-claims")
        return good if failed.isEmpty() else good.unionByName(self._by_words(texts, failed))

    def _digests(self, texts: DataFrame, spans: DataFrame) -> DataFrame:
        """doc_id, start, length, digest of the words of each stretch of windows."""
        wanted = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
        wanted = materialize(wanted.where(F.col("doc_id") != LAST), "spans")
        size = self.size

        def digest(texts: list[str | None], spans: list[list[dict]]) -> dict[str, list]:
            got = []
            for text, own in zip(texts, spans, strict=True):
                words = split_words(text)
                got.append([{"start": s["start"], "length": s["length"], "digest": stretch_digest(words, s["start"], s["length"] + size - 1)} for s in own])
            return {"digests": got}

        key = F.xxhash64("doc_id")
        joined = sift(texts, sieve(wanted, key), key).join(wanted, "doc_id")
        adds = [("digests", T._parse_datatype_string("array<struct<start:bigint,length:bigint,digest:binary>>"), DIGESTS)]
        return append(joined, digest, ["text", "spans"], adds, drop=("text", "spans")).select("doc_id", F.inline("digests")).distinct()

    def _by_words(self, texts: DataFrame, failed: DataFrame) -> DataFrame:
        """The windows of ``failed`` stretches whose words also start in a document with a smaller id, each as a stretch of one window."""
        size, bits = self.size, self.fingerprint_bits
        windows = failed.select("doc_id", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("start"), F.lit(1).cast("long").alias("length")).distinct()
        own = materialize(self._digests(texts, windows), "failed-windows")

        def seen(keys: np.ndarray):
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    out = []
                    for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                        words = split_words(text)
                        found = window_hashes(words, size, bits)
                        at = np.flatnonzero(np.isin(found, keys))
                        out += [(doc_id, int(i), int(found[i].view(np.int64)), stretch_digest(words, int(i), size)) for i in at]
                    yield pd.DataFrame(out, columns=["doc_id", "start", "key", "digest"])

            return trimmed(run)

        there = texts.where("doc_id is not null")
        key = F.xxhash64("doc_id")
        keyed = sift(there, sieve(own, key), key).mapInPandas(_keys_of_windows(size, bits), "doc_id long, start long, key long")
        keys = materialize(keyed.join(own.select("doc_id", "start"), ["doc_id", "start"], "left_semi").select("key").distinct(), "failed-keys")
        passes, firsts = -(-keys.count() // REPAIR_KEYS), None
        for k in range(passes):
            some = [r["key"] for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == k).collect()]  # about REPAIR_KEYS numbers
            found = there.mapInPandas(seen(np.array(some, np.int64).view(np.uint64)), "doc_id long, start long, key long, digest binary")
            first = materialize(found.groupBy("key", "digest").agg(F.min("doc_id").alias("first")).drop("key"), "first-windows")
            firsts = first if firsts is None else firsts.unionByName(first)
        firsts = firsts.groupBy("digest").agg(F.min("first").alias("first"))
        return own.join(firsts, "digest").where(F.col("first") < F.col("doc_id")).select("doc_id", "start", "length", "digest")

    def add(self, docs: DataFrame, *earlier: DataFrame, remember: bool = True) -> DataFrame:
        """Verified stretches doc_id, start, length, digest. ``earlier``: where documents of former batches can be read."""
        return self.verified(docs, self.claims(docs, remember), *earlier)


def _keys_of_windows(size: int, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                found = window_hashes(split_words(text), size, bits)
                yield pd.DataFrame({"doc_id": np.full(len(found), doc_id), "start": np.arange(len(found)), "key": found.view(np.int64)})

    return trimmed(run)


def batches_of(docs: DataFrame, n: int) -> list[DataFrame]:
    """``docs`` (doc_id, text) in ``n`` ranges of ascending doc_id with about as many rows each, but for the last, which need not be written
    and has twice as many; null ids come last."""
    cuts = docs.select(F.percentile_approx("doc_id", [k / (n + 1) for k in range(1, n)], 1000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    bounds = [None, *cuts, None]
    out = []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        rows = docs if lo is None else docs.where((F.col("doc_id") > lo) | F.col("doc_id").isNull() if hi is None else F.col("doc_id") > lo)
        out.append(rows if hi is None else rows.where(F.col("doc_id") <= hi))
    return out


def deduplicate(docs: DataFrame, index: WindowIndex | None = None, id_col: str = "doc_id", text_col: str = "text", *earlier: DataFrame, batches: int = BATCHES) -> DataFrame:
    """All input columns, and n_words, n_removed, kept_text: the words outside removed windows, joined by one space.

    With ``index`` the table is its next batch. Without one, an index is built for it from ``batches`` ranges of doc_id, in ascending order, so
    that each range is judged against the runs of those before; the last is judged but not written.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if index is not None:
        claims = index.claims(plain)
    else:
        index, claims, parts = WindowIndex(spark), None, batches_of(plain, batches)
        for k, part in enumerate(parts):
            found = index.claims(part, remember=k + 1 < len(parts))
            claims = found if claims is None else claims.unionByName(found)
            free_shuffles(spark)
        for r in index.runs:
            delete(spark, r.path)
    marked = materialize(index.verified(plain, claims, *earlier).groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "digest")).alias("spans")), "removed")
    doc, spans = unused(docs, "_doc", "_spans")
    keyed = docs.drop("n_words", "n_removed", "kept_text").withColumn(doc, F.col(id_col).cast("long"))
    few = sieve(marked, F.xxhash64("doc_id"))
    others = sift(keyed, few, F.xxhash64(doc), passing=False).withColumn(spans, F.lit(None).cast(marked.schema["spans"].dataType))
    own = sift(keyed, few, F.xxhash64(doc)).join(marked.select(F.col("doc_id").alias(doc), F.col("spans").alias(spans)), doc, "left")
    joined = others.unionByName(own).drop(doc)
    size = index.size

    def cut(texts: list[str | None], spans: list[list[dict] | None]) -> dict[str, list]:
        n_words, n_removed, kept = [], [], []
        for text, own in zip(texts, spans, strict=True):
            words = split_words(text)
            n_words.append(len(words))
            if own:
                covered = np.zeros(len(words) + 1, np.int64)
                for s in own:
                    end = s["start"] + s["length"] + size - 1
                    if stretch_digest(words, s["start"], end - s["start"]) == s["digest"]:
                        covered[s["start"]] += 1
                        covered[end] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(covered[:-1]) == 0).tolist()]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return {"n_words": n_words, "n_removed": n_removed, "kept_text": kept}

    long = (T.LongType(), pa.int64())
    adds = [("n_words", *long), ("n_removed", *long), ("kept_text", T.StringType(), pa.string())]
    return append(joined, cut, [text_col, spans], adds, drop=(spans,))


def op10_window_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
with w as (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
g as (
  select r, doc_id, i, array_to_string(ws[i : i + 12], ' ') as words
  from (select r, doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13)),
f as (select words, min(doc_id) as first from g group by words),
c as (select distinct r, unnest(range(i, i + 13)) as p from g join f using (words) where f.first < g.doc_id),
t as (select r, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
k as (select t.r, string_agg(word, ' ' order by t.p) as kept, count(*) as n from t anti join c on t.r = c.r and t.p = c.p group by t.r)
select w.doc_id, len(ws) as n_words, len(ws) - coalesce(k.n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k using (r)
"""
