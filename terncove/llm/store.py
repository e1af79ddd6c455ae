"""Intermediate tables in the folder that driver and executors share, and joins of decisions to rows with texts.

``materialize`` cuts a plan by writing it as Parquet below the shared folder and reading it back, so a lost executor costs a
reread and never a recomputation of what came before. The folder is the one that ``spark.checkpoint.dir`` or
``SparkContext.setCheckpointDir`` names; a session on one machine may do without, a cluster may not.

``sift`` keeps the rows that a set of keys can concern: the keys are marked in a filter of ``WORDS`` words of 64 bits, which is
what is broadcast, however many keys there are. Only rows that pass meet the keys themselves in a shuffle. The filter lets some
others pass too, more of them the fuller it is, so what is shuffled grows evenly with the number of keys, at every size by the
same plan.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 1 << 20

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a local one only where it names none and all runs on one machine."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = sc.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="terncove-")
    return _OWN[app]


def own_dir(spark: SparkSession) -> str:
    """The application's own folder inside the shared one."""
    return f"{shared_dir(spark)}/terncove-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Delete the application's intermediate tables: for when results are written. Results not yet computed would lose theirs."""
    _WRITTEN.pop(spark.sparkContext.applicationId, None)
    delete(spark, own_dir(spark))


def written(spark: SparkSession) -> int:
    """How many paths the application was given so far."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def drop_since(spark: SparkSession, mark: int) -> None:
    """Delete the tables written after ``written`` was ``mark``, but for the last, which the others led to."""
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in paths[mark:-1]:
        delete(spark, path)
    del paths[mark:-1]


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is done: it does when the driver's JVM has collected the plans that refer to them."""
    gc.collect()
    spark._jvm.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slots(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each after as many underscores as it takes to differ from all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _word(key: Column) -> Column:
    return key.bitwiseAND(F.lit(WORDS - 1))


def _bits(key: Column) -> Column:
    """Two of 64 bits, by other bits of the key than those that name its word."""
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, at).bitwiseAND(F.lit(63)).cast("int"))
    return one(32).bitwiseOR(one(48))


def sieve(keys: DataFrame, key: Column) -> DataFrame:
    """The filter of the 64-bit hashes ``key`` of ``keys``: at most ``WORDS`` rows word, bits."""
    marked = keys.select(_word(key).alias("word"), _bits(key).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return materialize(marked, "sieve")


def sift(df: DataFrame, marked: DataFrame, key: Column, passing: bool = True) -> DataFrame:
    """The rows of ``df`` whose hash ``key`` passes the filter, or those whose hash does not: these surely equal no key."""
    word, bits, own, mine = unused(df, "_word", "_bits", "_own", "_mine")
    probed = df.withColumns({own: _word(key), mine: _bits(key)}).join(
        F.broadcast(marked.select(F.col("word").alias(word), F.col("bits").alias(bits))), F.col(own) == F.col(word), "left"
    )  # WORDS rows at most
    hit = F.coalesce(F.col(bits).bitwiseAND(F.col(mine)) == F.col(mine), F.lit(False))
    return probed.where(hit if passing else ~hit).select(*[F.col(f"`{c}`") for c in df.columns])


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """What names a row where a doc_id may repeat: the id and a hash of the text."""
    return [F.col(id_col).alias("_id"), text_hash(F.col(text_col)).alias("_fp")]


def decide(
    docs: DataFrame, decisions: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text", fp: Callable[[Column], Column] = text_hash
) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (_id, _fp, ...; materialised) name (``inner``, with the further columns of the
    decisions) or do not name (``left_anti``). Rows that the filter of the decisions rules out are not shuffled."""
    hashed = F.xxhash64(F.col("_id"), F.col("_fp"))
    marked = sieve(decisions, hashed)
    own_id, own_fp, key_id, key_fp = unused(docs, "_own_id", "_own_fp", "_key_id", "_key_fp")
    keyed = docs.withColumns({key_id: F.col(id_col), key_fp: fp(F.col(text_col))})
    probe = F.xxhash64(F.col(key_id), F.col(key_fp))
    same = F.col(key_id).eqNullSafe(F.col(own_id)) & (F.col(key_fp) == F.col(own_fp))
    met = sift(keyed, marked, probe).join(decisions.withColumnsRenamed({"_id": own_id, "_fp": own_fp}), same, how).drop(own_id, own_fp, key_id, key_fp)
    if how == "inner":
        return met
    return sift(keyed, marked, probe, passing=False).drop(key_id, key_fp).unionByName(met)
