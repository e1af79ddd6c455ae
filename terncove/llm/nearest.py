"""Nearest neighbours by a block matrix join.

Each vector is quantised once to int8 codes and a scale; codes are what is dealt over candidate blocks and query blocks of bounded
size. Each pair of blocks is one tile: the codes of both are multiplied (the products are exact integers), which gives every inner
product up to a known quantisation error. With ``x = s*q + e`` for both sides, ``|x.y - s_x s_y q_x.q_y| <= |e_x| |y| + |s_x q_x| |e_y|``.
A pair whose upper bound is below the k-th best lower bound of its query cannot be among the k nearest; that is applied in each
tile, and again as the tiles' lists are merged, ``FAN_IN`` at a time, until one list a query is left. Original vectors are fetched for its
pairs only; these are recomputed in double precision and the k best taken by a heap.

Vectors that are equal (one hash, one code) are listed once: of a set of equal vectors only the k + 1 smallest ids can be among a
query's k nearest. This is exact, ties going to smaller ids. Where vectors lie closer to each other than codes can tell, a tile would
list them all; a query with more than ``CROWD * k`` survivors in a tile is judged there by the original vectors instead, in a second
round of only the tiles that have such queries. So no list exceeds ``CROWD * k`` and memory depends on block sizes only.

Defined results: vectors that are null, of zero length or norm, or that hold a null or non-finite component take no part,
nor do rows with a null id; vectors are compared only with vectors of their own dimension; rows that repeat an id count
once (the smallest vector in array order); a query without candidates has no rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches, trimmed
from .store import materialize

CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 2048
FAN_IN = 32
QUERY_BUCKET = 512  # queries that one merging call holds
CROWD = 16
LISTS = "query_id long, ids array<long>, low array<double>, high array<double>, hashes array<long>, part int, crowded boolean"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of what the codes stand for, norms of the errors."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    stands = codes * scale[:, None]
    return codes, scale, np.linalg.norm(stands, axis=1), np.linalg.norm(x - stands, axis=1)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, summed in order of the components."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def first_of_equals(groups: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k + 1`` smallest ids of each group, ascending."""
    order = np.lexsort((ids, groups))
    own = groups[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
    return np.sort(order[rank <= k])


def _column(pdf: pd.DataFrame, name: str, kind) -> np.ndarray:
    return pdf[name].to_numpy(kind)


def tile(q: pd.DataFrame, c: pd.DataFrame, k: int) -> list[tuple]:
    """Rows (query, ids, lower bounds, upper bounds, hashes, crowded) of one tile. ``q``, ``c``: id, code, scale, stands, err, hash."""
    c = c.iloc[first_of_equals(np.unique(c["code"].to_numpy(object) + c["hash"].map(lambda h: int(h).to_bytes(8, "little", signed=True)).to_numpy(object), return_inverse=True)[1], _column(c, "id", np.int64), k)]
    c_ids, c_hash = _column(c, "id", np.int64), _column(c, "hash", np.int64)
    q_ids = _column(q, "id", np.int64)
    q_codes, c_codes = (np.frombuffer(b"".join(x["code"]), np.int8).reshape(len(x), -1) for x in (q, c))
    q_scale, q_norm, q_err, c_scale, c_norm, c_err = (_column(x, n, float) for x in (q, c) for n in ("scale", "stands", "err"))
    kind = np.float32 if c_codes.shape[1] * 127 * 127 < 1 << 24 else np.float64  # the sums stay exact integers
    right, out, q_full = c_codes.astype(kind).T, [], q_norm + q_err
    for at in range(0, len(q), 256):
        rows = slice(at, at + 256)
        close = (q_codes[rows].astype(kind) @ right).astype(np.float64)
        close *= q_scale[rows, None] * c_scale[None, :]
        slack = (q_err[rows, None] * (c_norm + c_err)[None, :] + q_norm[rows, None] * c_err[None, :]) * (1 + 1e-9) + 1e-12 * q_full[rows, None] * c_norm
        own = q_ids[rows, None] == c_ids[None, :]
        close[own] = -np.inf
        low = close - slack
        floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        alive = (close + slack >= floor[:, None]) & ~own
        for i in range(len(low)):
            js = np.flatnonzero(alive[i])
            if len(js) > CROWD * k:
                out.append((int(q_ids[at + i]), [], [], [], [], True))
            elif len(js):
                out.append((int(q_ids[at + i]), c_ids[js], low[i, js], close[i, js] + slack[i, js], c_hash[js], False))
    return out


def exact_tile(q: pd.DataFrame, c: pd.DataFrame, k: int) -> list[tuple]:
    """Rows of a tile by the original vectors, the k best of each query. ``q``, ``c``: id, vec, hash."""
    c = c.sort_values("id")
    c_ids, c_hash, vectors = _column(c, "id", np.int64), _column(c, "hash", np.int64), np.stack(c["vec"].to_numpy()).astype(np.float64)
    out = []
    for query, vec in zip(q["id"].tolist(), q["vec"], strict=True):
        score = inner(np.broadcast_to(np.asarray(vec, np.float64), vectors.shape), vectors)
        score[c_ids == query] = -np.inf
        best = heapq.nsmallest(k, zip((-score).tolist(), c_ids.tolist(), range(len(score)), strict=True))
        js = [b[2] for b in best if b[0] < np.inf]
        if js:
            out.append((query, c_ids[js], score[js], score[js], c_hash[js], False))
    return out


def merge_lists(lists: pd.DataFrame, k: int) -> tuple[np.ndarray, ...]:
    """ids, lower and upper bounds and hashes of what can be among the k best of several lists of one query."""
    ids, low, high, hashes = (np.concatenate([np.asarray(x) for x in lists[c]]) for c in ("ids", "low", "high", "hashes"))
    kept = first_of_equals(hashes.astype(np.int64), ids, k)
    ids, low, high, hashes = ids[kept], low[kept], high[kept], hashes[kept]
    floor = heapq.nlargest(k, low.tolist())[-1] if len(low) >= k else -np.inf
    alive = high >= floor
    return ids[alive].astype(np.int64), low[alive], high[alive], hashes[alive].astype(np.int64)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Columns id and vec (array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~odd & F.exists(v, lambda x: x != 0))
    return rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(v).alias("vec"))


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    candidate_block: int = CANDIDATE_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row for which ``is_query`` (of column id) holds."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = materialize(usable(vectors, id_col, vector_col).withColumns({"dim": F.size("vec"), "hash": F.xxhash64("vec")}), "vectors")

    def code(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                codes, scale, stands, err = quantise(np.stack(part["vec"].to_numpy()).astype(np.float64))
                yield pd.DataFrame({"id": part["id"], "dim": dim, "hash": part["hash"], "code": [c.tobytes() for c in codes], "scale": scale, "stands": stands, "err": err})

    columns = ["id", "hash", "code", "scale", "stands", "err"]
    coded = materialize(rows.mapInPandas(trimmed(code), "id long, dim int, hash long, code binary, scale double, stands double, err double"), "codes")
    asked = is_query(F.col("id"))
    n_rows, n_queries = rows.count(), rows.where(asked).count()
    c_blocks, q_blocks = max(1, -(-n_rows // candidate_block)), max(1, -(-n_queries // query_block))
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    keys = ["qb", "cb", "dim"]
    c = coded.withColumn("cb", spread(c_blocks, 1)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    q = coded.where(asked).withColumn("qb", spread(q_blocks, 2)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    named = lambda df, more: df.select(*[F.col(x).alias(f"q_{x}") for x in (*keys, *more)])  # noqa: E731  columns of its own: both sides scan one table

    def tiles(find):
        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            got = []
            if len(left) and len(right):
                block = int(right["cb"].iloc[0])
                found = find(left.rename(columns=lambda n: n.removeprefix("q_")), right, k)
                got = [(query, ids, low, high, hashes, block, crowded) for query, ids, low, high, hashes, crowded in found]
            return pd.DataFrame(got, columns=[x.split()[0] for x in LISTS.split(", ")])

        return run

    by = lambda side, prefix="": side.groupBy(*[f"{prefix}{x}" for x in keys])
    first = by(named(q, columns), "q_").cogroup(by(c.select(*keys, *columns))).applyInPandas(tiles(tile), LISTS)
    first = materialize(first, "tiles")
    crowds = materialize(first.where("crowded").select(F.col("query_id").alias("id"), F.col("part").alias("cb")), "crowds")
    crowded = rows.join(crowds, "id").withColumn("qb", spread(q_blocks, 2))
    there = crowded.select("qb", "cb", "dim").distinct()
    around = rows.withColumn("cb", spread(c_blocks, 1)).join(there, ["cb", "dim"])
    second = by(named(crowded, ["id", "vec", "hash"]), "q_").cogroup(by(around.select(*keys, "id", "vec", "hash"))).applyInPandas(tiles(exact_tile), LISTS)
    lists = first.where("not crowded").unionByName(second)
    buckets = max(1, -(-n_queries // QUERY_BUCKET))
    bucket = F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(buckets)).cast("int").alias("bucket")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [(query, *merge_lists(part, k), int(part["part"].iloc[0]), False) for query, part in pdf.groupby("query_id", sort=False)]
        return pd.DataFrame(got, columns=[x.split()[0] for x in LISTS.split(", ")])

    parts = c_blocks
    while parts > 1:
        parts = -(-parts // FAN_IN)
        lists = lists.withColumn("part", F.pmod("part", F.lit(parts))).groupBy(bucket, "part").applyInPandas(merge, LISTS)
    pairs = lists.select("query_id", F.explode("ids").alias("vec_id"))
    both = pairs.join(rows.select(F.col("id").alias("vec_id"), F.col("vec").alias("there")), "vec_id")
    both = both.join(rows.where(asked).select(F.col("id").alias("query_id"), F.col("vec").alias("here")), "query_id")

    def recompute(batches):
        for pdf in batches:
            for _, part in pdf.groupby(pdf["here"].map(len)):
                score = inner(np.stack(part["here"].to_numpy()).astype(np.float64), np.stack(part["there"].to_numpy()).astype(np.float64))
                yield pd.DataFrame({"query_id": part["query_id"], "vec_id": part["vec_id"], "score": score})

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        got = []
        for query, part in pdf.groupby("query_id", sort=False):
            nearest_k = heapq.nsmallest(k, zip((-part["score"]).tolist(), part["vec_id"].tolist(), strict=True))
            got += [(query, n + 1, i, -s) for n, (s, i) in enumerate(nearest_k)]
        return pd.DataFrame(got, columns=["query_id", "rank", "vec_id", "score"])

    scored = both.mapInPandas(trimmed(recompute), "query_id long, vec_id long, score double")
    return scored.groupBy(bucket).applyInPandas(best, "query_id long, rank int, vec_id long, score double")


def op1_nearest(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, lambda i: i % 20 == 0, 20)


OP1_SQL = """
with v as (
  select vec_id, min(embedding::double[]) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
  group by vec_id),
p as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""
