"""Near copies by the Jaccard similarity of word shingles: all pairs of at least 0.8, none left to chance.

Trees first: SimHash fingerprints of the shingle sets within ``RADIUS`` bits of each other (``bktree``) name pairs; those whose sets are
similar link. Similar sets are expected to differ in up to 10 of 64 bits, so trees of a radius that can be searched miss many; the
rest is found by prefixes.

Shingles have one order for all texts. Two sets of similarity 0.8 or more share at least four fifths of the larger, so
their first common shingle lies in the first ``n - ceil(0.8 n) + 1`` of each (its prefix), and texts that share no prefix
shingle need no comparison. Any order is right; this one is by hash with shingles found often in a sample of the texts
last, so passages that many texts share do not fill prefixes. The sample decides about speed only.

A pair of given sizes needs less than the whole prefixes: with ``need`` = four ninths of both sizes, rounded up, its sets have at least
``m`` shingles in common among the first ``n - need + m`` of each, for every ``m`` up to ``need``: those beyond are ``need - m`` at most on the
side that reaches less far. So only matches at such places are counted, and ``m`` of them asked for; ``m`` grows with ``need``, as far as prefixes reach.
Each set also has a bit for each of ``ODD`` cells, whether the number
of its shingles in the cell is odd: sets differ in as many shingles at least as in bits, so the join itself leaves out most pairs that are not similar.
Another bound compares how many shingles of either set fall into each cell: differences there are differences of the sets, of large ones too. What passes both is compared by its whole sets.

A group of near copies would give the square of its size in pairs. So texts are first compared with one other of those that have the
same least shingle in one of ``ORDERS`` orders (similar sets have with probability 0.8 or more), then in rounds with one other of those that share
a prefix shingle, another one in each round: as many pairs as texts or prefix shingles. Only pairs whose texts are in different components after that
are looked for among all that share one. What stays quadratic is a group of texts that are nearly similar to each other, but not quite: all its pairs are
told apart by the bounds.

Sets are of 64-bit hashes. Texts without words have the empty set and count as equal; fewer words than a shingle make one. A null text counts as empty,
rows that repeat id and text get equal classes, an empty table gives an empty result, and columns beside id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append, trimmed
from .bktree import near_links
from .components import components
from .fingerprints import bit_counts, majority, shingle_set
from .store import decide, materialize, row_key
from .units import forget

SAMPLE = 8  # one text of so many is looked at to find frequent shingles
OFTEN = 2  # times in the sample
FREQUENT = 1_000_000  # shingles that are put last at most
RADIUS = 3
CELLS = 256
ODD = 512  # cells that have a bit
ORDERS = 4
ROUNDS = 8  # at most
FEW = 0.05  # a round that links so few, beside the first, is the last
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def name_of(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(found.tobytes(), 7)).view(np.int64))


def prefix(found: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which similar sets share one; ``last``: sorted shingles that come after all others."""
    late = np.zeros(len(found), bool)
    if len(last):
        late = last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found
    return np.r_[found[~late], found[late]][: len(found) - (4 * len(found) + 4) // 5 + 1]


def _similar(common: Column) -> Column:
    """common / (na + nb - common) >= 0.8, or whether it can be."""
    return 9 * common >= 4 * (F.col("na") + F.col("nb"))


_NEED = "((4 * (na + nb) + 8) div 9)"
#: Matches that are asked for: one, and one more for each hundred of ``need``, as far as the longer set's prefix reaches.
_MATCHES = f"greatest(1, least(1 + {_NEED} div 100, 1 + {_NEED} - (4 * greatest(na, nb) + 4) div 5))"


def _early() -> Column:
    """Whether a match at places i and j (from 0) counts for sets of sizes na and nb whose bits (odd_a, odd_b) may belong to similar ones."""
    apart = " + ".join(f"bit_count(odd_a[{k}] ^ odd_b[{k}])" for k in range(ODD // 64))
    return F.expr(f"i < na - {_NEED} + {_MATCHES} and j < nb - {_NEED} + {_MATCHES} and {apart} <= na + nb - 2 * {_NEED}")


def _sizes_fit() -> Column:
    return (5 * F.col("na") >= 4 * F.col("nb")) & (5 * F.col("nb") >= 4 * F.col("na"))


def least_shingles(found: np.ndarray) -> np.ndarray:
    """The least shingle of a set in each of ``ORDERS`` orders, as int64 (zeros for the empty set)."""
    if not len(found):
        return np.zeros(ORDERS, np.int64)
    h = found.view(np.uint64)
    return np.array([((h * odd) ^ ((h * odd) >> np.uint64(31))).min() for odd in _ODD[:ORDERS]], np.uint64).view(np.int64)


def cells(found: np.ndarray) -> bytes:
    """How many shingles fall into each cell, 255 at most."""
    counts = np.bincount((found.view(np.uint64) >> np.uint64(56)).astype(np.int64), minlength=CELLS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def odd_cells(found: np.ndarray) -> np.ndarray:
    """A bit for each cell of another cut, set where an odd number of shingles falls into it, as int64."""
    counts = np.bincount((found & (ODD - 1)).astype(np.int64), minlength=ODD)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _can_be_similar(batches):
    """Pairs a, b, na, nb with the cells of both to those that may be similar."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for c in ("cells_a", "cells_b"))
        na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("na", "nb"))
        common = (na + nb - np.abs(x - y).sum(axis=1, dtype=np.int64)) // 2
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(9 * common >= 4 * (na + nb)))


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """``texts`` with the set (``found``) in place of the text."""

    def run(texts: list[str | None]) -> dict[str, list]:
        forget()
        return {"found": [shingle_set(t, words) for t in texts]}

    return append(texts, run, ["text"], [("found", T.ArrayType(T.LongType()), pa.list_(pa.int64()))], drop=("text",))


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Those of ``pairs`` (a, b, na, nb) whose sets are similar, as edges a, b."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("cells").alias(f"cells_{c}"))
    pairs = materialize(pairs.distinct().join(of("a"), "a").join(of("b"), "b").mapInArrow(trimmed(_can_be_similar), "a long, b long"), "near-pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    chosen = rows.join(asked, "node", "left_semi").groupBy("node").agg(F.min(F.struct("_id", "_fp")).alias("r"))
    chosen = materialize(chosen.select("node", "r._id", "r._fp"), "near-texts")

    texts = decide(docs.select(id_col, F.col(text_col).alias("text")), chosen, "inner", id_col, "text").select("text", "node")
    sets = materialize(_sets(texts, words).dropDuplicates(["node"]), "near-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("fa")), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("fb")), "b")
    both = both.withColumns({"na": F.size("fa"), "nb": F.size("fb")})
    return materialize(both.where(_similar(F.size(F.array_intersect("fa", "fb")))).select("a", "b"), "near-links")


def near_sets(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: _id, _fp (``row_key``) and class_id, equal for texts that a chain of similar pairs connects."""
    keyed = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    long, longs = (T.LongType(), pa.int64()), (T.ArrayType(T.LongType()), pa.list_(pa.int64()))
    adds = [("node", *long), ("n", T.IntegerType(), pa.int32()), ("fp", *long), ("least", *longs), ("cells", T.BinaryType(), pa.binary()), ("odd", *longs), ("prefix", *longs)]

    def prefixes(of: DataFrame, last: np.ndarray) -> DataFrame:
        def run(texts: list[str | None]) -> dict[str, list]:
            forget()
            out: dict[str, list] = {name: [] for name, *_ in adds}
            for t in texts:
                found = shingle_set(t, words)
                out["node"].append(name_of(found))
                out["n"].append(len(found))
                out["fp"].append(int(majority(bit_counts(found.view(np.uint64)), len(found)).view(np.int64)) if len(found) else 0)
                out["least"].append(least_shingles(found))
                out["cells"].append(cells(found))
                out["odd"].append(odd_cells(found))
                out["prefix"].append(prefix(found, last))
            return out

        return append(of, run, ["text"], adds, drop=("text",))

    some = _sets(keyed.where(F.pmod("_fp", F.lit(SAMPLE)) == 0), words)
    often = some.select(F.explode("found").alias("h")).groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") >= OFTEN)
    often = materialize(often, "near-often")
    least, n = OFTEN, 0
    for r in often.groupBy(F.least("k", F.lit(10_000)).alias("k")).count().orderBy(F.desc("k")).collect():  # 10,000 rows at most
        n += r["count"]
        if n > FREQUENT:
            least = r["k"] + 1
            break
    last = np.sort(often.where(F.col("k") >= least).select("h").toArrow().column("h").to_numpy())  # FREQUENT numbers at most

    rows = materialize(prefixes(keyed, last), "near-rows")
    nodes = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "fp", "least", "cells", "odd", "prefix")])
    nodes = materialize(nodes, "near-nodes")
    held = nodes.select("node", "n", "odd", F.posexplode("prefix").alias("i", "h"))
    several = held.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("h")
    held = materialize(held.join(several, "h", "left_semi"), "near-shared")

    asked = near_by_trees(nodes).unionByName(near_by_least(nodes))
    links = _verified(asked, nodes, rows, docs, words, id_col, text_col)
    first, roots = links.count(), components(links)
    for k in range(ROUNDS):
        more = _verified(near_by_prefix(rooted(held, roots), k), nodes, rows, docs, words, id_col, text_col)
        links, n = links.unionByName(more), more.count()
        roots = components(links) if n else roots
        if n <= FEW * first:
            break
    named = rooted(held, roots)
    one = named.select("h", F.col("node").alias("a"), F.col("n").alias("na"), F.col("odd").alias("odd_a"), F.col("i"), F.col("root").alias("ra"))
    two = named.select("h", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("odd_b"), F.col("i").alias("j"), F.col("root").alias("rb"))
    pairs = one.join(two, "h").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _sizes_fit() & _early())
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c")).where(F.col("c") >= F.expr(_MATCHES))
    roots = components(links.unionByName(_verified(pairs.drop("c"), nodes, rows, docs, words, id_col, text_col)))
    return rows.select("_id", "_fp", "node").join(roots, "node", "left").select("_id", "_fp", F.coalesce("root", "node").alias("class_id"))


def rooted(held: DataFrame, roots: DataFrame) -> DataFrame:
    """``held`` (h, node, n, odd, i) with each node's root, for shingles h that more than one root has."""
    named = held.join(roots, "node", "left").select("h", "node", "n", "odd", "i", F.coalesce("root", "node").alias("root"))
    several = named.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
    return named.join(several, "h", "left_semi")


def near_by_least(nodes: DataFrame) -> DataFrame:
    """Pairs a, b, na, nb: each text with the first of those that have the same least shingle in one of the orders."""
    named = nodes.select("node", "n", F.posexplode("least").alias("o", "h"))
    row = F.struct(F.xxhash64("node", F.lit(0)).alias("order"), F.col("node").alias("a"), F.col("n").alias("na"))
    first = named.groupBy("o", "h").agg(F.min(row).alias("first"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    led = named.join(first, ["o", "h"]).where(F.col("node") != F.col("first.a"))
    return led.select("first.a", F.col("node").alias("b"), "first.na", F.col("n").alias("nb")).where(_sizes_fit())


def near_by_prefix(named: DataFrame, k: int) -> DataFrame:
    """Pairs a, b, na, nb: each text with one (another for each ``k``) of those that share a prefix shingle, where these two are not in one component yet."""
    row = F.struct(F.xxhash64("node", F.lit(k)).alias("order"), *[F.col(c).alias(to) for c, to in (("node", "a"), ("n", "na"), ("odd", "odd_a"), ("i", "i"), ("root", "ra"))])
    first = named.groupBy("h").agg(F.min(row).alias("first")).select("h", "first.a", "first.na", "first.odd_a", "first.i", "first.ra")
    rest = named.select("h", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("odd_b"), F.col("i").alias("j"), "root")
    return rest.join(first, "h").where((F.col("root") != F.col("ra")) & _sizes_fit() & _early()).select("a", "b", "na", "nb").distinct()


def near_by_trees(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``nodes``: node, n, fp (materialised). Pairs a, b, na, nb that BK-trees name: texts of one fingerprint with the first of them, and the
    first text of each fingerprint with that of the first other fingerprint within ``radius`` bits."""
    of_print = nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first"))
    of_print = materialize(of_print.select("fp", F.col("first.node").alias("node"), F.col("first.n").alias("n")), "near-prints")
    same = nodes.join(of_print.select("fp", F.col("node").alias("a"), F.col("n").alias("na")), "fp").where("node <> a")
    same = same.select("a", F.col("node").alias("b"), "na", F.col("n").alias("nb"))
    found = near_links(of_print.select("fp"), radius, whole=False).select(F.least("a", "b").alias("fa"), F.greatest("a", "b").alias("fb")).distinct()
    sides = found.join(of_print.select(F.col("fp").alias("fa"), F.col("node").alias("a"), F.col("n").alias("na")), "fa").join(
        of_print.select(F.col("fp").alias("fb"), F.col("node").alias("b"), F.col("n").alias("nb")), "fb"
    )
    return same.unionByName(sides.select("a", "b", "na", "nb")).where(_sizes_fit())
