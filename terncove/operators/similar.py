"""Similarity joins of names within a place: equi-joins on what two similar names must share, and native bounds instead of alignments."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.harvest import aligned_similarity, similarity_from
from ..functions.phones import constant_array, let
from ..plans.cut import cut, spread

GRAM = 3
#: Letters that a name and one that contains it are joined by.
WIDE = 6
#: Grams are ranked by how often the grams of their bucket occur, in powers of two: a table of this size, however many there are.
BUCKETS = 1 << 14


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"))


def letters(text: Column) -> Column:
    """Every letter with the number of its occurrence as one integer (code point and occurrence): texts share as many letters as such integers."""
    ranked = F.array_sort(F.transform(characters(text), F.ascii))
    # equal letters stand side by side: the occurrence is how far a letter is from the first of its kind
    return let(ranked, lambda r: F.transform(r, lambda c, i: c * 64 + F.least(i - F.array_position(r, c).cast("int") + 1, F.lit(63))))


def ratio_of(a_letters: Column, b_letters: Column) -> Column:
    """What the ratio of matching blocks of two names can be at most, from their ``letters``: twice those in common by all."""
    both = F.size(a_letters) + F.size(b_letters)
    return F.when(both > 0, 2.0 * F.size(F.array_intersect(a_letters, b_letters)) / both).otherwise(1.0)


def letter_bits(ls: Column) -> Column:
    """``letters`` as 128 bits, each letter turning one over: at least as many letters are apart as bits differ."""
    slot = lambda c: F.shiftright(c.cast("long") * 40_503, 7).bitwiseAND(F.lit(127).cast("long")).cast("int")

    def word(n: int) -> Column:
        bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot(c), F.lit(64)))
        return F.aggregate(ls, F.lit(0).cast("long"), lambda acc, c: F.when(F.shiftright(slot(c), 6) == n, acc.bitwiseXOR(bit(c))).otherwise(acc))

    return F.struct(word(0).alias("a"), word(1).alias("b"), F.size(ls).alias("n"))


def bits_allow(x: Column, y: Column, least: float) -> Column:
    """Whether the ratio of two names may be ``least`` by their lengths and ``letter_bits``: if it is, (1 - ``least``) of all letters are apart at most."""
    apart = (1 - least) * (x["n"] + y["n"]) + 1e-9
    return (F.abs(x["n"] - y["n"]) <= apart) & (F.bit_count(x["a"].bitwiseXOR(y["a"])) + F.bit_count(x["b"].bitwiseXOR(y["b"])) <= apart)


def ratio_bound(a: Column, b: Column) -> Column:
    """``ratio_of`` two texts. A letter that occurs more than 63 times in both counts in full: the bound stays one."""
    over = F.size(letters(a)) - F.size(F.array_distinct(letters(a)))
    return F.when(F.length(a) + F.length(b) > 0, ratio_of(letters(a), letters(b)) + 2.0 * over / (F.length(a) + F.length(b))).otherwise(1.0)


def lengths_allow(a: Column, b: Column, least: float) -> Column:
    return 2 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b)) - 1e-9


def contained(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def grams(text: Column) -> Column:
    """Distinct pieces of ``GRAM`` letters."""
    n = F.length(text) - (GRAM - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def rare_first(names: DataFrame) -> Column:
    """The grams of column ``norm``, those of rare buckets first. ``BUCKETS`` counts at most come to the driver."""
    counted = names.select(F.explode(grams(F.col("norm"))).alias("g")).groupBy(_bucket(F.col("g")).alias("b")).agg(F.count("*").alias("n")).collect()
    ranks = [0] * BUCKETS
    for r in counted:
        ranks[r["b"]] = r["n"].bit_length()
    table = constant_array(ranks)
    ranked = F.array_sort(F.transform(grams(F.col("norm")), lambda g: F.struct(F.get(table, _bucket(g)).alias("r"), g.alias("g"))))
    return F.transform(ranked, lambda r: r["g"])


def partner_lengths(n: Column, least: float) -> Column:
    """Per length of a partner, m, with which a name of ``n`` letters can have the ratio ``least`` without being equal: how many letters match at least, k."""
    lengths = F.sequence(F.ceil(n * least / (2 - least) - 1e-9).cast("int"), F.floor(n * (2 - least) / least + 1e-9).cast("int"))
    pairs = F.transform(lengths, lambda m: F.struct(m.alias("m"), F.ceil(least * (n + m) / 2 - 1e-9).cast("int").alias("k")))
    return F.filter(pairs, lambda p: (p["k"] <= F.least(n, p["m"])) & (2 * p["k"] < n + p["m"]))


def spoilt(n: Column, m: Column, k: Column) -> Column:
    """How many grams of a name of ``n`` letters one of ``m`` letters lacks at most if ``k`` letters match: each letter apart spoils ``GRAM``, each letter put in between one less."""
    return GRAM * (n - k) + (GRAM - 1) * (m - k)


def similar_names(names: DataFrame, least: float) -> DataFrame:
    """x, y: names of one place of which x is asked for, y is another, and one contains the other or their ratio is ``least`` (0.9 or more).

    ``names``: place, norm (not empty), id (long), asked, ls (``letters``); one row a place and name. Nearly equal names of two lengths share one of the rarest grams of either, as many
    as differing letters can spoil and one more; of a name inside another all pieces are there, so the one around its rarest gram is.
    """
    held = spread(names, "id").withColumn("bits", letter_bits(F.col("ls"))).drop("ls")
    held = cut(held.withColumn("gs", rare_first(names)))
    n, xn, yn = F.length("norm"), F.col("x_norm"), F.col("y_norm")

    def told(df: DataFrame, token: Column, side: str, *carried: str) -> DataFrame:
        rows = df.select(F.explode(token).alias("token"), "place", *[F.col(c).alias(f"{side}_{c}") for c in ("norm", "id", "asked", *carried)])
        return spread(rows, "place", "token")

    def dealt(df: DataFrame, side: str) -> DataFrame:
        held = df.select("*", F.explode(partner_lengths(n, least)).alias("p"))
        m, k = F.col("p.m"), F.col("p.k")
        lengths = (n, m) if side == "x" else (m, n)
        held = held.select("gs", "place", "norm", "id", "asked", "bits", F.struct(*lengths).alias("lengths"), (spoilt(n, m, k) + 1).alias("some"))
        return told(held, F.transform(F.slice("gs", F.lit(1), F.col("some")), lambda g: F.struct(F.col("lengths"), g)), side, "bits")

    close = dealt(held.where("asked"), "x").join(dealt(held, "y"), ["place", "token"])
    close = close.where(bits_allow(F.col("x_bits"), F.col("y_bits"), least)).where((xn != yn) & ~contained(xn, yn)).select(F.col("x_id").alias("x"), F.col("y_id").alias("y"), "x_norm", "y_norm")
    close = spread(close.distinct(), "x", "y").where(ratio_bound(xn, yn) >= least - 1e-9).where(aligned_similarity("x_norm", "y_norm") >= least).select("x", "y")
    # a name's rarest gram with letters beside it; names of fewer letters have their rarest gram, and of fewer than that are their own token
    wide = F.substring(F.col("norm"), F.least(F.instr(F.col("norm"), F.get("gs", F.lit(0))), n - (WIDE - 1)), F.lit(WIDE))
    token = F.when(n < GRAM, F.array("norm")).when(n < WIDE, F.slice("gs", 1, 1)).otherwise(F.array(wide))
    windows = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.substring(F.col("norm"), i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    sizes = held.agg(F.max(n < GRAM).alias("short"), F.max((n >= GRAM) & (n < WIDE)).alias("middle")).first()
    every = F.array_distinct(F.concat(windows(WIDE), *([F.col("gs")] if sizes["middle"] else []), *([windows(1), windows(2)] if sizes["short"] else [])))
    inside = told(held, token, "x").join(told(held, every, "y"), ["place", "token"]).where((xn != yn) & F.contains(yn, xn))
    inside = inside.select("x_id", "y_id", "x_asked", "y_asked")
    both = inside.where("x_asked").select(F.col("x_id").alias("x"), F.col("y_id").alias("y")).union(inside.where("y_asked").select("y_id", "x_id"))
    return close.union(both).distinct()


#: A place with more names at home than this is compared by blocks of bits, others by a join.
BUSY = 64
#: Names of a busy place that one task holds of either side.
BLOCK = 8_192


def name_bits(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, 128 bits of the letters, 256 bits of the pairs of letters): every letter or pair with the number of its occurrence turns one bit over, so two
    names have at least as many letters or pairs apart as bits differ."""

    length = np.array([len(name) for name in names], np.int64)
    one, two = np.zeros((2, len(names)), np.uint64), np.zeros((4, len(names)), np.uint64)

    def turn(words: np.ndarray, at: np.ndarray, tokens: np.ndarray) -> None:
        for k in range(tokens.shape[1]):
            seen = (tokens[:, :k] == tokens[:, k : k + 1]).sum(1, dtype=np.uint64)
            bit = ((tokens[:, k] * np.uint64(64) + seen) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(64 * len(words))
            words[(bit >> np.uint64(6)).astype(np.intp), at] ^= np.uint64(1) << (bit & np.uint64(63))

    for n in np.unique(length[length > 0]).tolist():
        every = np.flatnonzero(length == n)
        step = max(1, 4_000_000 // n)
        for at in (every[k : k + step] for k in range(0, len(every), step)):
            codes = np.frombuffer("".join([names[k] for k in at]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).astype(np.uint64)
            turn(one, at, codes)
            turn(two, at, codes[:, :-1] * np.uint64(0x110000) + codes[:, 1:])
    return length, one, two


def match_words(names: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """(rows of letters, a letter's places in each name as bits): names of 64 letters at most; row 0 is of letters that no name has."""
    rows = {c: n for n, c in enumerate(sorted(set().union(*names)), 1)}
    words = np.zeros((len(rows) + 1, len(names)), np.uint64)
    for j, name in enumerate(names):
        at: dict[str, int] = {}
        for k, c in enumerate(name):
            at[c] = at.get(c, 0) | 1 << k
        for c, word in at.items():
            words[rows[c], j] = word
    return rows, words


def common_letters(codes: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
    """Letters of the longest common subsequence of names i and names j (``length`` letters), all pairs at once: matching blocks have no more.

    ``codes``: rows of letters in ``words`` by place and name i. Bit-parallel recurrence: a zero bit of ``v`` is a letter in common.
    """
    v = np.full(len(i), ~np.uint64(0))
    for code in codes:
        u = v & words[code[i], j]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v & np.uint64((1 << length) - 1)).astype(np.int64)


def similar_by_bits(xs: list[str], ys: list[str], least: float) -> list[tuple[int, int]]:
    """Index pairs of all names whose ``similarity`` is ``least`` or more, leaving out what contains each other if bits differ too much.

    If M letters of T in both are in matching blocks, 2 M is ``least`` T or more: T - 2 M letters are apart, and as something lies between two blocks, there are T - 2 M + 1
    blocks at most, so 3 (T - 2 M) pairs of letters are apart at most. Of what passes, names of 64 letters at most need M letters in one order in both. What is left is aligned.
    """
    if not xs or not ys:
        return []
    (xn, xl, xp), (yn, yl, yp) = name_bits(xs), name_bits(ys)
    total = np.arange(int(xn.max() + yn.max()) + 1)
    of_length = lambda n: {int(k): np.flatnonzero(n == k) for k in np.unique(n)}
    found = []
    short = [name if len(name) <= 64 else "" for name in ys]
    rows, words_of = match_words(short)
    for kx, every_x in of_length(xn).items():
        codes = np.zeros((kx, len(xs)), np.intp)
        for k in every_x:
            codes[:, k] = [rows.get(c, 0) for c in xs[k]]
        for ky, at_y in of_length(yn).items():
            apart = kx + ky - 2 * math.ceil(least * (kx + ky) / 2 - 1e-9)
            if abs(kx - ky) > apart:
                continue
            near_l, near_p = yl[:, at_y], yp[:, at_y]
            step = max(1, 250_000 // len(at_y))
            for at_x in (every_x[k : k + step] for k in range(0, len(every_x), step)):
                part = xl[:, at_x, None]
                differ = np.bitwise_count(part[0] ^ near_l[0])
                differ += np.bitwise_count(part[1] ^ near_l[1])
                i, j = np.divmod(np.flatnonzero(differ <= apart), len(at_y))
                near = np.bitwise_count(xp[:, at_x[i]] ^ near_p[:, j]).sum(0, dtype=np.int64) <= 3 * apart
                i, j = at_x[i[near]], at_y[j[near]]
                if ky <= 64 and len(i):
                    ordered = 2 * common_letters(codes, words_of, i, j, ky) >= kx + ky - apart
                    i, j = i[ordered], j[ordered]
                alike = zip(i.tolist(), j.tolist(), strict=True)
                found += [(a, b) for a, b in alike if similarity_from(xs[a], ys[b], least) >= least]
    return found


def similar_at_places(asked: DataFrame, homes: DataFrame, near_equal: DataFrame, least: float) -> DataFrame:
    """place, x, y: names asked for at a place and names at home there that are equal, one of the pairs ``near_equal``, or of a ratio that may be ``least``.

    ``asked`` and ``homes``: place, id, norm, ls (``letters``), one row each a place and name; x and y are ids. Where many names are at home, blocks of both sides meet in
    tasks that compare bits and align what may be similar, so a busy place costs bits and not rows.
    """
    a = asked.select("place", F.col("id").alias("x"), F.col("norm").alias("x_norm"), F.col("ls").alias("x_ls"), letter_bits(F.col("ls")).alias("x_bits"))
    h = homes.select("place", F.col("id").alias("y"), F.col("norm").alias("y_norm"), F.col("ls").alias("y_ls"), letter_bits(F.col("ls")).alias("y_bits"))
    equal = a.join(h, (a["place"] == h["place"]) & (a["x"] == h["y"])).select(a["place"], "x", "y")
    known = a.join(near_equal, "x").join(h, ["place", "y"]).select("place", "x", "y")
    xs, ys = F.col("x_ls"), F.col("y_ls")
    alike = (F.col("x") != F.col("y")) & bits_allow(F.col("x_bits"), F.col("y_bits"), least)
    blocks = lambda df, name: df.groupBy("place").agg(F.ceil(F.count("*") / BLOCK).alias(name), F.count("*").alias(f"{name}_rows"))
    busy = cut(blocks(h, "h_blocks").where(F.col("h_blocks_rows") > BUSY).join(blocks(a, "a_blocks"), "place").select("place", "h_blocks", "a_blocks"))
    quiet = spread(a, "place").join(spread(h.join(busy, "place", "left_anti"), "place"), "place")
    close = quiet.where(alike).where(ratio_of(xs, ys) >= least - 1e-9).select("place", "x", "y")

    def dealt(df: DataFrame, own: str, other: str, side: str) -> DataFrame:
        rows = df.join(busy, "place").withColumn(own, F.pmod(F.xxhash64(side), F.col(own))).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return rows.select("place", "a_blocks", "h_blocks", side, f"{side}_norm")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, y = left["x"].tolist(), right["y"].tolist()
        met = [(x[i], y[j]) for i, j in similar_by_bits(left["x_norm"].tolist(), right["y_norm"].tolist(), least) if x[i] != y[j]]
        place = left["place"].iloc[0] if len(left) else 0
        return pd.DataFrame({"place": [place] * len(met), "x": [m[0] for m in met], "y": [m[1] for m in met]}).astype("int64")

    keys = ["place", "a_blocks", "h_blocks"]
    left, right = dealt(a, "a_blocks", "h_blocks", "x"), dealt(h, "h_blocks", "a_blocks", "y")
    right = right.select(F.col("place").alias("at"), *right.columns[1:])  # both sides may come from one table
    crowd = spread(left, *keys).groupBy(*keys).cogroup(spread(right, "at", *keys[1:]).groupBy("at", *keys[1:])).applyInPandas(meet, "place long, x long, y long")
    return equal.union(known).union(close).union(crowd).distinct()
