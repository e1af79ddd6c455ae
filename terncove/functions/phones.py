"""Numbering plans: which digits are a telephone number of which country.

A plan lists a country's code, its trunk prefix and which beginnings of a national number may have which lengths. All plans together are compiled into
one trie of digits, equal subtrees shared, that is held by two arrays of numbers: the next node by node and digit, and by node the lengths that a number
through it may have. Both are one constant of the query; a number walks them digit by digit within the JVM, and the longest beginning that a plan knows decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

#: E.164 allows so many digits, country code included.
LONGEST = 15

# Public numbering plans, simplified to beginnings of national numbers ("50-51": 50 and 51) and their lengths.
# Region: country code, trunk prefix, ((beginnings, lengths), ...).
PLANS: dict[str, tuple[str, str, tuple[tuple[str, tuple[int, ...]], ...]]] = {
    "UA": ("380", "0", ((" ".join([*C.UA_OPERATOR_CODES, *(f"{d}0-{d}9" for d in C.UA_AREA_FIRST_DIGITS)]), (9,)), ("800 900", (9, 10)))),
    "BY": ("375", "8", (("15-17 21-23 25 29 33 44", (9,)),)),
    "CZ": ("420", "", (("2-9", (9,)),)),
    "DE": ("49", "0", (("2-9", (6, 7, 8, 9, 10, 11)), ("15", (11,)), ("16-17", (10, 11)), ("800", (10, 11)))),
    "ES": ("34", "", (("6-9", (9,)),)),
    "FR": ("33", "0", (("1-9", (9,)),)),
    "GB": ("44", "0", (("1", (9, 10)), ("20 23-24 28-29 30 33-34 37 55-56 70-79 84 87 90-91 98", (10,)), ("80", (9, 10)))),
    "IT": ("39", "", (("0", (6, 7, 8, 9, 10, 11)), ("3", (9, 10)), ("80", (6, 9)))),
    "MD": ("373", "0", (("2-3 5-8 90", (8,)),)),
    "PL": ("48", "", (("12-18 22-25 29 32-34 41-46 48 50-63 65-69 71-79 80-89 91 94-95", (9,)),)),
    "RO": ("40", "0", (("2-3 7-9", (9,)),)),
    "RU": ("7", "8", (("3-4 6-9", (10,)),)),
    "SK": ("421", "0", (("2-5 9", (9,)),)),
    "US": ("1", "1", (("2-9xx2-9", (10,)),)),
}
# Country codes of two digits, as the international plan assigns them; 1 and 7 have one digit, all others three.
TWO_DIGIT_CODES = "20 27 30-34 36 39-41 43-49 51-58 60-66 81-82 84 86 90-95 98"
#: Countries without a plan here: so many digits in all.
OTHER_LENGTHS = tuple(range(8, LONGEST + 1))


def beginnings(spec: str) -> Iterator[str]:
    """The beginnings that a plan's text names; ``x`` is any digit, ``2-9xx2-9`` four places."""
    for word in spec.split():
        if "x" in word:
            head, tail = word.split("xx")
            ends = [list(beginnings(head)), [f"{n:02}" for n in range(100)], list(beginnings(tail))]
            yield from (a + b + c for a in ends[0] for b in ends[1] for c in ends[2])
        elif "-" in word:
            low, high = word.split("-")
            yield from (f"{n:0{len(low)}}" for n in range(int(low), int(high) + 1))
        else:
            yield word


def rows() -> Iterator[tuple[str, str, int]]:
    """(country code, beginning of the national number, length of the national number) of all plans."""
    for code, _, groups in PLANS.values():
        for spec, lengths in groups:
            yield from ((code, b, n) for b in beginnings(spec) for n in lengths)


def other_codes() -> list[str]:
    """Country codes without a plan."""
    two = set(beginnings(TWO_DIGIT_CODES))
    planned = {code for code, _, _ in PLANS.values()}
    three = (f"{n:03}" for n in range(200, 1000))
    return sorted({*two, *(c for c in three if c[:2] not in two and c[0] != "7")} - planned)


@cache
def compiled() -> tuple[list[int], list[int]]:
    """next (10 a node, 0: none) and lengths (bit n: n digits in all) of the shared trie; node 1 is the root."""
    root: dict = {}

    def put(digits: str, length: int) -> None:
        at = root
        for d in digits:
            at = at.setdefault(d, {})
        at["lengths"] = at.get("lengths", 0) | 1 << length

    for code, begin, length in rows():
        put(code + begin, len(code) + length)
    for code in other_codes():
        for n in OTHER_LENGTHS:
            put(code, n)
    known: dict[tuple, int] = {}
    after, lengths = [0] * 10, [0]

    def number(node: dict) -> int:
        key = (node.get("lengths", 0), *(number(node[str(d)]) if str(d) in node else 0 for d in range(10)))
        if key not in known:
            known[key] = len(lengths)
            lengths.append(key[0])
            after.extend(key[1:])
        return known[key]

    top = number(root)  # numbered last: swap it with node 1
    swap = {1: top, top: 1}
    order = [swap.get(n, n) for n in range(len(lengths))]
    return [swap.get(x, x) for n in order for x in after[n * 10 : n * 10 + 10]], [lengths[n] for n in order]


def constant_array(values: list[int]) -> Column:
    """One literal: the optimizer evaluates it once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used: within lambdas nothing else sees to that."""
    return F.get(F.transform(F.array(value), use), 0)


def is_number(digits: Column) -> Column:
    """Whether digits with their country code in front are a number that some plan knows."""
    after, lengths = map(constant_array, compiled())

    def step(at: Column, d: Column) -> Column:
        node = F.get(after, at["node"] * 10 + d.cast("int"))
        own = F.get(lengths, node)
        return F.struct(node.alias("node"), F.when(own != 0, own).otherwise(at["lengths"]).alias("lengths"))

    places = F.filter(F.split(digits, ""), lambda d: d != "")
    walked = F.aggregate(places, F.struct(F.lit(1).alias("node"), F.lit(0).alias("lengths")), step, lambda at: at["lengths"])
    allowed = F.call_function("getbit", walked, F.length(digits)) == 1
    return F.coalesce(F.when(digits.rlike(rf"^[1-9]\d{{3,{LONGEST - 1}}}$"), allowed), F.lit(False))


def international(candidate: Column, region: str = "UA") -> Column:
    """E.164 of one candidate as it is dialled in ``region``, else NULL: with a plus or 00 and a country code, with the trunk prefix, as a bare national
    number, or with the country code alone. An extension is left out."""
    code, trunk, _ = PLANS[region]
    short = F.trim(F.regexp_replace(candidate, r"(?iu)[\s,;]*(?:ext\.?|extension|доб\.?|вн\.?|#)\s*\d{1,7}\s*$", ""))

    def tried(of: Column) -> Column:
        short, digits = of["short"], of["digits"]
        local, rest = ~short.startswith("+"), lambda n: F.substring(digits, F.lit(n + 1), F.length(digits))
        forms = [(short.startswith("+"), digits), (local & digits.startswith("00"), rest(2))]
        if trunk:
            forms.append((local & digits.startswith(trunk), F.concat(F.lit(code), rest(len(trunk)))))
        forms += [(local, F.concat(F.lit(code), digits)), (local & digits.startswith(code), digits)]
        if region == "UA":  # the trunk prefix of old, 8 before the present one
            forms.append((local & digits.startswith(f"8{trunk}"), F.concat(F.lit(code), rest(1 + len(trunk)))))
        found = F.when(~short.rlike(r"^\+?[\d\s().\-]+$"), F.lit(None).cast("string"))
        for applies, number in forms:  # the first that holds ends the search
            found = found.when(applies & is_number(number), F.concat(F.lit("+"), number))
        return found

    return let(F.struct(short.alias("short"), F.regexp_replace(short, r"\D", "").alias("digits")), tried)


def candidates(text: Column, region: str = "UA") -> Column:
    """What may be numbers in running text: after a plus, 00, the trunk prefix or the region's country code."""
    code, trunk, _ = PLANS[region]
    starts = "|".join([r"\+", r"\b00", *([rf"\b{trunk}"] if trunk else []), rf"\b{code}", *([rf"\b8{trunk}"] if region == "UA" else [])])
    return F.regexp_extract_all(text, F.lit(rf"(?<![\d+])((?:{starts})[\d\s().\-]{{6,18}}\d)(?!\d)"))
