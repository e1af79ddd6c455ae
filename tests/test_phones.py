"""Numbering plans: the shared trie, and numbers as people write them."""

import itertools

import pytest
from pyspark.sql import functions as F

from terncove.functions import phones
from terncove.functions import text as X


def valid(digits: str) -> bool:
    """The walk over the two arrays, in Python."""
    after, lengths = phones.compiled()
    node, known = 1, 0
    for d in digits:
        node = after[node * 10 + int(d)]
        known = lengths[node] or known
    return bool(known >> len(digits) & 1)


BEGINNINGS: dict[str, set[int]] = {}
for _code, _begin, _n in phones.rows():
    BEGINNINGS.setdefault(_code + _begin, set()).add(len(_code) + _n)


def by_rows(digits: str) -> bool:
    """The definition: of the beginnings that a plan lists the longest decides about the length."""
    for k in range(len(digits), 0, -1):
        if digits[:k] in BEGINNINGS:
            return len(digits) in BEGINNINGS[digits[:k]]
    return any(digits.startswith(c) for c in phones.other_codes()) and len(digits) in phones.OTHER_LENGTHS


def test_trie_is_the_plans():
    heads = [code + tail for code, _, _ in phones.PLANS.values() for tail in ("", *(f"{n:03}" for n in range(0, 1000, 7)))] + ["995", "999", "20", "212", "0"]
    for head, n in itertools.product(heads, range(4, 16)):
        digits = (head + "2345678901234567")[:n]
        assert valid(digits) == by_rows(digits), digits


def test_equal_subtrees_are_shared():
    assert len(phones.compiled()[1]) < 200
    assert len(list(phones.beginnings("2-9xx2-9"))) == 6400


CASES = [
    ("0671234567", "+380671234567"),
    ("+380671234567", "+380671234567"),
    ("0671234567; 0509876543", "+380671234567"),
    ("+38 (067) 123-45-67; 0501112233", "+380671234567"),
    ("x; 0509876543", "+380509876543"),
    ("+38", None),
    (None, None),
    ("0000000000", "0000000000"),
    ("(12) 345-67-890", "(12) 345-67-890"),
    ("067 123 45 67 доб. 12", "+380671234567"),
    ("+1 212 555 0199", "+12125550199"),
    ("+1 212 555 019", "+1 212 555 019"),
    ("+1 212 555 01999", "+1 212 555 01999"),
    ("+1 112 555 0199", "+1 112 555 0199"),
    ("+44 20 7946 0958", "+442079460958"),
    ("+44 20 7946 09581", "+44 20 7946 09581"),
    ("0044 20 7946 0958", "+442079460958"),
    ("+48 22 123 45 67", "+48221234567"),
    ("+995 32 212 34 56", "+995322123456"),
    ("+995 32 21", None),
]


def test_normalize(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "i int, x string")
    got = [r.p for r in df.select("i", X.normalize_phone(F.col("x")).alias("p")).orderBy("i").collect()]
    assert got == [want for _, want in CASES]


@pytest.mark.parametrize("region, raw, want", [("DE", "030 1234567", "+49301234567"), ("PL", "22 123 45 67", "+48221234567"), ("US", "(212) 555-0199", "+12125550199"), ("GB", "020 7946 0958", "+442079460958"), ("US", "112 555 0199", "112 555 0199")])
def test_other_regions(spark, region, raw, want):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(X.normalize_phone(F.col("x"), region)).first()[0] == want


def test_found_in_text(spark):
    text = "тел. 067 123 45 67, факс +380 (50) 111-22-33; 067 123 45 67, order 1234567890123456, US +1 212 555 0199, bad +1 212 555 019"
    df = spark.createDataFrame([(text,), ("",), (None,)], "x string")
    got = [r[0] for r in df.select(X.find_phones(F.col("x"))).collect()]
    assert got == [["+380671234567", "+380501112233", "+12125550199"], [], None]
    assert df.select(X.find_phones(F.col("x"), limit=1)).first()[0] == ["+380671234567"]
