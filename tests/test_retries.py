"""Retries over mirrors against a sequential model."""

import random

import pytest
from pyspark.sql import functions as F

from terncove.operators import retries


def asked(attempts, mirrors, tries):
    """One query after another, as a client would."""
    out = {}
    for query in {q for q, *_ in attempts}:
        mirror, at, used, outcome = 0, 0, 0, "open"
        for _, kind in sorted((s, k) for q, s, k in attempts if q == query):
            if outcome != "open":
                break
            used += 1
            if kind == "ok":
                outcome = "ok"
            else:
                at += 1
                if kind == "broken" or at == tries:
                    mirror, at = mirror + 1, 0
                    if mirror == mirrors:
                        mirror, outcome = mirrors - 1, "failed"
        out[query] = (outcome, used, mirror)
    return out


@pytest.mark.parametrize(("mirrors", "tries", "size"), [(1, 1, 10_000), (3, 2, 2), (2, 3, 5), (4, 40, 7)])
def test_outcomes(spark, mirrors, tries, size):
    r = random.Random(mirrors)
    attempts = [("hot" if k % 3 == 0 else f"q{r.randint(0, 30)}", k, r.choices(retries.KINDS, [1, 12, 1])[0]) for k in range(400)]
    df = spark.createDataFrame(attempts, "query string, seq long, kind string").withColumn("state", F.lit("own")).repartition(5)
    got = {x.query: (x.outcome, x.attempts, x.mirror) for x in retries.outcomes(df, mirrors, tries, size).collect()}
    assert got == asked(attempts, mirrors, tries)


def test_odd_attempts(spark):
    df = spark.createDataFrame([(None, 1, "ok"), ("a", None, "ok"), ("a", 1, None), ("a", 2, "odd"), ("b", 1, "ok"), ("b", 2, "broken")], "query string, seq long, kind string")
    assert [tuple(x) for x in retries.outcomes(df).collect()] == [("b", "ok", 1, 0)]
    assert retries.outcomes(df.where("seq > 5")).count() == 0


def test_kinds(spark):
    body = '{"elements": []}'
    rows = [(200, body, "ok"), (200, '{"remark": "runtime error: x", "elements": []}', "busy"), (200, "<html>", "broken"), (429, None, "busy"), (504, "x", "busy"), (404, body, "broken"), (None, None, "broken"), (200, None, "broken")]
    df = spark.createDataFrame(rows, "s int, b string, want string")
    assert df.where(~retries.attempt_kind(F.col("s"), F.col("b")).eqNullSafe(F.col("want"))).count() == 0
