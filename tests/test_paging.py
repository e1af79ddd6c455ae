"""Pages of a snapshot against the whole sorted list."""

import random

import pytest
from pyspark.sql import functions as F

from terncove.operators import segments
from terncove.operators.paging import Snapshot


def test_deep_pages_read_few_ranges(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, f"n{r.randint(0, 300)}", None if r.random() < 0.4 else "+1") for i in range(3000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, name string, phone string")
    shot = Snapshot.take(df, segments.page_order(), f"file://{tmp_path}/s", range_rows=200)
    want = [x[0] for x in sorted(rows, key=lambda x: (x[2] is None, x[1], x[0]))]
    assert shot.total() == 3000 and len(shot.counts) == 15
    for offset, limit in ((0, 50), (190, 50), (2500, 50), (2990, 50), (5000, 10), (1000, 700), (7, 0)):
        assert [x.id for x in shot.page(offset, limit).collect()] == want[offset : offset + limit]
    deep = shot.ranges_of(2500, 50)
    assert len(deep) <= 2
    files = shot.page(2500, 50).inputFiles()
    assert {f.split("_range=")[1].split("/")[0] for f in files} <= {str(k) for k, _ in deep}
    assert [x.id for x in segments.page(df, 2500, 50).collect()] == want[2500:2550]


def test_pages_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "id long, name string, phone string")
    shot = Snapshot.take(df, segments.page_order(), f"file://{tmp_path}/s")
    assert shot.total() == 0


@pytest.mark.parametrize("threshold", [0.84])
def test_few_pairs_are_aligned_and_none_is_lost(spark, threshold):
    """The letter bound before alignment: few pairs of unlike names reach Python, and all similar ones do."""
    from difflib import SequenceMatcher

    from terncove.functions.text import plain_similarity
    from terncove.operators.dedupe import alignable

    r = random.Random(4)
    letters = "абвгдежзиклмнопрстуфхцчшщюя"
    names = ["".join(r.choices(letters, k=r.randint(6, 14))) for _ in range(120)]
    names += [n[:-1] + "я" for n in names[:15]]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    df = spark.createDataFrame(pairs, "norm string, norm2 string").withColumn("plain", plain_similarity(F.col("norm"), F.col("norm2")))
    sent = {(x.norm, x.norm2) for x in alignable(df, threshold).collect()}
    assert len(sent) < 0.05 * len(pairs)
    assert {p for p in pairs if p[0] not in p[1] and p[1] not in p[0] and SequenceMatcher(None, *p).ratio() >= threshold} <= sent
