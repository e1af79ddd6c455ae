"""The bounds of the near stage's joins never leave out a similar pair."""

import numpy as np
from pyspark.sql import functions as F

from terncove.llm import jaccard


def test_similar_pairs_pass_the_bounds(spark):
    r, rows = np.random.default_rng(5), []
    for k, n in enumerate([1, 2, 5, 9, 20, 45, 90, 300, 1200] * 12):
        a = np.unique(r.integers(-(2**63), 2**63 - 1, n))
        gone = r.integers(0, n // 5 + 1)
        new = r.integers(0, max(0, int(1.25 * (n - gone)) - n) + 1)  # as many as similarity allows, or fewer
        b = np.unique(np.r_[r.permutation(a)[gone:], r.integers(-(2**63), 2**63 - 1, new)])
        common = len(np.intersect1d(a, b))
        if 9 * common < 4 * (len(a) + len(b)):
            continue
        last = np.sort(r.permutation(np.union1d(a, b))[: n // 3])
        pa, pb = (jaccard.prefix(s, last).tolist() for s in (a, b))
        places = [(pa.index(h), pb.index(h)) for h in set(pa) & set(pb)]
        rows += [(k, len(a), len(b), jaccard.odd_cells(a).tolist(), jaccard.odd_cells(b).tolist(), i, j) for i, j in places]
        assert places
    df = spark.createDataFrame(rows, "k int, na int, nb int, odd_a array<long>, odd_b array<long>, i int, j int")
    kept = df.where(jaccard._early()).groupBy("k", "na", "nb").count().where(F.col("count") >= F.expr(jaccard._MATCHES))
    assert {x.k for x in kept.collect()} == {row[0] for row in rows} and len({row[0] for row in rows}) > 50
