"""Names of busy places are compared by bits: nothing similar is lost and little else is aligned."""

import random

from terncove.functions.harvest import similarity
from terncove.operators import linkage, similar


def names(r, n):
    out = []
    for _ in range(n):
        name = list("salon " + "".join(r.choices("0123456789abcdef", k=8)))
        out.append("".join(name))
        for _ in range(r.randint(0, 4)):
            i = r.randrange(len(name))
            name[i : i + 1] = r.choice([[], ["z"], [name[i], "q"]])
        out.append("".join(name))
    return out


def test_bits_lose_no_similar_pair(monkeypatch):
    every = names(random.Random(1), 120)
    want = {(i, j) for i, a in enumerate(every) for j, b in enumerate(every) if a not in b and b not in a and similarity(a, b) >= 0.8}
    assert want <= set(similar.similar_by_bits(every, every, 0.8))
    aligned = []
    monkeypatch.setattr(similar, "similarity_from", lambda a, b, least: aligned.append(1) or 0.0)
    similar.similar_by_bits(every, every, 0.8)
    assert len(aligned) < len(every) ** 2 / 20


def test_a_common_beginning_makes_no_candidates():
    places = linkage.Places()
    for i, name in enumerate(names(random.Random(2), 200)):
        places.add({"id": i, "norm": name, "lat": None, "lon": None, "house": None, "stems": set()})
    found = places.candidates({"norm": "salon 0123abcd", "lat": None, "lon": None, "house": None}, set())
    assert len(found) < 20


def test_names_of_the_same_letters_are_not_aligned(monkeypatch):
    r = random.Random(3)
    every = ["".join(r.sample("salon 0123abcd", 14)) for _ in range(200)]
    want = {(i, j) for i, a in enumerate(every) for j, b in enumerate(every) if similarity(a, b) >= 0.8}
    assert set(similar.similar_by_bits(every, every, 0.8)) == want
    aligned = []
    monkeypatch.setattr(similar, "similarity_from", lambda a, b, least: aligned.append(1) or 0.0)
    similar.similar_by_bits(every, every, 0.8)
    assert len(aligned) < 2 * len(want)


def test_names_of_the_same_letters_are_not_nearly_equal(spark):
    from pyspark.sql import functions as F

    norms = ["salon 0123abcd", "salon dcba3210", "salon 0123abcde", "salon z0123abcd", "0123ab", "x0123abx", "0123"]
    df = spark.createDataFrame([("c", n, i, True) for i, n in enumerate(norms)], "place string, norm string, id long, asked boolean").withColumn("ls", similar.letters(F.col("norm")))
    want = {(i, j) for i, a in enumerate(norms) for j, b in enumerate(norms) if i != j and similarity(a, b) >= 0.95}
    assert {(p.x, p.y) for p in similar.similar_names(df, 0.95).collect()} == want
