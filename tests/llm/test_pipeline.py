"""The pipeline's stages against brute force, each on what its predecessor kept."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terncove.llm import bpe



@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r, path = random.Random(4), tmp_path_factory.mktemp("sf")
    words = [f"plain{j}" for j in range(400)]
    texts = [" ".join(r.choices(words, k=r.randint(20, 120))) for _ in range(240)]
    toxic = [int(i % 5 == 0) for i in range(240)]
    for i, y in enumerate(toxic):
        if y:
            own = texts[i].split()
            for _ in range(4):
                own.insert(r.randrange(len(own)), r.choice(["vile", "nasty"]))
            texts[i] = " ".join(own)
    texts += [texts[1], texts[2], texts[2], texts[3] + " plain1", None, ""]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": [f"s{i % 3}" for i in range(len(texts))], "n_chars": [len(t or "") for t in texts]})
    docs.to_parquet(path / "documents.parquet")
    pd.DataFrame({"doc_id": range(240), "quality": 1, "toxic": toxic}).to_parquet(path / "labels.parquet")
    return str(path), texts, toxic


def test_stages(spark, folder):
    path, texts, toxic = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        seen.append([tuple(x) for x in docs.select("doc_id", "text").collect()])
        assert name == "encoding" or docs.columns == columns
    clean, exact, near, mixed, coded = seen
    dropped = {i for i in range(len(texts))} - {i for i, _ in clean}
    bad = {i for i, y in enumerate(toxic) if y}
    assert len(dropped ^ bad) <= 3
    last = {}
    for i, t in clean:
        last[t or ""] = max(i, last.get(t or "", -1))
    assert sorted(i for i, _ in exact) == sorted(last.values())
    rows = sorted(exact)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").split() for _, t in rows)]
    copies = {b for b in range(len(rows)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert sorted(i for i, _ in near) == [i for k, (i, _) in enumerate(rows) if k not in copies] and copies
    kept = dict(near)
    assert set(mixed) <= set(near) and max(Counter(mixed).values()) <= 2
    sizes = Counter()
    for i, t in near:
        sizes[i % 3] += len((t or "").split())
    taken = Counter()
    for i, t in mixed:
        taken[i % 3] += len((t or "").split())
    level, targets = 1.5 * sum(sizes.values()) / 6, {}
    targets[0] = min(3 * level, 2 * sizes[0])  # weights 3, 1, 2; only the first can be capped here
    for k, w in ((1, 1), (2, 2)):
        targets[k] = (1.5 * sum(sizes.values()) - targets[0]) * w / 3
        assert targets[k] < 2 * sizes[k]
    for k in range(3):
        assert abs(taken[k] - targets[k]) <= 0.01 * targets[k] + 2
    assert Counter(coded) == Counter(mixed) and kept
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_file("byte_bpe_50k.json"))
    for r in docs.collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "") and r.n_tokens == len(r.ids)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 0


def test_columns_named_like_what_stages_add(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    plain = sorted(r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, path).collect())
    names = ["toxicity", "Toxic_Spans", "ids", "decoded", "_own_toxicity", "fp"]
    for c in names:
        docs = docs.withColumn(c, F.concat(F.lit("own "), "doc_id"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, path).cache()
        assert kept.columns == docs.columns
        assert all(r[c] == f"own {r.doc_id}" for r in kept.collect() for c in names)
        if before is docs:
            assert sorted(r.doc_id for r in kept.collect()) == plain


def test_near_stage_drops_texts_of_similarity_four_fifths(spark):
    r = random.Random(11)
    texts = [[f"w{r.randrange(3000)}" for _ in range(r.randint(8, 160))] for _ in range(60)]
    for t in texts[:40]:  # copies with changed words, similar and not
        copy = list(t)
        for _ in range(r.randint(1, 3)):
            copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
        texts.append(copy)
    base = [f"y{k}" for k in range(200)]
    texts += [[*base[:k], f"z{k}", *base[k + 1 :]] for k in range(0, 200, 4)]
    texts += [[*base[:30], *[f"v{i}_{k}" for k in range(40)]] for i in range(50)]  # share a passage only
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(x.doc_id for x in corpus_pipeline.drop_near(spark, docs, "").collect())
    assert got == sorted(set(root)) and len(got) < len(texts) - 50
