"""Corpus operators against brute force on small tables: nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import hashlib
import random
import re
import zlib
from functools import reduce

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terncove.llm import bktree, bpe, exact_dedup, html_text, mixing, nearest, sharding, simhash, token_counts, toxicity, units, window_index
from terncove.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rnd = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(40)]
BASE = [" ".join(rnd.choices(VOCABULARY, k=rnd.randint(0, 60))) for _ in range(40)]
NEAR = [" ".join(t.split()[:-1] + ["zz"]) for t in BASE[:8]]
LONG = " ".join(rnd.choices(VOCABULARY, k=30_000))
TEXTS = [None, "", "  \n", "one", "Two\x1cwords", *BASE, *BASE[:10], *NEAR, LONG, LONG + " end", "é🙂 日本 <|endoftext|> x", "x" * 20_000]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts=TEXTS, extra=()):
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 11 == 0 else f"src{i % 3}", None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, null ids, and columns whose names the operators use themselves."""
    extra = [(3, "one", "en", "src0", 3), (3, "one", "en", "src0", 3), (None, "one", None, None, None), (None, None, None, None, None)]
    df = documents(spark, TEXTS[:12], extra)
    for c in ("fp", "ids", "rid", "n_tokens", "copies", "_shared", "text_sha256", "n_words", "toxicity", "shard", "fits", "n_bytes"):
        df = df.withColumn(c, F.lit("own"))
    return df.cache()


# --- 1 ---
def best(vectors, k):
    out = {}
    ok = {i: v for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for q, v in ok.items():
        if q % 20 == 0:
            scored = sorted((-reduce(lambda s, ab: s + ab[0] * ab[1], zip(v, w, strict=True), 0.0), i) for i, w in ok.items() if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("block", [7, 64, 10_000])
def test_nearest_is_exact(spark, block):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 6)]) for i in range(120)]
    rows += [(200 + i, rows[20][1]) for i in range(60)]  # one very common vector
    rows += [(500, None), (501, [0.0] * 6), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (None, [1.0] * 6), (520, [1.0, 2.0])]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("rank", F.lit(9))
    got = {}
    for r_ in nearest.nearest(df, lambda i: i % 20 == 0, 5, candidate_block=block, query_block=5).orderBy("query_id", "rank").collect():
        got.setdefault(r_.query_id, []).append((r_.vec_id, r_.score))
    want = {q: v for q, v in best(rows, 5).items() if v}
    assert got == want


@pytest.mark.parametrize("block", [16, 10_000])
def test_vectors_closer_than_codes_can_tell(spark, block, monkeypatch):
    monkeypatch.setattr(nearest, "CROWD", 2)
    r = np.random.default_rng(6)
    base = r.normal(size=8)
    rows = [(i, [float(x) for x in base + r.normal(size=8) * 1e-7]) for i in range(90)] + [(200 + i, [float(x) for x in r.normal(size=8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r_ in nearest.nearest(df, lambda i: i % 20 == 0, 4, candidate_block=block, query_block=6).orderBy("query_id", "rank").collect():
        got.setdefault(r_.query_id, []).append((r_.vec_id, r_.score))
    assert got == best(rows, 4)


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.nearest(df, lambda i: i % 20 == 0).count() == 0


# --- 2 ---
def fingerprint(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, radius):
    """Smallest index reachable."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_components(docs):
    prints = [fingerprint(t) for t in TEXTS]
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (p, c) for i, (p, c) in enumerate(zip(prints, linked(prints, 3), strict=True))}


@pytest.mark.parametrize("shard, blocks", [(3, None), (4096, None), (4096, 5), (4096, 6)])
def test_clusters_survive_tiling(spark, shard, blocks):
    values, base = set(), [rnd.getrandbits(64) for _ in range(6)]
    for b in base:
        for _ in range(40):
            v = b
            for _ in range(rnd.randint(0, 9)):
                v ^= 1 << rnd.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    root = {r.node: r.root for r in components(bktree.near_links(df, blocks=blocks, shard=shard)).collect()}
    want = linked(values, 3)
    groups = lambda labels: sorted(sorted(g) for g in _groups(labels))
    assert groups([root.get(s, s) for s in signed]) == groups(want)


@pytest.mark.parametrize("finish", [0, 30, 10**6])
def test_components_of_chains_and_hubs(spark, monkeypatch, finish):
    import terncove.llm.components as module

    monkeypatch.setattr(module, "FINISH", finish)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 200), (200, 250), (7, 7)]
    r = random.Random(3)
    r.shuffle(edges)
    got = {x.node: x.root for x in components(spark.createDataFrame([(b, a) if k % 2 else (a, b) for k, (a, b) in enumerate(edges)], "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), **dict.fromkeys((200, 250, 300), 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shard_names_grow_with_the_corpus():
    assert [bktree.choose_blocks(n, 3) for n in (0, 10**6, 10**8, 10**10, 10**12)] == [4, 4, 5, 6, 6]


def test_direct_pairs_are_near(spark):
    values = sorted({rnd.getrandbits(12) for _ in range(300)})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    pairs = {(x.a, x.b) for x in bktree.near_links(df, whole=False).collect()}
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in pairs)
    has = {a for a in values for b in values if a != b and (a ^ b).bit_count() <= 3}
    assert {a for a, _ in pairs} == has


def _groups(labels):
    out = {}
    for i, x in enumerate(labels):
        out.setdefault(x, []).append(i)
    return out.values()


def test_simhash_edges(empty, odd):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near(empty).count() == 0
    rows = simhash.near_duplicates(odd, keep=("ids",)).collect()
    assert len(rows) == odd.count() and all(r.ids == "own" for r in rows)
    same = {r.component_id for r in rows if r.doc_id in (3, None) and r.fp not in (0,)}
    assert 3 in same
    assert simhash.drop_near(odd).columns == odd.columns


# --- 3 ---
def ring_model(rows, shards, vnodes):
    points = sorted((int(hashlib.md5(f"shard/{s}/{v}".encode()).hexdigest()[:13], 16), s) for s in range(shards) for v in range(vnodes))
    places = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    arcs = {}
    for doc_id in rows:
        p = int(hashlib.md5(f"key/{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16)
        arcs.setdefault(next((i for i, (q, _) in enumerate(points) if q >= p), 0), []).append(doc_id)
    load, step = [0] * shards, 0
    waiting = {a: len(r) for a, r in arcs.items()}
    while any(waiting.values()):
        for a in sorted(waiting):
            s = points[(a + step) % len(points)][1]
            took = min(waiting[a], places[s] - load[s])
            load[s] += took
            waiting[a] -= took
        step += 1
    return load


def test_shards_are_full_and_gapless(docs, odd, empty):
    for df in (docs, odd):
        rows = sharding.shard_documents(df, 5, 3).collect()
        assert len(rows) == df.count()
        load = [sum(r.shard == s for r in rows) for s in range(5)]
        assert max(load) - min(load) <= 1 and load == ring_model([r.doc_id for r in rows], 5, 3)
        for s in range(5):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(load[s]))
    by_id = {r.doc_id: r for r in sharding.shard_documents(docs).collect()}
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        assert (by_id[i].size, by_id[i].text_crc32) == (len(data) + 1, zlib.crc32(data))
    assert sharding.shard_documents(empty).count() == 0


def ring_by_keys(rows, shards, vnodes):
    """Where each key goes when keys are dealt one by one: (position, tie-breakers) to shard. Rows: (slice, doc_id, crc, size)."""
    points = sorted((int(hashlib.md5(f"shard/{s}/{v}".encode()).hexdigest()[:13], 16), s) for s in range(shards) for v in range(vnodes))
    places = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    arcs = {}
    for key, (part, doc_id, crc, size) in enumerate(rows):
        p = int(hashlib.md5(f"key/{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16)
        arc = next((i for i, (q, _) in enumerate(points) if q >= p), 0)
        arcs.setdefault(arc, []).append((part, p, (doc_id is not None, doc_id), crc, size, key))
    queues, out, used = {a: sorted(r) for a, r in sorted(arcs.items())}, {}, [0] * shards
    for step in range(len(points)):
        for a, q in queues.items():  # each arc offers its first keys to the next point clockwise
            shard = points[(a + step) % len(points)][1]
            while q and places[shard]:
                out[q.pop(0)[-1]] = shard
                places[shard] -= 1
                used[shard] += 1
    return out


def test_every_key_goes_where_the_ring_says(spark, docs, odd):
    for df in (docs, odd, spark.createDataFrame([(None if i % 3 else 7, f"t{i % 11}") for i in range(300)], "doc_id long, text string")):
        got = sharding.shard_documents(df, 5, 3).collect()
        hashed = spark.createDataFrame([(r.doc_id, r.text_crc32, r.size) for r in got], "doc_id long, crc long, size long")
        part = F.pmod(F.xxhash64("doc_id", "crc", "size", F.lit(7)), F.lit(sharding.SLICES))
        rows = [(r.part, r.doc_id, r.crc, r.size) for r in hashed.select("*", part.alias("part")).collect()]
        model = ring_by_keys(rows, 5, 3)
        want, have = {}, {}
        for k, (row, r) in enumerate(zip(rows, got, strict=True)):  # equal rows are told apart by nothing: they are counted
            want.setdefault(row, []).append(model[k])
            have.setdefault(row, []).append(r.shard)
        assert {k: sorted(v) for k, v in want.items()} == {k: sorted(v) for k, v in have.items()}


def test_rows_that_repeat_an_id_spread_over_slices(spark):
    df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    part = F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary")), F.octet_length("text") + 1, F.lit(7)), F.lit(sharding.SLICES))
    assert df.select(part.alias("p")).distinct().count() > sharding.SLICES // 2


def test_few_keys_move_when_a_shard_joins(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a = {r.doc_id: r.shard for r in sharding.shard_documents(df, 8).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard_documents(df, 9).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.5 * len(a)


# --- 4 and 5 ---
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_file("byte_bpe_50k.json"))


MARKS = ["a", "b", "'", "s", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "日本", "🙂", "1", "²", "!", "...", "<|endoftext|>", "​", "　", "\r\n", "The", " of", "-", "\x00"]
JUMBLE = ["".join(rnd.choices(MARKS, k=rnd.randint(0, 50))) for _ in range(300)]


@pytest.mark.parametrize("chunks", [(256, 8192, 10), (3, 40, 3)])
def test_chunked_encoding_equals_the_library(library, monkeypatch, chunks):
    for name, value in zip(("LEAST", "MOST", "CUT_BITS"), chunks, strict=True):
        monkeypatch.setattr(bpe, name, value)
    coder = bpe.ChunkEncoder(bpe.tokenizer_file("byte_bpe_50k.json"))
    texts = [*(t or "" for t in TEXTS), *JUMBLE, " " * 3000, "ab" * 3000 + " " + "c" * 9000]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = coder.encode_batch(texts)
    assert [np.frombuffer(g, np.uint32).tolist() for g in got] == want
    assert [coder.decode(g) for g in got] == [library.decode(w, skip_special_tokens=False) for w in want]
    assert coder.chunks_encoded < coder.chunks_seen  # repeated texts reuse their chunks
    encoded, learned = coder.chunks_encoded, []
    monkeypatch.setattr(coder, "learn", learned.extend)
    assert coder.encode_batch(texts) == got and coder.chunks_encoded == encoded and not learned  # known chunks cost no tokenising


def test_joins_that_disagree_widen_to_the_whole_text(library):
    coder, text = bpe.ChunkEncoder(bpe.tokenizer_file("byte_bpe_50k.json")), " ".join(rnd.choices(VOCABULARY, k=2000))
    for word in VOCABULARY:
        coder.units[f" {word}"] = b"\x01\x00\x00\x00"  # a wrong memory
    assert np.frombuffer(coder.encode(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids and coder.widened == 1


class Counting:
    """The library, and the number of texts it was given."""

    def __init__(self, library):
        self.library, self.texts = library, 0

    def _batch(self, name, texts, **kw):
        self.texts += len(texts)
        return getattr(self.library, name)(texts, **kw)

    def encode_batch(self, texts, **kw):
        return self._batch("encode_batch", texts, **kw)

    def encode_batch_fast(self, texts, **kw):
        return self._batch("encode_batch_fast", texts, **kw)

    def encode(self, text, **kw):
        return self._batch("encode_batch", [text], **kw)[0]


@pytest.mark.parametrize("lengths_known", [True, False])
def test_new_units_reach_the_library_together(library, lengths_known):
    coder = bpe.ChunkEncoder(bpe.tokenizer_file("byte_bpe_50k.json"))
    coder.tokenizer = counting = Counting(coder.tokenizer)
    if not lengths_known:
        coder.n_bytes = coder.n_bytes + 1  # tokens then seem to end elsewhere than units
    words = [f"w{i}{m}" for i in range(3000) for m in ("", ",", "é", "'s", "<|endoftext|>", "\u00a0日")]
    text = "  ".join(words) + "\n"
    assert np.frombuffer(coder.encode(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids and not coder.widened
    if lengths_known:
        assert counting.texts < 2 * coder.chunks_seen + len(words) // 100


def test_memo_lacks_what_no_generation_has():
    memo = units.Memo(4)
    memo.update(a=b"1", b=b"2", c=b"3")
    memo.turn()
    memo["d"] = b"4"
    assert memo.lacking(["a", "d", "e"]) == ["e"] and dict(memo) == {"d": b"4", "a": b"1"}
    assert memo.lacking(["f"]) == ["f"]


def test_encode_documents(docs, odd, empty, library):
    path = bpe.tokenizer_file("byte_bpe_50k.json")
    for r in bpe.encode_documents(docs, path).collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids) and r.decoded == (r.text or "")
    got = bpe.encode_documents(odd, path)
    assert got.count() == odd.count() and {"shard", "doc_id", "ids"} <= set(got.columns) and len(got.columns) == len(set(got.columns))
    assert bpe.encode_documents(empty, path).count() == 0


def test_counts_at_every_prefix(library):
    own = token_counts.PrefixCounter(bpe.tokenizer_file("byte_bpe_50k.json"))
    for text in [*(t or "" for t in TEXTS), *JUMBLE]:
        assert own.total(text) == len(library.encode(text, add_special_tokens=False).ids)
    for text in ("internationalisation", "The quick brown fox", "日本語"):
        data, counts = text.encode(), own.prefix_counts(text)
        for i in range(len(data) + 1):
            try:
                cut = data[:i].decode()
            except UnicodeDecodeError:
                continue
            assert counts.at(i) == len(library.encode(cut, add_special_tokens=False).ids)
        for budget in range(6):
            assert counts.at(counts.longest_within(budget)) <= budget
            assert all(counts.at(i) > budget for i in range(counts.longest_within(budget) + 1, min(len(data), counts.longest_within(budget) + 2)))


def test_count_documents(docs, odd, empty, library):
    path = bpe.tokenizer_file("byte_bpe_50k.json")
    rows = {r.doc_id: r for r in token_counts.count_tokens(docs, path, budgets=(0, 5)).collect()}
    for i, t in enumerate(TEXTS):
        assert rows[i].n_bytes == len((t or "").encode()) and rows[i].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids)
        assert rows[i].fits[0] == 0
    assert token_counts.count_tokens(odd, path).count() == odd.count() and token_counts.count_tokens(empty, path).count() == 0


# --- 6 ---
def toxic_corpus(n, seed):
    r, texts, labels = random.Random(seed), [], []
    for i in range(n):
        words = r.choices([f"plain{j}" for j in range(300)], k=r.randint(5, 300))
        if i % 4 == 0:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(["vile", "nasty", f"gruff{r.randint(0, 99)}"]))
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_toxicity_on_held_out_texts():
    crf = toxicity.fit(*toxic_corpus(600, 1))
    texts, labels = toxic_corpus(200, 2)
    scores, spans = toxicity.Scorer(crf)(texts, True)
    right = sum((s >= 0.5) == bool(y) for s, y in zip(scores, labels, strict=True))
    assert right >= 190
    words = {t[s["start"] : s["end"]] for t, own in zip(texts, spans, strict=True) for s in own}
    assert {"vile", "nasty"} <= {w for phrase in words for w in phrase.split()}


def test_marginals_equal_enumeration():
    r = np.random.default_rng(3)
    scores, trans = r.normal(size=7), r.normal(size=(2, 2))
    p = toxicity.marginals(scores, np.array([0]), np.array([7]), trans)[2]
    weight, total = np.zeros(7), 0.0
    for bits in range(128):
        y = [(bits >> i) & 1 for i in range(7)]
        w = np.exp(sum(s for s, b in zip(scores, y, strict=True) if b) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        weight += w * np.array(y)
    assert np.allclose(p, weight / total)


def test_scores_from_enumerated_marginals():
    """A text's score is the logistic of what forward-backward gives, here summed over all labellings of its words."""
    crf = toxicity.fit(*toxic_corpus(200, 4))
    for text in ("plain1 vile plain2 nasty", "plain3", "nasty vile gruff1 plain9 plain8 vile", ""):
        words = text.split()
        scores = [crf.emission(w) for w in words]
        weight, total = np.zeros(len(words)), 0.0
        for bits in range(1 << len(words)):
            y = [(bits >> i) & 1 for i in range(len(words))]
            w = np.exp(sum(s for s, b in zip(scores, y, strict=True) if b) + sum(crf.trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            weight += w * np.array(y)
        p = weight / total if words else np.zeros(0)
        most = min(max(p.max() if words else 1e-6, 1e-6), 1 - 1e-6)
        x = np.array([1.0, np.log(p.sum() + 1e-3), np.log(most / (1 - most))])
        want = 1 / (1 + np.exp(-np.clip(x @ crf.calibration, -30, 30)))
        assert abs(toxicity.Scorer(crf)([text], False)[0][0] - want) < 1e-6


def test_toxicity_of_the_given_labels(spark):
    """On the given tables, by rows that the model did not learn from and by the others. Labels of texts without any word that tells are noise."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.learn(docs, labels), spans=False).join(labels.where("toxic is not null"), "doc_id")
    n = {(r.held, r.toxic, r.hit): r["count"] for r in scored.groupBy(toxicity.held_out(F.col("doc_id")).alias("held"), "toxic", (F.col("toxicity") >= 0.5).alias("hit")).count().collect()}
    for held in (True, False):
        right, wrong, missed = n.get((held, 1, True), 0), n.get((held, 0, True), 0), n.get((held, 1, False), 0)
        assert right / max(1, right + wrong) >= 0.9 and right / (right + missed) >= 0.6


def test_toxicity_edges(spark, odd, empty):
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(12)] + [(5, None, 0), (None, None, 1)], "doc_id long, quality int, toxic int")
    for model in (toxicity.learn(odd, labels), toxicity.learn(odd, labels.where("1 = 0")), toxicity.learn(empty, labels)):
        got = toxicity.score(odd, model).collect()
        assert len(got) == odd.count() and all(0 <= r.toxicity <= 1 for r in got)
    assert toxicity.score(empty, toxicity.fit([], [])).count() == 0


# --- 7 ---
def test_mixture_meets_its_targets(spark, empty, odd):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * max(0, int(r.lognormvariate(3, 1)))), "en", None if i % 10 == 9 else f"s{min(i % 8, 4)}", None) for i in range(3000)]
    df = spark.createDataFrame([*rows, rows[5], rows[5]], DOCS)
    got = mixing.mix(df).collect()
    assert len(got) == 3002
    size = {}
    for x in got:
        size.setdefault(x.source, [0, 0, x.target])
        size[x.source][0] += x.size
        size[x.source][1] += x.taken
        assert 0 <= x.taken <= 2 * x.size and (x.size == 0 or x.taken % x.size == 0)
    weights = {s: [3, 1, 2][i % 3] for i, s in enumerate([*sorted(s for s in size if s is not None), None])}
    left, open_, want = 1.5 * sum(v[0] for v in size.values()), set(size), {}
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if level * weights[s] > 2 * size[s][0]]
        want |= {s: 2 * size[s][0] for s in full} if full else {s: level * weights[s] for s in open_}
        left -= sum(want[s] for s in full)
        open_ = open_ - set(full) if full else set()
    for s, (_, taken, target) in size.items():
        assert abs(target - want[s]) < 1e-6 * max(1, want[s]) and abs(taken - target) <= 0.01 * target + 2
    again = {(x.doc_id, x.size): x.taken for x in mixing.mix(df.repartition(7)).collect()}
    assert all(again[x.doc_id, x.size] == x.taken for x in got)
    copies = {}
    for x in mixing.repeat_rows(df).collect():
        copies[x.doc_id] = copies.get(x.doc_id, 0) + 1
    want_copies = {}
    for x in got:
        want_copies[x.doc_id] = want_copies.get(x.doc_id, 0) + x.copies
    assert copies == {i: n for i, n in want_copies.items() if n}
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd).count() == odd.count()
    assert mixing.repeat_rows(odd).columns == odd.columns


def test_rates_do_not_depend_on_the_order_of_sums(spark):
    r = random.Random(8)
    sizes = [int(r.lognormvariate(5, 1.5)) + 1 for _ in range(4000)]
    classes = spark.createDataFrame([("a", x, 1) for x in sizes], "name string, size long, n long").groupBy("name", "size").agg(F.sum("n").alias("n"))
    targets = spark.createDataFrame([("a", sum(sizes), 0.618 * sum(sizes))], "name string, source_size long, target double")
    lams = [mixing.solve_dual(classes.repartition(p), targets, 2.0, steps).first()["lam"] for p, steps in ((3, 10), (7, 14), (5, 40))]
    assert len(set(lams)) == 1 and lams[0] < 0
    m = sum(sizes) / len(sizes)
    words = sum(2 * x / (1 + np.exp(-lams[0] * x / m)) for x in sizes)
    assert abs(words / sum(sizes) - 0.618) < 1e-6


def test_word_counts(docs):
    got = {r.doc_id: r.n for r in docs.select("doc_id", mixing.word_count(F.col("text")).alias("n")).collect()}
    assert got == {i: len(WORD.findall(t or "")) for i, t in enumerate(TEXTS)}


# --- 8 ---
def test_exact_groups(docs, empty, odd):
    groups = {}
    for i, t in enumerate(TEXTS):
        groups.setdefault(t or "", []).append(i)
    for r in exact_dedup.exact_groups(docs).collect():
        own = groups[TEXTS[r.doc_id] or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert r.text_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0
    rows = exact_dedup.exact_groups(odd).collect()
    assert len(rows) == odd.count()
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})  # one of each, repeats included
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(t or "" for (t,) in kept.select("text").collect()) == sorted({t or "" for (t,) in odd.select("text").collect()})


@pytest.mark.parametrize("segment_bits, slot_bits", [(0, 0), (0, 6), (3, 5), (5, 0), (4, 14)])
def test_filters_merge_without_loss(segment_bits, slot_bits):
    r = np.random.default_rng(1)
    parts = [r.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(5)]
    parts = [np.r_[p, parts[0][:50], p[:5], np.array([0, 2**64 - 1], np.uint64)] for p in parts]
    by_segment = {}
    for p in parts:
        for segment, *row in exact_dedup.partition_filters(p, segment_bits, slot_bits):
            by_segment.setdefault(segment, []).append(exact_dedup.CountingQuotientFilter.read(segment_bits, slot_bits, *row))
    got = {}
    for segment, filters in by_segment.items():
        one = exact_dedup.merged(filters)
        assert (one.remainders < 2 ** (64 - segment_bits - slot_bits)).all() and one.runs.sum() == len(one.remainders)
        top = segment << (64 - segment_bits) if segment_bits else 0
        got |= {int(k) | top: int(c) for k, c in zip(one.keys(), one.counts, strict=True)}
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert got == dict(zip(keys.tolist(), counts.tolist(), strict=True))


def test_remainders_travel_in_fewer_bytes_than_fingerprints():
    keys = np.random.default_rng(2).integers(0, 2**64, 100_000, dtype=np.uint64)
    rows = exact_dedup.partition_filters(keys, 2, 14)
    assert sum(len(x) for r in rows for x in r[1:]) < 7 * len(keys)


# --- 9 ---
MENU = "<nav><a>Home</a></nav><div>Follow our feed</div>"


def page(body, menu=MENU):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body>{menu}{body}<footer>c 2024</footer></body></html>"


def test_pages(spark):
    rows = [
        (1, "https://a.com/x/1", page("<article><h1>T &amp; A</h1><p>One\n two<p>three <b>four</b></p><script>no()</script><div class='comments'><p>nice</p></div></article>")),
        (2, "https://a.com/x/2", page("<div><p>Alpha.</p><p>Beta.</p></div>")),
        (3, "https://a.com/x/3", page("<div><p>Gamma.</p></div>")),
        (4, "https://b.com/1", page("<p>Lonely.</p>", "<div class='sidebar-menu'>Menu</div>")),
        (5, None, None), (6, "https://c.com", ""), (7, "::", "<p>bare &lt;text&gt; <br>next"), (7, "::", "<p>bare &lt;text&gt; <br>next"),
        (None, "https://a.com/y", "<div class=ad>x</div><aside>y</aside><form>z</form><p>kept</p><!-- c -->"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own")).withColumn("key", F.lit(1))
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()), key=str)
    want = [(1, "T & A\nOne two\nthree four"), (2, "Alpha.\nBeta."), (3, "Gamma."), (4, "Lonely."), (5, ""), (6, ""), (7, "bare <text>\nnext"), (7, "bare <text>\nnext"), (None, "kept")]
    assert got == sorted(((i, t, len(t)) for i, t in want), key=str)
    assert html_text.extract(df.where("1 = 0")).count() == 0


def test_names_of_page_state_delete_nothing(spark):
    bodies = [
        "<body class='single has-sidebar no-comments'><article><p>Kept.</p></article></body>",
        "<body class='menu'><p>Kept.</p></body>",
        "<div class='layout-with-menu'><p>Kept.</p></div>",
        "<article class='post no-comments'><p>Kept.</p></article>",
        "<main id='social'><p>Kept.</p></main>",
        "<div class='overlay'><div><article><p>Kept.</p></article></div>no</div>",
        "<article><section id='discussion'><p>Kept.</p></section><div class='related'><p>no</p></div><section id='comments'>no</section></article>",
        "<article><p>Kept.</p><div class='box ad'>no</div><div class='nav-menu'>no</div></article>",
    ]
    df = spark.createDataFrame([(i, f"https://h{i}.com/", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {i: "Kept." for i in range(len(bodies))}


def test_differencing_decides_inside_articles(spark):
    box, team = "<div class='author-box'><p>By the staff.</p><p>Write to us.</p></div>", "<ul id='team'><li>Ann</li><li>{}</li></ul>"
    own = lambda n: f"<h1>T{n}</h1><p>Own {n}, first.</p><p>A passage of both.</p><div class='entry'><p>A quotation.</p><p>Own {n}, last.</p></div>"
    pages = {
        (1, "a.com/x/1"): page(f"<article>{own(1)}{box}{team.format('Bob')}</article>"),
        (2, "a.com/x/2"): page(f"<article>{own(2)}{box}{team.format('Eve')}</article>"),
        (3, "b.com/x/1"): page("<main><article><p>One story that is longer than its menu.</p></article><article><p>Latest news</p></article></main>"),
        (4, "b.com/x/2"): page("<main><article><p>Two mice that ran away from the kitchen.</p></article><article><p>Latest news</p></article></main>"),
        (5, "c.com/x/1"): page("<article><p>Short.</p></article>"),
        (6, "c.com/x/2"): page("<article><p>Short.</p><p>And a good deal more than that, which the other page does not have.</p></article>"),
        (7, "d.com/x/1"): page(f"<article>{own(7)}{box}</article>"),
    }
    df = spark.createDataFrame([(i, f"https://{u}", h) for (i, u), h in pages.items()], "page_id long, url string, html string")
    text = lambda n: [f"T{n}", f"Own {n}, first.", "A passage of both.", "A quotation.", f"Own {n}, last."]
    want = {
        1: [*text(1), "Ann", "Bob"], 2: [*text(2), "Ann", "Eve"],  # parts that are shared as a whole go, passages and parts with lines of their own stay
        3: ["One story that is longer than its menu."], 4: ["Two mice that ran away from the kitchen."],
        5: ["Short."], 6: ["Short.", "And a good deal more than that, which the other page does not have."],  # the greater part of an article never goes
        7: [*text(7), "By the staff.", "Write to us."],  # no other page of the host says whose it is
    }
    assert {r.page_id: r.text.split("\n") for r in html_text.extract(df).collect()} == want


def test_empty_and_embedded_elements_keep_text():
    source = "<article>One <svg viewBox='0 0'/> two <svg><text>no</text></svg><math><mi>x</mi></math><math/> <object data=a>three</object><iframe src='a'/> four</article>"
    assert [x.text for x in html_text.page_lines(source)] == ["One two x three four"]


def differenced(pages):
    """Texts of pages (key, host, path, lines) without article elements, by the definition: quadratic alignment, runs of copies."""

    def common(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        return best[0][0]

    def size(lines):
        return sum(map(len, lines))

    pages, runs, out = sorted(pages, key=lambda p: (p[1], p[2], p[0])), [], {}
    for p in pages:
        last = runs[-1][-1] if runs else None
        if last and last[1] == p[1]:
            shared = [last[3][i] for i in html_text.common_lines(last[3], p[3])]
            assert len(shared) == common(last[3], p[3])
            if size(shared) >= 0.8 * max(size(last[3]), size(p[3])):
                runs[-1].append(p)
                continue
        runs.append([p])
    for k, run in enumerate(runs):
        for p in run:
            near = [q for q in ([runs[k - 1][-1]] if k else []) + ([runs[k + 1][0]] if k + 1 < len(runs) else []) if q[1] == p[1]]
            prefix = lambda q: next((i for i, (x, y) in enumerate(zip(q[2], p[2], strict=False)) if x != y), min(len(q[2]), len(p[2])))  # noqa: E731, B023
            gone = set(html_text.common_lines(p[3], max(near, key=prefix)[3])) if near else set()
            out[p[0]] = "\n".join(x for i, x in enumerate(p[3]) if i not in gone)
    return out


@pytest.mark.parametrize("slots", [1, 7])
def test_differencing_decides_on_pages_without_an_article_element(spark, slots):
    r, pages = random.Random(5), []
    for h in range(4):
        top = [f"Menu {h} {k}" for k in range(r.randint(2, 4))]
        for n in range(12 if h else 40):
            body = [" ".join(f"w{r.randrange(9)}" for _ in range(r.randint(8, 20))) for _ in range(r.randint(1, 5))]
            if n and r.random() < 0.4:  # a copy of the page before, with another line at most
                body = [*pages[-1][3][len(top) : -1], *(["Updated."] if r.random() < 0.5 else [])]
            pages.append((len(pages), f"h{h}.com", f"/{r.choice('ab')}/{n:02}", [*top, *body, f"Footer {h}"]))
    rows = [(k, f"https://{h}{p}", "<body>" + "".join(f"<p>{x}</p>" for x in lines)) for k, h, p, lines in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slots)
    try:
        # keys order pages of one path, so the model orders them alike; paths differ here
        got = {x.page_id: x.text for x in html_text.extract(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == differenced(pages)
    cut = sum(got[k] != "\n".join(lines) for k, _, _, lines in pages)
    copies = sum(lines[-2] in got[k] for k, _, _, lines in pages)
    assert cut > 0.9 * len(pages) and copies > 0.9 * len(pages)  # menus went, copies kept their article


def test_common_lines_are_longest():
    def length(a, b):
        best_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best_[i + 1][j + 1] = best_[i][j] + 1 if x == y else max(best_[i][j + 1], best_[i + 1][j])
        return best_[-1][-1]

    for _ in range(200):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        found = html_text.common_lines(a, b)
        assert found == sorted(set(found)) and len(found) == length(a, b)
        it = iter(b)
        assert all(a[i] in it for i in found)


# --- 10 ---
def removed_words(texts, size):
    first, out = {}, []
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            w = tuple(words[k : k + size])
            if first.setdefault(w, i) < i:
                gone[k : k + size] = [True] * size
        out.append([w for w, g in zip(words, gone, strict=True) if not g])
    return out


@pytest.mark.parametrize("block, batches", [(50, 1), (50, 5), (1_000_000, 4)])
def test_windows(spark, docs, monkeypatch, block, batches):
    monkeypatch.setattr(window_index, "BLOCK_WORDS", block)
    texts = [*TEXTS, *[" ".join(BASE[i].split()[:20] + ["new"] + BASE[i + 1].split()) for i in range(10)]]
    df = documents(spark, texts)
    want = removed_words(texts, 13)
    for r in window_index.deduplicate(df, batches=batches).collect():
        assert (r.n_words, r.n_removed, r.kept_text) == (len(WORD.findall(texts[r.doc_id] or "")), len(WORD.findall(texts[r.doc_id] or "")) - len(want[r.doc_id]), " ".join(want[r.doc_id]))


def test_batches_against_the_index(spark):
    texts = [*BASE, *BASE[::-1], *NEAR, *BASE[5:30]]
    df, index, got, levels = documents(spark, texts), window_index.WindowIndex(spark, segment_windows=400), {}, []
    for lo in range(0, len(texts), 12):
        batch, past = df.where(f"doc_id >= {lo} and doc_id < {lo + 12}"), df.where(f"doc_id < {lo}")
        got |= {r.doc_id: r.kept_text for r in window_index.deduplicate(batch, index, "doc_id", "text", past).collect()}
        levels.append(sorted(r.level for r in index.runs))
        index = window_index.WindowIndex.open(spark, index.path) if lo % 24 else index  # a later session goes on from the manifest
        index.segment_windows = 400
    assert got == {i: " ".join(w) for i, w in enumerate(removed_words(texts, 13))}
    # batches gather as runs; every third run of a level is compacted into one of the next
    assert levels[:9] == [[0], [0, 0], [1], [0, 1], [0, 0, 1], [1, 1], [0, 1, 1], [0, 0, 1, 1], [2]]
    total = sum(r.windows for r in index.runs)
    assert index.rewritten <= 2 * total  # as often as there are levels
    assert len({r.bits for r in index.runs}) >= 1 and max(r.bits for r in index.runs) >= 2  # segments became more as windows did


def test_segments_split_as_they_grow():
    keys = np.sort(np.random.default_rng(3).integers(0, 2**64, 5000, dtype=np.uint64))
    doc, at = np.arange(5000) % 37, np.arange(5000) * 3
    row = window_index._packed(0, "", "index", keys, doc, at)
    import pandas as pd

    parts = pd.concat(window_index._split(3)(iter([pd.DataFrame([row], columns=window_index.RUN_COLUMNS)])))
    assert sorted(parts["segment"]) == list(range(8))
    got = [window_index._expand(r) for r in parts.itertuples(index=False)]
    assert (np.concatenate([g[0] for g in got]) == keys).all() and (np.concatenate([g[1] for g in got]) == doc).all()
    assert (np.concatenate([g[2] for g in got]) == at).all() and all((g[0] >> np.uint64(61) == s).all() for g, s in zip(got, parts["segment"], strict=True))


def test_repeats_are_found_though_fingerprints_collide(spark):
    """With fingerprints of 5 bits nearly all claims name a wrong place; the repeats are the same."""
    texts = [" ".join(f"v{rnd.randrange(60)}" for _ in range(40)) for _ in range(30)]
    texts += [" ".join(texts[k].split()[:25] + texts[k + 7].split()[5:]) for k in range(20)]
    df = documents(spark, texts)
    index = window_index.WindowIndex(spark, fingerprint_bits=5)
    got = {r.doc_id: r.kept_text for r in window_index.deduplicate(df, index).collect()}
    assert got == {i: " ".join(x) for i, x in enumerate(removed_words(texts, 13))}


def test_window_edges(odd, empty):
    assert window_index.deduplicate(empty).count() == 0
    got = window_index.deduplicate(odd)
    assert got.count() == odd.count() and got.where("n_removed > 0 and doc_id is null").count() == 0


def test_window_hashes_depend_on_words_alone():
    a = window_index.window_hashes(window_index.split_words("x y  z a b c"), 3)
    b = window_index.window_hashes(window_index.split_words("z a b\nc"), 3)
    assert a[2:].tolist() == b.tolist() and len(set(a.tolist())) == 4
    assert len(window_index.window_hashes([b"x"], 3)) == 0
