"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Two states, clean and toxic, over the words of a text. A word's emission score is the sum of the weights of its features
(the word in lower case without outer punctuation, its beginnings of 4 to 7 letters); two states make forward-backward a
pair of scalar recursions over log-odds, which run over many chains at once.

Learning needs labels of words; the table labels documents. Words get labels from it: in a toxic document a word is toxic
if one of its features is a cue, that is, far more frequent (by document) in toxic than in clean documents of the sample by
the log-likelihood ratio. All other words are clean. The CRF is fitted to these labelled words by full-batch gradient steps,
then a small logistic model maps a document's marginals (expected number of toxic words, strongest word) to its score.

The sample is bounded and documented: ``TOXIC_SAMPLE`` and ``CLEAN_SAMPLE`` labelled documents at most, those with the
smallest hash of doc_id; among them texts above ``LONGEST`` bytes are left out, and rows that repeat a doc_id count as the greatest. Everything else covers all rows and whole texts. Scores
depend on the text alone.

Defined results: null and empty texts have no words and get the score of no evidence; rows of a doc_id with contradictory
labels are not learned from; without labels of both kinds every score is the share of toxic labels (0 without labels); an
empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append
from .fingerprints import simhash
from .units import Memo, forget

TOXIC_SAMPLE = 600
CLEAN_SAMPLE = 1500
LONGEST = 32_768
ALIKE = 12  # bits by which SimHash fingerprints of near copies differ at most
CHAIN = 256  # words; a text is cut into chains of this length
LEAST_DOCUMENTS = 3  # of the sample in which a feature occurs to get a weight
STEPS = 70
MEMO_WORDS = 250_000
SPANS = "array<struct<start:int,end:int,probability:double>>"

_WORD = re.compile(r"[^ \t-\r]+")
_OUTER = string.punctuation + "\u00a1\u00bf\u00ab\u00bb\u201c\u201d\u2018\u2019\u2026"


def features(word: str) -> list[str]:
    """One for any word, the word in lower case without outer punctuation, and its beginnings of 4 to 7 letters."""
    core = word.strip(_OUTER).lower()
    return ["", f"{core}\n", *[core[:n] for n in range(4, min(len(core), 7) + 1)]]


def chain_starts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the chains of texts of so many words that follow each other in one array."""
    parts = -(-lengths // CHAIN)
    of = np.repeat(np.arange(len(lengths)), parts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(np.cumsum(lengths) - lengths, parts) + nth * CHAIN
    return start, np.minimum(CHAIN, lengths[of] - nth * CHAIN)


def marginals(scores: np.ndarray, start: np.ndarray, length: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log-odds and P(toxic) of each word. ``trans[i, j]``: weight of state j after state i."""
    e = np.exp(trans)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    live = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")  # chains longer than t
    forward, backward = np.zeros(len(scores)), np.zeros(len(scores))
    for t, n in enumerate(live):
        i = start[:n] + t
        if t == 0:
            forward[i] = scores[i]
        else:
            u = np.exp(np.clip(forward[i - 1], -50, 50))
            forward[i] = scores[i] + np.log((e[0, 1] + e[1, 1] * u) / (e[0, 0] + e[1, 0] * u))
    for t in range(len(live) - 2, -1, -1):
        i = start[: live[t + 1]] + t
        v = np.exp(np.clip(scores[i + 1] + backward[i + 1], -50, 50))
        backward[i] = np.log((e[1, 0] + e[1, 1] * v) / (e[0, 0] + e[0, 1] * v))
    return forward, backward, 1 / (1 + np.exp(-np.clip(forward + backward, -50, 50)))


@dataclass
class Crf:
    weights: dict[str, float]
    trans: np.ndarray
    calibration: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0, 0.0]))
    constant: float | None = None

    def emission(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))

    def evidence(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per text: 1, log of the expected number of toxic words, log-odds of the strongest one."""
        ends = np.cumsum(lengths)
        sums = np.r_[0, np.cumsum(p)]
        most = np.full(len(lengths), 1e-6)
        some = lengths > 0
        if some.any():
            most[some] = np.maximum.reduceat(p, (ends - lengths)[some])
        most = np.clip(most, 1e-6, 1 - 1e-6)
        return np.stack([np.ones(len(lengths)), np.log(np.maximum(sums[ends] - sums[ends - lengths], 0) + 1e-3), np.log(most / (1 - most))], axis=1)


def fit(texts: list[str], toxic: list[int], clean_share: float = 1.0) -> Crf:
    """``clean_share``: how many clean documents one of the sample stands for, relative to a toxic one."""
    crf = Crf({}, np.zeros((2, 2)))
    y_doc = np.array(toxic)
    if len(set(toxic)) < 2:
        crf.constant = float(np.mean(y_doc)) if len(y_doc) else 0.0
        return crf
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in _WORD.findall(t)], np.int64) for t in texts]
    lengths = np.array([len(d) for d in docs])
    words = np.concatenate(docs)
    names: dict[str, int] = {}
    per_word = [[names.setdefault(f, len(names)) for f in features(w)] for w in vocabulary]
    row = np.repeat(np.arange(len(per_word)), [len(b) for b in per_word])
    col = np.concatenate([np.array(b) for b in per_word])
    # cues: features whose document frequency tells toxic from clean
    seen = np.zeros((2, len(names)))
    of_word = np.r_[0, np.cumsum([len(b) for b in per_word])]
    for d, t in zip(docs, toxic, strict=True):
        if len(d):
            u = np.unique(d)
            seen[t, np.unique(np.concatenate([col[of_word[w] : of_word[w + 1]] for w in u]))] += 1
    often = seen.sum(axis=0) >= LEAST_DOCUMENTS
    row, col = row[often[col]], (np.cumsum(often) - 1)[col[often[col]]]
    seen, n_features = seen[:, often], int(often.sum())
    kept_names = [f for f, o in zip(names, often, strict=True) if o]
    n1, n0 = y_doc.sum(), (1 - y_doc).sum()
    a, b = seen[1], seen[0]
    share = (a + b) / (n1 + n0)
    part = lambda x, n, s: x * np.log(np.maximum(x, 1e-12) / np.maximum(n * s, 1e-12))
    g2 = 2 * (part(a, n1, share) + part(b, n0, share) + part(n1 - a, n1, 1 - share) + part(n0 - b, n0, 1 - share))
    cue = (g2 >= 25) & ((a + 0.5) / (n1 + 1) >= 15 * (b + 0.5) / (n0 + 1))
    word_cue = np.zeros(len(per_word), bool)
    word_cue[row[cue[col]]] = True
    y = (word_cue[words] & np.repeat(y_doc == 1, lengths)).astype(float)
    # full-batch gradient steps (Adam) on the penalised likelihood
    start, length = chain_starts(lengths)
    first = np.zeros(len(words), bool)
    first[start] = True
    seq = np.flatnonzero(~first)
    yi = y.astype(int)
    observed = np.bincount(yi[seq - 1] * 2 + yi[seq], minlength=4).reshape(2, 2) if len(seq) else np.zeros((2, 2))
    theta = np.zeros(n_features)
    m, v = np.zeros(n_features + 4), np.zeros(n_features + 4)
    for step in range(1, STEPS + 1):
        scores = np.bincount(row, theta[col], len(per_word))[words]
        forward, backward, p = marginals(scores, start, length, crf.trans)
        by_word = np.bincount(words, y - p, len(per_word))
        g_w = np.bincount(col, by_word[row], n_features) - 0.02 * theta
        u = np.exp(np.clip(forward[seq - 1], -50, 50))
        x = np.exp(np.clip(scores[seq] + backward[seq], -50, 50))
        e = np.exp(crf.trans)
        parts = [e[0, 0], e[0, 1] * x, e[1, 0] * u, e[1, 1] * u * x]
        total = parts[0] + parts[1] + parts[2] + parts[3]
        expected = np.array([(w / total).sum() for w in parts]).reshape(2, 2)
        del parts, total, u, x
        g = np.r_[g_w, (observed - expected - 0.02 * crf.trans).ravel()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        delta = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta += delta[:-4]
        crf.trans += delta[-4:].reshape(2, 2)
    scores = np.bincount(row, theta[col], len(per_word))[words]
    crf.weights = {f: float(w) for f, w in zip(kept_names, theta, strict=True) if abs(w) > 0.05}
    x = crf.evidence(marginals(scores, start, length, crf.trans)[2], lengths)
    beta, weight = np.zeros(3), np.where(y_doc == 1, 1.0, clean_share)
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3)
        beta += np.linalg.solve(h, x.T @ (weight * (y_doc - q)) - 0.05 * beta)
    crf.calibration = beta
    return crf


class Scorer:
    def __init__(self, crf: Crf):
        self.crf, self.memo = crf, Memo(MEMO_WORDS)

    def __call__(self, texts: list[str | None], spans: bool) -> tuple[list[float], list[list[dict]]]:
        crf, memo = self.crf, self.memo
        memo.turn()
        if crf.constant is not None:
            return [crf.constant] * len(texts), [[] for _ in texts]
        scores, lengths = [], []
        for text in texts:
            words = _WORD.findall(text or "")
            lengths.append(len(words))
            missing = {w for w in words if w not in memo}
            for w in missing:
                if memo.recall(w) is None:
                    memo[w] = crf.emission(w)
            scores.extend(map(memo.__getitem__, words))
        lengths = np.array(lengths, np.int64)
        start, length = chain_starts(lengths)
        p = marginals(np.array(scores, float), start, length, crf.trans)[2]
        score = 1 / (1 + np.exp(-np.clip(crf.evidence(p, lengths) @ crf.calibration, -30, 30)))
        found: list[list[dict]] = [[] for _ in texts]
        if spans:
            ends = np.cumsum(lengths)
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(p >= 0.5), "right")).tolist():
                own = p[ends[k] - lengths[k] : ends[k]]
                for i, w in enumerate(_WORD.finditer(texts[k])):
                    if own[i] >= 0.5:
                        if found[k] and i and own[i - 1] >= 0.5:
                            found[k][-1]["end"] = w.end()
                            found[k][-1]["probability"] = max(found[k][-1]["probability"], float(own[i]))
                        else:
                            found[k].append({"start": w.start(), "end": w.end(), "probability": float(own[i])})
        return score.tolist(), found


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves remainder 0 by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def one_of_each(texts: dict[int, str]) -> list[int]:
    """Ids without near copies of smaller ids: words that only copies of one text share would pass for cues."""
    ids = sorted(texts)
    prints, stays = simhash([texts[i] for i in ids]), []
    for k in range(len(ids)):
        if not stays or int(np.bitwise_count(prints[stays] ^ prints[k]).min()) > ALIKE:
            stays.append(k)
    return [ids[k] for k in stays]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Crf:
    """Fit on at most TOXIC_SAMPLE + CLEAN_SAMPLE labelled documents that are not held out."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most")
    order = F.xxhash64("doc_id", F.lit(5))
    counts = {int(r["toxic"]): r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    pick = own.where("toxic = 1").orderBy(order).limit(TOXIC_SAMPLE).union(own.where("toxic = 0").orderBy(order).limit(CLEAN_SAMPLE))
    wanted = {r["doc_id"]: int(r["toxic"]) for r in pick.select("doc_id", "toxic").collect()}
    if not wanted:
        return fit([], [])
    few = docs.sparkSession.createDataFrame([(k,) for k in wanted], "_wanted long")  # as many as the samples hold
    text = F.coalesce(F.col(text_col), F.lit(""))
    there = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).where(F.octet_length("text") <= LONGEST)
    rows = there.join(F.broadcast(few), there["id"] == few["_wanted"], "left_semi").groupBy("id").agg(F.max("text").alias("text")).collect()
    texts = {r["id"]: r["text"] for r in rows}
    ids = one_of_each(texts)
    toxic = [wanted[i] for i in ids]
    share = (counts.get(0, 0) / max(1, toxic.count(0))) / (counts.get(1, 1) / max(1, toxic.count(1)))
    return fit([texts[i] for i in ids], toxic, share)


def score(docs: DataFrame, crf: Crf, text_col: str = "text", spans: bool = True) -> DataFrame:
    """All input columns, toxicity (0 to 1) and toxic_spans (character offsets and the strongest marginal of each)."""
    scorers: list[Scorer] = []  # one a task: its memo goes when the task ends

    def run(texts: list[str | None]) -> dict[str, list]:
        if not scorers:
            forget()
            scorers.append(Scorer(crf))
        values, found = scorers[0](texts, spans)
        return {"toxicity": values, "toxic_spans": found}

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
    adds = [("toxicity", T.DoubleType(), pa.float64()), ("toxic_spans", T._parse_datatype_string(SPANS), kind)]
    return append(docs, run, [text_col], adds)


def op6_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    crf = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, crf)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
