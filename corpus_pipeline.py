"""The corpus pipeline: from ``documents`` to encoded training text in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame over all that its predecessor kept; all but the last return
the columns of documents. Empty inputs give empty results; how each stage treats nulls, ties and repeated rows is stated in
its operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terncove.llm import bpe, exact_dedup, mixing, simhash, toxicity
from terncove.llm.store import drop_since, materialize, unused, written

TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below ``TOXIC_FROM``, by a model learned from their labels. Columns of the documents that are named like the score stay theirs."""
    crf = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clash = [c for c in docs.columns if c.lower() in ("toxicity", "toxic_spans")]
    own = dict(zip(clash, unused(docs, *[f"_own_{c}" for c in clash]), strict=True))
    scored = toxicity.score(docs.withColumnsRenamed(own), crf, spans=False)
    return scored.where(F.col("toxicity") < TOXIC_FROM).select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the row with the smallest doc_id."""
    return simhash.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, by leaving documents out or repeating their rows."""
    return mixing.repeat_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, decoded and n_tokens."""
    return bpe.encode_documents(docs, bpe.tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Learned scores and token ids have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        mark = written(spark)
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
            drop_since(spark, mark)  # what led to the stage's result
    return docs
