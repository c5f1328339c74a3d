"""The corpus pipeline: five stages, each over all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiegrid.llm import bpe, decontam, pii, simhash, toxicity
from tiegrid.llm.common import materialize, table
from tiegrid.llm.queries import WORD_BPE, tokenizer_path


def recount(docs: DataFrame) -> DataFrame:
    """n_chars of texts that a stage may have changed; a null text keeps what it had."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity makes them toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.deduplicate(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut; a document that is mostly such passages goes."""
    return recount(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return recount(pii.redact_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every document that is left."""
    return bpe.encode_documents(docs, tokenizer_path(WORD_BPE))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("pii", redact_personal_data),
    ("bpe", encode),
]

#: No SQL: the model, fingerprints and encoder can't be written as such.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
