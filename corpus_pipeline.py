"""The corpus pipeline: stages over ``documents``, each written and read again.

Toxic documents go; of each group of near duplicates one document stays;
documents with benchmark passages go; what is left is mixed by source, copies
and all; the mix is encoded, and the last stage returns one row per document
of the store. Each stage reads what its predecessor kept.

A stage bounds the Arrow batches of its session to ``BATCH_BYTES``, as its
result is computed later; ``run`` puts the session's own bound back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.llm import jaccard_join, mixing, pu_toxicity, suffix_decontam, token_store
from ledgerlight.llm.queries import TOKENIZER, table
from ledgerlight.session import collected_stages, remove, stage, stage_path

# An executor holds the batch of each of its tasks several times, to send it, in the Python worker and as it comes back.
# By default a batch ends at 10,000 rows or 64 MB; of whole texts it is then tens of MB.
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 20

_staged: list[str] = []


def alone(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage removes what the one before it staged, whose result has been written by then, and has batches of ``BATCH_BYTES``."""

    @wraps(step)
    def run_alone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _staged)
        _staged.clear()
        spark.conf.set(BATCH_CONF, BATCH_BYTES)
        with collected_stages(_staged):
            return step(spark, docs, sf_dir)

    return run_alone


@alone
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pu_toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


@alone
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


@alone
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@alone
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


@alone
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "tokens")
    _staged.append(path)
    token_store.write_store(docs, path, TOKENIZER, end_id=1)
    return token_store.stored_documents(docs, path).drop("by_key")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
    ("token_ids", token_ids),
]
# Scores of a trained model decide the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    written: list[str] = []
    bound = spark.conf.get(BATCH_CONF)
    try:
        for name, step in STAGES:
            before = list(written)
            with collected_stages(written):
                docs = stage(step(spark, docs, sf_dir), name)
            remove(spark, before)
    finally:
        spark.conf.set(BATCH_CONF, bound)
    remove(spark, _staged)
    _staged.clear()
    return docs
