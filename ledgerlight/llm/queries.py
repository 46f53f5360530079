"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import (
    decision_list, grammar_runs, hilbert_shards, jaccard_join, length_histogram, mixing, pu_toxicity, resident_lloyd, skip_crf, snapshots,
    suffix_decontam, token_store, warc,
)
from ledgerlight.session import stage_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram.histogram(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), stage_path(spark, "tokens")
    token_store.write_store(docs, path, TOKENIZER, end_id=1)
    return token_store.stored_documents(docs, path)


def op3_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.collapse(table(spark, sf_dir, "conversations"))


def op5_suffix_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = decision_list.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows


def op8_skip_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = skip_crf.detect(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *[f"n_{k}" for k in skip_crf.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_resident_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resident_lloyd.codes(table(spark, sf_dir, "embeddings"))


def op12_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.shard_rows(table(spark, sf_dir, "documents"))


def op13_grammar_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar_runs.digests(grammar_runs.detect(grammar_runs.repeated_tails(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_token_store": op2_token_store,
    "op3_pu_toxicity": op3_pu_toxicity,
    "op4_snapshot_collapse": op4_snapshot_collapse,
    "op5_suffix_decontam": op5_suffix_decontam,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_decision_list": op7_decision_list,
    "op8_skip_crf": op8_skip_crf,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_mix": op10_mix,
    "op11_resident_lloyd": op11_resident_lloyd,
    "op12_hilbert_shards": op12_hilbert_shards,
    "op13_grammar_runs": op13_grammar_runs,
}
ORACLE: dict[str, str] = {
    "op4_snapshot_collapse": snapshots.ORACLE_SNAPSHOTS,
    "op6_warc_derivatives": warc.oracle_sql(),
    "op10_mix": mixing.ORACLE_MIX,
    "op11_resident_lloyd": resident_lloyd.oracle_sql(),
    "op12_hilbert_shards": hilbert_shards.oracle_sql(),
}
