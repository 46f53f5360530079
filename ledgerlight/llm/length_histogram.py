"""Token counts as an exact histogram of encoded lengths.

Documents are aggregated by their encoded length: each task sends one row per
distinct length and batch, so what is shuffled follows the number of lengths,
not of documents. Prefix and suffix sums over the lengths, in two levels of
blocks, then answer totals, quantiles and truncated totals for every context
limit without reading the corpus again.

Cases: a null or empty text has length 0 and is counted; repeated rows count
each; an empty table gives an empty histogram; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.tokens import encoder, slices, text_bytes
from ledgerlight.session import stage

BLOCK = 1024


def encoded_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(length, n_docs): one row per distinct encoded length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            lengths = [len(ids) // coder.dtype.itemsize for part in slices(batch, "text", 1 << 24) for ids in coder.encode(text_bytes(part.column("text")))]
            values, counts = np.unique(np.array(lengths, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], ["length", "n"])
        coder.forget()

    return docs.select("text").mapInArrow(count, "length long, n long").groupBy("length").agg(F.sum("n").alias("n_docs"))


def histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per distinct length, with the answers for a limit of that length.

    docs_at_most, tokens_at_most: documents no longer than it and their tokens;
    docs_above, tokens_above: the suffix sums beyond it; truncated_total: the
    tokens left if every document is cut to it.
    """
    # Read twice below: without staging, every text would be encoded twice.
    rows = stage(encoded_lengths(docs, tokenizer), "lengths").withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    behind = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{n}_{side}": F.coalesce(F.sum(f"block_{n}").over(w), F.lit(0)) for n in ("docs", "tokens") for side, w in (("up", behind), ("down", ahead))}
    rows = rows.join(blocks.select("block", *[c.alias(n) for n, c in sums.items()]), "block")
    above = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    to_here = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    docs_above = F.col("docs_up") + over("n_docs", above)
    tokens_at_most = F.col("tokens_down") + over("tokens", to_here)
    return rows.select(
        "length", "n_docs",
        (F.col("docs_down") + over("n_docs", to_here)).alias("docs_at_most"), tokens_at_most.alias("tokens_at_most"),
        docs_above.alias("docs_above"), (F.col("tokens_up") + over("tokens", above)).alias("tokens_above"),
        (tokens_at_most + F.col("length") * docs_above).alias("truncated_total"),
    )


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context, truncated_total, docs_cut) for any limits, in one pass over the histogram."""
    total = lambda c: F.coalesce(F.sum(F.least(F.col("length"), F.lit(c)) * F.col("n_docs")), F.lit(0))
    cut = lambda c: F.coalesce(F.sum(F.when(F.col("length") > c, F.col("n_docs"))), F.lit(0))
    structs = [F.struct(F.lit(c).cast("long").alias("context"), total(c).alias("truncated_total"), cut(c).alias("docs_cut")) for c in limits]
    return hist.agg(F.array(*structs).alias("rows")).select(F.inline("rows"))


def quantiles(hist: DataFrame, probabilities: list[float]) -> DataFrame:
    """(probability, length): the least length with at least that share of documents at or below it."""
    everything: Column = F.col("docs_at_most") + F.col("docs_above")
    structs = [
        F.struct(F.lit(float(p)).alias("probability"), F.min(F.when(F.col("docs_at_most") >= F.lit(float(p)) * everything, F.col("length"))).alias("length"))
        for p in probabilities
    ]
    return hist.agg(F.array(*structs).alias("rows")).select(F.inline("rows"))
