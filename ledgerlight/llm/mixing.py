"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key whose rate is its quality weight, so
that reading a source in key order is weighted sampling without replacement.
Each source takes its complete epochs first and then the documents of the
smallest keys up to its word budget; the one document that crosses the budget
is taken in part.

How it scales: texts are read once, into narrow rows that are staged. The
order within a source is two-level: equal slices of the key's range are summed
by partial aggregation, whole slices are decided from those sums, and only the
one slice a budget ends in is sorted. What is joined back has a row per source. A source with a third of all documents
so meets neither one task nor one sort.

Cases: a null text has size 0 and takes nothing; a null source is a source of
its own, last in order; a null or repeated doc_id is kept row by row (repeated
rows share a key and are taken one after the other, in order of size); a
source without words has target 0; an empty table gives an empty result; extra
columns pass through ``mixed``; names that begin with ``mix_`` are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.session import stage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SLICES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for clean text, down to 0.05 as symbols pile up."""
    chars = F.length(text)
    symbols = chars - F.length(F.translate(text, SYMBOLS, ""))
    return F.greatest(F.lit(0.05), F.coalesce(1.0 - 5.0 * symbols / F.greatest(chars, F.lit(1)), F.lit(0.05)))


def uniform(seed: str, *parts: Column) -> Column:
    """A number in (0, 1) from the md5 of ``seed`` and the given values."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, epochs: int) -> DataFrame:
    """Target words of each source, from (source, source_size).

    Sources in order of code points, null last, get ``weights`` in turn. The
    total, ``share`` of all words, is dealt by weight; what would exceed
    ``epochs`` times a source is dealt again among the others. The fixed point
    is found at once: with sources in order of cap per weight, a source is
    capped exactly if the level left by those before it reaches its cap. One
    row per source meets these windows, whatever the number of documents.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.lit(len(weights))
    rows = (
        sizes.withColumn("rank", F.row_number().over(in_order))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") - 1) % turn + 1))
        .withColumn("cap", F.col("source_size") * epochs)
        .withColumn("total", share * F.sum("source_size").over(Window.partitionBy()))
    )
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("level_here", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
    rows = rows.withColumn("capped", F.col("cap") <= F.col("level_here") * F.col("weight"))
    everything = Window.partitionBy()
    level = (F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)) / F.sum(
        F.when(~F.col("capped"), F.col("weight"))
    ).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def keyed(docs: DataFrame, seed: str, weight: Column | None) -> DataFrame:
    """The rows with mix_size, mix_key and mix_slice (an equal slice of the key's range)."""
    text = F.col("text")
    rows = docs.withColumn("mix_size", word_count(text))
    rate = quality_weight(text) if weight is None else weight
    rows = rows.withColumn("mix_key", -F.log(uniform(seed, F.col("doc_id"), F.col("mix_size"))) / rate)
    return rows.withColumn("mix_slice", F.floor(SLICES * (1 - F.exp(-F.col("mix_key")))).cast("int"))


def budgets(rows: DataFrame, weights: tuple[float, ...], share: float, epochs: int) -> DataFrame:
    """One row per source: its size and target, its whole epochs, the slice the rest ends in and the words ahead of it."""
    cells = stage(rows.groupBy("source", "mix_slice").agg(F.sum("mix_size").alias("cell")), "mix-cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = stage(targets.withColumn("whole", whole).withColumn("rest", F.round(F.col("target") - whole * F.col("source_size")).cast("long")), "mix-targets")
    up_to = Window.partitionBy("source").orderBy("mix_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("ahead", F.sum("cell").over(up_to) - F.col("cell"))
    over = cells.join(targets, cells["source"].eqNullSafe(targets["source"])).where(F.col("ahead") + F.col("cell") > F.col("rest"))
    last = over.groupBy(cells["source"].alias("of")).agg(F.min(F.struct("mix_slice", "ahead")).alias("last"))
    rows = targets.join(last, targets["source"].eqNullSafe(F.col("of")), "left")
    return stage(rows.select("source", "source_size", "target", "whole", "rest", F.col("last.mix_slice").alias("last_slice"), F.col("last.ahead").alias("ahead")), "mix-budgets")


def decided(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """The rows with mix_whole (complete epochs) and mix_part (words taken once more)."""
    state = budget.select(F.col("source").alias("mix_source"), *[F.col(c).alias(f"mix_{c}") for c in ("source_size", "target", "whole", "rest", "last_slice", "ahead")])
    joined = rows.join(state, rows["source"].eqNullSafe(state["mix_source"]))
    ends_here = F.coalesce(F.col("mix_slice") == F.col("mix_last_slice"), F.lit(False))
    beyond = F.coalesce(F.col("mix_slice") > F.col("mix_last_slice"), F.lit(False))
    sure = joined.where(~ends_here).withColumn("mix_part", F.when(beyond, F.lit(0)).otherwise(F.col("mix_size")).cast("long"))
    by_key = Window.partitionBy("mix_source", "mix_slice").orderBy("mix_key", "doc_id", "mix_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("mix_rest") - F.col("mix_ahead") - F.sum("mix_size").over(by_key) + F.col("mix_size")
    return sure.unionByName(joined.where(ends_here).withColumn("mix_part", F.least(F.col("mix_size"), F.greatest(F.lit(0), left)).cast("long")))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2,
    seed: str = "mix", weight: Column | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    ``taken`` counts the words the mix takes of the document, repeats
    included; ``target`` is its source's. ``weight`` is the quality weight of
    a document (by default from its symbols).
    """
    rows = stage(keyed(docs, seed, weight).select("doc_id", "source", "mix_size", "mix_key", "mix_slice"), "mix-rows")
    return decided(rows, budgets(rows, weights, share, epochs)).select(
        "doc_id", "source", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_whole") * F.col("mix_size") + F.col("mix_part")).alias("taken"),
    )


def mixed(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2,
    seed: str = "mix", weight: Column | None = None,
) -> DataFrame:
    """The mix itself: each document once per epoch, with its columns; one that is taken in part ends after its last word taken."""
    rows = keyed(docs, seed, weight)
    rows = decided(rows, budgets(rows.select("source", "mix_slice", "mix_size"), weights, share, epochs))
    copies = F.col("mix_whole") + F.when(F.col("mix_part") > 0, 1).otherwise(0)
    rows = rows.where(copies > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    cut = (F.col("mix_copy") > F.col("mix_whole")) & (F.col("mix_part") < F.col("mix_size"))
    rows = rows.withColumn("text", F.when(cut, first_words(F.col("text"), F.col("mix_part"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(docs.columns)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, exactly as it stands."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


ORACLE_MIX = """
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), keyed AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / greatest(0.05::DOUBLE, coalesce(1.0::DOUBLE - 5.0::DOUBLE * (length(text) - length(translate(text, '#*$%&|<>', ''))) / greatest(length(text), 1), 0.05::DOUBLE)) AS key
  FROM sized
), sources AS (
  SELECT *, 2 * source_size AS cap, [3, 1, 2][((rank - 1) % 3 + 1)::INT] AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source)
), filled AS (
  SELECT *, cap <= weight * (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped
  FROM sources
), targets AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight *
    (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN NOT capped THEN weight END) OVER () END AS target
  FROM filled
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets
), ordered AS (
  SELECT k.doc_id, k.source, k.size, b.source_size, b.target, b.whole, round(b.target - b.whole * b.source_size)::BIGINT AS rest,
    (sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size)::BIGINT AS ahead
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, size, source_size, target, (whole * size + least(size, greatest(0, rest - ahead)))::BIGINT AS taken FROM ordered
"""
