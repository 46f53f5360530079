"""Chat formatting after collapsing cumulative snapshots.

A log that stores a conversation again after every turn holds each of its
beginnings as a conversation of its own. Rolling hashes of turn prefixes find
them: the hash after k turns is the running sum of hashes of (position, role,
text), so a prefix of one conversation equals another's whole. A conversation
whose hash is a proper prefix of another, or that equals one of a smaller
conv_id, is removed by anti-joins; the rest is rendered.

How it scales: repeated rows are merged by partial aggregation; positions and
running sums come in two levels, over blocks of ``BLOCK`` turns, so one long
conversation is not one task; only 16-byte hashes meet in the joins, and
conversations of one hash are one row there. Text is shuffled for rendering
only, and only that of maximal conversations.

Cases: turns go by turn number (null first), then role, then text; a row that
is repeated exactly is one turn; a null role is ``unknown``, a null text is
empty; a row without conv_id is a conversation of one turn and its conv_id
stays null; ties of equal conversations go to the least conv_id, null last;
empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.session import stage

BLOCK = 256
HEAD, TAIL, SEP = "<|im_start|>", "<|im_end|>", "\n"


def turns(conversations: DataFrame) -> DataFrame:
    """(key, conv_id, position, role, text): distinct turns in order from 0; ``key`` names a conversation."""
    role, text = F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text).distinct()
    alone = F.concat_ws(":", F.lit("row"), F.md5(F.concat_ws("\x00", F.coalesce(F.col("turn").cast("string"), F.lit("")), "role", "text")))
    rows = rows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), alone)).withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("key", "block").agg(F.count("*").alias("n")).select("key", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("key", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.join(blocks, ["key", "block"]).select("key", "conv_id", (F.col("ahead") + F.row_number().over(inside) - 1).alias("position"), "role", "text")


def turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "position", "role", "text")


def wrapped_sum(column: str, window) -> Column:
    """The running sum modulo 2**64 of a long, without overflow errors: high and low halves are summed apart."""
    low = F.sum(F.col(column).bitwiseAND(F.lit(0xFFFFFFFF))).over(window)
    high = F.sum(F.shiftrightunsigned(column, 32)).over(window)
    return F.shiftleft((high + F.shiftrightunsigned(low, 32)).bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def prefixes(ordered: DataFrame) -> DataFrame:
    """(key, conv_id, n, h1, h2): of each conversation and count of turns, the rolling hashes of that prefix."""
    rows = ordered.select("key", "conv_id", "position", turn_hash(1).alias("a"), turn_hash(2).alias("b"), F.floor(F.col("position") / BLOCK).alias("block"))
    inside = Window.partitionBy("key", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("a", wrapped_sum("a", inside)).withColumn("b", wrapped_sum("b", inside))
    ends = rows.groupBy("key", "block").agg(F.max_by("a", "position").alias("block_a"), F.max_by("b", "position").alias("block_b"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("key", "block", *[F.coalesce(wrapped_sum(f"block_{c}", before), F.lit(0)).alias(f"ahead_{c}") for c in "ab"])
    total = lambda c: wrapped_pair(F.col(c), F.col(f"ahead_{c}"))
    return rows.join(ends, ["key", "block"]).select("key", "conv_id", (F.col("position") + 1).alias("n"), total("a").alias("h1"), total("b").alias("h2"))


def wrapped_pair(a: Column, b: Column) -> Column:
    mask = F.lit(0xFFFFFFFF)
    low = a.bitwiseAND(mask) + b.bitwiseAND(mask)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high.bitwiseAND(mask), 32).bitwiseOR(low.bitwiseAND(mask))


def maximal(ordered: DataFrame) -> DataFrame:
    """(key, n): the conversations that are no proper prefix of another and the least of their equals."""
    every = stage(prefixes(ordered), "prefixes")
    last = every.groupBy("key", "conv_id").agg(F.max("n").alias("n"))
    whole = every.join(last.select("key", "n"), ["key", "n"])
    # One row per distinct conversation: the least id, null last, stands for all its copies.
    least = F.min(F.struct(F.col("conv_id").isNull(), F.coalesce("conv_id", F.lit(0)), "key"))
    distinct = whole.groupBy("n", "h1", "h2").agg(least.alias("first")).select("n", "h1", "h2", F.col("first.key").alias("key"))
    inner = every.join(last.select("key", F.col("n").alias("n_turns")), "key").where("n < n_turns").select("n", "h1", "h2").distinct()
    return distinct.join(inner, ["n", "h1", "h2"], "left_anti").select("key", "n")


def render(ordered: DataFrame) -> DataFrame:
    """(key, rendered): the turns of each conversation with role marks, one after another."""
    turn = F.concat(F.lit(HEAD), F.col("role"), F.lit(SEP), F.col("text"), F.lit(TAIL + SEP))
    rows = ordered.groupBy("key", "conv_id").agg(F.array_sort(F.collect_list(F.struct("position", turn.alias("turn")))).alias("turns"))
    return rows.select("key", "conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("rendered"))


def collapse(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, rendered."""
    ordered = turns(conversations)
    kept = stage(maximal(ordered), "maximal")
    rows = render(ordered.join(kept.select("key"), "key", "left_semi"))
    return rows.join(kept, "key").select("conv_id", F.col("n").alias("n_turns"), "rendered")


ORACLE_SNAPSHOTS = """
WITH distinct_turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT conv_id, list(role || chr(10) || text ORDER BY turn NULLS FIRST, role, text) AS turns FROM distinct_turns GROUP BY conv_id
), firsts AS (
  SELECT min(conv_id) AS conv_id, turns FROM whole GROUP BY turns
), inner_prefixes AS (
  SELECT DISTINCT turns[1:n] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS n FROM firsts)
)
SELECT conv_id, len(turns)::BIGINT AS n_turns,
  array_to_string(list_transform(turns, lambda t: '<|im_start|>' || t || '<|im_end|>' || chr(10)), '') AS rendered
FROM firsts ANTI JOIN inner_prefixes USING (turns)
"""
