"""Exact grouped quantiles that hold when one group has most of the rows.

``percentile`` keeps every distinct value of a group in one task. Here a
sketch first brackets each wanted rank between two values; one counted pass
then keeps only the distinct values inside the bracket (everything below
collapses to one counter on the map side), so the final ordered step sees
about ``4 / accuracy`` of a group at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .columns import attach


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    closed: bool = False,
    accuracy: int = 10_000,
) -> DataFrame:
    """One row per group with the linearly interpolated quantiles ``probs``.

    ``df`` is read twice, so pass a staged or cheap frame.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    # The sketch is off by at most 1 / accuracy of the group; four times that
    # on each side holds the wanted rank with room to spare.
    slack = 4.0 / accuracy
    small = F.count(F.lit(1)) <= accuracy

    def cut(p: float):
        # Small groups, and ranks near an end, are bracketed by the ends.
        end = F.min("_v") if p < 0.5 else F.max("_v")
        if not slack < p < 1 - slack:
            return end
        return F.percentile_approx("_v", F.lit(p), F.lit(accuracy))

    def low(p: float):
        return F.when(small, F.min("_v")).otherwise(cut(p - slack))

    def high(p: float):
        return F.when(small, F.max("_v")).otherwise(cut(p + slack))

    brackets = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.array(*[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(float(p)).alias("p"),
                low(p).alias("lo"),
                high(p).alias("hi"),
            )
            for name, p in probs.items()
        ]).alias("_b"),
    )
    brackets = brackets.select(*keys, "_n", F.explode("_b").alias("_b")).select(*keys, "_n", "_b.*")

    counted = (
        attach(rows, brackets, keys, closed=closed, how="inner")
        .where(F.col("_v") <= F.col("hi"))
        .withColumn("_v", F.when(F.col("_v") >= F.col("lo"), F.col("_v")))
        .groupBy(*keys, "name", "p", "_n", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = W.partitionBy(*keys, "name").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    rank = F.col("p") * (F.col("_n") - 1)
    ranked = counted.withColumn("_cum", F.sum("_c").over(upto)).withColumn("_r", rank)
    missed_below = F.col("_v").isNull() & (F.col("_cum") > F.floor("_r"))
    ends = ranked.groupBy(*keys, "name", "_r").agg(
        F.min(F.when(F.col("_cum") > F.floor("_r"), F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_cum") > F.ceil("_r"), F.col("_v"))).alias("_z"),
        F.count_if(missed_below).alias("_low"),
    )
    # A rank outside its bracket would be a wrong answer: fail instead.
    inside = F.col("_z").isNotNull() & (F.col("_low") == 0)
    checked = F.when(inside, F.col("_z")).otherwise(F.raise_error(F.lit("quantile bracket missed")).cast("double"))
    ends = ends.withColumn("_z", checked)
    point = F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_r") - F.floor("_r"))
    return ends.groupBy(*keys).agg(*[
        F.max(F.when(F.col("name") == name, point)).alias(name) for name in probs
    ])
