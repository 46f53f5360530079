"""Features of calendar-dense segment series, on capped cost."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import ratio_change
from .features import trailing

# Input columns of the model, in the given order.
SEGMENT_FEATURES = (
    "rolling_mean_7", "rolling_std_7", "rolling_mean_14", "rolling_std_14", "rolling_mean_30", "rolling_std_30",
    "pct_change_1d", "pct_change_7d", "ema_7", "ema_14",
    "rolling_min_7", "rolling_max_7", "ratio_to_rolling_max_7", "zscore_base",
)


def cap_outliers(
    df: DataFrame, key: str = "segment_id", cost: str = "cost_usd", low: float = 0.01, high: float = 0.99
) -> DataFrame:
    """Cost clipped to the segment's own quantiles, as ``cost_capped``.

    A segment has one row per calendar day, so the exact quantiles of a group
    fit one task; computed as a window they reuse the segment's shuffle.
    """
    cuts = F.percentile(F.col(cost), F.array(F.lit(low), F.lit(high))).over(W.partitionBy(key))
    return (
        df.withColumn("_cuts", cuts)
        .withColumn("cost_capped", F.least(F.greatest(F.col(cost), F.col("_cuts")[0]), F.col("_cuts")[1]))
        .drop("_cuts")
    )


EMA_BLOCK = 32


def _horner(factor: float):
    return lambda acc, term: acc * F.lit(factor) + term


def with_ema(df: DataFrame, spans: Sequence[int] = (7, 14), key: str = "segment_id", value: str = "cost_capped") -> DataFrame:
    """Exponential moving averages, seeded with the first value.

    The recurrence is cut into blocks of rows. Inside a block it is a weighted
    running sum; what earlier blocks add is the same recurrence over their end
    values, of which only the last few still count in double precision. All
    windows share the segment's partitioning, and no row list is ever built.
    """
    w = W.partitionBy(key).orderBy("date")
    i = F.col("_i")
    place, block = i % EMA_BLOCK, F.floor(i / EMA_BLOCK).cast("int")
    out = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_b", block)
    inside = W.partitionBy(key, "_b").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    for span in spans:
        a = 2.0 / (span + 1)
        q = 1.0 - a
        kept = math.ceil(math.log(1e-18) / math.log(q) / EMA_BLOCK) + 1
        earlier = W.partitionBy(key).orderBy("_b").rangeBetween(-kept, -1)
        seeded = F.when(i == 0, F.col(value)).otherwise(F.col(value) * F.lit(a))
        local = F.sum(seeded * F.pow(F.lit(q), -place)).over(inside) * F.pow(F.lit(q), place)
        out = out.withColumn("_local", local)
        ends = F.collect_list(F.when(place == EMA_BLOCK - 1, F.col("_local"))).over(earlier)
        carry = F.aggregate("_ends", F.lit(0.0), _horner(q ** EMA_BLOCK))
        out = out.withColumn("_ends", ends).withColumn("_carry", carry)
        out = out.withColumn(f"ema_{span}", F.col("_local") + F.pow(F.lit(q), place + 1) * F.col("_carry"))
        out = out.drop("_local", "_ends", "_carry")
    return out.drop("_i", "_b")


def segment_features(segments: DataFrame, key: str = "segment_id", ema: bool = True) -> DataFrame:
    """All segment features. Every step is partitioned by the segment."""
    w = W.partitionBy(key).orderBy("date")
    df = cap_outliers(segments, key)
    x = F.col("cost_capped")
    cols = {}
    for k in (7, 14, 30):
        cols[f"rolling_mean_{k}"] = F.avg(x).over(trailing(w, k))
        cols[f"rolling_std_{k}"] = F.coalesce(F.stddev_samp(x).over(trailing(w, k)), F.lit(0.0))
    for k in (1, 7):
        cols[f"pct_change_{k}d"] = F.coalesce(ratio_change(x, F.lag(x, k).over(w)), F.lit(0.0))
    cols["rolling_min_7"] = F.min(x).over(trailing(w, 7))
    cols["rolling_max_7"] = F.max(x).over(trailing(w, 7))
    df = df.withColumns(cols).withColumns({
        "ratio_to_rolling_max_7": F.when(F.col("rolling_max_7") > 0, x / F.col("rolling_max_7")).otherwise(0.0),
        "zscore_base": F.when(
            F.col("rolling_std_7") > 0, (x - F.col("rolling_mean_7")) / F.col("rolling_std_7")
        ).otherwise(0.0),
    })
    return with_ema(df, key=key) if ema else df


def sample_cap(df: DataFrame, cap: int, keys: Sequence[str], row_key: Sequence[str], seed: int = 42) -> DataFrame:
    """At most ``cap`` rows per group, chosen by a hash of the row.

    The same rows come out whatever the partitioning. The per-group limit is
    applied on the map side before the shuffle.
    """
    shuffled = W.partitionBy(*keys).orderBy(F.xxhash64(*[F.col(c) for c in row_key], F.lit(seed)), *row_key)
    return df.withColumn("_rn", F.row_number().over(shuffled)).where(F.col("_rn") <= cap).drop("_rn")
