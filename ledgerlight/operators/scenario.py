"""Labelled anomaly injection on a real billing table.

Factors are fixed or come from a hash of the row, so a run can be repeated.
Offsets count days from the table's first day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MONEY


def _offset(df: DataFrame, start: str | Column | None) -> Column:
    first = F.lit(start).cast("date") if start is not None else df.select(F.min("date").alias("_first")).scalar()
    return F.datediff(F.col("date"), first)


def _label(df: DataFrame) -> Column:
    return F.col("is_anomaly") if "is_anomaly" in df.columns else F.lit(0)


def _scaled(df: DataFrame, hit: Column, factor: Column) -> DataFrame:
    cost = F.when(hit, F.col("cost_usd").cast(MONEY) * factor.cast("decimal(9,4)")).otherwise(F.col("cost_usd"))
    return df.withColumns({
        "is_anomaly": F.when(hit, 1).otherwise(_label(df)).cast("int"),
        "cost_usd": F.round(cost, 4).cast(MONEY),
    })


def inject_spikes(
    df: DataFrame, offsets: Sequence[int] | None = None, every: int | None = None, factor: float = 4.0,
    where: Column | None = None, start: str | Column | None = None,
) -> DataFrame:
    """Multiply the cost on the listed days, or on every ``every``-th day, counted from ``start`` (else the first day of ``df``)."""
    day = _offset(df, start)
    hit = day.isin(list(offsets)) if offsets is not None else (day % every == every - 1)
    if where is not None:
        hit = hit & where
    return _scaled(df, hit, F.lit(factor))


def inject_drift(
    df: DataFrame, ranges: Sequence[tuple[int, int]], daily: float = 0.05, start: str | None = None
) -> DataFrame:
    """Grow the cost by ``daily`` per day inside each range; overlaps compound."""
    day = _offset(df, start)
    factor, hit = F.lit(1).cast("decimal(9,4)"), F.lit(False)
    for lo, hi in ranges:
        inside = day.between(lo, hi)
        growth = F.lit(1) + (day - lo).cast("decimal(9,4)") * F.lit(daily).cast("decimal(5,4)")
        factor = factor * F.when(inside, growth).otherwise(F.lit(1).cast("decimal(9,4)"))
        hit = hit | inside
    return _scaled(df, hit, factor)


def inject_hashed(
    df: DataFrame, key: Column, share: int = 20, low: float = 3.0, high: float = 8.0, start: str | None = None
) -> DataFrame:
    """Scale one row in ``share`` by a factor between ``low`` and ``high``.

    ``key`` is a whole number per row; which rows are hit and by how much
    follow from it alone.
    """
    hit = F.pmod(key, F.lit(share)) == 0
    step = F.pmod(F.floor(key / share), F.lit(6)) / F.lit(5.0)
    return _scaled(df, hit, F.lit(low) + step * F.lit(high - low))
