"""Z-score detector on the residual of an additive weekly decomposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import attach, flag
from ..schemas import SERIES_KEYS
from ..session import stage
from .sequence import home_rows, in_blocks, with_positions

PERIOD = 7
HALF = PERIOD // 2
MIN_POINTS = 2 * PERIOD


def _in_head(i: Column) -> Column:
    return i.between(HALF, HALF + PERIOD - 1)


def _in_tail(i: Column, n: Column) -> Column:
    last = n - 1 - HALF
    return i.between(last - PERIOD + 1, last)


def _line(slope: str, intercept: str, i: Column) -> Column:
    return F.col(slope) * i + F.col(intercept)


def _full_trend(i: Column, n: Column) -> Column:
    """Centred mean, continued at both ends by the fitted lines."""
    return (
        F.when(i < HALF, _line("_hs", "_hi", i))
        .when(i > n - 1 - HALF, _line("_ts", "_ti", i))
        .otherwise(F.col("_centre"))
    )


def _edge_fits(i: Column, n: Column) -> dict[str, Column]:
    head = F.when(_in_head(i), F.col("_centre"))
    tail = F.when(_in_tail(i, n), F.col("_centre"))
    at = i.cast("double")
    return {
        "_hs": F.regr_slope(head, at), "_hi": F.regr_intercept(head, at),
        "_ts": F.regr_slope(tail, at), "_ti": F.regr_intercept(tail, at),
    }


def seasonal_residual(
    df: DataFrame, keys: Sequence[str] = SERIES_KEYS, order: Sequence[str] = ("date",), cost: str = "total_cost"
) -> DataFrame:
    """Add ``trend``, ``seasonal`` and ``residual`` per series.

    Series shorter than two periods keep their raw cost as the residual. All
    windows share the series partitioning: one shuffle.
    """
    series = W.partitionBy(*keys)
    w = series.orderBy(*order)
    i, n = F.col("_i"), F.col("_n")
    df = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(series))
    inner = i.between(HALF, n - 1 - HALF)
    df = df.withColumn("_centre", F.when(inner, F.avg(cost).over(w.rowsBetween(-HALF, HALF))))
    df = df.withColumns({name: fit.over(series) for name, fit in _edge_fits(i, n).items()})
    df = df.withColumn("trend", _full_trend(i, n)).withColumn("_detrended", F.col(cost) - F.col("trend"))
    phase = W.partitionBy(*keys, "_phase")
    df = df.withColumn("_phase", i % PERIOD)
    df = df.withColumns({"_mean": F.avg("_detrended").over(phase), "_size": F.count(F.lit(1)).over(phase)})
    level = F.sum(F.col("_mean") / F.col("_size")).over(series) / PERIOD
    df = df.withColumn("seasonal", F.col("_mean") - level)
    return _finish(df, n, cost)


def _finish(df: DataFrame, n: Column, cost: str) -> DataFrame:
    long_enough = n >= MIN_POINTS
    out = df.withColumn(
        "residual",
        F.when(long_enough, F.col(cost) - F.col("trend") - F.col("seasonal")).otherwise(F.col(cost).cast("double")),
    )
    out = out.withColumns({c: F.when(long_enough, F.col(c)) for c in ("trend", "seasonal")})
    return out.drop("_i", "_n", "_centre", "_hs", "_hi", "_ts", "_ti", "_detrended", "_phase", "_mean", "_size")


def service_residual(df: DataFrame, key: str = "service_category", cost: str = "total_cost", closed: bool = False) -> DataFrame:
    """The same decomposition over all rows of a service as one sequence.

    Overlapping blocks give the centred mean; the edge lines and the seasonal
    means are grouped aggregates joined back. No task holds a whole service.
    """
    i, n = F.col("seq"), F.col("seq_len")
    cut, w = in_blocks(with_positions(df, key), HALF, HALF, key)
    inner = i.between(HALF, n - 1 - HALF)
    rows = home_rows(cut.withColumn("_centre", F.when(inner, F.avg(cost).over(w.rowsBetween(-HALF, HALF)))))
    rows = stage(rows, "trend")
    fits = rows.groupBy(key).agg(*[fit.alias(name) for name, fit in _edge_fits(i, n).items()])
    rows = attach(rows, fits, [key], closed).withColumn("trend", _full_trend(i, n))
    rows = rows.withColumn("_detrended", F.col(cost) - F.col("trend")).withColumn("_phase", (i % PERIOD).cast("int"))
    phases = rows.groupBy(key, "_phase").agg(F.avg("_detrended").alias("_mean"))
    phases = phases.withColumn("seasonal", F.col("_mean") - F.avg("_mean").over(W.partitionBy(key))).drop("_mean")
    return _finish(attach(rows, phases, [key, "_phase"], closed), n, cost).drop("seq", "seq_len")


def severity_bin(z: Column) -> Column:
    return F.when(z <= 2, "normal").when(z <= 3, "low").when(z <= 4, "medium").when(z > 4, "high")


def _verdict(df: DataFrame, threshold: float) -> DataFrame:
    z = F.col("residual_z")
    return df.withColumns({"zscore_flag": flag(z > threshold), "zscore_severity": severity_bin(z)})


def zscore_detector(
    df: DataFrame,
    keys: Sequence[str] = SERIES_KEYS,
    order: Sequence[str] = ("date",),
    cost: str = "total_cost",
    threshold: float = 2.5,
) -> DataFrame:
    """Add ``residual_z``, ``zscore_flag`` and ``zscore_severity`` per series."""
    series = W.partitionBy(*keys)
    out = seasonal_residual(df, keys, order, cost)
    gap = F.col("residual") - F.avg("residual").over(series)
    out = out.withColumn("residual_z", F.abs(F.try_divide(gap, F.stddev_pop("residual").over(series))))
    return _verdict(out, threshold)


def zscore_detector_by_service(
    df: DataFrame, key: str = "service_category", cost: str = "total_cost", threshold: float = 2.5, closed: bool = False
) -> DataFrame:
    """The detector over each service's single sequence, as the reference runs it."""
    out = stage(service_residual(df, key, cost, closed), "residual")
    stats = out.groupBy(key).agg(F.avg("residual").alias("_avg"), F.stddev_pop("residual").alias("_std"))
    z = F.abs(F.try_divide(F.col("residual") - F.col("_avg"), F.col("_std")))
    return _verdict(attach(out, stats, [key], closed).withColumn("residual_z", z).drop("_avg", "_std"), threshold)
