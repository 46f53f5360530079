"""Lag, rolling and relative features of daily series.

All of them use one window specification, so a series is shuffled and sorted
once. A series holds one row per day: its length is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from ..functions.columns import EPSILON, attach, calendar_columns, flag, ratio_change
from ..schemas import SERIES_KEYS

ENGINEERED = (
    "cost_lag_1", "cost_lag_7", "cost_lag_30",
    "rolling_mean_7", "rolling_std_7", "rolling_mean_30", "rolling_std_30",
    "cost_change_1d", "cost_change_7d", "zscore", "deviation_from_mean",
)


def series_window(keys: Sequence[str] = SERIES_KEYS, order: Sequence[str] = ("date",)) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order)


def trailing(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(1 - rows, 0)


def with_lags(df: DataFrame, w: WindowSpec, cost: str = "total_cost", lags: Sequence[int] = (1, 7, 30)) -> DataFrame:
    return df.withColumns({f"cost_lag_{k}": F.lag(cost, k).over(w) for k in lags})


def with_rolling(df: DataFrame, w: WindowSpec, cost: str = "total_cost", rows: Sequence[int] = (7, 30)) -> DataFrame:
    out: dict[str, Column] = {}
    for k in rows:
        out[f"rolling_mean_{k}"] = F.avg(cost).over(trailing(w, k))
        out[f"rolling_std_{k}"] = F.stddev_samp(cost).over(trailing(w, k))
    return df.withColumns(out)


def with_change(df: DataFrame, w: WindowSpec, cost: str = "total_cost", lags: Sequence[int] = (1, 7)) -> DataFrame:
    return df.withColumns({f"cost_change_{k}d": ratio_change(F.col(cost), F.lag(cost, k).over(w)) for k in lags})


def with_global_zscore(
    df: DataFrame, service: str = "service_category", cost: str = "total_cost", closed: bool = False
) -> DataFrame:
    """Absolute z-score against all rows of the service (population deviation).

    Grouped statistics joined back: a window over a whole service would put
    that service into one task. ``df`` is read twice.
    """
    stats = df.groupBy(service).agg(F.avg(cost).alias("_avg"), F.stddev_pop(cost).alias("_std"))
    z = F.abs(F.try_divide(F.col(cost) - F.col("_avg"), F.col("_std")))
    return attach(df, stats, [service], closed).withColumn("zscore", z).drop("_avg", "_std")


def with_deviation(df: DataFrame, cost: str = "total_cost") -> DataFrame:
    gap = F.col(cost) - F.col("rolling_mean_7")
    return df.withColumn("deviation_from_mean", gap / (F.col("rolling_std_7") + F.lit(EPSILON)))


def with_calendar(df: DataFrame) -> DataFrame:
    return df.withColumns(calendar_columns()).drop("day_of_month")


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with every feature present; infinities never arise (see ``ratio_change``)."""
    return df.na.drop(subset=list(columns) if columns else None)


def engineer_features(
    daily: DataFrame,
    series_keys: Sequence[str] = SERIES_KEYS,
    complete: bool = True,
    closed: bool = False,
) -> DataFrame:
    """Full feature frame. ``zscore`` is taken before incomplete rows go."""
    out = series_features(with_global_zscore(daily, closed=closed), series_keys)
    return complete_rows(out) if complete else out


def series_features(daily: DataFrame, series_keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """The features that need a row's own series only: all but ``zscore``."""
    w = series_window(series_keys)
    out = with_change(with_rolling(with_lags(daily, w), w), w)
    return with_calendar(with_deviation(out))


def min_history(
    df: DataFrame, rows: int = 30, keys: Sequence[str] = ("service_category",), closed: bool = False
) -> DataFrame:
    """Keep groups with at least ``rows`` rows. ``df`` is read twice."""
    enough = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= rows).select(*keys)
    return attach(df, enough, keys, closed, how="left_semi")


def time_split(df: DataFrame, share: float, keys: Sequence[str], order: Sequence[str] = ("date",)) -> DataFrame:
    """Mark the first ``share`` of each series' rows as training rows."""
    w = W.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    rn = F.row_number().over(w.orderBy(*order))
    return df.withColumn("is_train", flag(rn <= F.floor(n * F.lit(share))))


def last_rows_split(df: DataFrame, test_rows: int, keys: Sequence[str], order: Sequence[str] = ("date",)) -> DataFrame:
    """Mark all but the last ``test_rows`` rows of each series as training rows."""
    newest = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("is_train", flag(F.row_number().over(newest) > test_rows))


def sliding_windows(
    df: DataFrame, w: WindowSpec, columns: Sequence[str], length: int, preceding: bool = False, name: str = "window"
) -> DataFrame:
    """Vector of the last ``length`` values of each column, oldest first.

    The vector belongs to its last row, or with ``preceding`` to the row after
    it. Rows without a full window get NULL.
    """
    oldest = length if preceding else length - 1
    cells = [F.lag(c, oldest - i).over(w) if oldest - i else F.col(c) for i in range(length) for c in columns]
    full = F.row_number().over(w) > oldest
    return df.withColumn(name, F.when(full, F.array(*[c.cast("double") for c in cells])))
