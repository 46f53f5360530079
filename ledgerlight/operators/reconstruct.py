"""Window reconstruction detectors: linear autoencoders over sliding windows.

A window is compressed to a few principal directions and rebuilt; what the
directions cannot rebuild is the error. Fitting is one grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.columns import attach, flag
from ..functions.quantiles import exact_quantiles
from ..schemas import SERIES_KEYS
from ..session import stage
from .features import sliding_windows
from .sequence import home_rows, in_blocks, with_positions

LENGTH = 7
DIRECTIONS = 2


def standardize(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], closed: bool = False, fit_rows: Column | None = None,
    suffix: str = "_scaled",
) -> DataFrame:
    """Grouped standard scaling with the population deviation; constant columns become 0."""
    base = df.where(fit_rows) if fit_rows is not None else df
    stats = base.groupBy(*keys).agg(*[
        agg for c in columns for agg in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))
    ])
    out = attach(df, stats, keys, closed).withColumns({
        f"{c}{suffix}": F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in columns
    })
    return out.drop(*[f"_{p}_{c}" for c in columns for p in "ms"])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _directions(means: pd.Series, products: pd.Series) -> pd.Series:
    """Leading eigenvectors of the covariance given by first and second moments."""
    out = []
    for m, p in zip(means, products):
        m = np.asarray(m, float)
        size = len(m)
        second = np.zeros((size, size))
        second[np.triu_indices(size)] = p
        second = np.triu(second) + np.triu(second, 1).T
        _, vectors = np.linalg.eigh(second - np.outer(m, m))
        out.append([v.tolist() for v in vectors[:, ::-1][:, :DIRECTIONS].T])
    return pd.Series(out)


def fit_windows(windows: DataFrame, group: str, vector: str = "window", length: int = LENGTH) -> DataFrame:
    """Mean and leading directions of the windows of each group.

    The moments are plain averages, combined on the map side; only one small
    row per group reaches Python.
    """
    cell = lambda i: F.col(vector)[i]
    pairs = [(i, j) for i in range(length) for j in range(i, length)]
    moments = windows.where(F.col(vector).isNotNull()).groupBy(group).agg(
        F.array(*[F.avg(cell(i)) for i in range(length)]).alias("_mean"),
        F.array(*[F.avg(cell(i) * cell(j)) for i, j in pairs]).alias("_products"),
    )
    return moments.select(group, "_mean", _directions("_mean", "_products").alias("_axes"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def rebuild_error(vector: Column, mean: Column, axes: Column, length: int) -> Column:
    """Mean squared part of the window outside the directions."""
    centred = F.zip_with(vector, mean, lambda v, m: v - m)
    kept = F.aggregate(
        F.transform(axes, lambda axis: _dot(centred, axis)), F.lit(0.0), lambda s, v: s + v * v
    )
    return F.greatest((_dot(centred, centred) - kept) / F.lit(float(length)), F.lit(0.0))


def window_reconstruction(
    df: DataFrame,
    group: str = "service_category",
    keys: Sequence[str] = SERIES_KEYS,
    order: Sequence[str] = ("date",),
    cost: str = "total_cost",
    length: int = LENGTH,
    quantile: float = 0.95,
    closed: bool = False,
    by_service: bool = False,
) -> DataFrame:
    """Add ``lstm_error`` and ``lstm_flag`` (error above the group's quantile).

    The first ``length - 1`` rows of a sequence, and sequences of no more than
    ``length`` rows, have error 0 and no flag. With ``by_service`` the rows of
    a service form one sequence, cut into overlapping blocks.
    """
    scaled = standardize(df, [cost], [group], closed)
    value = f"{cost}_scaled"
    if by_service:
        cut, w = in_blocks(with_positions(scaled, group), length - 1, 0, group)
        rows = home_rows(sliding_windows(cut, w, [value], length))
        usable = (F.col("seq") >= length - 1) & (F.col("seq_len") > length)
    else:
        series = W.partitionBy(*keys)
        rows = sliding_windows(scaled, series.orderBy(*order), [value], length)
        rows = rows.withColumn("_len", F.count(F.lit(1)).over(series))
        usable = F.col("_len") > length
    rows = rows.withColumn("window", F.when(usable, F.col("window"))).drop("_len", "seq", "seq_len", value)
    rows = stage(rows, "windows")
    model = fit_windows(rows, group, length=length)
    error = rebuild_error(F.col("window"), F.col("_mean"), F.col("_axes"), length)
    scored = attach(rows, model, [group], closed).withColumn("_error", error).drop("_mean", "_axes", "window")
    scored = stage(scored, "window-errors")
    cuts = exact_quantiles(scored, [group], "_error", {"_cut": quantile}, closed)
    return attach(scored, cuts, [group], closed).withColumns({
        "lstm_error": F.coalesce(F.col("_error"), F.lit(0.0)),
        "lstm_flag": flag(F.col("_error") > F.col("_cut")),
    }).drop("_error", "_cut")


# Input columns of the model, in the given order.
MULTI_COLUMNS = ("cost_usd", "rolling_mean_7", "rolling_std_7", "pct_change_1d")


def window_reconstruction_multi(
    df: DataFrame,
    key: str = "segment_id",
    columns: Sequence[str] = MULTI_COLUMNS,
    length: int = 14,
    directions: int = 4,
    save_to: str | None = None,
) -> DataFrame:
    """Error of rebuilding the ``length`` rows before each row, as ``lstm_score``.

    Needs ``is_train``. Columns are scaled per segment on its training rows;
    the directions come from all training windows in one distributed fit.
    Windows do not cross from the training part into the held-out part.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    scaled = standardize(df, columns, [key], fit_rows=F.col("is_train") == 1)
    names = [f"{c}_scaled" for c in columns]
    w = W.partitionBy(key, "is_train").orderBy("date")
    rows = stage(sliding_windows(scaled, w, names, length, preceding=True).drop(*names), "multi-windows")
    full = rows.where(F.col("window").isNotNull()).withColumn("_v", array_to_vector("window"))
    train = full.where(F.col("is_train") == 1)
    model = PCA(k=directions, inputCol="_v", outputCol="_p").fit(train)
    if save_to:
        model.write().overwrite().save(save_to)
    # One 56-number row: the centre of the training windows.
    centre = train.select(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray()
    shift = model.pc.toArray().T @ centre
    gap = F.zip_with(F.col("window"), F.array(*[F.lit(float(c)) for c in centre]), lambda v, m: v - m)
    kept = F.zip_with(vector_to_array("_p"), F.array(*[F.lit(float(s)) for s in shift]), lambda v, m: v - m)
    size = float(length * len(columns))
    error = F.greatest((_dot(gap, gap) - _dot(kept, kept)) / size, F.lit(0.0))
    return model.transform(full).withColumn("lstm_score", error).drop("_v", "_p", "window")
