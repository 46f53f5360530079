"""Detector and forecast quality as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import safe_ratio


def _counts(truth: str, pred: str) -> dict[str, Column]:
    y, p = F.col(truth) == 1, F.col(pred) == 1
    return {"tp": F.count_if(y & p), "fp": F.count_if(~y & p), "fn": F.count_if(y & ~p), "negatives": F.count_if(~y)}


def precision(tp: Column, fp: Column) -> Column:
    return safe_ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return safe_ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return safe_ratio(2 * tp, 2 * tp + fp + fn)


def quality(df: DataFrame, keys: Sequence[str], truth: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and false positive rate; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    counted = df.groupBy(*keys).agg(*[c.alias(n) for n, c in _counts(truth, pred).items()])
    return counted.select(
        *keys,
        precision(tp, fp).alias("precision_score"),
        recall(tp, fn).alias("recall_score"),
        f1(tp, fp, fn).alias("f1_score"),
        (fp / F.greatest(F.col("negatives"), F.lit(1))).alias("false_positive_rate"),
    )


def roc_auc(df: DataFrame, keys: Sequence[str], truth: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties included; 0 for one class.

    Rows collapse to (score, positives, negatives) before the ordered step, so
    heavy ties shrink there and only distinct scores are sorted.
    """
    y = F.col(truth) == 1
    levels = df.groupBy(*keys, score).agg(F.count_if(y).alias("_pos"), F.count_if(~y).alias("_neg"))
    below = W.partitionBy(*keys).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    levels = levels.withColumn("_under", F.coalesce(F.sum("_neg").over(below), F.lit(0)))
    won = F.sum(F.col("_pos") * (F.col("_under") + F.col("_neg") / 2.0))
    return levels.groupBy(*keys).agg(
        F.coalesce(F.try_divide(won, (F.sum("_pos") * F.sum("_neg")).cast("double")), F.lit(0.0)).alias("roc_auc")
    )


def mape_fraction(df: DataFrame, keys: Sequence[str], actual: str, predicted: str, eps: float = 2.220446049250313e-16) -> DataFrame:
    """Mean absolute relative error as a fraction."""
    y, p = F.col(actual), F.col(predicted)
    return df.groupBy(*keys).agg(F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(eps))).alias("mape"))


def mape_positive(df: DataFrame, keys: Sequence[str], actual: str, predicted: str, undefined: float = 999.0) -> DataFrame:
    """Mean absolute relative error in percent over positive actuals."""
    y, p = F.col(actual), F.col(predicted)
    error = F.avg(F.when(y > 0, F.abs((y - p) / F.when(y > 0, y)))) * 100
    return df.groupBy(*keys).agg(F.coalesce(error, F.lit(undefined)).alias("mape"))


def metric_rows(quality_df: DataFrame, mape_df: DataFrame, key: str = "service_category", suffix: str = "_lightgbm") -> DataFrame:
    """Model metric rows as stored, one per service."""
    return quality_df.join(mape_df, key).select(
        F.concat(F.col(key), F.lit(suffix)).alias("model_name"), "f1_score", "precision_score", "recall_score", "mape"
    )
