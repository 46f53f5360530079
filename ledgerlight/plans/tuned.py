"""The tuned run: fitted detectors, searched weights and cut-offs per segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import attach, flag
from ..operators import evaluation, features, forecast, forest, kernel, reconstruct, segments, tuning
from ..session import stage
from ..sources.store import write_parameters, write_segment_metrics

MIN_DAYS = 50
SHARE = 0.8
KEY = "segment_id"


def judge(scores: DataFrame, weights: dict[str, float] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Held-out rows with their verdict, and the chosen cut-off per segment."""
    scaled = tuning.minmax_scores(stage(scores, "scores"))
    held = stage(tuning.weighted_ensemble(scaled, weights).where(F.col("is_train") == 0), "held")
    sweep = tuning.threshold_sweep(held, [KEY], "is_anomaly", "fused_score", tuning.FINAL_GRID)
    best = tuning.best_threshold(sweep, [KEY])
    judged = attach(held, best.select(KEY, "threshold"), [KEY])
    return judged.withColumn("prediction", flag(F.col("fused_score") > F.col("threshold"))), best


def segment_quality(judged: DataFrame) -> DataFrame:
    quality = evaluation.quality(judged, [KEY], "is_anomaly", "prediction")
    return quality.join(evaluation.roc_auc(judged, [KEY], "is_anomaly", "fused_score"), KEY)


def fitted_scores(segment_rows: DataFrame) -> DataFrame:
    """The four scores of every row that has a full window before it."""
    rows = features.time_split(segments.segment_features(segment_rows), SHARE, [KEY])
    rows = features.min_history(stage(rows, "segment-features"), MIN_DAYS, [KEY])
    fit = F.col("is_train") == 1
    rows = forest.isolation_forest(rows, KEY, segments.SEGMENT_FEATURES, [KEY, "date"], fit_rows=fit)
    rows = stage(kernel.kernel_one_class(rows), "kernel-scores")
    rows = reconstruct.window_reconstruction_multi(rows)
    return rows.select(KEY, "date", "is_anomaly", "is_train", F.abs("zscore_base").alias("z_score"), "if_score", "svm_score", "lstm_score")


def tuned_run(segment_rows: DataFrame, save_to: str | None = None) -> DataFrame:
    """One row per segment: weights, cut-off, severity quantiles and quality."""
    scores = stage(fitted_scores(segment_rows), "fitted-scores")
    held = tuning.minmax_scores(scores).where(F.col("is_train") == 0)
    weights = stage(tuning.weight_search(held).drop("threshold", "f1"), "weights")
    judged, best = judge(scores, weights)
    judged = stage(judged, "judged")
    out = (
        segment_quality(judged)
        .join(best.select(KEY, "threshold"), KEY)
        .join(tuning.severity_quantiles(judged), KEY)
        .join(weights, KEY)
    )
    if save_to:
        out = stage(out, "tuned")
        metrics = ["f1_score", "precision_score", "recall_score", "roc_auc", "false_positive_rate"]
        documents = out.select(
            KEY,
            F.struct(*[f"w_{c}" for c in tuning.SCORES]).alias("weights"),
            "threshold",
            F.struct("q50", "q80").alias("severity_quantiles"),
            F.struct(*metrics).alias("metrics"),
        )
        write_parameters(documents, f"{save_to}/tuned_params")
        write_segment_metrics(out.select(KEY, *metrics), f"{save_to}/segment_metrics")
    return out


# Candidate boosting settings; the rows of all segments share each fit.
SETTINGS = {
    "slow": {"max_iter": 60, "step": 0.05, "depth": 4},
    "fast": {"max_iter": 40, "step": 0.1, "depth": 5},
    "sampled": {"max_iter": 40, "step": 0.1, "depth": 4, "subsample": 0.8, "feature_share": "0.8"},
}


def tune_boosting(rows: DataFrame, settings: dict[str, dict] = SETTINGS) -> DataFrame:
    """Validation error per segment and setting, the lowest one marked.

    The loop is over settings; every fit is distributed over all rows.
    """
    out = None
    for name, params in settings.items():
        held = forecast.boosted_predictions(rows, segments.SEGMENT_FEATURES, "cost_usd", KEY, **params)
        part = evaluation.mape_positive(held, [KEY], "cost_usd", "predicted").withColumn("setting", F.lit(name))
        out = part if out is None else out.unionByName(part)
    out = stage(out, "boost-trials")
    first = W.partitionBy(KEY).orderBy("mape", "setting")
    return out.withColumn("is_best", flag(F.row_number().over(first) == 1))
