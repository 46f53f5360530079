"""Score fusion, threshold calibration and weight search as grouped counts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import attach, safe_ratio

SCORES = ("z_score", "if_score", "svm_score", "lstm_score")
# Candidate cut-offs of the weight search and of the final choice.
SEARCH_GRID = [float(t) for t in np.linspace(0.1, 0.9, 20)]
FINAL_GRID = [float(t) for t in np.linspace(0.1, 0.9, 100)]
DETECTOR_PERCENTILES = [float(p) / 100 for p in np.linspace(80, 99.9, 20)]
WINDOW_PERCENTILES = [0.95, 0.96, 0.97, 0.98, 0.99]


def minmax_scores(df: DataFrame, columns: Sequence[str] = SCORES, key: str = "segment_id") -> DataFrame:
    """Scale scores to 0..1 by the segment's training range; no clipping."""
    train = df.where(F.col("is_train") == 1)
    ends = train.groupBy(key).agg(*[a for c in columns for a in (F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"))])
    out = attach(df, ends, [key])
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        span = F.when(span == 0, 1.0).otherwise(span)
        out = out.withColumn(f"{c}_n", (F.col(c) - F.col(f"_lo_{c}")) / span)
    return out.drop(*[f"_{e}_{c}" for c in columns for e in ("lo", "hi")])


def fuse(weights: Sequence[Column], columns: Sequence[str]) -> Column:
    """Weighted score with the weights brought to a sum of 1."""
    total = sum(weights[1:], weights[0])
    parts = [safe_ratio(w, total) * F.col(c) for w, c in zip(weights, columns)]
    return sum(parts[1:], parts[0])


def weighted_ensemble(df: DataFrame, weights: dict[str, float] | DataFrame, key: str = "segment_id") -> DataFrame:
    """Add ``fused_score`` from fixed weights or from a weight row per segment."""
    names = [f"{c}_n" for c in SCORES]
    if isinstance(weights, DataFrame):
        out = attach(df, weights.select(key, *[f"w_{c}" for c in SCORES]), [key], how="inner")
        score = fuse([F.col(f"w_{c}") for c in SCORES], names)
        return out.withColumn("fused_score", score).drop(*[f"w_{c}" for c in SCORES])
    return df.withColumn("fused_score", fuse([F.lit(float(weights[c])) for c in SCORES], names))


def _passed(score: str, thresholds: Sequence[float] | None = None) -> Column:
    """How many of the ascending candidates the score exceeds.

    Fixed candidates become a sum of comparisons, which stays in generated
    code; candidates of the group come from its ``_grid`` column.
    """
    if thresholds is None:
        return F.size(F.filter("_grid", lambda t: F.col(score) > t))
    hits = [(F.col(score) > F.lit(float(t))).cast("int") for t in thresholds]
    return sum(hits[1:], hits[0])


def _swept(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Confusion counts at every threshold from counts per passed-level.

    A group has at most one level per threshold, so the arrays are tiny.
    """
    packed = counted.groupBy(*keys).agg(
        F.first("_grid").alias("_grid"), F.sum("_pos").alias("_all"),
        F.collect_list(F.struct("_level", "_pos", "_neg")).alias("_levels"),
    )

    def above(field: str, i: Column) -> Column:
        hit = F.filter("_levels", lambda level: level["_level"] > i)
        return F.aggregate(hit, F.lit(0).cast("long"), lambda s, level: s + level[field])

    points = F.transform(
        "_grid", lambda t, i: F.struct(t.alias("threshold"), above("_pos", i).alias("tp"), above("_neg", i).alias("fp"))
    )
    rows = packed.select(*keys, "_all", F.explode(points).alias("_p")).select(*keys, "_all", "_p.*")
    fn = F.col("_all") - F.col("tp")
    f1 = safe_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + fn)
    return rows.select(*keys, "threshold", "tp", "fp", fn.alias("fn"), f1.alias("f1"))


def threshold_sweep(
    df: DataFrame,
    keys: Sequence[str],
    truth: str,
    score: str,
    thresholds: Sequence[float] | None = None,
    percentiles: Sequence[float] | None = None,
) -> DataFrame:
    """F1 of ``score > threshold`` at every candidate, per group.

    Rows are counted once by how many candidates they pass; no row is paired
    with every candidate. ``percentiles`` takes the candidates from the group's
    own scores (for groups bounded by the calendar).
    """
    y = F.col(truth) == 1
    if percentiles is not None:
        cuts = df.groupBy(*keys).agg(F.percentile(score, F.array(*[F.lit(p) for p in percentiles])).alias("_grid"))
        rows = attach(df.select(*keys, truth, score), cuts, keys).withColumn("_level", _passed(score))
    else:
        rows = df.select(*keys, truth, _passed(score, thresholds).alias("_level"))
    counts = [F.count_if(y).alias("_pos"), F.count_if(~y).alias("_neg")]
    if percentiles is not None:
        counted = rows.groupBy(*keys, "_level").agg(*counts, F.first("_grid").alias("_grid"))
    else:
        counted = rows.groupBy(*keys, "_level").agg(*counts).withColumn("_grid", _literals(thresholds))
    return _swept(counted, keys)


def _literals(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def best_threshold(sweep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First candidate with the best F1; threshold 0 where nothing scores."""
    first = W.partitionBy(*keys).orderBy(F.col("f1").desc(), "threshold")
    best = sweep.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1)
    return best.select(*keys, F.when(F.col("f1") > 0, F.col("threshold")).otherwise(0.0).alias("threshold"), "f1")


def severity_quantiles(df: DataFrame, key: str = "segment_id", score: str = "fused_score", pred: str = "prediction") -> DataFrame:
    """Median and 80 % quantile of the flagged scores, 1.0 where none is flagged."""
    hit = F.when(F.col(pred) == 1, F.col(score))
    q = F.percentile(hit, F.array(F.lit(0.5), F.lit(0.8)))
    return df.groupBy(key).agg(q.alias("_q")).select(
        key, F.coalesce(F.col("_q")[0], F.lit(1.0)).alias("q50"), F.coalesce(F.col("_q")[1], F.lit(1.0)).alias("q80")
    )


def halton(index: int, base: int) -> float:
    value, scale = 0.0, 1.0
    while index:
        scale /= base
        index, digit = divmod(index, base)
        value += digit * scale
    return value


def weight_trials(trials: int = 30) -> list[tuple[int, tuple[float, ...]]]:
    """Deterministic, evenly spread weight vectors."""
    return [(i, tuple(halton(i, b) for b in (2, 3, 5, 7))) for i in range(1, trials + 1)]


def weight_search(
    df: DataFrame,
    key: str = "segment_id",
    truth: str = "is_anomaly",
    trials: Sequence[tuple[int, tuple[float, ...]]] | None = None,
    grid: Sequence[float] = tuple(SEARCH_GRID),
) -> DataFrame:
    """Best weights per segment: all trials, cut-offs and segments in one job.

    Each row is scored once per trial (a fixed number) and counted on the map
    side, so the shuffle carries segments x trials x levels rows.
    """
    weights = [f"w_{c}" for c in SCORES]
    trials = list(trials or weight_trials())
    table = F.array(*[
        F.struct(F.lit(i).alias("trial"), *[F.lit(w / sum(ws)).alias(n) for n, w in zip(weights, ws)]) for i, ws in trials
    ])
    names = [f"{c}_n" for c in SCORES]
    rows = df.select(key, truth, *names, F.explode(table).alias("_t")).select(key, truth, *names, "_t.*")
    parts = [F.col(w) * F.col(c) for w, c in zip(weights, names)]
    y = F.col(truth) == 1
    counted = (
        rows.withColumn("_fused", sum(parts[1:], parts[0]))
        .groupBy(key, "trial", *weights, _passed("_fused", grid).alias("_level"))
        .agg(F.count_if(y).alias("_pos"), F.count_if(~y).alias("_neg"))
        .withColumn("_grid", _literals(grid))
    )
    swept = _swept(counted, [key, "trial", *weights])
    first = W.partitionBy(key).orderBy(F.col("f1").desc(), "trial", "threshold")
    best = swept.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1)
    return best.select(key, "trial", "threshold", "f1", *weights)
