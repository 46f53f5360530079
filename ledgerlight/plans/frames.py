"""Frames the registered queries start from, all derived from the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions, features, normalize, rollup, scenario, segments, vote, zscore
from ..schemas import ROW_KEY, SERIES_KEYS
from ..session import stage
from ..sources import billing, store

# The taxonomy is a fixed list, so per-service values are a handful of rows.
CLOSED = True
RULE_FLAGS = ("zscore_flag", "if_flag", "lstm_flag")
RUN_TIME = "2001-01-01 00:00:00"


def rounded(col: str | Column, digits: int = 4) -> Column:
    """Round for comparison; the small shift keeps exact halves off the edge."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double") + F.lit(10.0 ** -(digits + 3)), digits)


def present(df: DataFrame, keys: Sequence[str], numbers: Sequence[str] = (), others: Sequence[str] = (), digits: int = 4) -> DataFrame:
    return df.select(*keys, *[rounded(c, digits).alias(c) for c in numbers], *others)


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize(billing.billing_view(spark, sf_dir))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.daily_rollup(normalized(spark, sf_dir))


def staged_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily rollup written once: what follows reads it several times,
    and the billing rows only this one time."""
    return stage(daily(spark, sf_dir), "daily")


def complete_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.engineer_features(staged_daily(spark, sf_dir), closed=CLOSED)


def staged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(complete_features(spark, sf_dir), "features")


def rule_voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote of three flags that SQL can express: residual z, global z, deviation."""
    df = zscore.zscore_detector(complete_features(spark, sf_dir))
    df = df.withColumns({
        "if_flag": (F.col("zscore") > 2.5).cast("int"),
        "lstm_flag": (F.abs("deviation_from_mean") > 2.0).cast("int"),
    })
    return vote.vote(df)


def decided(spark: SparkSession, sf_dir: str, policy=decisions.BATCH_POLICY) -> DataFrame:
    return decisions.priority(decisions.impact(rule_voted(spark, sf_dir)), policy)


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided rows with their rule texts, under the anomaly log's column names."""
    base = stage(decided(spark, sf_dir), "decided")
    rich = decisions.enrich_top_impact(base, closed=CLOSED)
    return as_log(rich)


def as_log(df: DataFrame) -> DataFrame:
    return df.withColumn("cost_usd", F.col("total_cost")).withColumn("is_anomaly", F.col("final_anomaly"))


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the anomaly log the reports use, without the texts."""
    return as_log(decided(spark, sf_dir)).select(
        *ROW_KEY, "cost_usd", "is_anomaly", "severity_label", "severity_score", "model_votes", "impact_score", "priority"
    )


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.to_contract(logged(spark, sf_dir), "anomaly_logs", RUN_TIME)


# Labels for tuning: a spike on every 9th day of the table, within the days a
# segment already has.
LABEL_EVERY, LABEL_FACTOR = 9, 4.0


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The first day comes from one column of the fact table, not from a second scan of the whole view.
    first = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.min(F.col("l_shipdate").cast("date"))).scalar()
    return scenario.inject_spikes(normalized(spark, sf_dir), every=LABEL_EVERY, factor=LABEL_FACTOR, start=first)


def segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.segment_daily(labelled(spark, sf_dir))


def staged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(segment_rows(spark, sf_dir), "segments")


def split_segments(spark: SparkSession, sf_dir: str, ema: bool = True) -> DataFrame:
    feats = segments.segment_features(segment_rows(spark, sf_dir), ema=ema)
    return features.time_split(feats, 0.8, ["segment_id"])


def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scores SQL can express, in place of the fitted detectors' scores.

    Rounded, so that scores equal in exact arithmetic tie in every engine.
    """
    df = split_segments(spark, sf_dir, ema=False)
    return df.select(
        "segment_id", "date", "is_anomaly", "is_train",
        F.round(F.abs("zscore_base"), 9).alias("z_score"),
        F.round(F.abs("pct_change_1d"), 9).alias("if_score"),
        F.round(F.abs("pct_change_7d"), 9).alias("svm_score"),
        F.round("ratio_to_rolling_max_7", 9).alias("lstm_score"),
    )


def service_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.totals(normalized(spark, sf_dir), cost="cost_usd")


SERIES = list(SERIES_KEYS)
KEY = list(ROW_KEY)
