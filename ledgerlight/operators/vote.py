"""Majority vote and cross-service spikes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EPSILON, attach, flag, ladder

FLAGS = ("zscore_flag", "if_flag", "lstm_flag")


def severity_label(score: Column) -> Column:
    return F.when(score < 0.34, "low").when(score < 0.99, "medium").otherwise("high")


def vote(df: DataFrame, flags: Sequence[str] = FLAGS, threshold: int = 2) -> DataFrame:
    """Votes, verdict and severity from 0/1 flags that sit on the same rows."""
    votes = F.lit(0)
    for f in flags:
        votes = votes + F.col(f)
    out = df.withColumn("vote_count", votes.cast("int"))
    out = out.withColumns({
        "model_votes": F.col("vote_count"),
        "final_anomaly": flag(F.col("vote_count") >= threshold),
        "severity_score": F.round(F.col("vote_count") / F.lit(len(flags)), 2),
    })
    return out.withColumn("severity_label", severity_label(F.col("severity_score")))


def correlated_spikes(
    df: DataFrame, cost: str = "total_cost", service: str = "service_category", limit: float = 2.0, least: int = 2
) -> DataFrame:
    """Per date, how many services lie more than ``limit`` deviations off.

    A service without a row on a date counts as 0 there. The date-by-service
    grid is never built: the zeros enter the mean and deviation by count, and
    whether a zero itself is a spike is one fact per service.
    """
    cells = df.groupBy("date", service).agg(F.sum(cost).cast("double").alias("_x"))
    days = F.col("_days")
    n_days = cells.select(F.count_distinct("date").alias("_days"))
    seen = F.count(F.lit(1))
    per_service = cells.groupBy(service).agg(seen.alias("_n"), F.avg("_x").alias("_m"), F.var_pop("_x").alias("_v"))
    per_service = per_service.withColumn("_days", n_days.scalar())
    spread = F.col("_v") * F.col("_n") + F.col("_m") * F.col("_m") * F.col("_n") * (days - F.col("_n")) / days
    per_service = per_service.select(
        service,
        (F.col("_m") * F.col("_n") / days).alias("_mean"),
        (F.sqrt(F.try_divide(spread, days - 1)) + F.lit(EPSILON)).alias("_std"),
    ).withColumn("_zero_spikes", flag(F.col("_mean") / F.col("_std") > limit))
    zero_total = per_service.select(F.coalesce(F.sum("_zero_spikes"), F.lit(0)).alias("_zeros"))
    z = F.abs(F.col("_x") - F.col("_mean")) / F.col("_std")
    per_date = (
        attach(cells, per_service, [service])
        .groupBy("date")
        .agg(F.sum(flag(z > limit)).alias("_hit"), F.sum("_zero_spikes").alias("_zero_here"))
        .withColumn("services_spiking", F.col("_hit") - F.col("_zero_here") + zero_total.scalar())
    )
    return per_date.select(
        "date", F.col("services_spiking").cast("long"), flag(F.col("services_spiking") >= least).alias("correlated_anomaly")
    )


def correlated_states(spikes: DataFrame, source_rows: DataFrame | None = None, least_rows: int = 0) -> DataFrame:
    """Named state of the correlated dates; nothing when the source is tiny."""
    out = spikes.where(F.col("correlated_anomaly") == 1).select(
        F.date_format("date", "yyyy-MM-dd").alias("day"),
        "services_spiking",
        ladder(
            F.col("services_spiking"),
            [(3, "CRITICAL SYSTEM DEVIATION"), (2, "HIGH DIVERGENCE")],
            "ELEVATED FLUCTUATION",
        ).alias("telemetry_state"),
    )
    if source_rows is not None:
        enough = source_rows.limit(least_rows + 1).select((F.count(F.lit(1)) > least_rows).alias("_ok"))
        out = out.where(enough.scalar())
    return out
