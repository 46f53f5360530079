"""The reporting questions over the result tables, each one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import flag

P0, P1 = "P0 - Critical", "P1 - High"


def _flagged() -> Column:
    return F.col("is_anomaly").cast("int") == 1


def slice_rows(
    df: DataFrame,
    providers: Sequence[str] | None = None,
    first: str | None = None,
    last: str | None = None,
    service: str | None = None,
    only_anomalies: bool = False,
) -> DataFrame:
    """Dashboard slice; every predicate reaches the scan. Absent ones are not added."""
    if providers:
        df = df.where(F.col("provider").isin(list(providers)))
    if first:
        df = df.where(F.col("date").cast("date") >= F.lit(first).cast("date"))
    if last:
        df = df.where(F.col("date").cast("date") <= F.lit(last).cast("date"))
    if service:
        df = df.where(F.col("service_category") == service)
    return df.where(_flagged()) if only_anomalies else df


def overview(df: DataFrame) -> DataFrame:
    """Counters of the overview page in one pass."""
    return df.agg(
        F.count_if(_flagged()).alias("total_anomalies"),
        F.count_if(F.col("priority") == P0).alias("p0_critical"),
        F.count_if(F.col("priority") == P1).alias("p1_high"),
        *[F.count_if(F.col("severity_label") == s).alias(f"{s}_severity") for s in ("high", "medium", "low")],
    )


def kpi_strip(df: DataFrame) -> DataFrame:
    urgent = F.coalesce(F.col("priority").rlike("P0|P1"), F.lit(False))
    return df.agg(
        F.count_if(_flagged()).alias("total_anomalies"),
        F.count_if(urgent).alias("p0_p1_count"),
        F.count_if(F.col("severity_label") == "high").alias("high_severity"),
        F.coalesce(F.sum("impact_score"), F.lit(0.0)).alias("total_impact"),
    )


def vote_agreement(df: DataFrame) -> DataFrame:
    votes = F.col("model_votes")
    return df.where(_flagged()).agg(
        F.count(F.lit(1)).alias("total_flags"),
        F.round(F.avg(votes), 2).alias("average_votes"),
        F.count_if(votes >= 3).alias("strong"),
        F.count_if(votes < 3).alias("weak"),
    )


def shares(df: DataFrame, col: str) -> DataFrame:
    """Count and share of each value. Only the counted values meet in one task."""
    counted = df.groupBy(col).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.withColumn("share", F.col("row_count") / F.sum("row_count").over(W.partitionBy()))


def severity_share(df: DataFrame) -> DataFrame:
    return shares(df.where(_flagged()), "severity_label")


def vote_distribution(df: DataFrame, key: str = "service_category") -> DataFrame:
    return df.groupBy(key, "model_votes", "severity_label").agg(F.count(F.lit(1)).alias("row_count"))


def daily_spend(df: DataFrame, cost: str = "cost_usd") -> DataFrame:
    return df.groupBy("date").agg(F.sum(cost).cast("double").alias("total_cost"))


def severity_markers(df: DataFrame) -> DataFrame:
    """One marker per flagged date and severity at the day's total spend."""
    daily = daily_spend(df)
    marked = df.where(_flagged()).select("severity_label", "date").distinct()
    return marked.join(daily, "date").select("severity_label", "date", "total_cost")


def service_costs(df: DataFrame) -> DataFrame:
    """Cost per service and its anomalous part, one pass, 0 where none."""
    return df.groupBy("service_category").agg(
        F.sum("cost_usd").cast("double").alias("total_cost"),
        F.coalesce(F.sum(F.when(_flagged(), F.col("cost_usd"))).cast("double"), F.lit(0.0)).alias("anomaly_cost"),
    )


def provider_allocation(df: DataFrame) -> DataFrame:
    """Total, flagged rows and mean daily spend per provider.

    Rolled up to (provider, date) once; the reference's join of two aggregates
    over the same rows folds into a second aggregate.
    """
    per_day = df.groupBy("provider", "date").agg(
        F.sum("cost_usd").cast("double").alias("_day"), F.sum(flag(_flagged())).alias("_flags")
    )
    return per_day.groupBy("provider").agg(
        F.sum("_day").alias("total_cost"), F.sum("_flags").alias("anomaly_count"), F.avg("_day").alias("avg_daily")
    )


def filter_domains(df: DataFrame, cols: Sequence[str] = ("provider", "service_category")) -> DataFrame:
    """Distinct values of the filter columns, long form, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("filter"), F.col(c).alias("value")) for c in cols])).alias("_p")
    return df.select(pairs).select("_p.*").where(F.col("value").isNotNull()).distinct()


def date_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("date").cast("date").alias("first_day"), F.max("date").cast("date").alias("last_day"))


def rows_with_total(df: DataFrame) -> DataFrame:
    """The rows with their total count beside them, for a paged answer.

    The count is a scalar subquery: a window over everything would put all
    rows into one task.
    """
    return df.withColumn("total_rows", df.select(F.count(F.lit(1)).alias("_n")).scalar())


