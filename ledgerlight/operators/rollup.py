"""Daily rollups. Partial aggregation runs before every shuffle, so a hot
provider, service or day leaves each task as one row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import WEEKDAYS, segment_id
from ..schemas import SERIES_KEYS

DAILY_KEYS = ("date", *SERIES_KEYS)


def daily_rollup(df: DataFrame, keys: Sequence[str] = DAILY_KEYS) -> DataFrame:
    """Sum, mean and count of the cost per key; the label too where present.

    Money is added as a decimal and leaves as a double, so the sum does not
    depend on the order of the rows.
    """
    total = F.sum("cost_usd")
    aggs = [
        total.cast("double").alias("total_cost"),
        F.try_divide(total.cast("double"), F.count("cost_usd").cast("double")).alias("avg_cost"),
        F.count("cost_usd").alias("record_count"),
    ]
    if "is_anomaly" in df.columns:
        aggs.append(F.max("is_anomaly").cast("int").alias("is_anomaly"))
    return df.groupBy(*keys).agg(*aggs)


def totals(df: DataFrame, keys: Sequence[str] = ("date", "service_category"), cost: str = "total_cost") -> DataFrame:
    """Total cost per key list."""
    return df.groupBy(*keys).agg(F.sum(cost).cast("double").alias("total_cost"))


def densify(df: DataFrame, keys: Sequence[str], fill: dict[str, object]) -> DataFrame:
    """Every calendar day between a series' first and last row; gaps get ``fill``.

    Each row is stretched up to the day before the next one, so no calendar
    table and no join are needed: one shuffle on the series.
    """
    following = F.lead("date").over(W.partitionBy(*keys).orderBy("date"))
    stretched = (
        df.withColumn("_last", F.coalesce(F.date_sub(following, 1), F.col("date")))
        .withColumn("_day", F.explode(F.sequence(F.col("date"), F.col("_last"))))
    )
    real = F.col("_day") == F.col("date")
    return stretched.select(
        *keys,
        F.col("_day").alias("date"),
        *[F.coalesce(F.when(real, F.col(c)), F.lit(v).cast(dict(df.dtypes)[c])).alias(c) for c, v in fill.items()],
    )


def segment_daily(df: DataFrame, keys: Sequence[str] = ("service_category", "team")) -> DataFrame:
    """Calendar-dense daily cost and label per segment."""
    label = F.max("is_anomaly").cast("int") if "is_anomaly" in df.columns else F.lit(0)
    per_day = (
        df.groupBy(segment_id(*keys).alias("segment_id"), "date")
        .agg(F.sum("cost_usd").cast("double").alias("cost_usd"), label.alias("is_anomaly"))
    )
    return densify(per_day, ["segment_id"], {"cost_usd": 0.0, "is_anomaly": 0})


def weekday_matrix(df: DataFrame, row: str = "service_category", cost: str = "cost_usd") -> DataFrame:
    """Mean cost per row value and weekday, Monday first, 0 where there is none.

    The list of days is fixed, so the pivot needs no extra job.
    """
    named = df.withColumn("_dow", F.date_format("date", "EEEE"))
    return named.groupBy(row).pivot("_dow", list(WEEKDAYS)).agg(F.avg(F.col(cost).cast("double"))).na.fill(0.0)


def service_matrix(df: DataFrame, services: Sequence[str], cost: str = "cost_usd") -> DataFrame:
    """Date by service cost matrix for a known list of services, 0 where absent."""
    wide = df.groupBy("date").pivot("service_category", list(services)).agg(F.sum(cost).cast("double"))
    return wide.na.fill(0.0)
