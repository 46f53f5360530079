"""Cleaning of raw billing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import calendar_columns, clean_money, out_of_range, parse_date
from ..schemas import MALFORMED

# Provider product name to service category.
TAXONOMY = {
    "Amazon EC2": "compute",
    "Amazon S3": "storage",
    "Amazon RDS": "managed_services",
    "Amazon CloudFront": "networking",
    "AWS Lambda": "compute",
    "Virtual Machines": "compute",
    "Blob Storage": "storage",
    "Azure SQL": "managed_services",
    "Azure CDN": "networking",
    "Compute Engine": "compute",
    "Cloud Storage": "storage",
    "Cloud SQL": "managed_services",
    "Cloud CDN": "networking",
}
OTHER = "other"
CATEGORIES = (*sorted(set(TAXONOMY.values())), OTHER)


def category_of(name: Column) -> Column:
    """Taxonomy lookup on a literal map; unknown and missing names are ``other``."""
    pairs = [F.lit(part) for item in TAXONOMY.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(OTHER))


def with_category(df: DataFrame) -> DataFrame:
    """Add ``service_category`` from whichever service column the export has."""
    have = set(df.columns)
    if "service_name" in have:
        expr = category_of(F.col("service_name"))
    elif "service" in have:
        expr = F.coalesce(F.col("service"), F.lit(OTHER))
    elif "service_category" in have:
        expr = F.coalesce(F.col("service_category"), F.lit(OTHER))
    else:
        expr = F.lit(OTHER)
    return df.withColumn("service_category", expr)


def with_day(df: DataFrame) -> DataFrame:
    """``date`` as a day. Text is parsed, unreadable text becomes NULL."""
    kind = dict(df.dtypes)["date"]
    return df.withColumn("date", parse_date("date") if kind == "string" else F.col("date").cast("date"))


def reject_reason(df: DataFrame) -> Column:
    """Why a raw row cannot be used, NULL if it can; ``df`` has its raw columns."""
    text = dict(df.dtypes)["date"] == "string"
    no_day = (parse_date("date") if text else F.col("date").cast("date")).isNull()
    reason = F.when(no_day, "date is unreadable").when(out_of_range("cost_usd"), "cost is out of range")
    if MALFORMED in df.columns:
        reason = F.when(F.col(MALFORMED).isNotNull(), "line is malformed").otherwise(reason)
    return reason


def rejected(df: DataFrame) -> DataFrame:
    """(reason, stage, row): the raw rows that ``normalize`` leaves out."""
    columns = [F.col(c) for c in df.columns]
    rows = df.select(reject_reason(df).alias("reason"), F.lit("input").alias("stage"), F.to_json(F.struct(*columns)).alias("row"))
    return rows.where(F.col("reason").isNotNull())


def rejected_dates(df: DataFrame) -> DataFrame:
    """Rows whose date cannot be read; they are reported, not guessed."""
    return df.where(F.col("date").isNull() | parse_date("date").isNull())


def clean(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "cost_usd": clean_money("cost_usd"),
        "team": F.coalesce(F.col("team"), F.lit("unknown")),
        "environment": F.coalesce(F.col("environment"), F.lit("unknown")),
    })


def normalize(df: DataFrame) -> DataFrame:
    """Category, day, clean money and keys, calendar columns. One narrow pass."""
    usable = df.where(reject_reason(df).isNull()).drop(MALFORMED)
    cleaned = clean(with_day(with_category(usable)))
    calendar = calendar_columns()
    calendar.pop("is_month_end")
    return cleaned.withColumns(calendar)
