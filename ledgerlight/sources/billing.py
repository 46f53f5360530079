"""Billing readers and writers, and the billing view over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import MONEY
from ..schemas import BILLING, BILLING_BULK, BILLING_EXPORT, MALFORMED


def csv_schema(spark: SparkSession, path: str) -> T.StructType:
    """Schema of a CSV export by the names in its header, in any order; columns of no known layout are text."""
    kinds = {f.name: f for layout in (BILLING_BULK, BILLING_EXPORT, BILLING) for f in layout.fields}
    names = spark.read.option("header", True).csv(path).columns
    return T.StructType([*(kinds.get(n, T.StructField(n, T.StringType())) for n in names), T.StructField(MALFORMED, T.StringType())])


def read_billing(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None) -> DataFrame:
    """Billing rows; types come from the known layouts, nothing is inferred from the data.

    CSV columns are taken by name: a file whose header differs from the others'
    is an error, and a line that does not fit is kept whole in ``MALFORMED``.
    """
    if fmt != "csv":
        return spark.read.schema(schema or BILLING).format(fmt).load(path)
    reader = spark.read.schema(schema or csv_schema(spark, path)).option("header", True).option("enforceSchema", False)
    return reader.option("columnNameOfCorruptRecord", MALFORMED).csv(path)


def trailing_snapshot(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Last ``n`` rows of an append log in the given total order.

    Sort plus limit becomes a per-task top-n and a merge, no global sort.
    """
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def append_batch(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add rows to a growing table. Each CSV part carries its own header."""
    writer = df.write.mode("append")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def sorted_by_date(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows ranged by date over the partitions and sorted inside each.

    All columns follow the date in the range key, so one busy day can be split.
    """
    ties = [c for c in df.columns if c != "date"]
    ranged = df.repartitionByRange(partitions, "date", *ties) if partitions else df.repartitionByRange("date", *ties)
    return ranged.sortWithinPartitions("date", *ties)


def sorted_export(df: DataFrame, path: str, fmt: str = "parquet", partitions: int | None = None) -> None:
    writer = sorted_by_date(df, partitions).write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def replicate(df: DataFrame, copies: int) -> DataFrame:
    """Every row ``copies`` times, without re-reading the source per copy."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_copy")


def downcast(df: DataFrame) -> DataFrame:
    """Narrow numeric types for bulk storage."""
    narrow = {"cost_usd": "float", "usage_quantity": "float", "is_anomaly": "byte"}
    return df.withColumns({c: F.col(c).cast(t) for c, t in narrow.items() if c in df.columns})


# --- billing view over the star-schema test tables ---------------------------

# Product name per provider and part type. Types not listed stay
# outside the taxonomy on purpose.
PRODUCT_OF = {
    "STANDARD": ("Amazon EC2", "Virtual Machines", "Compute Engine"),
    "SMALL": ("Amazon S3", "Blob Storage", "Cloud Storage"),
    "LARGE": ("Amazon RDS", "Azure SQL", "Cloud SQL"),
    "ECONOMY": ("Amazon CloudFront", "Azure CDN", "Cloud CDN"),
    "MEDIUM": ("AWS Lambda", "Virtual Machines", "Compute Engine"),
}
UNMAPPED_PRODUCT = "Support"
PROVIDERS = ("AWS", "Azure", "GCP")


def _provider() -> Column:
    slot = F.col("n_regionkey") % F.lit(3)
    return F.when(slot == 0, PROVIDERS[0]).when(slot == 1, PROVIDERS[1]).otherwise(PROVIDERS[2])


def _product() -> Column:
    expr = F.lit(UNMAPPED_PRODUCT)
    for kind, names in PRODUCT_OF.items():
        by_provider = (
            F.when(F.col("provider") == PROVIDERS[0], names[0])
            .when(F.col("provider") == PROVIDERS[1], names[1])
            .otherwise(names[2])
        )
        expr = F.when(F.col("p_type") == kind, by_provider).otherwise(expr)
    return expr


def billing_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order, customer, nation, region and part, as billing rows.

    Line items and orders grow together, so their join is pinned to a shuffle
    (size estimates may otherwise broadcast the line items of a small export);
    AQE splits its skewed keys. The dimensions carry no hints: they are
    broadcast by their file size and shuffle beyond the threshold.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    account = (
        t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        .join(t("nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_mktsegment", "r_name", _provider().alias("provider"))
    )
    order = (
        t("orders").select("o_orderkey", "o_custkey")
        .join(account, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "c_mktsegment", "r_name", "provider")
    )
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    kept = F.lit(1) - F.col("l_discount").cast("decimal(4,2)")
    environment = (
        F.when(F.col("l_returnflag") == "A", "production")
        .when(F.col("l_returnflag") == "N", "staging")
        .otherwise("development")
    )
    return (
        t("lineitem")
        .join(order.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_shipdate").cast("date").alias("date"),
            "provider",
            _product().alias("service_name"),
            F.col("c_mktsegment").alias("team"),
            environment.alias("environment"),
            F.concat_ws("-", F.col("provider"), F.col("p_type"), F.col("l_suppkey").cast("string")).alias("resource_id"),
            (price * kept).cast(MONEY).alias("cost_usd"),
            F.col("l_quantity").alias("usage_quantity"),
            F.when(F.col("p_type").isin("STANDARD", "MEDIUM"), "hours").otherwise("GB").alias("usage_unit"),
            F.col("r_name").alias("region"),
        )
    )


def usage_events(events: DataFrame) -> DataFrame:
    """The event log read as usage rows: one series per event type and user."""
    return events.select(
        F.col("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("service_category"),
        F.col("user_id").cast("string").alias("team"),
        F.col("value").alias("cost_usd"),
    )
