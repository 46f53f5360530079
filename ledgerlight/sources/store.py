"""Result tables as Parquet: contract, idempotent batch writes, fetches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.columns import key_hash
from ..schemas import TABLES, TEXT_LIMITS

# Column whose values become folders, so a filter on it prunes files.
LAYOUT = {
    "anomaly_logs": "service_category",
    "forecast_results": "service_category",
    "model_metrics": None,
    "budget_breaches": None,
    "correlated_anomalies": None,
    "anomaly_causes": "service_category",
    "rejects": None,
    "live_batches": None,
}
# Columns that identify a row of each table.
IDENTITY = {
    "anomaly_logs": ("date", "provider", "service_category", "team", "environment"),
    "forecast_results": ("date", "provider", "service_category", "team"),
    "model_metrics": ("model_name",),
    "budget_breaches": ("service_category",),
    "correlated_anomalies": ("date",),
    "anomaly_causes": ("date", "provider", "service_category", "team", "environment"),
}
METRIC_KEYS = ("model_name", "f1_score", "precision_score", "recall_score", "mape")


def to_contract(df: DataFrame, table: str, created_at: str | None = None) -> DataFrame:
    """Project onto a table's schema: casts, NaN to NULL, id and timestamp."""
    schema = TABLES[table]
    have = set(df.columns)
    out = []
    for field in schema.fields:
        if field.name == "id":
            identity = [c for c in IDENTITY[table] if c in have]
            col = key_hash(*identity) if "id" not in have else F.col("id")
        elif field.name == "created_at" and "created_at" not in have:
            col = F.lit(created_at).cast("timestamp") if created_at else F.current_timestamp()
        elif field.name not in have:
            raise ValueError(f"{table} needs the column {field.name}")
        else:
            col = F.col(field.name)
            if isinstance(field.dataType, T.DoubleType):
                col = F.nanvl(col.cast("double"), F.lit(None).cast("double"))
        out.append(col.cast(field.dataType).alias(field.name))
    return df.select(*out)


def contract_reasons(schema: T.StructType, limits: dict[str, int] = TEXT_LIMITS):
    """Array of the rules a row breaks; empty when it breaks none."""
    rules = []
    for field in schema.fields:
        if not field.nullable:
            rules.append(F.when(F.col(field.name).isNull(), F.lit(f"{field.name} is missing")))
        if field.name in limits:
            too_long = F.length(field.name) > limits[field.name]
            rules.append(F.when(too_long, F.lit(f"{field.name} is too long")))
    return F.array_compact(F.array(*rules))


def validate_contract(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Split rows into valid ones and rejected ones with their reasons."""
    judged = df.withColumn("reasons", contract_reasons(schema))
    valid = judged.where(F.size("reasons") == 0).drop("reasons")
    return valid, judged.where(F.size("reasons") > 0)


class ResultStore:
    """The result tables under one folder.

    A batch overwrites only its own ``batch_id`` folder, so a task or batch
    that runs twice leaves one copy of its rows.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def create_tables(self) -> None:
        """Write every table empty, so readers find a schema before any run."""
        for table, schema in TABLES.items():
            empty = self.spark.createDataFrame([], schema)
            self._write(empty.withColumn("batch_id", F.lit("none")), table, "ignore")

    def _write(self, df: DataFrame, table: str, mode: str) -> None:
        by = LAYOUT[table]
        folders = ["batch_id", *([by] if by else [])]
        # One file per folder, or several where a folder is large.
        df = df.hint("rebalance", *folders)
        if "date" in df.columns:
            df = df.sortWithinPartitions(*folders, "date")
        (
            df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
            .partitionBy(*folders).parquet(self.path(table))
        )

    def insert_rejects(self, parts: Sequence[DataFrame], batch_id: str) -> None:
        """Store what was turned away: input rows as they are, contract failures with their reasons."""
        rows = None
        for part in parts:
            if "reasons" in part.columns:
                part = part.select(F.array_join("reasons", ", ").alias("reason"), F.lit("contract").alias("stage"), F.to_json(F.struct("*")).alias("row"))
            rows = part if rows is None else rows.unionByName(part)
        self.insert(rows, "rejects", batch_id)

    def insert(self, df: DataFrame, table: str, batch_id: str) -> DataFrame:
        """Store one batch; returns the rows the contract rejected."""
        valid, rejected = validate_contract(to_contract(df, table), TABLES[table])
        self._write(valid.withColumn("batch_id", F.lit(batch_id)), table, "overwrite")
        return rejected

    def insert_anomalies(self, df: DataFrame, batch_id: str) -> DataFrame:
        return self.insert(df, "anomaly_logs", batch_id)

    def insert_forecasts(self, df: DataFrame, batch_id: str) -> DataFrame:
        return self.insert(df, "forecast_results", batch_id)

    def insert_metrics(self, df: DataFrame, batch_id: str) -> DataFrame:
        missing = [k for k in METRIC_KEYS if k not in df.columns]
        if missing:
            raise ValueError(f"metric rows need {', '.join(missing)}")
        return self.insert(df, "model_metrics", batch_id)

    def read(self, table: str) -> DataFrame:
        schema = T.StructType([*TABLES[table].fields, T.StructField("batch_id", T.StringType())])
        relaxed = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
        return self.spark.read.schema(relaxed).parquet(self.path(table))

    def read_current(self, table: str, service: str | None = None, provider: str | None = None) -> DataFrame:
        """One row per identity: a day judged by several batches keeps the newest verdict.

        The filters are on parts of the identity, so they may come first and prune folders.
        """
        return self._newest(of(self.read(table), service, provider), table)

    def _newest(self, df: DataFrame, table: str) -> DataFrame:
        identity = ["id"] if "id" in df.columns else list(IDENTITY[table])
        newest = W.partitionBy(*identity).orderBy(F.col("batch_id").desc())
        return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") == 1).drop("_rn")

    def changed(self, df: DataFrame, table: str, batch_id: str) -> DataFrame:
        """The rows of ``df``, in the table's schema, that differ from the newest ones of the batches before.

        Rows the batch itself has stored count as changed, so a replay replaces them.
        """
        rows, stored = to_contract(df, table), self.read(table)
        own = stored.where(F.col("batch_id") == batch_id).select("id")
        newest = self._newest(stored.where(F.col("batch_id") < batch_id), table).join(own, "id", "left_anti")
        values = [f.name for f in TABLES[table].fields if f.name not in ("id", "created_at")]
        known = newest.select(F.col("id").alias("_id"), F.struct(*values).alias("_stored"))
        return rows.withColumn("_row", F.struct(*values)).join(known, F.expr("id = _id AND _row <=> _stored"), "left_anti").drop("_row")

    def clear_all(self) -> None:
        """Drop all result rows before a new analysis; the tables stay readable."""
        for table, schema in TABLES.items():
            empty = self.spark.createDataFrame([], schema).withColumn("batch_id", F.lit("none"))
            by = LAYOUT[table]
            folders = ["batch_id", *([by] if by else [])]
            empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*folders).parquet(self.path(table))

    def fetch_anomalies(self, service: str | None = None, provider: str | None = None, limit: int = 1000) -> DataFrame:
        return fetch(self.read_current("anomaly_logs", service, provider), limit=limit)

    def fetch_forecasts(self, service: str | None = None, provider: str | None = None, limit: int = 1000) -> DataFrame:
        return fetch(self.read("forecast_results"), service, provider, limit)

    def fetch_latest_metrics(self, model_name: str | None = None) -> DataFrame:
        return latest_metrics(self.read("model_metrics"), model_name)


def of(df: DataFrame, service: str | None, provider: str | None) -> DataFrame:
    if service:
        df = df.where(F.col("service_category") == service)
    if provider:
        df = df.where(F.col("provider") == provider)
    return df


def fetch(
    df: DataFrame,
    service: str | None = None,
    provider: str | None = None,
    limit: int = 1000,
    ties: Sequence[str] = ("provider", "service_category", "team", "id"),
) -> DataFrame:
    """Newest rows first; filters only where an argument is given."""
    return of(df, service, provider).orderBy(F.col("date").desc(), *[c for c in ties if c in df.columns]).limit(limit)


def latest_metrics(df: DataFrame, model_name: str | None = None, tie: str = "id") -> DataFrame:
    """Newest row of every model, or of the named one.

    ``row_number() = 1`` is cut to one row per model on the map side.
    """
    if model_name:
        df = df.where(F.col("model_name") == model_name)
    newest = W.partitionBy("model_name").orderBy(F.col("created_at").desc(), F.col(tie))
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") == 1).drop("_rn")


def write_parameters(df: DataFrame, path: str, key: str = "segment_id") -> None:
    """One JSON document per segment, in a folder per segment."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def read_parameters(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_segment_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
