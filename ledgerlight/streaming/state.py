"""State of the live run between batches: versioned tables, cut by a hash of the service.

A batch reads the buckets of the services it touches, in their newest version,
and writes a version of its own of these buckets; a manifest names the version
of every bucket. So what a batch reads and writes depends on the services it
touches, not on how many batches there were, and a replayed batch starts from
the versions before it and writes the same again. Versions that neither the
newest manifest nor the one before needs are removed.

Tables, all keyed by service:

* ``days``: exact cost and row count per series and day.
* ``moments``: count, mean and sum of squared deviations per series. Merged they
  give a service's mean and deviation without reading its days.
* ``scored``: features and z-scores of complete rows. Both need a row's own
  series only, so rows of series without new data are taken over as they are.
* ``totals``: exact cost per service and day, which forecasts are fitted on.
* ``verdicts``: the newest verdict per row, which tells what a batch changes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import features, zscore
from ..operators.rollup import DAILY_KEYS
from ..schemas import SERIES_KEYS
from ..session import remove, stage

BUCKETS = 64
TABLES = ("days", "moments", "scored", "totals", "verdicts")
MANIFEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("version", T.StringType()), T.StructField("previous", T.StringType())])
NONE = "none"


class LiveState:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def create(self) -> None:
        """An empty manifest, so that the first batch finds one."""
        empty = self.spark.createDataFrame([], MANIFEST).withColumn("batch_id", F.lit(NONE))
        empty.write.mode("ignore").partitionBy("batch_id").parquet(self.path("manifest"))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("service_category"), F.lit(self.buckets)).cast("int")

    def before(self, name: str) -> dict[int, tuple[str, str | None]]:
        """(version, the one before) of each bucket as the batch ``name`` finds it; at most ``buckets`` rows."""
        stored = T.StructType([*MANIFEST.fields, T.StructField("batch_id", T.StringType())])
        rows = self.spark.read.schema(stored).parquet(self.path("manifest")).where(F.col("batch_id") < name)
        newest = rows.agg(F.max("batch_id")).first()[0]
        return {r.bucket: (r.version, r.previous) for r in rows.where(F.col("batch_id") == newest).collect()} if newest else {}

    def read(self, table: str, schema: T.StructType, versions: dict[int, str]) -> DataFrame:
        """The rows of the given version of each bucket; the folders of all others are pruned."""
        if not versions:
            return self.spark.createDataFrame([], schema)
        stored = T.StructType([*schema.fields, T.StructField("batch_id", T.StringType()), T.StructField("bucket", T.IntegerType())])
        wanted = reduce(lambda a, b: a | b, [(F.col("batch_id") == v) & (F.col("bucket") == b) for b, v in sorted(versions.items())])
        return self.spark.read.schema(stored).parquet(self.path(table)).where(wanted).drop("batch_id", "bucket")

    def current(self, table: str) -> DataFrame:
        """All rows of a table as they are after the last batch."""
        versions = {b: v for b, (v, _) in self.before("~").items()}
        fields = [f for f in self.spark.read.parquet(self.path(table)).schema.fields if f.name not in ("batch_id", "bucket")]
        return self.read(table, T.StructType(fields), versions)

    def write(self, table: str, rows: DataFrame, name: str) -> None:
        placed = rows.withColumn("batch_id", F.lit(name)).withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("batch_id", "bucket").parquet(self.path(table))

    def commit(self, name: str, touched: Sequence[int], known: dict[int, tuple[str, str | None]]) -> None:
        """Name the versions that hold from now on, then remove those that no replay can need."""
        now = known | {b: (name, known[b][0] if b in known else None) for b in touched}
        rows = self.spark.createDataFrame([(b, v, p) for b, (v, p) in now.items()], MANIFEST).withColumn("batch_id", F.lit(name))
        rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(self.path("manifest"))
        old = [(b, known[b][1]) for b in touched if b in known and known[b][1] and known[b][1] < name]
        remove(self.spark, [f"{self.path(t)}/batch_id={v}/bucket={b}" for b, v in old for t in TABLES])


def of_keys(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Rows whose keys are among ``wanted`` (or, with ``left_anti``, are not); missing values are equal."""
    named = wanted.select(*[F.col(k).alias(f"_{k}") for k in keys])
    return rows.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), how)


def as_daily(days: DataFrame) -> DataFrame:
    total, n = F.col("cost").cast("double"), F.col("record_count")
    return days.select(*DAILY_KEYS, total.alias("total_cost"), F.try_divide(total, n.cast("double")).alias("avg_cost"), n)


def series_moments(days: DataFrame) -> DataFrame:
    """count, mean and sum of squared deviations of each series' daily cost."""
    cost = F.col("cost").cast("double")
    return days.groupBy(*SERIES_KEYS).agg(F.count(cost).alias("n"), F.avg(cost).alias("mean"), (F.var_pop(cost) * F.count(cost)).alias("m2"))


def service_moments(moments: DataFrame) -> DataFrame:
    """(service_category, _avg, _std) of all its series together, merged by Chan's rule."""
    whole = moments.groupBy("service_category").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_avg"))
    apart = F.col("n") * F.pow(F.col("mean") - F.col("_avg"), F.lit(2.0))
    return moments.join(whole, "service_category").groupBy("service_category", "_avg").agg(F.sqrt(F.sum(F.col("m2") + apart) / F.sum("n")).alias("_std"))


def with_service_zscore(scored: DataFrame, moments: DataFrame) -> DataFrame:
    """Absolute z-score of each row against its service, from the moments alone; rows without one are incomplete."""
    z = F.abs(F.try_divide(F.col("total_cost") - F.col("_avg"), F.col("_std")))
    return scored.join(service_moments(moments), "service_category").withColumn("zscore", z).where("zscore IS NOT NULL").drop("_avg", "_std")


def advance(state: LiveState, sums: DataFrame, name: str) -> tuple[DataFrame, DataFrame, dict[int, str], DataFrame, dict[int, tuple[str, str | None]]]:
    """Merge a batch's daily sums into the state.

    Returns the touched services' complete rows with features and z-scores,
    their daily totals, the versions the batch found in the buckets it touches,
    the touched services, and all versions known before.
    """
    services = stage(sums.select("service_category").distinct().withColumn("bucket", state.bucket()), "touched-services")
    touched = [r.bucket for r in services.select("bucket").distinct().collect()]
    known = state.before(name)
    found = {b: known[b][0] for b in touched if b in known}
    series = stage(sums.select(*SERIES_KEYS).distinct(), "touched-series")

    old = state.read("days", sums.schema, found)
    merged = of_keys(old, series, SERIES_KEYS).unionByName(sums).groupBy(*DAILY_KEYS)
    merged = stage(merged.agg(F.sum("cost").cast(sums.schema["cost"].dataType).alias("cost"), F.sum("record_count").alias("record_count")), "touched-days")
    state.write("days", of_keys(old, series, SERIES_KEYS, "left_anti").unionByName(merged), name)

    fresh = series_moments(merged)
    moments = stage(of_keys(state.read("moments", fresh.schema, found), series, SERIES_KEYS, "left_anti").unionByName(fresh), "moments")
    state.write("moments", moments, name)

    fresh = zscore.zscore_detector(features.complete_rows(features.series_features(as_daily(merged))))
    scored = of_keys(state.read("scored", fresh.schema, found), series, SERIES_KEYS, "left_anti").unionByName(fresh)
    scored = stage(scored, "scored")
    state.write("scored", scored, name)

    fresh = sums.groupBy("service_category", "date").agg(F.sum("cost").cast(sums.schema["cost"].dataType).alias("cost"))
    totals = state.read("totals", fresh.schema, found).unionByName(fresh).groupBy("service_category", "date")
    totals = stage(totals.agg(F.sum("cost").cast(sums.schema["cost"].dataType).alias("cost")), "service-totals")
    state.write("totals", totals, name)

    rows = with_service_zscore(of_keys(scored, services, ["service_category"]), moments)
    ahead = of_keys(totals, services, ["service_category"]).withColumn("total_cost", F.col("cost").cast("double")).drop("cost")
    return rows, ahead, found, services, known
