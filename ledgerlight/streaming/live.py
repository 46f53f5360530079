"""The same analytics on arriving rows, with Structured Streaming.

Files land in a folder, the checkpoint remembers which were read, event time
and watermarks decide when a day is closed, and every write is keyed by the
batch id so a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import decisions, features, forecast, normalize
from ..operators.rollup import DAILY_KEYS
from ..plans import pipeline
from ..schemas import MALFORMED, SERIES_KEYS
from ..session import stage, stage_path, staging
from ..sources.billing import billing_view, usage_events
from ..sources.store import ResultStore, to_contract
from .state import LiveState, advance, of_keys, with_service_zscore

INTERVAL = "60 seconds"
DEPTH = 30


def arriving_rows(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int | None = None, glob: str | None = None
) -> DataFrame:
    if fmt == "csv" and MALFORMED not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField(MALFORMED, T.StringType())])
    reader = spark.readStream.schema(schema)
    if fmt == "csv":
        # A header that differs from the schema is an error, not a wrong reading; a line that does not fit is kept whole.
        reader = reader.option("header", True).option("enforceSchema", False).option("columnNameOfCorruptRecord", MALFORMED)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(fmt).load(path)


def append_stream(rows: DataFrame, path: str, checkpoint: str, interval: str | None = INTERVAL):
    """Keep adding arriving rows to a Parquet table."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def without_repeats(rows: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Drop rows whose key was already seen inside the watermark."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def daily_totals(rows: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("service_category",), delay: str | None = None) -> DataFrame:
    """Tumbling daily totals; with ``delay`` it also sets the watermark."""
    if delay:
        rows = rows.withWatermark(ts, delay)
    return (
        rows.groupBy(F.window(ts, "1 day").alias("_w"), *keys)
        .agg(F.count(F.lit(1)).alias("record_count"), F.sum("cost_usd").cast("double").alias("total_cost"))
        .select(F.col("_w.start").cast("date").alias("date"), *keys, "record_count", "total_cost")
    )


def rolling_totals(rows: DataFrame, days: int = 7, ts: str = "ts", keys: tuple[str, ...] = ("service_category",)) -> DataFrame:
    """Totals over the last ``days`` days, one per day, by event time."""
    return (
        rows.groupBy(F.window(ts, f"{days} days", "1 day").alias("_w"), *keys)
        .agg(F.sum("cost_usd").cast("double").alias("rolling_total"))
        .select((F.col("_w.end").cast("date") - F.expr("INTERVAL 1 DAY")).cast("date").alias("date"), *keys, "rolling_total")
    )


# --- lag and rolling features with per-series state --------------------------------

FEATURE_COLUMNS = (
    "cost_lag_1", "cost_lag_7", "cost_lag_30", "rolling_mean_7", "rolling_std_7", "rolling_mean_30", "rolling_std_30",
    "cost_change_1d", "cost_change_7d", "deviation_from_mean",
)
_STATE = T.StructType([T.StructField("last", T.DateType()), T.StructField("costs", T.ArrayType(T.DoubleType()))])


def _features_of(costs: list[float]) -> list[float | None]:
    """Features of the newest value; ``costs`` is oldest first."""
    now = costs[-1]
    lag = {k: costs[-1 - k] if len(costs) > k else None for k in (1, 7, 30)}
    week, month = np.array(costs[-7:]), np.array(costs[-30:])
    std = lambda v: float(v.std(ddof=1)) if len(v) > 1 else None
    change = {k: now / lag[k] - 1 if lag[k] else None for k in (1, 7)}
    sd7 = std(week)
    gap = (now - week.mean()) / (sd7 + 1e-9) if sd7 is not None else None
    return [lag[1], lag[7], lag[30], float(week.mean()), sd7, float(month.mean()), std(month), change[1], change[7], gap]


def streaming_features(days: DataFrame, keys: tuple[str, ...] = SERIES_KEYS, idle: str | None = None) -> DataFrame:
    """Features of arriving daily rows from the last 30 values of their series.

    ``days`` is a stream of closed days (``keys``, ``date``, ``total_cost``). A
    day at or before the newest one of its series is passed on with
    ``is_late`` 1 and no features, so no row is lost. A series' state is at most
    30 numbers; with ``idle`` the state of a series silent for that long is
    dropped. That timer keeps an ``availableNow`` query from ever stopping, so
    set it on continuously running queries only.
    """
    kinds = {f.name: f.dataType for f in days.schema.fields}
    schema = T.StructType(
        [T.StructField(k, kinds[k]) for k in keys]
        + [T.StructField("date", T.DateType()), T.StructField("total_cost", T.DoubleType())]
        + [T.StructField(c, T.DoubleType()) for c in FEATURE_COLUMNS]
        + [T.StructField("is_late", T.IntegerType())]
    )
    columns = [f.name for f in schema.fields]
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, costs = state.get if state.exists else (None, [])
        costs = list(costs)
        out = []
        rows = pd.concat(list(batches)).sort_values("date")
        for day, cost in zip(rows["date"], rows["total_cost"]):
            if last is not None and day <= last:
                out.append([*key, day, cost, *[None] * len(FEATURE_COLUMNS), 1])
                continue
            costs.append(float(cost))
            out.append([*key, day, cost, *_features_of(costs), 0])
            last, costs = day, costs[-DEPTH:]
        state.update((last, costs))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        frame = pd.DataFrame(out, columns=columns)
        yield frame.astype({c: float for c in (*FEATURE_COLUMNS, "total_cost")})

    return (
        days.select(*keys, "date", F.col("total_cost").cast("double").alias("total_cost"))
        .groupBy(*keys)
        .applyInPandasWithState(advance, schema, _STATE, "append", timeout)
    )


# --- the live run --------------------------------------------------------------------


def live_batch(spark: SparkSession, bronze: str, root: str, closed: bool = False):
    """The ``foreachBatch`` step of the live run.

    A batch's rows go to the bronze table under the batch id; their daily sums
    are merged into the run's state (``streaming.state``). The services the
    batch touches are judged again: series with new rows get new features and
    z-scores, the others keep theirs, and the detectors that look at a whole
    service run over its rows in the state. Deviations and cut-offs are over
    the whole history, so a batch can change the verdict of any day of these
    services: every verdict that differs from the newest one is stored, flagged
    or not, and the table ends equal to a batch run over all rows. What is
    turned away goes to ``rejects``, counts of each batch to ``live_batches``.
    Everything is keyed by the batch id, so a replay replaces it.
    """
    store, state = ResultStore(spark, root), LiveState(spark, f"{bronze}-state")
    state.create()

    def step(batch: DataFrame, batch_id: int) -> None:
        with staging(spark):
            run(batch, f"{batch_id:012d}")

    def run(batch: DataFrame, name: str) -> None:
        raw = stage(batch, "arrived")
        rows = normalize.normalize(raw)
        by_batch(rows, name).parquet(bronze)
        sums = stage(rows.groupBy(*DAILY_KEYS).agg(F.sum("cost_usd").alias("cost"), F.count("cost_usd").alias("record_count")), "sums")
        turned_away, stored = [normalize.rejected(raw)], 0
        if not sums.isEmpty():
            refused, stored = judged_again(sums, name)
            turned_away += refused
        store.insert_rejects(turned_away, name)
        counts = raw.agg(F.count(F.lit(1)).alias("arrived"), F.count_if(normalize.reject_reason(raw).isNull()).alias("kept"))
        counts = counts.withColumn("rejected", F.col("arrived") - F.col("kept")).withColumn("verdicts", F.lit(stored).cast("long"))
        store.insert(counts, "live_batches", name)

    def judged_again(sums: DataFrame, name: str) -> tuple[list[DataFrame], int]:
        rows, totals, found, services, known = advance(state, sums, name)
        rows = features.min_history(rows, pipeline.MIN_ROWS, closed=closed)
        verdicts = pipeline.decide(pipeline.judge_scored(rows, closed), decisions.LIVE_POLICY, closed)
        fresh = stage(to_contract(verdicts, "anomaly_logs"), "verdicts")
        old = state.read("verdicts", fresh.schema, found)
        values = [F.col(f.name) for f in fresh.schema.fields if f.name not in ("id", "created_at")]
        stored = old.select(F.col("id").alias("_id"), F.struct(*values).alias("_stored"))
        changed = fresh.withColumn("_row", F.struct(*values)).join(stored, F.expr("id = _id AND _row <=> _stored"), "left_anti").drop("_row")
        changed = stage(changed, "changed")
        state.write("verdicts", of_keys(old, services, ["service_category"], "left_anti").unionByName(fresh), name)
        refused = [store.insert_anomalies(changed, name)]
        ahead = stage(forecast.seasonal_forecast(totals, closed=closed), "ahead")
        refused.append(store.insert_forecasts(pipeline.forecast_contract(ahead), name))
        state.commit(name, [r.bucket for r in services.select("bucket").distinct().collect()], known)
        return refused, changed.count()

    return step


def by_batch(rows: DataFrame, name: str):
    """Writer of one batch's folder; writing it again replaces it."""
    writer = rows.withColumn("batch_id", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    return writer.partitionBy("batch_id")


def run_live(rows: DataFrame, bronze: str, root: str, checkpoint: str, interval: str | None = INTERVAL):
    """Start the live run; ``interval=None`` works off what is there and stops."""
    step = live_batch(rows.sparkSession, bronze, root)
    writer = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


class ProgressLog(StreamingQueryListener):
    """Batch counters: one record per batch, and failures as they end a query."""

    def __init__(self) -> None:
        self.records: list[tuple] = []
        self.failures = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        # Plain types only: records outlive the query.
        self.records.append((str(p.id), int(p.batchId), int(p.numInputRows), float(p.batchDuration) / 1000.0))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failures += event.exception is not None

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.records, "query_id string, batch_id long, input_rows long, seconds double")


# --- replay of the given event log ------------------------------------------------------

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def newest_per_key(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of each key from an update-mode output table."""
    w = W.partitionBy(*keys).orderBy(F.col("batch_id").desc())
    return updates.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "batch_id")


def replay_daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the event log through the daily window to its end and read the result."""
    out, checkpoint = stage_path(spark, "stream-out"), stage_path(spark, "stream-checkpoint")
    rows = usage_events(arriving_rows(spark, sf_dir, EVENTS, glob="events.parquet"))
    totals = daily_totals(without_repeats(rows, ["event_id"], delay="3 days"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)
        )

    query = (
        totals.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = T.StructType([*totals.schema.fields, T.StructField("batch_id", T.LongType())])
    return newest_per_key(spark.read.schema(schema).parquet(out), ["date", "service_category"])


ARRIVALS = 2


def replay_billing(spark: SparkSession, sf_dir: str, arrivals: int = ARRIVALS) -> DataFrame:
    """The billing view through the live run in several batches; the rows as the run's state has them at the end.

    A row's batch comes from a checksum, so every later batch brings late rows
    for days, series and services that were judged before.
    """
    landing, bronze, root, checkpoint = (stage_path(spark, name) for name in ("landing", "bronze", "live", "live-checkpoint"))
    turn = F.pmod(F.crc32(F.concat_ws("|", "date", "resource_id", "cost_usd")), F.lit(arrivals))
    rows = stage(billing_view(spark, sf_dir).withColumn("turn", turn), "billing")
    ResultStore(spark, root).create_tables()
    for i in range(arrivals):
        rows.where(F.col("turn") == i).drop("turn").write.parquet(f"{landing}/{i}")
        run_live(arriving_rows(spark, f"{landing}/*", rows.drop("turn").schema), bronze, root, checkpoint, interval=None).awaitTermination()
    state = LiveState(spark, f"{bronze}-state")
    scored = with_service_zscore(state.current("scored"), state.current("moments"))
    return features.min_history(scored, pipeline.MIN_ROWS)
