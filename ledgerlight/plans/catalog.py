"""The registered queries: one entry per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.columns import parse_date
from ..operators import (
    attribution, autoencoder, decisions, evaluation, features, forecast, forest, gesd, kernel, normalize, one_class, reconstruct,
    reports, rollup, scenario, segments, tuning, vote, zscore,
)
from ..schemas import MALFORMED
from ..session import stage, stage_path
from ..sources import billing, store
from ..streaming import live
from . import frames, pipeline, tuned
from .frames import CLOSED, KEY, SERIES, present, rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


LOG_NUMBERS = ["cost_usd", "severity_score", "impact_score"]
LOG_REST = ["is_anomaly", "severity_label", "model_votes", "priority"]


def _log(df: DataFrame, *extra: str) -> DataFrame:
    return present(df, KEY, LOG_NUMBERS, [*LOG_REST, *extra])


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- sources and sinks ---------------------------------------------------------


@register
def scan_billing(spark, sf_dir):
    """Export the billing rows as CSV with headers and scan them back by schema."""
    path = stage_path(spark, "billing-csv")
    rows = billing.billing_view(spark, sf_dir).withColumnRenamed("service_name", "service")
    billing.append_batch(rows.withColumn("is_anomaly", F.lit(0)), path, "csv")
    back = billing.read_billing(spark, path)
    return normalize.with_day(back).drop("is_anomaly", MALFORMED)


SNAPSHOT = ["date", "provider", "service_name", "team", "environment", "resource_id", "cost_usd", "usage_quantity", "region"]


def _snapshot_rows(spark, sf_dir):
    return billing.billing_view(spark, sf_dir).withColumn("cost_usd", F.col("cost_usd").cast("double")).select(*SNAPSHOT)


@register
def trailing_snapshot(spark, sf_dir):
    return billing.trailing_snapshot(_snapshot_rows(spark, sf_dir), 50_000, SNAPSHOT)


@register
def sorted_export(spark, sf_dir):
    path = stage_path(spark, "sorted")
    rows = _snapshot_rows(spark, sf_dir)
    billing.sorted_export(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


@register
def anomaly_log_rows(spark, sf_dir):
    rows = frames.log_rows(spark, sf_dir)
    return present(rows, ["provider", "service_category", "team"], LOG_NUMBERS, [
        F.col("date").cast("timestamp_ntz").alias("date"),
        "is_anomaly", "severity_label", "root_cause", "llm_insight", "recommended_action", "estimated_savings",
        "model_votes", "priority",
    ])


def _seasonal(spark, sf_dir):
    return forecast.seasonal_forecast(stage(frames.service_totals(spark, sf_dir), "service-totals"), closed=CLOSED)


BOUNDS = ["forecast_50", "forecast_90", "forecast_10"]
BUDGET = 6_000_000.0


@register
def forecast_rows(spark, sf_dir):
    rows = store.to_contract(pipeline.forecast_contract(_seasonal(spark, sf_dir)), "forecast_results", frames.RUN_TIME)
    return present(rows, ["provider", "service_category", "team"], BOUNDS, [
        F.col("date").cast("timestamp_ntz").alias("date"), "horizon_days",
    ], 2)


def _fitted(spark, sf_dir):
    """In-sample fit of the trend and weekday model, for the error metrics."""
    totals = stage(frames.service_totals(spark, sf_dir), "service-totals")
    by_service = W.partitionBy("service_category")
    dated = totals.withColumn("_t", F.datediff("date", F.min("date").over(by_service)).cast("double"))
    dated = dated.withColumns({
        "_b": F.regr_slope("total_cost", "_t").over(by_service), "_a": F.regr_intercept("total_cost", "_t").over(by_service),
    })
    line = F.col("_a") + F.col("_b") * F.col("_t")
    effect = F.avg(F.col("total_cost") - line).over(W.partitionBy("service_category", F.weekday("date")))
    return dated.withColumn("predicted", line + effect).select("service_category", "date", "total_cost", "predicted")


@register
def metric_rows(spark, sf_dir):
    quality = evaluation.quality(frames.rule_voted(spark, sf_dir), ["service_category"], "zscore_flag", "final_anomaly")
    mape = evaluation.mape_fraction(_fitted(spark, sf_dir), ["service_category"], "total_cost", "predicted")
    rows = evaluation.metric_rows(quality, mape)
    return present(rows, ["model_name"], ["f1_score", "precision_score", "recall_score", "mape"])


@register
def fetch_anomalies(spark, sf_dir):
    ties = ["provider", "service_category", "team", "environment"]
    return _log(store.fetch(frames.log_view(spark, sf_dir), "compute", "AWS", 1000, ties))


@register
def fetch_forecasts(spark, sf_dir):
    rows = store.fetch(pipeline.forecast_contract(_seasonal(spark, sf_dir)), limit=100)
    return present(rows, ["date", "provider", "service_category", "team"], BOUNDS, ["horizon_days"], 2)


@register
def latest_metrics(spark, sf_dir):
    scored = zscore.zscore_detector(frames.complete_features(spark, sf_dir))
    monthly = scored.groupBy(
        F.concat("service_category", F.lit("_zscore")).alias("model_name"), F.trunc("date", "month").alias("created_at")
    ).agg(F.avg("zscore_flag").alias("anomaly_rate"), F.avg("residual_z").alias("mean_z"))
    return present(store.latest_metrics(monthly, tie="model_name"), ["model_name", "created_at"], ["anomaly_rate", "mean_z"])


@register
def overview_counters(spark, sf_dir):
    return reports.overview(frames.log_view(spark, sf_dir))


@register
def rows_with_total(spark, sf_dir):
    flagged = stage(frames.log_view(spark, sf_dir).where(F.col("is_anomaly") == 1), "flagged")
    return _log(reports.rows_with_total(flagged), "total_rows")


@register
def contract_rejects(spark, sf_dir):
    """Daily rows with a missing team or an over-long provider, and why they fail."""
    rows = frames.daily(spark, sf_dir).select(
        *KEY,
        F.when(F.col("record_count") % 5 != 0, F.col("team")).alias("_team"),
        F.concat_ws("-", "provider", "service_category", F.lit("account")).alias("_provider"),
    )
    schema = T.StructType([T.StructField("team", T.StringType(), False), T.StructField("provider", T.StringType(), False)])
    judged = rows.select(*[F.col(c).alias(f"k_{c}") for c in KEY], F.col("_team").alias("team"), F.col("_provider").alias("provider"))
    _, rejected = store.validate_contract(judged, schema)
    has = lambda text: F.when(F.array_contains("reasons", text), F.lit(text))
    return rejected.select(
        *[F.col(f"k_{c}").alias(c) for c in KEY],
        has("team is missing").alias("missing"), has("provider is too long").alias("too_long"),
    )


def _judged(spark, sf_dir):
    return tuned.judge(frames.rule_scores(spark, sf_dir), FIXED_WEIGHTS)


FIXED_WEIGHTS = {"z_score": 0.4, "if_score": 0.2, "svm_score": 0.2, "lstm_score": 0.2}


@register
def tuned_params_json(spark, sf_dir):
    """Write one JSON document per segment and read them back by schema."""
    judged, best = _judged(spark, sf_dir)
    docs = best.join(tuning.severity_quantiles(judged), "segment_id").select(
        "segment_id", F.struct("threshold", F.struct("q50", "q80").alias("severity_quantiles")).alias("ensemble")
    )
    path = stage_path(spark, "parameters")
    store.write_parameters(docs, path)
    back = store.read_parameters(spark, path, docs.schema)
    return back.select("segment_id", *[
        rounded(F.col(c)).alias(n) for n, c in (
            ("threshold", "ensemble.threshold"), ("q50", "ensemble.severity_quantiles.q50"), ("q80", "ensemble.severity_quantiles.q80"),
        )
    ])


SEGMENT_METRICS = ["f1_score", "precision_score", "recall_score", "roc_auc", "false_positive_rate"]


@register
def segment_metrics(spark, sf_dir):
    """Write the segment metrics as CSV and read them back by schema."""
    judged, _ = _judged(spark, sf_dir)
    rows = tuned.segment_quality(judged)
    path = stage_path(spark, "segment-metrics")
    store.write_segment_metrics(rows.select("segment_id", *SEGMENT_METRICS), path)
    schema = T.StructType([T.StructField("segment_id", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in SEGMENT_METRICS])
    return present(spark.read.schema(schema).option("header", True).csv(path), ["segment_id"], SEGMENT_METRICS)


# --- projections and cleaning ----------------------------------------------------


@register
def service_taxonomy(spark, sf_dir):
    rows = normalize.with_category(billing.billing_view(spark, sf_dir))
    return rows.groupBy("service_name", "service_category").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("cost_usd").cast("double").alias("total_cost")
    )


@register
def service_fallback(spark, sf_dir):
    """Category counts when the export names its service column differently or not at all."""
    rows = stage(billing.billing_view(spark, sf_dir).select("service_name").withColumn(
        "cat", normalize.category_of(F.col("service_name"))), "services")
    variants = {
        "service_name": rows.select("service_name"),
        "service": rows.select(F.col("service_name").alias("service")),
        "service_category": rows.select(F.col("cat").alias("service_category")),
        "none": rows.select(F.lit(1).alias("x")),
    }
    out = None
    for name, df in variants.items():
        part = normalize.with_category(df).groupBy("service_category").agg(F.count(F.lit(1)).alias("row_count"))
        part = part.select(F.lit(name).alias("source"), "service_category", "row_count")
        out = part if out is None else out.unionByName(part)
    return out


@register
def mixed_date_parse(spark, sf_dir):
    """Ship dates written in mixed patterns, some unreadable, parsed back to days."""
    day = F.col("l_shipdate")
    patterns = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MMM-yyyy", "MMM d, yyyy"]
    slot = F.pmod(F.col("l_orderkey"), F.lit(11))
    text = F.date_format(day, patterns[0])
    for i, p in enumerate(patterns[1:], 1):
        text = F.when(slot == i, F.date_format(day, p)).otherwise(text)
    text = F.when(slot == 10, F.lit("not a date")).otherwise(text)
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("date"))
    return rows.select("l_orderkey", "l_linenumber", parse_date("date").alias("parsed"))


@register
def clean_costs(spark, sf_dir):
    """Billing rows with gaps and negative costs put in, then cleaned."""
    slot = F.col("usage_quantity") % 10
    dirty = billing.billing_view(spark, sf_dir).withColumns({
        "cost_usd": F.when(slot == 0, F.lit(None)).when(slot == 1, -F.col("cost_usd")).otherwise(F.col("cost_usd")),
        "team": F.when(slot != 2, F.col("team")),
        "environment": F.when(slot != 3, F.col("environment")),
    })
    return normalize.clean(dirty).select(
        "date", "provider", "resource_id", "usage_quantity", F.col("cost_usd").cast("double").alias("cost_usd"), "team", "environment"
    )


@register
def calendar_features(spark, sf_dir):
    names = ["day_of_week", "day_of_month", "month", "week_of_year", "is_weekend"]
    rows = frames.normalized(spark, sf_dir).groupBy("date", *names).agg(F.count(F.lit(1)).alias("row_count"))
    return features.with_calendar(rows.withColumn("_dom", F.col("day_of_month"))).select(
        "date", "day_of_week", F.col("_dom").alias("day_of_month"), "month", "week_of_year", "is_weekend", "is_month_end", "row_count"
    )


@register
def feature_complete_rows(spark, sf_dir):
    rows = frames.complete_features(spark, sf_dir)
    return present(rows, KEY, ["total_cost", "avg_cost", *features.ENGINEERED], [
        "record_count", "day_of_week", "month", "week_of_year", "is_weekend", "is_month_end",
    ])


@register
def downcast_billing(spark, sf_dir):
    rows = billing.downcast(billing.billing_view(spark, sf_dir))
    return rows.select(
        "resource_id", "date", F.round(F.col("cost_usd").cast("double"), 2).alias("cost_usd"),
        F.col("usage_quantity").cast("double").alias("usage_quantity"),
    )


@register
def dow_heatmap(spark, sf_dir):
    rows = rollup.weekday_matrix(frames.normalized(spark, sf_dir))
    return present(rows, ["service_category"], [c for c in rows.columns if c != "service_category"])


@register
def segment_daily(spark, sf_dir):
    return present(frames.segment_rows(spark, sf_dir), ["segment_id", "date"], ["cost_usd"], ["is_anomaly"])


@register
def cap_outliers(spark, sf_dir):
    return present(segments.cap_outliers(frames.segment_rows(spark, sf_dir)), ["segment_id", "date"], ["cost_usd", "cost_capped"])


# --- filters ----------------------------------------------------------------------


@register
def min_history_gate(spark, sf_dir):
    rows = frames.staged_features(spark, sf_dir)
    return present(features.min_history(rows, 450, ["provider", "service_category", "team"]), KEY, ["total_cost"])


@register
def slice_filter(spark, sf_dir):
    rows = reports.slice_rows(frames.log_view(spark, sf_dir), ["AWS", "GCP"], "1996-01-01", "1999-12-31", "storage", True)
    return _log(rows)


@register
def kpi_strip(spark, sf_dir):
    out = reports.kpi_strip(frames.log_view(spark, sf_dir))
    return out.withColumn("total_impact", rounded("total_impact", 2))


@register
def sample_cap(spark, sf_dir):
    """Rows left per segment after the hash-ordered sampling cap."""
    rows = frames.normalized(spark, sf_dir)
    key = ["date", "provider", "environment", "resource_id", "cost_usd", "usage_quantity"]
    kept = segments.sample_cap(rows, 500, ["service_category", "team"], key)
    return kept.groupBy("service_category", "team").agg(F.count(F.lit(1)).alias("row_count"))


# --- joins --------------------------------------------------------------------------


@register
def provider_allocation(spark, sf_dir):
    out = reports.provider_allocation(frames.log_view(spark, sf_dir))
    return present(out, ["provider"], ["total_cost", "avg_daily"], ["anomaly_count"], 2)


@register
def severity_markers(spark, sf_dir):
    out = reports.severity_markers(stage(frames.log_view(spark, sf_dir), "log"))
    return present(out, ["severity_label", "date"], ["total_cost"], digits=2)


@register
def vote_ensemble(spark, sf_dir):
    return frames.rule_voted(spark, sf_dir).select(
        *KEY, *frames.RULE_FLAGS, "vote_count", "final_anomaly", "severity_score", "severity_label"
    )


@register
def service_costs(spark, sf_dir):
    out = reports.service_costs(frames.log_view(spark, sf_dir))
    return present(out, ["service_category"], ["total_cost", "anomaly_cost"], digits=2)


@register
def anomaly_semi_features(spark, sf_dir):
    """Candidate anomalies among all rows, kept where the complete features have them."""
    daily = frames.staged_daily(spark, sf_dir)
    everything = stage(features.engineer_features(daily, complete=False, closed=CLOSED), "features")
    candidates = everything.where(F.col("zscore") > 1.5)
    return present(attribution.keep_known(candidates, features.complete_rows(everything)), KEY, ["total_cost", "zscore"])


@register
def root_cause_topk(spark, sf_dir):
    """Top three causes when the contributions are the gaps to five baselines."""
    names = ["cost_lag_1", "cost_lag_7", "rolling_mean_7", "rolling_std_7", "rolling_mean_30"]
    rows = frames.complete_features(spark, sf_dir).where(F.col("zscore") > 2.5)
    gaps = F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), (F.col("total_cost") - F.col(n)).alias("shap_value")) for n in names
    ])).alias("_g")
    contributions = rows.select(*KEY, gaps).select(*KEY, "_g.*")
    ranked = decisions.rank_causes(contributions, KEY)
    return present(ranked, KEY, ["shap_value", "abs_impact"], ["root_cause", "cause_rank"])


# --- aggregations -------------------------------------------------------------------


@register
def daily_rollup(spark, sf_dir):
    return present(frames.daily(spark, sf_dir), KEY, ["total_cost", "avg_cost"], ["record_count"])


@register
def service_series(spark, sf_dir):
    return present(frames.service_totals(spark, sf_dir), ["service_category", "date"], ["total_cost"])


@register
def daily_spend(spark, sf_dir):
    return present(reports.daily_spend(frames.normalized(spark, sf_dir)), ["date"], ["total_cost"])


@register
def severity_share(spark, sf_dir):
    return present(reports.severity_share(frames.log_view(spark, sf_dir)), ["severity_label"], ["share"], ["row_count"])


@register
def vote_distribution(spark, sf_dir):
    return reports.vote_distribution(frames.log_view(spark, sf_dir))


@register
def service_pivot(spark, sf_dir):
    rows = rollup.service_matrix(frames.normalized(spark, sf_dir), normalize.CATEGORIES)
    return present(rows, ["date"], list(normalize.CATEGORIES))


@register
def vote_agreement(spark, sf_dir):
    return reports.vote_agreement(frames.log_view(spark, sf_dir))


@register
def filter_domains(spark, sf_dir):
    log = stage(frames.log_view(spark, sf_dir).select("provider", "service_category", "date"), "log-keys")
    bounds = reports.date_bounds(log)
    ends = bounds.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("filter"), F.col(c).cast("string").alias("value")) for c in bounds.columns
    ])).alias("_p")).select("_p.*")
    return reports.filter_domains(log).unionByName(ends)


@register
def severity_quantiles(spark, sf_dir):
    judged, _ = _judged(spark, sf_dir)
    return present(tuning.severity_quantiles(judged), ["segment_id"], ["q50", "q80"])


# --- window features ------------------------------------------------------------------


@register
def lag_features(spark, sf_dir):
    rows = features.with_lags(frames.daily(spark, sf_dir), features.series_window())
    return present(rows, KEY, ["total_cost", "cost_lag_1", "cost_lag_7", "cost_lag_30"])


@register
def rolling_features(spark, sf_dir):
    rows = features.with_rolling(frames.daily(spark, sf_dir), features.series_window())
    return present(rows, KEY, ["rolling_mean_7", "rolling_std_7", "rolling_mean_30", "rolling_std_30"])


@register
def pct_change(spark, sf_dir):
    rows = features.with_change(frames.daily(spark, sf_dir), features.series_window())
    return present(rows, KEY, ["cost_change_1d", "cost_change_7d"])


@register
def global_zscore(spark, sf_dir):
    return present(features.with_global_zscore(frames.staged_daily(spark, sf_dir), closed=CLOSED), KEY, ["zscore"])


@register
def rolling_deviation(spark, sf_dir):
    rows = features.with_rolling(frames.daily(spark, sf_dir), features.series_window(), rows=(7,))
    return present(features.with_deviation(rows), KEY, ["deviation_from_mean"])


SEGMENT_KEY = ["segment_id", "date"]


@register
def segment_rolling(spark, sf_dir):
    rows = segments.segment_features(frames.segment_rows(spark, sf_dir), ema=False)
    names = [c for c in segments.SEGMENT_FEATURES if not c.startswith("ema") and c != "zscore_base"]
    return present(rows, SEGMENT_KEY, names)


@register
def ema_features(spark, sf_dir):
    rows = segments.with_ema(segments.cap_outliers(frames.segment_rows(spark, sf_dir)))
    return present(rows, SEGMENT_KEY, ["ema_7", "ema_14"])


@register
def segment_zscore(spark, sf_dir):
    return present(segments.segment_features(frames.segment_rows(spark, sf_dir), ema=False), SEGMENT_KEY, ["zscore_base"])


@register
def sliding_windows(spark, sf_dir):
    rows = features.sliding_windows(frames.daily(spark, sf_dir), features.series_window(), ["total_cost"], 7)
    full = rows.where(F.col("window").isNotNull())
    return full.select(*KEY, *[rounded(F.col("window")[i]).alias(f"w{i}") for i in range(7)])


@register
def time_split(spark, sf_dir):
    rows = features.time_split(frames.complete_features(spark, sf_dir), 0.8, SERIES)
    rows = rows.withColumnRenamed("is_train", "_tr")
    rows = features.last_rows_split(rows, 30, SERIES)
    return rows.groupBy(*SERIES).agg(
        F.count_if(F.col("_tr") == 1).alias("train_rows"),
        F.count_if(F.col("_tr") == 0).alias("held_rows"),
        F.max(F.when(F.col("_tr") == 1, F.col("date"))).alias("last_train_day"),
        F.count_if(F.col("is_train") == 1).alias("rows_before_last_30"),
    )


@register
def seasonal_residual(spark, sf_dir):
    rows = zscore.seasonal_residual(frames.complete_features(spark, sf_dir))
    return present(rows, KEY, ["trend", "seasonal", "residual"])


# --- detection --------------------------------------------------------------------------


@register
def zscore_detector(spark, sf_dir):
    rows = zscore.zscore_detector(frames.complete_features(spark, sf_dir))
    return present(rows, KEY, ["residual_z"], ["zscore_flag", "zscore_severity"])


@register
def zscore_detector_service(spark, sf_dir):
    rows = zscore.zscore_detector_by_service(frames.staged_features(spark, sf_dir), closed=CLOSED)
    return present(rows, KEY, ["residual", "residual_z"], ["zscore_flag", "zscore_severity"])


@register
def gesd_outliers(spark, sf_dir):
    rows = gesd.gesd_outliers(frames.staged_daily(spark, sf_dir))
    return present(rows, KEY, ["total_cost"], ["removal_rank"])


@register
def isolation_forest(spark, sf_dir):
    rows = forest.isolation_forest(frames.staged_features(spark, sf_dir), closed=CLOSED)
    return present(rows, KEY, ["total_cost", "if_score"], ["if_flag"])


@register
def window_reconstruction(spark, sf_dir):
    rows = reconstruct.window_reconstruction(frames.staged_features(spark, sf_dir), closed=CLOSED)
    return present(rows, KEY, ["total_cost", "lstm_error"], ["lstm_flag"])


@register
def correlated_spikes(spark, sf_dir):
    return vote.correlated_spikes(frames.staged_daily(spark, sf_dir))


@register
def correlated_states(spark, sf_dir):
    rows = frames.staged_daily(spark, sf_dir)
    return vote.correlated_states(vote.correlated_spikes(rows), rows)


@register
def standardize(spark, sf_dir):
    names = ["cost_lag_1", "rolling_mean_7", "deviation_from_mean"]
    rows = reconstruct.standardize(frames.staged_features(spark, sf_dir), names, ["service_category"], CLOSED)
    return present(rows, KEY, [f"{c}_scaled" for c in names])


@register
def kernel_one_class(spark, sf_dir):
    rows = kernel.kernel_one_class(stage(frames.split_segments(spark, sf_dir), "segment-features"))
    return present(rows, SEGMENT_KEY, ["svm_score"], ["is_train", "is_anomaly"])


@register
def one_class_machine(spark, sf_dir):
    """Nu hinge machines of all segments, solved together on their training rows."""
    rows = one_class.one_class_machine(stage(frames.split_segments(spark, sf_dir), "segment-features"))
    return present(rows, SEGMENT_KEY, ["svm_score"], ["is_train", "is_anomaly", "svm_flag"])


@register
def window_reconstruction_multi(spark, sf_dir):
    rows = reconstruct.window_reconstruction_multi(stage(frames.split_segments(spark, sf_dir, ema=False), "segment-features"))
    return present(rows, SEGMENT_KEY, ["lstm_score"], ["is_train", "is_anomaly"])


@register
def sequence_autoencoder(spark, sf_dir):
    """Recurrent autoencoders over weekly windows, all services trained together."""
    rows = autoencoder.sequence_autoencoder(frames.staged_features(spark, sf_dir), closed=CLOSED)
    return present(rows, KEY, ["total_cost", "lstm_error"], ["lstm_flag"])


@register
def isolation_forest_split(spark, sf_dir):
    """Forest scores of segment rows, fitted on the training part only."""
    rows = stage(frames.split_segments(spark, sf_dir), "segment-features")
    out = forest.isolation_forest(
        rows, "segment_id", segments.SEGMENT_FEATURES, SEGMENT_KEY, fit_rows=F.col("is_train") == 1
    )
    return present(out, SEGMENT_KEY, ["if_score"], ["is_train", "if_flag"])


SCALED = [f"{c}_n" for c in tuning.SCORES]


def _minmax(spark, sf_dir):
    return tuning.minmax_scores(stage(frames.rule_scores(spark, sf_dir), "scores"))


@register
def minmax_scores(spark, sf_dir):
    return present(_minmax(spark, sf_dir), SEGMENT_KEY, SCALED, ["is_train"])


@register
def weighted_ensemble(spark, sf_dir):
    return present(tuning.weighted_ensemble(_minmax(spark, sf_dir), FIXED_WEIGHTS), SEGMENT_KEY, ["fused_score"], ["is_train"])


SWEEP = ["tp", "fp", "fn"]


@register
def threshold_sweep(spark, sf_dir):
    held = tuning.weighted_ensemble(_minmax(spark, sf_dir), FIXED_WEIGHTS).where(F.col("is_train") == 0)
    out = tuning.threshold_sweep(held, ["segment_id"], "is_anomaly", "fused_score", tuning.FINAL_GRID)
    return out.select("segment_id", rounded("threshold", 6).alias("threshold"), *SWEEP, rounded("f1").alias("f1"))


@register
def percentile_sweep(spark, sf_dir):
    held = stage(frames.rule_scores(spark, sf_dir).where(F.col("is_train") == 0), "held-scores")
    out = tuning.threshold_sweep(held, ["segment_id"], "is_anomaly", "z_score", percentiles=tuning.DETECTOR_PERCENTILES)
    return present(out, ["segment_id"], ["threshold", "f1"], SWEEP)


@register
def weight_search(spark, sf_dir):
    out = tuning.weight_search(_minmax(spark, sf_dir).where(F.col("is_train") == 0))
    return present(out, ["segment_id"], ["threshold", "f1", *[f"w_{c}" for c in tuning.SCORES]], ["trial"])


# --- decisions and attribution --------------------------------------------------------------


@register
def rule_enrichment(spark, sf_dir):
    texts = decisions.rule_texts(F.col("total_cost"), F.col("severity_label"), F.col("service_category"), F.col("team"))
    return frames.decided(spark, sf_dir).select(*KEY, *[c.alias(n) for n, c in texts.items()])


@register
def top_impact_enrichment(spark, sf_dir):
    return frames.logged(spark, sf_dir).select(*KEY, "is_anomaly", *decisions.QUIET_TEXTS)


@register
def impact_priority(spark, sf_dir):
    return present(frames.decided(spark, sf_dir), KEY, ["impact_score"], ["priority"])


@register
def impact_priority_live(spark, sf_dir):
    return present(frames.decided(spark, sf_dir, decisions.LIVE_POLICY), KEY, ["impact_score"], ["priority"])


@register
def top_anomalies(spark, sf_dir):
    return _log(decisions.top_anomalies(frames.log_view(spark, sf_dir)))


def _explained(spark, sf_dir):
    return stage(frames.decided(spark, sf_dir), "decided")


@register
def attribution_model(spark, sf_dir):
    """Expected cost of every service's model and how far its anomalies lie from it."""
    rows = attribution.explain_services(_explained(spark, sf_dir), normalize.CATEGORIES)
    per_row = rows.groupBy(*KEY).agg(F.max("base_value").alias("expected_cost"), F.sum("shap_value").alias("explained_gap"))
    return present(per_row, KEY, ["expected_cost", "explained_gap"], digits=2)


@register
def shap_attribution(spark, sf_dir):
    rows = attribution.explain_services(_explained(spark, sf_dir), normalize.CATEGORIES)
    ranked = decisions.rank_causes(rows, KEY)
    return present(ranked, KEY, ["shap_value", "abs_impact"], ["root_cause", "cause_rank"], 2)


# --- forecast and budget ------------------------------------------------------------------------


@register
def seasonal_forecast(spark, sf_dir):
    return present(_seasonal(spark, sf_dir), ["service_category", "date"], BOUNDS, digits=2)


@register
def changepoint_forecast(spark, sf_dir):
    return present(forecast.changepoint_forecast(frames.service_totals(spark, sf_dir)), ["service_category", "date"], BOUNDS, digits=2)


@register
def changepoint_tuning(spark, sf_dir):
    out = forecast.tune_changepoints(frames.service_totals(spark, sf_dir))
    return present(out, ["service_category", "prior_scale"], ["mape"], ["is_best"])


@register
def gbt_forecast(spark, sf_dir):
    """Held-out error of the boosted model per service, last 30 rows of each series held out."""
    rows = features.last_rows_split(frames.complete_features(spark, sf_dir), 30, SERIES)
    held = forecast.boosted_predictions(stage(rows, "boost"))
    out = evaluation.mape_fraction(held, ["service_category"], "total_cost", "predicted")
    return present(out, ["service_category"], ["mape"])


@register
def gbt_tuned(spark, sf_dir):
    """Validation error of each boosting setting per segment, the best one marked."""
    return present(
        tuned.tune_boosting(stage(frames.split_segments(spark, sf_dir), "segment-features")),
        ["segment_id", "setting"], ["mape"], ["is_best"],
    )


@register
def mape_fraction(spark, sf_dir):
    out = evaluation.mape_fraction(_fitted(spark, sf_dir), ["service_category"], "total_cost", "predicted")
    return present(out, ["service_category"], ["mape"])


@register
def mape_positive(spark, sf_dir):
    out = evaluation.mape_positive(_fitted(spark, sf_dir), ["service_category"], "total_cost", "predicted")
    return present(out, ["service_category"], ["mape"])


@register
def budget_breach(spark, sf_dir):
    return forecast.budget_breach(_seasonal(spark, sf_dir), BUDGET)


@register
def horizon_totals(spark, sf_dir):
    out = forecast.horizon_totals(_seasonal(spark, sf_dir), budget=BUDGET)
    return present(out, ["service_category", "horizon_days"], ["projected_total", "upper_total", "lower_total", "remaining_budget"], digits=2)


@register
def trajectory_risk(spark, sf_dir):
    out = forecast.trajectory_risk(_seasonal(spark, sf_dir), BUDGET)
    return present(out, ["service_category"], ["projected_spend"], ["trajectory", "is_breach", "budget_percent"], 2)


@register
def over_budget_days(spark, sf_dir):
    out = forecast.over_budget_days(_seasonal(spark, sf_dir), BUDGET)
    return present(out, ["service_category", "date"], ["forecast_50"], ["daily_budget", "over_budget"], 2)


@register
def spend_timeline(spark, sf_dir):
    totals = stage(frames.service_totals(spark, sf_dir), "service-totals")
    out = forecast.spend_timeline(totals, forecast.seasonal_forecast(totals, closed=CLOSED))
    return present(out, ["service_category", "date", "kind"], ["p50", "p10", "p90"], digits=2)


# --- evaluation -----------------------------------------------------------------------------------

QUALITY = ["precision_score", "recall_score", "f1_score", "false_positive_rate"]


@register
def detector_quality(spark, sf_dir):
    out = evaluation.quality(frames.rule_voted(spark, sf_dir), ["service_category"], "zscore_flag", "final_anomaly")
    return present(out, ["service_category"], QUALITY)


@register
def detector_quality_segments(spark, sf_dir):
    judged, _ = _judged(spark, sf_dir)
    return present(evaluation.quality(judged, ["segment_id"], "is_anomaly", "prediction"), ["segment_id"], QUALITY)


@register
def roc_auc(spark, sf_dir):
    held = tuning.weighted_ensemble(_minmax(spark, sf_dir), FIXED_WEIGHTS).where(F.col("is_train") == 0)
    return present(evaluation.roc_auc(held, ["segment_id"], "is_anomaly", "fused_score"), ["segment_id"], ["roc_auc"])


# --- sets and scenarios -----------------------------------------------------------------------------


@register
def replicate_rows(spark, sf_dir):
    rows = billing.replicate(frames.normalized(spark, sf_dir), 3)
    return rows.groupBy("service_category", "provider").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("cost_usd").cast("double").alias("total_cost")
    )


def _scenario(df: DataFrame) -> DataFrame:
    out = df.groupBy("date", "provider", "service_category").agg(
        F.sum("is_anomaly").cast("long").alias("labelled"), F.sum("cost_usd").alias("total_cost")
    )
    return present(out, ["date", "provider", "service_category"], ["total_cost"], ["labelled"], 2)


@register
def inject_spikes(spark, sf_dir):
    return _scenario(scenario.inject_spikes(frames.normalized(spark, sf_dir), [45, 90, 120, 150]))


@register
def inject_drift(spark, sf_dir):
    return _scenario(scenario.inject_drift(frames.normalized(spark, sf_dir), [(60, 75), (70, 90)]))


@register
def inject_random(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_extendedprice").cast("decimal(18,4)").alias("cost_usd")
    )
    out = scenario.inject_hashed(rows, F.col("l_orderkey"))
    return out.withColumn("cost_usd", F.col("cost_usd").cast("double"))


# --- whole runs ----------------------------------------------------------------------------------------


@register
def pipeline_anomalies(spark, sf_dir):
    """The batch run up to the anomaly log: three detectors, vote, texts, priority."""
    rows = pipeline.detect(billing.billing_view(spark, sf_dir), closed=CLOSED)
    return present(rows, KEY, LOG_NUMBERS, [*LOG_REST, "root_cause", "estimated_savings"])


@register
def tuned_run(spark, sf_dir):
    """The tuned run per segment: four fitted detectors, searched weights, held-out quality."""
    out = tuned.tuned_run(frames.segment_rows(spark, sf_dir))
    return present(out, ["segment_id"], [*SEGMENT_METRICS, "threshold", "q50", "q80"])


@register
def stream_daily_totals(spark, sf_dir):
    """Events read as a stream, counted per day and type by a watermarked window."""
    return present(live.replay_daily_totals(spark, sf_dir), ["date", "service_category"], ["total_cost"], ["record_count"], 2)


@register
def live_replay_anomalies(spark, sf_dir):
    """The billing rows through the live run in two batches, the second full of late rows: the z-score detector's anomalies in its state."""
    rows = live.replay_billing(spark, sf_dir).where("zscore_flag = 1")
    return present(rows, KEY, ["total_cost", "zscore", "residual_z"], ["zscore_severity"])
