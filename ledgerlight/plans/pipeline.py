"""The batch run: billing rows in, result tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attribution, decisions, evaluation, features, forecast, forest, normalize, reconstruct, rollup, vote, zscore
from ..schemas import ROW_KEY, SERIES_KEYS
from ..session import stage
from ..sources.store import ResultStore

MIN_ROWS = 30


def prepare(raw: DataFrame, closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Daily rollup and complete features, each written once.

    Everything after the rollup works on one row per series and day; the
    billing rows are read a single time.
    """
    daily = stage(rollup.daily_rollup(normalize.normalize(raw)), "daily")
    return daily, complete_features(daily, closed)


def complete_features(daily: DataFrame, closed: bool = False) -> DataFrame:
    rows = stage(features.engineer_features(daily, closed=closed), "features")
    return features.min_history(rows, MIN_ROWS, closed=closed)


def judge(rows: DataFrame, closed: bool = False, sequence: str = "series", contamination: float = 0.05) -> DataFrame:
    """Three detectors on the same rows, then the vote; no joins between them.

    ``sequence="service"`` runs the z-score and window detectors over each
    service's single sequence, as the reference does.
    """
    if sequence not in ("series", "service"):
        raise ValueError(f"unknown sequence {sequence!r}")
    by_service = sequence == "service"
    scored = zscore.zscore_detector_by_service(rows, closed=closed) if by_service else zscore.zscore_detector(rows)
    return judge_scored(scored, closed, by_service, contamination)


def judge_scored(scored: DataFrame, closed: bool = False, by_service: bool = False, contamination: float = 0.05) -> DataFrame:
    """The detectors after the z-score, then the vote."""
    scored = forest.isolation_forest(scored, contamination=contamination, closed=closed)
    scored = reconstruct.window_reconstruction(scored, closed=closed, by_service=by_service)
    return vote.vote(scored)


def decide(voted: DataFrame, policy=decisions.BATCH_POLICY, closed: bool = False, top: int | None = None) -> DataFrame:
    """Impact, priority and texts under the anomaly log's column names.

    All flagged rows get their texts; ``top`` leaves them to so many of each service.
    """
    rows = decisions.priority(decisions.impact(voted), policy)
    if top is None:
        rich = decisions.enrich(rows, F.col("final_anomaly") == 1)
    else:
        rich = decisions.enrich_top_impact(stage(rows, "decided"), top, closed=closed)
    return rich.withColumns({"cost_usd": F.col("total_cost"), "is_anomaly": F.col("final_anomaly")})


def detect(raw: DataFrame, closed: bool = False, sequence: str = "series", policy=decisions.BATCH_POLICY) -> DataFrame:
    _, rows = prepare(raw, closed)
    return decide(judge(rows, closed, sequence), policy, closed)


def forecast_contract(rows: DataFrame, horizon: int = forecast.HORIZON) -> DataFrame:
    return rows.select(
        "date", F.lit("MULTI").alias("provider"), "service_category", F.lit("all").alias("team"),
        "forecast_50", "forecast_90", "forecast_10", F.lit(horizon).alias("horizon_days"),
    )


def run_batch(
    raw: DataFrame,
    root: str,
    batch_id: str = "batch",
    budget: float = forecast.MONTHLY_BUDGET,
    closed: bool = False,
    sequence: str = "series",
    policy=decisions.BATCH_POLICY,
    boost_rounds: int = 200,
    explain: bool = True,
    clear: bool = False,
) -> ResultStore:
    """Full run over one billing table; every result table gets this batch.

    Running the same ``batch_id`` again replaces its rows.
    """
    store = ResultStore(raw.sparkSession, root)
    if clear:
        store.clear_all()
    daily, rows = prepare(raw, closed)
    log = stage(decide(judge(rows, closed, sequence), policy, closed), "log")
    rejects = [normalize.rejected(raw), store.insert_anomalies(log, batch_id)]

    split = stage(features.last_rows_split(rows, MIN_ROWS, SERIES_KEYS), "boost")
    held = forecast.boosted_predictions(split, max_iter=boost_rounds)
    quality = evaluation.quality(log, ["service_category"], "zscore_flag", "final_anomaly")
    mape = evaluation.mape_fraction(held, ["service_category"], "total_cost", "predicted")
    rejects.append(store.insert_metrics(evaluation.metric_rows(quality, mape), batch_id))

    totals = stage(rollup.totals(daily), "service-totals")
    ahead = stage(forecast.seasonal_forecast(totals, closed=closed), "forecast")
    rejects.append(store.insert_forecasts(forecast_contract(ahead), batch_id))
    rejects.append(store.insert(forecast.budget_breach(ahead, budget), "budget_breaches", batch_id))
    rejects.append(store.insert(vote.correlated_spikes(daily), "correlated_anomalies", batch_id))

    if explain:
        shap = attribution.explain_services(log)
        causes = decisions.causes_per_anomaly(decisions.rank_causes(shap, ROW_KEY), ROW_KEY)
        rejects.append(store.insert(causes, "anomaly_causes", batch_id))
    store.insert_rejects(rejects, batch_id)
    return store
