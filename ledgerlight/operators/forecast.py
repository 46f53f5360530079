"""Spend forecasts with bounds, and budget questions on top of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.columns import attach, flag, ladder

HORIZON = 90
Z80 = 1.2815515655446004  # standard normal quantile of the 80 % interval
MONTHLY_BUDGET = 50_000.0
NO_BREACH = "No Breach Predicted"


def future_days(history: DataFrame, key: str = "service_category", horizon: int = HORIZON) -> DataFrame:
    """The ``horizon`` days after each series' last day."""
    last = history.groupBy(key).agg(F.max("date").alias("_last"), F.min("date").alias("_first"))
    ahead = F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon))
    return last.select(key, "_first", F.explode(ahead).alias("date"))


def clip_bounds(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in ("forecast_10", "forecast_50", "forecast_90")})


def seasonal_forecast(
    history: DataFrame, key: str = "service_category", cost: str = "total_cost", horizon: int = HORIZON, closed: bool = False
) -> DataFrame:
    """Linear trend plus weekday effect, with a normal 80 % interval.

    Every series is fitted in the same grouped job. ``history`` may hold one
    row per day or many; it is read a few times.
    """
    span = history.groupBy(key).agg(F.min("date").alias("_first"))
    y = F.col(cost).cast("double")
    dated = attach(history, span, [key], closed).select(
        key, "date", y.alias("_y"), F.datediff("date", "_first").cast("double").alias("_t"), F.weekday("date").alias("_dow")
    )
    line = dated.groupBy(key).agg(F.regr_slope("_y", "_t").alias("_b"), F.regr_intercept("_y", "_t").alias("_a"))
    fitted = F.col("_a") + F.col("_b") * F.col("_t")
    rest = attach(dated, line, [key], closed).select(key, "_dow", (F.col("_y") - fitted).alias("_r"))
    # Mean and scatter per weekday are enough for the effect and the total scatter.
    days = rest.groupBy(key, "_dow").agg(
        F.avg("_r").alias("_effect"), F.var_pop("_r").alias("_v"), F.count(F.lit(1)).alias("_n")
    )
    spread = days.groupBy(key).agg(F.sqrt(F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("_sd"))
    model = attach(days.select(key, "_dow", "_effect"), attach(line, spread, [key], closed), [key], closed)
    ahead = future_days(history, key, horizon).withColumn("_dow", F.weekday("date"))
    ahead = ahead.withColumn("_t", F.datediff("date", "_first").cast("double"))
    centre = fitted + F.coalesce(F.col("_effect"), F.lit(0.0))
    # A weekday never seen has no effect row: take the line from any weekday's row.
    lines = attach(line, spread, [key], closed)
    out = attach(attach(ahead, lines, [key], closed), model.select(key, "_dow", "_effect"), [key, "_dow"], closed)
    return clip_bounds(out.select(
        key, "date",
        (centre - Z80 * F.col("_sd")).alias("forecast_10"),
        centre.alias("forecast_50"),
        (centre + Z80 * F.col("_sd")).alias("forecast_90"),
    ))


# --- trend with changepoints ---------------------------------------------------

CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
FOURIER_ORDER = 3


def _design(t: np.ndarray, dow: np.ndarray, knots: np.ndarray) -> np.ndarray:
    columns = [np.ones_like(t), t, *[np.maximum(t - k, 0.0) for k in knots]]
    for order in range(1, FOURIER_ORDER + 1):
        angle = 2 * np.pi * order * dow / 7.0
        columns += [np.sin(angle), np.cos(angle)]
    return np.column_stack(columns)


def _fit_changepoints(pdf: pd.DataFrame, horizon: int, prior_scale: float) -> pd.DataFrame:
    """Ridge fit of one series: slope changes are shrunk, the rest is free."""
    pdf = pdf.sort_values("date")
    day = pd.to_datetime(pdf["date"])
    start, span = day.iloc[0], max((day.iloc[-1] - day.iloc[0]).days, 1)
    y = pdf["y"].to_numpy(float)
    scale = max(np.abs(y).max(), 1e-9)
    t = (day - start).dt.days.to_numpy(float) / span
    count = min(CHANGEPOINTS, max(len(y) - 2, 0))
    knots = np.linspace(0, CHANGEPOINT_RANGE, count + 1)[1:]
    x = _design(t, day.dt.dayofweek.to_numpy(float), knots)
    penalty = np.full(x.shape[1], 1e-6)
    penalty[2:2 + len(knots)] = 1.0 / prior_scale
    coef = np.linalg.solve(x.T @ x + np.diag(penalty), x.T @ (y / scale))
    sd = float(np.sqrt(np.mean((y / scale - x @ coef) ** 2)))
    ahead = pd.date_range(day.iloc[-1] + pd.Timedelta(days=1), periods=horizon)
    t_new = (ahead - start).days.to_numpy(float) / span
    centre = _design(t_new, ahead.dayofweek.to_numpy(float), knots) @ coef
    bound = np.maximum(np.stack([centre - Z80 * sd, centre, centre + Z80 * sd]) * scale, 0.0)
    return pd.DataFrame({"date": ahead.date, "forecast_10": bound[0], "forecast_50": bound[1], "forecast_90": bound[2]})


def changepoint_forecast(
    daily_totals: DataFrame,
    key: str = "service_category",
    cost: str = "total_cost",
    horizon: int = HORIZON,
    prior_scale: float = 0.05,
) -> DataFrame:
    """Piecewise-linear trend with weekly Fourier terms.

    Takes one row per day and series, so a group is bounded by the calendar.
    """
    kind = dict((f.name, f.dataType) for f in daily_totals.schema.fields)[key]
    schema = T.StructType([T.StructField(key, kind), T.StructField("date", T.DateType())] + [
        T.StructField(c, T.DoubleType()) for c in ("forecast_10", "forecast_50", "forecast_90")
    ])

    def fit(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = _fit_changepoints(pdf, horizon, prior_scale)
        out.insert(0, key, group[0])
        return out

    rows = daily_totals.select(key, "date", F.col(cost).cast("double").alias("y"))
    return rows.groupBy(key).applyInPandas(fit, schema)


def tune_changepoints(
    daily_totals: DataFrame,
    key: str = "service_category",
    cost: str = "total_cost",
    scales: Sequence[float] = (0.01, 0.05, 0.1, 0.5),
    share: float = 0.8,
) -> DataFrame:
    """Validation error of each prior scale per series, the best one marked.

    Trials are rows: (series, scale) groups run side by side in one job.
    """
    kind = dict((f.name, f.dataType) for f in daily_totals.schema.fields)[key]
    schema = T.StructType([
        T.StructField(key, kind), T.StructField("prior_scale", T.DoubleType()), T.StructField("mape", T.DoubleType()),
    ])

    def score(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        cut = int(len(pdf) * share)
        train, held = pdf.iloc[:cut], pdf.iloc[cut:]
        error = 999.0
        if len(train) > 1 and len(held):
            last = pd.to_datetime(train["date"].iloc[-1])
            reach = (pd.to_datetime(held["date"].iloc[-1]) - last).days
            ahead = _fit_changepoints(train, reach, group[1]).set_index("date")["forecast_50"]
            y = held["y"].to_numpy(float)
            p = ahead.loc[held["date"]].to_numpy()
            if (y > 0).any():
                error = float(np.mean(np.abs((y - p)[y > 0] / y[y > 0])) * 100)
        return pd.DataFrame({key: [group[0]], "prior_scale": [group[1]], "mape": [error]})

    trials = daily_totals.select(
        key, "date", F.col(cost).cast("double").alias("y"),
        F.explode(F.array(*[F.lit(float(s)) for s in scales])).alias("prior_scale"),
    )
    scored = trials.groupBy(key, "prior_scale").applyInPandas(score, schema)
    best = F.row_number().over(W.partitionBy(key).orderBy("mape", "prior_scale")) == 1
    return scored.withColumn("is_best", flag(best))


# --- budget -------------------------------------------------------------------


def budget_breach(forecast: DataFrame, budget: float = MONTHLY_BUDGET, key: str = "service_category") -> DataFrame:
    """Share of days above the daily bound and first cumulative crossings.

    The forecast of a series has as many rows as the horizon has days.
    """
    running = W.partitionBy(key).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    cum = forecast.withColumns({
        "_c50": F.sum("forecast_50").over(running), "_c90": F.sum("forecast_90").over(running),
    })
    above = F.count_if(F.col("forecast_50") > budget / 30)

    def crossing(col: str):
        first = F.min(F.when(F.col(col) >= budget, F.col("date")))
        return F.coalesce(F.date_format(first, "yyyy-MM-dd"), F.lit(NO_BREACH))

    out = cum.groupBy(key).agg(
        F.round(above / F.count(F.lit(1)) * 100, 1).alias("breach_probability"),
        crossing("_c50").alias("breach_date_50"),
        crossing("_c90").alias("breach_date_90"),
    )
    risk = ladder(F.col("breach_probability"), [(70, "HIGH RISK"), (40, "MEDIUM RISK")], "LOW RISK")
    return out.withColumn("trajectory", risk)


def horizon_totals(
    forecast: DataFrame, horizons: Sequence[int] = (7, 30, 90), budget: float = MONTHLY_BUDGET, key: str = "service_category"
) -> DataFrame:
    """Totals of the three bounds over each horizon, all horizons in one pass."""
    rn = F.row_number().over(W.partitionBy(key).orderBy("date"))
    cells = forecast.withColumn("_rn", rn).withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return (
        cells.where(F.col("_rn") <= F.col("horizon_days"))
        .groupBy(key, "horizon_days")
        .agg(
            F.sum("forecast_50").alias("projected_total"),
            F.sum("forecast_90").alias("upper_total"),
            F.sum("forecast_10").alias("lower_total"),
        )
        .withColumn("remaining_budget", F.lit(float(budget)) - F.col("projected_total"))
    )


def trajectory_risk(forecast: DataFrame, budget: float = MONTHLY_BUDGET, days: int = 30, key: str = "service_category") -> DataFrame:
    """Projected spend of the next month against the budget."""
    rn = F.row_number().over(W.partitionBy(key).orderBy("date"))
    spend = forecast.withColumn("_rn", rn).where(F.col("_rn") <= days).groupBy(key).agg(F.sum("forecast_50").alias("projected_spend"))
    steps = [(budget * 0.9, "HIGH TRAJECTORY RISK"), (budget * 0.7, "ELEVATED RISK")]
    return spend.withColumns({
        "trajectory": ladder(F.col("projected_spend"), steps, "STABLE TRAJECTORY"),
        "is_breach": flag(F.col("projected_spend") > budget),
        "budget_percent": F.round(F.col("projected_spend") / budget * 100, 1),
    })


def over_budget_days(forecast: DataFrame, budget: float = MONTHLY_BUDGET) -> DataFrame:
    return forecast.withColumns({
        "daily_budget": F.lit(budget / 30), "over_budget": flag(F.col("forecast_50") > budget / 30),
    })


def spend_timeline(history: DataFrame, forecast: DataFrame, key: str = "service_category", cost: str = "total_cost") -> DataFrame:
    """Past totals and forecast on one axis, told apart by ``kind``."""
    past = history.groupBy(key, "date").agg(F.sum(cost).cast("double").alias("p50")).select(
        key, "date", F.lit("history").alias("kind"), "p50",
        F.lit(None).cast("double").alias("p10"), F.lit(None).cast("double").alias("p90"),
    )
    ahead = forecast.select(
        key, "date", F.lit("forecast").alias("kind"),
        F.col("forecast_50").alias("p50"), F.col("forecast_10").alias("p10"), F.col("forecast_90").alias("p90"),
    )
    return past.unionByName(ahead)


# --- boosted trees --------------------------------------------------------------

# Input columns of the model, in the given order.
BOOST_FEATURES = (
    "cost_lag_1", "cost_lag_7", "cost_lag_30", "rolling_mean_7", "rolling_mean_30", "rolling_std_7",
    "cost_change_1d", "cost_change_7d", "day_of_week", "month", "week_of_year", "is_weekend", "is_month_end",
)


def boosted_predictions(
    df: DataFrame,
    features: Sequence[str] = BOOST_FEATURES,
    label: str = "total_cost",
    group: str = "service_category",
    max_iter: int = 200,
    step: float = 0.05,
    depth: int = 6,
    tolerance: float = 0.001,
    subsample: float = 1.0,
    feature_share: str = "all",
    save_to: str | None = None,
) -> DataFrame:
    """Held-out predictions of gradient-boosted trees.

    One fit over all groups, the group being a feature the trees can split on:
    the rows stay distributed and no group is fitted by a driver loop. Rows
    with ``is_train`` 0 stop the boosting early and are what is returned.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = df.withColumn("_held", F.col("is_train") == 0).na.fill(0, subset=list(features))
    boost = GBTRegressor(
        featuresCol="_x", labelCol=label, predictionCol="predicted", validationIndicatorCol="_held",
        maxIter=max_iter, stepSize=step, maxDepth=depth, validationTol=tolerance,
        subsamplingRate=subsample, featureSubsetStrategy=feature_share, seed=42,
    )
    model = Pipeline(stages=[
        StringIndexer(inputCol=group, outputCol="_g", handleInvalid="keep", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=["_g", *features], outputCol="_x"),
        boost,
    ]).fit(rows)
    if save_to:
        model.write().overwrite().save(save_to)
    return model.transform(rows.where(F.col("_held"))).drop("_g", "_x", "_held")
