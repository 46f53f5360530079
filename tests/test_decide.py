"""Impact, priority, texts, root causes, attribution, forecasts, budget, reports."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import attribution, decisions, forecast, reports
from ledgerlight.schemas import ROW_KEY

RNG = np.random.default_rng(3)
EDGES = [0.0, 500.0, 500.01, 1500.0, 1500.01, 2000.0, 2000.01, 3000.0, 3000.01, 5000.01, 8000.0, 8000.01]


def expected_priority(v, severity, policy):
    if severity >= 1.0 and v < policy.floor:
        return "P1 - High"
    names = ((policy.critical, "P0 - Critical"), (policy.high, "P1 - High"), (policy.medium, "P2 - Medium"))
    return next((label for bound, label in names if v > bound), "P3 - Low")


@pytest.mark.parametrize("policy", [decisions.BATCH_POLICY, decisions.LIVE_POLICY])
def test_priority_edges(spark, policy):
    rows = [(v, s, a) for v in EDGES for s in (0.67, 1.0) for a in (0, 1)]
    df = spark.createDataFrame(rows, "impact_score double, severity_score double, final_anomaly int")
    for r in decisions.priority(df, policy).collect():
        want = expected_priority(r.impact_score, r.severity_score, policy) if r.final_anomaly else "P3 - Low"
        assert r.priority == want


def test_impact_is_zero_off_anomalies(spark):
    df = spark.createDataFrame([(100.0, 0.67, 1), (100.0, 0.33, 0)], "total_cost double, severity_score double, final_anomaly int")
    assert [r.impact_score for r in decisions.impact(df).collect()] == pytest.approx([67.0, 0.0])


def test_rule_bands(spark):
    costs = [800.0, 800.01, 2000.01, 4000.01]
    services = ["compute", "storage", "networking", "managed_services", "other"]
    df = spark.createDataFrame([(c, s, "t", "high") for c, s in itertools.product(costs, services)],
                               "cost double, service string, team string, severity string")
    texts = decisions.rule_texts(F.col("cost"), F.col("severity"), F.col("service"), F.col("team"))
    out = df.select("cost", "service", *[c.alias(n) for n, c in texts.items()]).collect()
    savings = dict(zip(costs, ["$50-$300", "$300-$1200", "$1000-$3000", "$2000-$7000"]))
    assert all(r.estimated_savings == savings[r.cost] for r in out)
    assert all(r.root_cause.endswith("(Team: t)") for r in out) and len({r.root_cause for r in out}) == 5
    assert {("critical" in r.llm_insight) for r in out if r.cost > 2000} == {True}


def test_only_the_top_rows_get_texts_and_missing_inputs_fall_back(spark, day):
    rows = [("compute", day(i), "AWS", "t" if i else None, "prod", float(100 + i), "high", 1.0, 1) for i in range(8)]
    rows += [("compute", day(20), "AWS", "t", "prod", 9999.0, "low", 0.0, 0), ("storage", day(1), "AWS", "t", "prod", 5.0, "medium", 0.67, 1)]
    df = spark.createDataFrame(rows, "service_category string, date date, provider string, team string, environment string, "
                                     "total_cost double, severity_label string, severity_score double, final_anomaly int")
    out = decisions.enrich_top_impact(df.fillna({"team": "t"}), 3).toPandas()
    rich = out[out.llm_insight != "Normal behavior"]
    assert sorted(rich.total_cost) == [5.0, 105.0, 106.0, 107.0] and len(out) == 10
    fallback = decisions.enrich(df.where("team IS NULL"), F.lit(True)).first()
    assert fallback.root_cause == "Unknown"


def test_causes_are_ranked_by_size(spark):
    df = spark.createDataFrame([(1, "cost_lag_1", -5.0), (1, "month", 2.0), (1, "is_weekend", 1.0), (1, "cost_lag_7", 0.5)], "id int, feature string, shap_value double")
    r = decisions.causes_per_anomaly(decisions.rank_causes(df, ["id"]), ["id"]).first()
    assert [c.root_cause for c in r.top_causes] == ["Previous day cost pattern", "month", "Unexpected weekend activity"]
    assert r.primary_cause == "Previous day cost pattern" and r.impact_score == 5.0


def brute_shapley(leaves, x):
    """Shapley values by enumerating feature subsets."""
    from math import factorial

    features = sorted({w[0] for _, walls in leaves for w in walls})

    def value(subset):
        total = 0.0
        for v, walls in leaves:
            for f, low, high, share in walls:
                v *= float(low < x[f] <= high) if f in subset else share
            total += v
        return total

    phi, n = np.zeros(len(x)), len(features)
    for f in features:
        rest = [g for g in features if g != f]
        for k in range(n):
            for s in itertools.combinations(rest, k):
                w = factorial(k) * factorial(n - 1 - k) / factorial(n)
                phi[f] += w * (value({*s, f}) - value(set(s)))
    return phi, value(set())


def test_shapley_values_are_exact_and_additive(spark, tmp_path):
    x = RNG.uniform(0, 1, (300, 3))
    y = 10 * x[:, 0] + 5 * (x[:, 1] > 0.5) * x[:, 2]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, cost double")
    path = attribution.fit_cost_model(df, str(tmp_path / "m"), ["a", "b", "c"], "cost", trees=5, depth=3)
    leaves = attribution.read_leaves(spark, path)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressionModel

    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df.limit(20))
    predicted = [r.prediction for r in RandomForestRegressionModel.load(path).transform(rows).collect()]
    m = np.array([[r.a, r.b, r.c] for r in rows.collect()])
    phi, base = attribution.contributions(leaves, m)
    np.testing.assert_allclose(phi.sum(axis=1) + base, predicted, atol=1e-6)
    for i in range(3):
        want, want_base = brute_shapley(leaves, m[i])
        np.testing.assert_allclose(phi[i], want, atol=1e-9)
        assert base == pytest.approx(want_base)


def test_first_anomalies_and_semi_join(spark, day):
    rows = [("compute", day(i), "AWS", "t", "prod", float(i), 1) for i in range(15)]
    df = spark.createDataFrame(rows, "service_category string, date date, provider string, team string, environment string, impact_score double, final_anomaly int")
    top = attribution.first_anomalies(df)
    assert sorted(r.impact_score for r in top.collect()) == [float(i) for i in range(5, 15)]
    assert attribution.keep_known(top, df.where("impact_score > 12").select(*ROW_KEY)).count() == 2


def totals(spark, day, values, service="s"):
    return spark.createDataFrame([(service, day(i), float(v)) for i, v in enumerate(values)], "service_category string, date date, total_cost double")


def test_seasonal_forecast_matches_numpy(spark, day):
    t = np.arange(70)
    y = 100 + 2 * t + 10 * (t % 7 == 3) + RNG.normal(0, 1, 70)
    out = forecast.seasonal_forecast(totals(spark, day, y)).orderBy("date").toPandas()
    b, a = np.polyfit(t, y, 1)
    r = y - a - b * t
    effect = np.array([r[d::7].mean() for d in range(7)])
    sd = (r - effect[t % 7]).std()
    ahead = np.arange(70, 160)
    centre = a + b * ahead + effect[ahead % 7]
    np.testing.assert_allclose(out["forecast_50"], centre, atol=1e-8)
    np.testing.assert_allclose(out["forecast_90"] - out["forecast_50"], 1.2815515655 * sd, atol=1e-6)
    assert len(out) == 90 and out["date"].iloc[0] == day(70)


def test_forecast_is_clipped_and_handles_unseen_weekdays(spark, day):
    out = forecast.seasonal_forecast(totals(spark, day, [100, 60, 20])).toPandas()
    assert len(out) == 90 and (out[["forecast_10", "forecast_50", "forecast_90"]] >= 0).all().all()


def test_changepoint_forecast_follows_a_bend(spark, day):
    t = np.arange(200)
    y = np.where(t < 100, 100 + t, 200 - 0.5 * (t - 100)) + 3 * np.sin(2 * np.pi * t / 7)
    out = forecast.changepoint_forecast(totals(spark, day, y), horizon=14, prior_scale=10.0).orderBy("date").toPandas()
    want = 200 - 0.5 * (np.arange(200, 214) - 100) + 3 * np.sin(2 * np.pi * np.arange(200, 214) / 7)
    np.testing.assert_allclose(out["forecast_50"], want, rtol=0.05)
    tuned = forecast.tune_changepoints(totals(spark, day, y)).toPandas()
    assert tuned["is_best"].sum() == 1 and tuned.loc[tuned.is_best == 1, "mape"].iloc[0] == tuned["mape"].min()


def breach(spark, day, p50, p90, budget):
    rows = [("s", day(i), a, b, 0.0) for i, (a, b) in enumerate(zip(p50, p90))]
    df = spark.createDataFrame(rows, "service_category string, date date, forecast_50 double, forecast_90 double, forecast_10 double")
    return df, forecast.budget_breach(df, budget).first()


def test_budget_breach_cases(spark, day):
    _, never = breach(spark, day, [1.0] * 90, [1.0] * 90, 3000.0)
    assert (never.breach_probability, never.breach_date_50, never.breach_date_90, never.trajectory) == (
        0.0, "No Breach Predicted", "No Breach Predicted", "LOW RISK")
    _, exact = breach(spark, day, [100.0] * 90, [100.0] * 90, 3000.0)
    assert exact.breach_date_50 == str(day(29)) and exact.breach_probability == 0.0
    _, upper = breach(spark, day, [10.0] * 50 + [101.0] * 40, [30.0] * 50 + [101.0] * 40, 4600.0)
    assert upper.breach_date_50 == "No Breach Predicted" and upper.breach_date_90 != "No Breach Predicted"


def test_horizons_and_trajectory(spark, day):
    df, _ = breach(spark, day, [10.0] * 90, [20.0] * 90, 330.0)
    h = {r.horizon_days: r for r in forecast.horizon_totals(df, budget=330.0).collect()}
    assert [h[k].projected_total for k in (7, 30, 90)] == [70.0, 300.0, 900.0] and h[30].remaining_budget == 30.0
    r = forecast.trajectory_risk(df, 330.0).first()
    assert (r.projected_spend, r.trajectory, r.is_breach, r.budget_percent) == (300.0, "HIGH TRAJECTORY RISK", 0, 90.9)
    assert forecast.trajectory_risk(df, 400.0).first().trajectory == "ELEVATED RISK"
    assert forecast.over_budget_days(df, 299.0).agg(F.sum("over_budget")).first()[0] == 90


@pytest.fixture(scope="module")
def log(spark, day):
    rows = [
        (day(0), "AWS", "a", 10.0, 1, "high", 3, 10.0, "P1 - High"), (day(0), "AWS", "b", 5.0, 0, "low", 1, 0.0, None),
        (day(1), "GCP", "a", 7.0, 1, "medium", 2, 4.7, "P0 - Critical"), (day(2), "AWS", "a", 1.0, 0, "low", 0, 0.0, "P3 - Low"),
    ]
    return spark.createDataFrame(rows, "date date, provider string, service_category string, cost_usd double, is_anomaly int, "
                                       "severity_label string, model_votes int, impact_score double, priority string")


def test_reports(log, day):
    k = reports.kpi_strip(log).first()
    assert (k.total_anomalies, k.p0_p1_count, k.high_severity, k.total_impact) == (2, 2, 1, 14.7)
    o = reports.overview(log).first()
    assert (o.total_anomalies, o.p0_critical, o.p1_high, o.high_severity, o.medium_severity, o.low_severity) == (2, 1, 1, 1, 1, 2)
    v = reports.vote_agreement(log).first()
    assert (v.total_flags, v.average_votes, v.strong, v.weak) == (2, 2.5, 1, 1)
    p = {r.provider: r for r in reports.provider_allocation(log).collect()}
    assert (p["AWS"].total_cost, p["AWS"].anomaly_count, p["AWS"].avg_daily) == (16.0, 1, 8.0)
    s = {r.service_category: r for r in reports.service_costs(log).collect()}
    assert (s["a"].anomaly_cost, s["b"].anomaly_cost) == (17.0, 0.0)
    m = {(r.severity_label, r.date): r.total_cost for r in reports.severity_markers(log).collect()}
    assert m == {("high", day(0)): 15.0, ("medium", day(1)): 7.0}
    assert {r.severity_label: r.share for r in reports.severity_share(log).collect()} == {"high": 0.5, "medium": 0.5}
    assert {(r["filter"], r["value"]) for r in reports.filter_domains(log).collect()} == {
        ("provider", "AWS"), ("provider", "GCP"), ("service_category", "a"), ("service_category", "b")}
    assert reports.date_bounds(log).first() == (day(0), day(2))
    assert {r.total_rows for r in reports.rows_with_total(log).collect()} == {4}
    assert reports.slice_rows(log, ["AWS"], str(day(0)), str(day(1)), "a", True).count() == 1
    assert reports.slice_rows(log).count() == 4


def test_top_anomalies_falls_back_to_cost(log):
    top = decisions.top_anomalies(log, 1, ties=["date"])
    assert top.first().impact_score == 10.0
    assert decisions.top_anomalies(log.drop("impact_score"), 1, ties=["date"]).first().cost_usd == 10.0
