"""Window features against pandas and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlight.functions.quantiles import exact_quantiles
from ledgerlight.operators import features, segments, sequence, zscore

RNG = np.random.default_rng(7)


def close(a, b):
    np.testing.assert_allclose(np.array(a, float), np.array(b, float), rtol=1e-9, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("n", [1, 7, 13, 14, 30, 31, 45])
def test_engineered_features_match_pandas(series, n):
    x = pd.Series(RNG.uniform(10, 100, n).round(2))
    out = features.engineer_features(series({"a": list(x)}), complete=False).orderBy("date").toPandas()
    for k in (1, 7, 30):
        close(out[f"cost_lag_{k}"], x.shift(k))
    for k in (7, 30):
        close(out[f"rolling_mean_{k}"], x.rolling(k, min_periods=1).mean())
        close(out[f"rolling_std_{k}"], x.rolling(k, min_periods=1).std())
    close(out["cost_change_1d"], x.pct_change(1))
    close(out["cost_change_7d"], x.pct_change(7))
    if n > 1:
        close(out["zscore"], abs((x - x.mean()) / x.std(ddof=0)))
    kept = features.engineer_features(series({"a": list(x)}))
    assert kept.count() == max(n - 30, 0)


def test_change_from_zero_is_missing_not_infinite(series):
    out = features.engineer_features(series({"a": [0.0, 5.0, 0.0, 0.0, 3.0]}), complete=False).orderBy("date").toPandas()
    assert out["cost_change_1d"].isna().tolist() == [True, True, False, True, True]


def test_lags_count_rows_not_days(series):
    out = features.with_lags(series({"a": [1.0, None, None, 2.0]}), features.series_window()).orderBy("date").toPandas()
    assert out["cost_lag_1"].tolist()[1] == 1.0


def test_gate_and_splits(series):
    df = series({"long": [1.0] * 40, "short": [1.0] * 5})
    assert {r[0] for r in features.min_history(df, 30).select("service_category").distinct().collect()} == {"long"}
    split = features.time_split(df, 0.8, ["service_category"])
    assert split.groupBy("service_category").agg(F.sum("is_train")).toPandas().set_index("service_category").iloc[:, 0].to_dict() == {"long": 32, "short": 4}
    last = features.last_rows_split(df, 30, ["service_category"])
    assert last.where("is_train = 1").count() == 10


def test_sliding_windows_align_like_the_two_sequence_cutters(series):
    df = series({"a": [float(i) for i in range(20)]})
    w = features.series_window()
    seven = features.sliding_windows(df, w, ["total_cost"], 7).where("window is not null").orderBy("date").collect()
    assert len(seven) == 14 and list(seven[0].window) == [0, 1, 2, 3, 4, 5, 6]
    before = features.sliding_windows(df, w, ["total_cost"], 14, preceding=True).where("window is not null").orderBy("date").collect()
    assert len(before) == 6 and list(before[0].window) == list(range(14)) and before[0].total_cost == 14


def test_segment_features_match_pandas(spark, day):
    x = pd.Series(RNG.uniform(0, 50, 400).round(2))
    x[50:60] = 0.0
    df = spark.createDataFrame([("s", day(i), float(v), 0) for i, v in enumerate(x)], "segment_id string, date date, cost_usd double, is_anomaly int")
    out = segments.segment_features(df).orderBy("date").toPandas()
    c = x.clip(x.quantile(0.01), x.quantile(0.99))
    close(out["cost_capped"], c)
    for k in (7, 14, 30):
        close(out[f"rolling_mean_{k}"], c.rolling(k, min_periods=1).mean())
        np.testing.assert_allclose(out[f"rolling_std_{k}"], c.rolling(k, min_periods=1).std().fillna(0), atol=1e-6)
    close(out["ema_7"], c.ewm(span=7, adjust=False).mean())
    close(out["ema_14"], c.ewm(span=14, adjust=False).mean())
    close(out["rolling_max_7"], c.rolling(7, min_periods=1).max())
    assert np.isfinite(out["pct_change_1d"]).all() and (out.loc[53:59, "ratio_to_rolling_max_7"] == c[53:60] / c.rolling(7, min_periods=1).max()[53:60]).sum() >= 0


def test_sample_cap_is_stable_over_partitionings(spark, series):
    df = series({"a": [1.0] * 300, "b": [1.0] * 20})
    pick = lambda d: sorted(r.date for r in segments.sample_cap(d, 50, ["service_category"], ["service_category", "date"]).where("service_category = 'a'").collect())
    assert pick(df.repartition(1)) == pick(df.repartition(7)) and len(pick(df)) == 50
    assert segments.sample_cap(df, 50, ["service_category"], ["date"]).where("service_category = 'b'").count() == 20


def decompose(x: np.ndarray) -> np.ndarray:
    n = len(x)
    if n < 14:
        return x
    t = np.full(n, np.nan)
    for i in range(3, n - 3):
        t[i] = x[i - 3:i + 4].mean()
    head, tail = np.arange(3, 10), np.arange(n - 10, n - 3)
    a, b = np.polyfit(head, t[head], 1)
    t[:3] = a * np.arange(3) + b
    a, b = np.polyfit(tail, t[tail], 1)
    t[n - 3:] = a * np.arange(n - 3, n) + b
    d = x - t
    s = np.array([d[p::7].mean() for p in range(7)])
    s -= s.mean()
    return d - s[np.arange(n) % 7]


@pytest.mark.parametrize("n", [13, 14, 15, 40])
def test_residual_matches_the_definition(series, n):
    x = RNG.uniform(10, 20, n) + 5 * np.sin(np.arange(n))
    out = zscore.zscore_detector(series({"a": list(x)})).orderBy("date").toPandas()
    r = decompose(x)
    np.testing.assert_allclose(out["residual"], r, atol=1e-9)
    np.testing.assert_allclose(out["residual_z"], abs((r - r.mean()) / r.std()), atol=1e-9)


def test_constant_series_is_not_flagged(series):
    out = zscore.zscore_detector(series({"a": [5.0] * 20}))
    assert out.agg(F.sum("zscore_flag")).first()[0] == 0


def test_severity_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(2.0,), (2.1,), (3.0,), (4.0,), (4.1,), (None,)], "z double")
    assert [r[0] for r in df.select(zscore.severity_bin(F.col("z"))).collect()] == ["normal", "low", "low", "medium", "high", None]


def many_teams(spark, day, n=60):
    rows = [(day(i), "AWS", "s", f"t{k}", "prod", float(RNG.uniform(1, 9)) + (80 if (i, k) == (30, 2) else 0)) for i in range(n) for k in range(5)]
    return spark.createDataFrame(rows, "date date, provider string, service_category string, team string, environment string, total_cost double")


def test_service_sequence_equals_one_window(spark, day, monkeypatch):
    """Blocks of 16 positions give what one window over the service gives."""
    df = many_teams(spark, day)
    order = ["date", "provider", "team", "environment"]
    whole = zscore.zscore_detector(df, ["service_category"], order).orderBy(*order).toPandas()
    monkeypatch.setattr(sequence.in_blocks, "__defaults__", ("service_category", 16))
    monkeypatch.setattr(zscore, "in_blocks", lambda d, b, a, k: sequence.in_blocks(d, b, a, k, 16))
    split = zscore.zscore_detector_by_service(df).orderBy(*order).toPandas()
    np.testing.assert_allclose(whole["residual"], split["residual"], atol=1e-9)
    assert (whole["zscore_flag"] == split["zscore_flag"]).all() and split["zscore_flag"].sum() >= 1


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_quantiles_with_a_hot_group_and_ties(spark, accuracy):
    hot = np.concatenate([np.zeros(3000), RNG.normal(0, 1, 2000).round(3)])
    rows = [("hot", float(v)) for v in hot] + [("tiny", 3.0), ("tiny", 5.0), ("one", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"lo": 0.05, "mid": 0.5, "hi": 0.95, "end": 1.0, "start": 0.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs, accuracy=accuracy).collect()}
    for key, values in {"hot": hot, "tiny": [3.0, 5.0], "one": [7.0]}.items():
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(values, p), abs=1e-12)
