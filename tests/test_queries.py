"""Registered queries against their SQL on the smallest tables, and whole runs."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from ledgerlight.operators import scenario
from ledgerlight.plans import frames, pipeline, tuned
from ledgerlight.sources.billing import billing_view

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def canon(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 3)
    text = str(value)
    return text.removesuffix(" 00:00:00")


def test_every_query_is_registered_once():
    assert set(SQL) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, small, name):
    df = contract.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = Counter(tuple(canon(r[c]) for c in cols) for r in df.collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = Counter(tuple(canon(r[i]) for i in order) for r in cursor.fetchall())
    assert got == want


def test_entry_runs(spark):
    row = contract.entry(spark).first()
    assert row.total_anomalies > 0 and row.total_impact > 0


def test_batch_run_fills_every_table_and_can_be_repeated(spark, small, tmp_path):
    raw = scenario.inject_spikes(billing_view(spark, small), every=40).drop("environment").selectExpr("*", "'all' AS environment")
    run = lambda: pipeline.run_batch(raw, str(tmp_path), "b1", budget=1e6, boost_rounds=3, explain=True)
    store = run()
    counts = {t: store.read(t).count() for t in ("anomaly_logs", "forecast_results", "model_metrics", "budget_breaches", "correlated_anomalies", "anomaly_causes")}
    assert all(counts.values()), counts
    assert counts["forecast_results"] == 90 * counts["budget_breaches"]
    log = store.read("anomaly_logs")
    assert log.select("id").distinct().count() == counts["anomaly_logs"]
    assert log.where("NOT is_anomaly AND (impact_score <> 0 OR priority <> 'P3 - Low')").count() == 0
    assert store.fetch_latest_metrics().count() == counts["model_metrics"]
    pipeline.run_batch(raw, str(tmp_path), "b1", budget=1e6, boost_rounds=3, explain=False)
    assert store.read("anomaly_logs").count() == counts["anomaly_logs"]


def test_tuned_run_scores_labelled_segments(spark, small, tmp_path):
    out = tuned.tuned_run(frames.segment_rows(spark, small), str(tmp_path)).toPandas()
    assert len(out) and out["f1_score"].between(0, 1).all() and out["roc_auc"].mean() > 0.5
    total = sum(out[f"w_{c}"] for c in ("z_score", "if_score", "svm_score", "lstm_score"))
    assert total.round(9).eq(1).all()
    assert spark.read.json(f"{tmp_path}/tuned_params").count() == len(out)
