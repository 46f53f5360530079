"""Contract, idempotent batches, fetches and parameter documents."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.schemas import ANOMALY_LOGS, TABLES
from ledgerlight.sources import store

LOG = ("date date, provider string, service_category string, team string, environment string, cost_usd double, is_anomaly int, "
       "severity_label string, severity_score double, root_cause string, llm_insight string, recommended_action string, "
       "estimated_savings string, model_votes int, impact_score double, priority string")


def rows(spark, day, n, service="compute", cost=1.0, team="t"):
    return spark.createDataFrame(
        [(day(i), "AWS", service, team, "prod", cost, i % 2, "low", 0.33, "c", "i", "a", "$0", 1, float("nan"), "P3 - Low") for i in range(n)], LOG
    )


@pytest.fixture
def results(spark, tmp_path):
    s = store.ResultStore(spark, str(tmp_path / "results"))
    s.create_tables()
    return s


def test_tables_are_readable_before_any_run(results):
    assert all(results.read(t).count() == 0 for t in TABLES)


def test_insert_casts_and_is_idempotent_per_batch(results, spark, day):
    results.insert_anomalies(rows(spark, day, 5), "b1")
    results.insert_anomalies(rows(spark, day, 5), "b1")
    results.insert_anomalies(rows(spark, day, 3, "storage"), "b2")
    got = results.read("anomaly_logs")
    assert got.count() == 8 and dict(got.dtypes)["is_anomaly"] == "boolean"
    assert got.where("impact_score IS NULL").count() == 8
    assert results.read_current("anomaly_logs").count() == 8
    results.insert_anomalies(rows(spark, day, 5, cost=2.0), "b3")
    current = results.read_current("anomaly_logs").where("service_category = 'compute'")
    assert current.count() == 5 and {r.cost_usd for r in current.collect()} == {2.0}
    results.clear_all()
    assert results.read("anomaly_logs").count() == 0


def test_contract_rejects_with_reasons(results, spark, day):
    bad = rows(spark, day, 2, team=None).unionByName(rows(spark, day, 1, service="x" * 60))
    rejected = results.insert_anomalies(bad, "b1")
    assert sorted(tuple(r.reasons) for r in rejected.collect()) == [
        ("service_category is too long",), ("team is missing",), ("team is missing",)]
    assert results.read("anomaly_logs").count() == 0
    with pytest.raises(ValueError, match="needs the column"):
        store.to_contract(spark.range(1), "anomaly_logs")
    assert store.to_contract(rows(spark, day, 1), "anomaly_logs").columns == ANOMALY_LOGS.fieldNames()


def test_metrics_need_their_keys(results, spark):
    with pytest.raises(ValueError, match="mape"):
        results.insert_metrics(spark.createDataFrame([("m", 1.0, 1.0, 1.0)], "model_name string, f1_score double, precision_score double, recall_score double"), "b")


def test_fetch_filters_order_and_limit(results, spark, day):
    results.insert_anomalies(rows(spark, day, 6).unionByName(rows(spark, day, 4, "storage")), "b1")
    got = results.fetch_anomalies("compute", limit=3).collect()
    assert [r.date.date() for r in got] == [day(5), day(4), day(3)]
    assert results.fetch_anomalies(provider="none").count() == 0
    plan = results.fetch_anomalies("compute")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(service_category" in plan


def test_latest_metrics_breaks_ties(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    df = spark.createDataFrame([(1, "a", 0.1, at(1)), (2, "a", 0.2, at(2)), (3, "b", 0.3, at(5)), (4, "b", 0.4, at(5)), (5, "c", 0.5, at(1)), (6, "c", 0.6, at(0))],
                               "id long, model_name string, f1_score double, created_at timestamp")
    assert {r.model_name: r.id for r in store.latest_metrics(df).collect()} == {"a": 2, "b": 3, "c": 5}
    assert store.latest_metrics(df, "b").count() == 1


def test_parameter_documents_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s1", 0.5), ("s2", 0.7)], "segment_id string, t double").select("segment_id", F.struct("t").alias("ensemble"))
    path = str(tmp_path / "params")
    store.write_parameters(df, path)
    back = store.read_parameters(spark, path, T.StructType([*df.schema.fields]))
    assert {(r.segment_id, r.ensemble.t) for r in back.collect()} == {("s1", 0.5), ("s2", 0.7)}
