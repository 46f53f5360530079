"""Cleaning, taxonomy, dates and calendar on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions.columns import segment_id
from ledgerlight.operators import features, normalize, rollup
from ledgerlight.schemas import BILLING, BILLING_BULK, BILLING_EXPORT, MALFORMED
from ledgerlight.sources import billing

DIRTY = [
    ("2024-03-01", "AWS", "Amazon EC2", "data", "prod", "r1", 10.0, 1.0, "hours", "us", 0),
    ("03/02/2024", "AWS", "Amazon S3", None, "prod", "r2", -5.0, 1.0, "GB", "us", 0),
    ("2024-03-03 10:11:12", "Azure", "Azure SQL", "data", None, "r3", None, 1.0, "GB", "us", 1),
    ("04-Mar-2024", "GCP", "Cloud CDN", "data", "prod", "r4", float("nan"), 1.0, "GB", "us", 0),
    ("not a date", "GCP", "Cloud SQL", "data", "prod", "r5", 1.0, 1.0, "GB", "us", 0),
    ("2024/03/05", "GCP", "Mystery", "data", "prod", "r6", 2.5, 1.0, "GB", "us", 0),
    ("Mar 6, 2024", "GCP", None, "data", "prod", "r7", 3.5, 1.0, "GB", "us", 0),
    (None, "GCP", "Cloud SQL", "data", "prod", "r8", 1.0, 1.0, "GB", "us", 0),
]


@pytest.fixture(scope="module")
def dirty(spark):
    return spark.createDataFrame(DIRTY, BILLING_EXPORT)


def test_normalize_cleans_and_drops_unreadable_dates(dirty):
    rows = {r.resource_id: r for r in normalize.normalize(dirty).collect()}
    assert set(rows) == {"r1", "r2", "r3", "r4", "r6", "r7"}
    assert rows["r2"].date == dt.date(2024, 3, 2) and rows["r2"].team == "unknown" and rows["r2"].cost_usd == 0
    assert rows["r3"].date == dt.date(2024, 3, 3) and rows["r3"].environment == "unknown" and rows["r3"].cost_usd == 0
    assert rows["r6"].service_category == "other" and rows["r7"].service_category == "other"
    assert rows["r1"].service_category == "compute" and float(rows["r1"].cost_usd) == 10.0


def test_nan_cost_becomes_zero(spark):
    df = spark.createDataFrame([(float("nan"), None, None)], "cost_usd double, team string, environment string")
    assert float(normalize.clean(df).first().cost_usd) == 0.0


def test_rejected_dates_are_reported(dirty):
    assert {"r5", "r8"} <= {r.resource_id for r in normalize.rejected_dates(dirty).collect()}


def test_category_fallback(spark):
    one = lambda ddl, row: normalize.with_category(spark.createDataFrame([row], ddl)).first().service_category
    assert one("service_name string, service string", ("Blob Storage", "x")) == "storage"
    assert one("service string", ("networking",)) == "networking"
    assert one("service_category string", ("compute",)) == "compute"
    assert one("x int", (1,)) == "other"


def test_calendar_edges(spark):
    days = [dt.date(2024, 2, 29), dt.date(2024, 12, 30), dt.date(2021, 1, 3), dt.date(2020, 12, 31), dt.date(2024, 3, 3), dt.date(2024, 3, 4)]
    df = spark.createDataFrame([(d,) for d in days], "date date")
    got = {r.date: r for r in features.with_calendar(df).collect()}
    for d in days:
        iso = d.isocalendar()
        assert (got[d].day_of_week, got[d].week_of_year) == (iso[2] - 1, iso[1])
        assert got[d].is_weekend == int(d.weekday() >= 5)
        assert got[d].is_month_end == int((d + dt.timedelta(days=1)).month != d.month)


def test_rollup_is_exact_and_keeps_labels(spark, dirty):
    rows = normalize.normalize(dirty)
    daily = rollup.daily_rollup(rows)
    assert "is_anomaly" in daily.columns
    assert "is_anomaly" not in rollup.daily_rollup(rows.drop("is_anomaly")).columns
    many = spark.createDataFrame([(dt.date(2024, 1, 1), "p", "s", "t", "e", 0.1)] * 1000,
                                 "date date, provider string, service_category string, team string, environment string, cost_usd double")
    row = rollup.daily_rollup(many.withColumn("cost_usd", F.col("cost_usd").cast("decimal(18,4)"))).first()
    assert (row.total_cost, row.record_count) == (100.0, 1000) and row.avg_cost == pytest.approx(0.1)


def test_csv_round_trip_and_append(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame(DIRTY[:3], BILLING)
    billing.append_batch(df, path, "csv")
    billing.append_batch(df, path, "csv")
    back = billing.read_billing(spark, path)
    assert back.count() == 6 and back.drop(MALFORMED).schema == BILLING
    assert back.where("provider = 'provider'").count() == 0


def test_sorted_export_orders_files_by_date(spark, tmp_path, day):
    df = spark.createDataFrame([(day(i * 7 % 50), i) for i in range(200)], "date date, x int")
    path = str(tmp_path / "sorted")
    billing.sorted_export(df, path, partitions=4)
    spans = (
        spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("date").alias("a"), F.max("date").alias("b")).orderBy("a").collect()
    )
    assert all(x.b <= y.a for x, y in zip(spans, spans[1:])) and spark.read.parquet(path).count() == 200


def test_trailing_snapshot_replicate_downcast(spark, day):
    df = spark.createDataFrame([(day(i), float(i), 1.0, 0) for i in range(30)], "date date, cost_usd double, usage_quantity double, is_anomaly int")
    last = billing.trailing_snapshot(df, 5, ["date", "cost_usd"])
    assert sorted(r.cost_usd for r in last.collect()) == [25.0, 26.0, 27.0, 28.0, 29.0]
    assert billing.replicate(df, 3).count() == 90
    narrow = dict(billing.downcast(df).dtypes)
    assert (narrow["cost_usd"], narrow["is_anomaly"]) == ("float", "tinyint")
    assert dict((f.name, f.dataType.typeName()) for f in BILLING_BULK.fields)["cost_usd"] == "float"


def test_segment_id(spark):
    df = spark.createDataFrame([("Managed Services", "Data Team")], "s string, t string")
    assert df.select(segment_id("s", "t").alias("x")).first().x == "managed_services_data_team"


def test_densify_fills_gaps_inside_the_series_only(spark, day):
    df = spark.createDataFrame(
        [(day(0), "a", "x", 1.0, 1), (day(3), "a", "x", 2.0, 0), (day(9), "a", "x", 3.0, 0), (day(4), "b", "x", 5.0, 0)],
        "date date, service_category string, team string, cost_usd double, is_anomaly int",
    )
    out = rollup.segment_daily(df).toPandas()
    a = out[out.segment_id == "a_x"].sort_values("date")
    assert len(a) == 10 and a.cost_usd.sum() == 6.0 and list(a.is_anomaly) == [1] + [0] * 9
    assert len(out[out.segment_id == "b_x"]) == 1


def test_weekday_matrix_and_service_matrix(spark, day):
    df = spark.createDataFrame([(day(0), "a", 2.0), (day(7), "a", 4.0), (day(1), "b", 3.0)], "date date, service_category string, cost_usd double")
    m = {r.service_category: r.asDict() for r in rollup.weekday_matrix(df).collect()}
    assert m["a"]["Monday"] == 3.0 and m["a"]["Tuesday"] == 0.0 and m["b"]["Tuesday"] == 3.0
    wide = {r.date: r for r in rollup.service_matrix(df, ["a", "b"]).collect()}
    assert wide[day(1)].a == 0.0 and wide[day(1)].b == 3.0


def test_csv_is_read_by_name_and_rejects_are_kept(spark, tmp_path):
    header = ["date", "provider", "service", "team", "environment", "resource_id", "cost_usd", "usage_quantity", "usage_unit", "region", "is_anomaly"]
    bulk = ["date", "provider", "service_category", "team", "environment", "cost_usd", "usage_quantity", "region", "is_anomaly"]
    value = {"date": "2024-01-02", "provider": "AWS", "service": "compute", "service_category": "compute", "team": "data", "environment": "prod", "resource_id": "r",
             "cost_usd": "12.5", "usage_quantity": "3", "usage_unit": "hours", "region": "us", "is_anomaly": "1"}
    seen = []
    for i, names in enumerate((header, list(reversed(header)), bulk)):
        (tmp_path / f"l{i}").mkdir()
        (tmp_path / f"l{i}" / "a.csv").write_text("\n".join([",".join(names), ",".join(value[n] for n in names)]))
        rows = normalize.normalize(billing.read_billing(spark, str(tmp_path / f"l{i}")))
        seen.append(rows.select("date", "service_category", "team", "cost_usd", "region", "is_anomaly").first())
    assert seen[0] == seen[1] == seen[2] and float(seen[0].cost_usd) == 12.5 and seen[0].is_anomaly == 1
    export = "date,provider,service,team,environment,cost_usd\n" + "\n".join(
        ["2024-01-02,AWS,compute,a,p,1", "nonsense,AWS,compute,a,p,1", "2024-01-02,AWS,compute,a,p,2e14", "2024-01-02,AWS,compute,a,p,oops", "2024-01-03,AWS,compute,a,p,"])
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.csv").write_text(export)
    raw = billing.read_billing(spark, str(tmp_path / "bad"))
    assert sorted(r.reason for r in normalize.rejected(raw).collect()) == ["cost is out of range", "date is unreadable", "line is malformed"]
    assert normalize.normalize(raw).count() == 2
