"""Streams against their batch twins, with late and repeated rows."""

import datetime as dt
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import decisions, features
from ledgerlight.plans import pipeline
from ledgerlight.schemas import BILLING
from ledgerlight.session import shared_dir
from ledgerlight.sources.billing import usage_events
from ledgerlight.sources.store import ResultStore
from ledgerlight.streaming import live
from ledgerlight.streaming.state import LiveState, as_daily, service_moments

RNG = np.random.default_rng(5)
SCHEMA = "event_id long, ts timestamp, service_category string, cost_usd double"


def ts(day, hour=1):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)


def drain(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def test_replay_equals_batch(spark, small):
    batch = usage_events(spark.read.parquet(f"{small}/events.parquet")).groupBy(F.to_date("ts").alias("date"), "service_category").agg(
        F.count("*").alias("record_count"), F.sum("cost_usd").alias("total_cost"))
    a = batch.orderBy("date", "service_category").toPandas()
    b = live.replay_daily_totals(spark, small).orderBy("date", "service_category").toPandas()
    assert len(a) == len(b) and (a["record_count"] == b["record_count"]).all()
    np.testing.assert_allclose(a["total_cost"], b["total_cost"])


def test_closed_days_late_rows_and_repeats(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    files = [
        [(1, ts(0), "a", 1.0), (2, ts(0), "a", 2.0), (3, ts(1), "a", 4.0)],
        [(2, ts(0), "a", 2.0), (4, ts(6), "a", 8.0)],
        [(5, ts(0, 5), "a", 100.0), (6, ts(7), "a", 1.0)],
        [(7, ts(30), "a", 1.0)],
    ]
    dropped = 0
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(src / f"f{i}"))
        stream = live.arriving_rows(spark, str(src / "*"), spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
        totals = live.daily_totals(live.without_repeats(stream, ["event_id"], delay="1 day"))
        query = (totals.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
                 .outputMode("append").trigger(availableNow=True).start())
        drain(query)
        dropped += sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    got = {r.date: (r.record_count, r.total_cost) for r in spark.read.parquet(out).collect()}
    day = lambda n: ts(n).date()
    assert got == {day(0): (2, 3.0), day(1): (1, 4.0), day(6): (1, 8.0), day(7): (1, 1.0)}
    assert dropped >= 1


def test_streaming_features_equal_batch_and_mark_late_days(spark, series, tmp_path, day):
    x = list(RNG.uniform(5, 10, 45))
    df = series({"a": x, "b": x[:10]})
    src, out = tmp_path / "in", str(tmp_path / "out")
    cut = [df.where(F.col("date") < F.lit(day(20))), df.where(F.col("date") >= F.lit(day(20))), df.where(F.col("date") == F.lit(day(3)))]
    for i, part in enumerate(cut):
        part.coalesce(1).write.parquet(str(src / f"f{i}"))
        stream = live.arriving_rows(spark, str(src / "*"), df.schema)
        drain(live.streaming_features(stream).writeStream.format("parquet").option("path", out)
              .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start())
    got = spark.read.parquet(out)
    assert got.where("is_late = 1").count() == 2
    keys = ["service_category", "date"]
    fresh = got.where("is_late = 0").orderBy(*keys).toPandas()
    batch = features.engineer_features(df, complete=False).orderBy(*keys).toPandas()
    assert len(fresh) == len(batch) == 55
    for c in live.FEATURE_COLUMNS:
        np.testing.assert_allclose(fresh[c].astype(float), batch[c].astype(float), rtol=1e-8, atol=1e-6, equal_nan=True)


def test_rolling_totals(spark):
    df = spark.createDataFrame([(1, ts(i), "a", float(i)) for i in range(10)], SCHEMA)
    got = {r.date: r.rolling_total for r in live.rolling_totals(df).collect()}
    assert got[ts(9).date()] == sum(range(3, 10)) and got[ts(2).date()] == 3.0


BILL = ("date date, provider string, service_category string, team string, environment string, cost_usd double, "
        "usage_quantity double, region string")


@pytest.fixture
def bills(spark, day):
    def build(first, last, spike=()):
        rows = []
        for i in range(first, last):
            for service in ("compute", "storage"):
                v = float(3000 + 100 * np.sin(i * 2 * np.pi / 7) + np.random.default_rng(i).normal(0, 20))
                rows.append((day(i), "AWS", service, "data", "prod", v * (5 if i in spike else 1), 1.0, "us"))
        return spark.createDataFrame(rows, BILL)

    return build


def test_live_run_stores_only_new_anomalies_and_survives_a_replay(spark, bills, tmp_path, day):
    src = tmp_path / "in"
    bronze, root = str(tmp_path / "bronze"), str(tmp_path / "results")
    ResultStore(spark, root).create_tables()
    log = live.ProgressLog()
    spark.streams.addListener(log)
    for i, part in enumerate([bills(0, 90, (70,)), bills(90, 93, (91,))]):
        part.coalesce(1).write.parquet(str(src / f"f{i}"))
        rows = live.arriving_rows(spark, str(src / "*"), part.schema)
        drain(live.run_live(rows, bronze, root, str(tmp_path / "cp"), interval=None))
    spark.streams.removeListener(log)
    store = ResultStore(spark, root)
    stored = store.read_current("anomaly_logs")
    flagged = lambda: {(r.service_category, r.date.date()) for r in store.read_current("anomaly_logs").where("is_anomaly").collect()}
    assert {r.date.date() for r in stored.where("batch_id = '000000000001' AND is_anomaly").collect()} == {day(91)}
    assert ("compute", day(70)) in flagged() and store.read("forecast_results").count() == 2 * 2 * 90
    before = store.read("anomaly_logs").count()
    live.live_batch(spark, bronze, root)(bills(90, 93, (91,)), 1)
    assert store.read("anomaly_logs").count() == before
    assert spark.read.parquet(bronze).count() == 2 * 93


def test_live_verdicts_follow_late_rows(spark, bills, tmp_path, day):
    """Late rows change a stored verdict, and the live table ends equal to a batch run over all rows."""
    bronze, root = str(tmp_path / "bronze"), str(tmp_path / "results")
    step, store = live.live_batch(spark, bronze, root), ResultStore(spark, root)
    store.create_tables()
    low = bills(0, 90).withColumn("cost_usd", F.when((F.col("date") == F.lit(day(80))) & (F.col("service_category") == "compute"), 100.0).otherwise(F.col("cost_usd")))
    late = bills(80, 81).where("service_category = 'compute'").withColumn("cost_usd", F.col("cost_usd") - 100.0)
    step(low, 0)
    is_flagged = lambda: store.read_current("anomaly_logs").where((F.to_date("date") == F.lit(day(80))) & (F.col("service_category") == "compute")).first().is_anomaly
    assert is_flagged()
    step(late, 1)
    assert not is_flagged()
    batch = pipeline.detect(low.unionByName(late), policy=decisions.LIVE_POLICY)
    want = {(r.service_category, r.date, r.is_anomaly == 1) for r in batch.where(F.col("date") >= F.lit(day(80))).collect()}
    got = {(r.service_category, r.date.date(), r.is_anomaly) for r in store.read_current("anomaly_logs").where(F.to_date("date") >= F.lit(day(80))).collect()}
    assert got == want


def test_live_verdicts_of_all_days_follow_a_later_spike(spark, bills, tmp_path, day):
    """Later spikes push days far before them out of deviation and top share; a series with a gap; a replay."""
    bronze, root = str(tmp_path / "bronze"), str(tmp_path / "results")
    step, store = live.live_batch(spark, bronze, root), ResultStore(spark, root)
    store.create_tables()
    first, later = bills(0, 100, (40, 50)), bills(140, 150, (141, 143, 145, 147))
    later = later.withColumn("cost_usd", F.col("cost_usd") * 10).where("service_category = 'compute'")
    verdicts = lambda rows, kind: {(r.service_category, kind(r.date), bool(r.is_anomaly), r.model_votes) for r in rows.collect()}
    current = lambda: verdicts(store.read_current("anomaly_logs"), lambda d: d.date())
    step(first, 0)
    before = current()
    step(later, 1)
    want = verdicts(pipeline.detect(first.unionByName(later), policy=decisions.LIVE_POLICY), lambda d: d)
    assert any(v not in want and v[1] <= day(50) for v in before)
    assert current() == want
    rows = store.read("anomaly_logs").count()
    assert store.read("anomaly_logs").where("batch_id = '000000000001' AND service_category = 'storage'").isEmpty()
    step(later, 1)
    assert current() == want and store.read("anomaly_logs").count() == rows


def test_append_stream_continues_from_its_checkpoint(spark, bills, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    for i in range(2):
        part = bills(i, i + 1)
        part.coalesce(1).write.parquet(str(src / f"f{i}"))
        drain(live.append_stream(live.arriving_rows(spark, str(src / "*"), part.schema), out, cp, interval=None))
    assert spark.read.parquet(out).count() == 4


def test_state_grows_with_services_not_batches(spark, bills, tmp_path, day):
    """A batch reads and writes the buckets of its services only, old versions go, and no staged folder stays."""
    bronze, root = str(tmp_path / "bronze"), str(tmp_path / "results")
    step, store, state = live.live_batch(spark, bronze, root), ResultStore(spark, root), LiveState(spark, f"{bronze}-state")
    store.create_tables()
    shared = Path(shared_dir(spark)) / "ledgerlight"
    staged = lambda: {p.name for p in shared.glob("*/*")}
    before = staged()
    step(bills(0, 60, (50,)), 0)
    for i in range(1, 4):
        step(bills(59 + i, 60 + i, ()).where("service_category = 'compute'"), i)
    assert staged() == before
    known = state.before("~")
    assert sorted(known.values()) == [("000000000000", None), ("000000000003", "000000000002")]
    folders = {p.name for t in ("days", "scored", "verdicts") for p in (tmp_path / "bronze-state" / t).glob("batch_id=*/bucket=*")}
    assert len(folders) == 2 and len(list((tmp_path / "bronze-state" / "days").glob("batch_id=*/bucket=*"))) == 3
    compute = [b for b, (v, _) in known.items() if v == "000000000003"]
    read = state.read("days", state.current("days").schema, {b: known[b][0] for b in compute})
    assert all(f"batch_id=000000000003/bucket={compute[0]}" in f for f in read.inputFiles()) or "PartitionFilters" in read._jdf.queryExecution().toString()
    assert read.count() == 63 and state.current("days").count() == 123
    counts = {r.batch_id: (r.arrived, r.kept, r.rejected) for r in store.read("live_batches").where("batch_id <> 'none'").collect()}
    assert counts == {"000000000000": (120, 120, 0)} | {f"{i:012d}": (1, 1, 0) for i in (1, 2, 3)}
    moments = service_moments(state.current("moments")).orderBy("service_category").toPandas()
    plain = as_daily(state.current("days")).groupBy("service_category").agg(F.avg("total_cost").alias("a"), F.stddev_pop("total_cost").alias("s")).orderBy("service_category").toPandas()
    np.testing.assert_allclose(moments[["_avg", "_std"]].astype(float), plain[["a", "s"]].astype(float), rtol=1e-10)


def test_live_csv_keeps_rejects(spark, tmp_path):
    """A cost that is no number, a short line and an unreadable day are rejects of the live run, not zeros."""
    src = tmp_path / "in"
    src.mkdir()
    head = "date,provider,service,team,environment,resource_id,cost_usd,usage_quantity,usage_unit,region,is_anomaly"
    rest = "AWS,compute,data,prod,r1"
    lines = [head, f"2024-01-01,{rest},5.0,1,h,us,0", f"2024-01-02,{rest},abc,1,h,us,0", f"2024-01-03,{rest}", f"someday,{rest},7.0,1,h,us,0", f"2024-01-04,{rest},9.0,1,h,us,0"]
    (src / "a.csv").write_text("\n".join(lines) + "\n")
    bronze, root = str(tmp_path / "bronze"), str(tmp_path / "results")
    store = ResultStore(spark, root)
    store.create_tables()
    drain(live.run_live(live.arriving_rows(spark, str(src), BILLING, "csv"), bronze, root, str(tmp_path / "cp"), interval=None))
    reasons = sorted(r.reason for r in store.read("rejects").where("batch_id <> 'none'").collect())
    assert reasons == ["date is unreadable", "line is malformed", "line is malformed"]
    assert sorted(r.cost_usd for r in spark.read.parquet(bronze).collect()) == [5, 9]
    counts = store.read("live_batches").where("batch_id <> 'none'").first()
    assert (counts.arrived, counts.kept, counts.rejected) == (5, 2, 3)
