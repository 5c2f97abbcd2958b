from pyspark.sql import functions as F

from panewright.model import MetricSpec
from panewright.operators import timesem

SCHEMA = "partition_id string, log_index long, tick_ms long, arrival_ms long, event_id string, metric string"


def rows(spark, data):
    """data: (log_index, tick, arrival, metric)"""
    return spark.createDataFrame([("p", i, t, a, f"evt-{i}", m) for i, t, a, m in data], SCHEMA)


def test_late_events_of_metrics_that_cannot_retract(spark):
    df = rows(spark, [(1, 1000, 2000, "metric"), (2, 900, 2000, "metric"), (3, 900, 2000, "unknown")])
    got = timesem.mark_late(df, [MetricSpec("metric", "quantile", 100)], 0, 0)
    assert [r.late for r in got.orderBy("log_index").collect()] == [False, True, False]
    assert [(r.event_id, r.reason) for r in timesem.audits(got).collect()] == [("evt-2", "NON_RETRACTABLE_FINALIZED")]
    assert timesem.dropped_metrics(got).first().dropped == ["metric"]
    quiet = timesem.mark_late(df, [MetricSpec("metric", "sum", 100)], 0, 0)
    assert quiet.where("late").count() == 1 and timesem.audits(quiet).count() == 0


def test_correction_horizon_and_strictness(spark):
    df = rows(spark, [(1, 1000, None, "m"), (2, 900, None, "m"), (3, 899, None, "m")])
    got = timesem.mark_late(df, [MetricSpec("m", "sum", 100, correction_ms=100)], 0, 0)
    assert [r.late for r in got.orderBy("log_index").collect()] == [False, False, True]


def test_a_metric_with_its_own_lateness(spark):
    df = rows(spark, [(1, 5000, None, "a"), (2, 4500, None, "a"), (3, 4500, None, "b")])
    specs = [MetricSpec("a", "sum", 100, lateness_ms=200), MetricSpec("b", "sum", 100)]
    got = timesem.mark_late(df, specs, 2000, 0).orderBy("log_index").collect()
    assert [r.late for r in got] == [False, True, False]


def test_skew(spark):
    df = rows(spark, [(1, 10_000, 0, "m"), (2, 0, 2_000_000, "m"), (3, 10, 10, "m"), (4, 10, None, "m"), (5, 5_000, 0, "m")])
    got = timesem.skew(df)
    by = {r.log_index: r.skew for r in got.collect()}
    assert by[1] == "FUTURE_SKEW" and by[3] is None and by[4] is None and by[5] is None
    assert by[2] == "PAST_SKEW"
    assert [(r.metric, r.event_id) for r in timesem.skew_audits(got).collect()] == [("__partition__", "evt-1")]


def test_watermark(spark):
    df = rows(spark, [(1, 3000, 300, "m"), (2, 3200, 500, "m")])
    assert [r.watermark_ms for r in timesem.trace(df).orderBy("log_index").collect()] == [100, 300]
    alone = timesem.trace(rows(spark, [(1, 3000, None, "m"), (2, 900, None, "m")]), arrival=False).orderBy("log_index").collect()
    assert [(r.watermark_ms, r.lateness_ms, r.lag_ms) for r in alone] == [(1000, 0, 2000), (1000, 100, 2000)]


def test_decoration(spark):
    df = spark.range(1).select(timesem.decorate(F.array(F.lit("A")), F.lit("metric.late"), F.array(F.lit("metric.late"))).alias("x"), timesem.decorate(F.array(F.lit("A")), F.lit("other"), F.lit(None)).alias("y"))
    assert tuple(df.first()) == (["A", "NON_RETRACTABLE_DROPPED"], ["A"])


def test_horizon_and_stall(spark):
    wm = spark.createDataFrame([("p", "a", 120, 10), ("p", "b", 150, 30)], "partition_id string, metric string, watermark_ms long, correction_ms long")
    assert timesem.finalized_horizon(wm).first().finalized_ms == 110
    lag = lambda applied: spark.range(1).select(timesem.stalled(F.lit(200), F.lit(10), F.lit(applied), F.lit(30)).alias("x")).first().x
    assert lag(300) == 110 and lag(200) is None
