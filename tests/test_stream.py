import pytest
from pyspark.sql import functions as F

from panewright.functions.aggregates import Family
from panewright.model import EVENT, AggregationConfig, MetricSpec
from panewright.operators import dedup, sequence, timesem, windows
from panewright.sources import tables
from panewright.streaming import stream


@pytest.fixture(scope="module")
def logged(spark, sf_dir, tmp_path_factory):
    """The events in ten files, in log order, with some retried ids."""
    path = str(tmp_path_factory.mktemp("log"))
    e = tables.read_events_table(spark, sf_dir, 4).withColumn("event_id", F.when(F.col("log_index") % 17 == 0, F.concat(F.lit("evt-"), F.col("log_index") - 8)).otherwise(F.col("event_id")))
    for k in range(10):
        e.where(F.floor(F.col("log_index") / 100) == k).coalesce(1).write.mode("append").parquet(path)
    return path


HOUR = 3_600_000


@pytest.mark.parametrize("mode", ["event", "head"])
def test_event_stream_equals_batch(spark, logged, tmp_path, mode):
    """Late ticks, and with head panes ticks out of order; retries with other payloads, null ids; and a restart from the checkpoint halfway."""
    stream.use_rocksdb(spark)
    config = AggregationConfig((MetricSpec("total", "sum", 6 * HOUR, correction_ms=HOUR, source="value"), MetricSpec("mid", "quantile", 3 * HOUR, correction_ms=HOUR, param=0.5, source="value"), MetricSpec("who", "distinct", 2 * HOUR, correction_ms=HOUR, source="value")), HOUR, 6 * HOUR, pane_assignment=mode)
    i = F.col("log_index")
    e = tables.read_files(spark, logged)
    e = e.withColumn("tick_ms", F.col("tick_ms") - F.when((i % 5 == 0) & F.lit(mode == "head"), 2 * HOUR).when(i % 7 == 0, 30 * HOUR).otherwise(0)).withColumn("event_id", F.when(i % 19 != 0, F.col("event_id"))).withColumn("payload", F.when(i % 34 != 0, F.lit("p")))
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    for k in range(10):
        if k == 6:
            _run(spark, path, config, tmp_path, out)
        e.where(F.floor(i / 100) == k).coalesce(1).write.mode("append").parquet(path)
    _run(spark, path, config, tmp_path, out)
    got = {(r.log_index, r.spec): r.result for r in spark.read.parquet(out).collect()}
    judged = timesem.judge(dedup.fresh(dedup.decide(tables.read_files(spark, path), 2 * HOUR)), config.specs, 3 * HOUR, 0)
    rows = windows.with_pane(windows.explode_measurements(judged), HOUR)
    if mode == "head":
        rows = sequence.running_max(rows, {"_head": F.col("pane")}).withColumn("pane", F.col("_head")).drop("_head")
    want = {(r.log_index, r.spec): r.result for r in windows.evaluate(rows, config).collect()}
    assert 1500 < len(want) < 3 * e.count() - 200 and set(got) == set(want)
    assert all(got[k] == (None if v is None else pytest.approx(v)) for k, v in want.items())


def _run(spark, path, config, tmp_path, out):
    live = stream.event_stream(tables.stream_files(spark, path, files_per_trigger=3), config, 2 * HOUR, 3 * HOUR, 0)
    stream.write_parquet(live, str(tmp_path / "cp"), out).awaitTermination()


def test_pane_stream_equals_batch(spark, logged, tmp_path):
    live = stream.pane_stream(tables.stream_files(spark, logged), HOUR, 0)
    stream.write_parquet(live, str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination()
    got = {(r.partition_id, r.pane): (round(r.s, 6), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    rows = windows.with_pane(windows.explode_measurements(tables.read_files(spark, logged)), HOUR)
    states = windows.pane_states(rows, Family("sum")).join(windows.pane_states(rows, Family("count")), ["partition_id", "metric", "lane", "pane"])
    want = {(r.partition_id, r.pane): (round(r.s, 6), r.n) for r in states.collect()}
    assert len(got) > 0.9 * len(want) and all(want[k] == v for k, v in got.items())


def test_batches_and_retries(spark, logged, tmp_path):
    seen = []
    s = stream.drop_retries(tables.stream_files(spark, logged), 30 * 86_400_000)
    stream.write_batches(s, str(tmp_path / "cp"), lambda df, k: seen.append(df.count())).awaitTermination()
    assert sum(seen) == tables.read_files(spark, logged).select("partition_id", "event_id").distinct().count()


def test_schema_and_builtin_measurements(spark, logged):
    e = tables.read_files(spark, logged)
    assert [f.name for f in e.schema.fields] == [f.name for f in EVENT.fields]
    names = [m.metric for m in tables.builtin_measurements(e).first().measurements]
    assert names == ["value", "ingest_events_total", "ingest_payload_bytes"]
    assert tables.telemetry(e).count() == e.count()
