import pytest
from pyspark.sql import functions as F

from panewright.model import ConfigError
from panewright.operators import dedup, sequence


def events(spark, data, schema):
    return spark.createDataFrame([("p", *d) for d in data], f"partition_id string, {schema}")


def test_fnv_and_route(spark):
    def fnv(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = (h ^ x) * 0x100000001B3 % 2**64
        return h

    keys = ["", "a", "foobar", "ключ", "x" * 300, None]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", sequence.fnv1a(F.col("k")).alias("h")).collect()
    assert {r.k: r.h for r in got} == {k: None if k is None else (fnv(k.encode()) + 2**63) % 2**64 - 2**63 for k in keys}
    names = ["p0", "p1", "p2"]
    routed = sequence.route(spark.createDataFrame([(k,) for k in keys if k is not None], "k string"), F.col("k"), names, exact=True).collect()
    assert all(r.partition_id == names[fnv(r.k.encode()) % 3] for r in routed)


def test_topology():
    sequence.check_topology([("a", ["x", "y", "z"])])
    for bad in ([], [("", None)], [("a", None), ("a", None)], [("a", ["x"])], [("a", ["x", "x", "y"])]):
        with pytest.raises(ConfigError):
            sequence.check_topology(bad)


def test_ticks(spark):
    df = events(spark, [(i, m) for i, m in enumerate([1000, 1000, 1000, 1500, 1500, 900])], "log_index long, ms long")
    assert [r.tick_ms for r in sequence.commit_ticks(df, "ms").orderBy("log_index").collect()] == [1000, 1001, 1002, 1500, 1501, 1502]
    assert [r.tick_ms for r in sequence.replay_ticks(df, "ms").orderBy("log_index").collect()] == [0, 1, 2, 500, 501, 502]
    assert tuple(sequence.last_tick(df.withColumn("tick_ms", F.col("ms")), 2).first()) == ("p", 5, 900)


def test_rate(spark):
    df = events(spark, [(1, 1000), (2, 2000), (3, 3200)], "log_index long, tick_ms long")
    got = [r.rate for r in sequence.commit_rate(df).orderBy("log_index").collect()]
    assert got[0] is None and got[1:] == pytest.approx([1.0, 0.2 * 1000 / 1200 + 0.8])
    ticks, t = [], 0
    for i in range(2000):
        t += 1 + i * 7919 % 90
        ticks.append((i, t))
    want, rate = [], None
    for (_, a), (_, b) in zip(ticks, ticks[1:], strict=False):
        x = 1000 / max(b - a, 1)
        rate = x if rate is None else 0.2 * x + 0.8 * rate
        want.append(rate)
    got = sequence.commit_rate(events(spark, ticks, "log_index long, tick_ms long")).orderBy("log_index").collect()
    assert [r.rate for r in got][1:] == pytest.approx(want)


@pytest.mark.parametrize("alpha", [0.001, 0.05, 0.9, 0.99, 0.99999, 1.0])
def test_rate_of_any_alpha_and_from_a_snapshot(spark, alpha):
    ticks, t = [], 0
    for i in range(3000):
        t += 1 + i * 7919 % 90
        ticks.append((i, t))
    want, rate = [None], None
    for (_, a), (_, b) in zip(ticks, ticks[1:], strict=False):
        x = 1000 / max(b - a, 1)
        rate = x if rate is None else alpha * x + (1 - alpha) * rate
        want.append(rate)
    df = events(spark, ticks, "log_index long, tick_ms long")
    assert [r.rate for r in sequence.commit_rate(df, alpha).orderBy("log_index").collect()][1:] == pytest.approx(want[1:])
    seed = spark.createDataFrame([("p", ticks[999][1], want[999])], "partition_id string, tick_ms long, rate double")
    rest = sequence.commit_rate(df.where("log_index >= 1000"), alpha, seed)
    assert rest.columns == ["partition_id", "log_index", "tick_ms", "rate"]
    assert [r.rate for r in rest.orderBy("log_index").collect()] == pytest.approx(want[1000:])


def test_alpha_out_of_range(spark):
    for alpha in (0, -1, 1.1):
        with pytest.raises(ConfigError):
            sequence.commit_rate(events(spark, [(1, 1)], "log_index long, tick_ms long"), alpha)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_chunks_of_a_log(spark, chunk):
    import random

    rng = random.Random(chunk)
    data = [(i, rng.randint(0, 500)) for i in range(0, 300, 3)]
    df = events(spark, data, "log_index long, ms long").unionByName(spark.createDataFrame([(None, 5, 7), (None, 9, 3)], "partition_id string, log_index long, ms long"))
    got = sequence.running_max(df, {"top": F.col("ms"), "odd": F.when(F.col("ms") % 2 == 1, F.col("ms"))}, chunk).collect()
    mine = {r.log_index: r for r in got if r.partition_id}
    assert all(mine[i].top == max(m for j, m in data if j <= i) and mine[i].odd == max((m for j, m in data if j <= i and m % 2), default=None) for i, _ in data)
    assert sorted((r.log_index, r.top) for r in got if r.partition_id is None) == [(5, 7), (9, 7)]
    last, want = None, []
    for _, m in data:
        last = m if last is None else max(m, last + 1)
        want.append(last)
    assert [r.tick_ms for r in sequence.commit_ticks(df, "ms", chunk=chunk).where("partition_id is not null").orderBy("log_index").collect()] == want


def test_equal_rows_and_null_partitions_are_kept(spark):
    df = spark.createDataFrame([(None, 1, 10, "a", "x"), (None, 2, 20, "a", "x"), ("p", 3, 30, "b", "x"), ("p", 3, 30, "b", "x")], "partition_id string, log_index long, tick_ms long, event_id string, payload string")
    got = sorted((r.log_index, r.decision) for r in dedup.decide(df, 100).collect())
    assert got == [(1, "Fresh"), (2, "Duplicate"), (3, "Duplicate"), (3, "Fresh")]


def test_capacity_reconciler(spark):
    df = events(spark, [(1, 0, 10.0), (2, 10_000, 99.0), (3, 30_000, 20.5), (4, 60_000, 5.0), (5, 90_000, 30.0)], "log_index long, tick_ms long, rate double")
    assert [(r.tick_ms, r.capacity) for r in sequence.reconcile_capacity(df).orderBy("tick_ms").collect()] == [(0, 10), (30_000, 21), (90_000, 30)]


def test_last_writer(spark):
    df = events(spark, [(1, "k", 10), (2, "k", 8), (3, "k", 11), (4, "o", 1)], "log_index long, partition_key string, seqno long")
    got = sequence.last_writer_wins(df).orderBy("log_index").collect()
    assert [(r.applied, r.last_seq) for r in got] == [(True, None), (False, 10), (True, 10), (True, None)]


def test_versions(spark):
    df = events(spark, [(i,) for i in range(6)], "log_index long")
    assert [r.v for r in df.select("log_index", sequence.select_version(F.col("log_index"), 1, 2, 4).alias("v")).orderBy("log_index").collect()] == [1, 1, 1, 1, 2, 2]
    v = spark.createDataFrame([("p", 2, 7), ("p", 5, 8)], "partition_id string, barrier long, version long")
    assert [r.version for r in sequence.versions_as_of(df, v).orderBy("log_index").collect()] == [0, 0, 7, 7, 7, 8]


def test_retention(spark):
    s = spark.createDataFrame([(5, 9, 1000, 10, 2.5, 4)], "full_floor long, incremental_floor long, horizon long, retry_s long, rate double, learner_floor long")
    r = sequence.retention_plan(s).first()
    assert (r.floor, r.dedup_floor, r.retain_from, r.learner_floor) == (9, 975, 975, 975)


DEDUP = "log_index long, tick_ms long, event_id string, payload string"


def test_retry_window(spark):
    df = events(spark, [(1, 1000, "a", "x"), (2, 2000, "a", "x"), (3, 5100, "a", "x"), (4, 5200, "a", "x"), (5, 100, "b", "x"), (6, 200, "b", "y"), (7, 300, None, None), (8, 301, None, None)], DEDUP)
    got = dedup.decide(df, 2000)
    assert [r.decision for r in got.orderBy("log_index").collect()] == ["Fresh", "Duplicate", "RetryExpired", "Fresh", "Fresh", "Divergent", "Fresh", "Fresh"]
    assert tuple(dedup.counters(got).first()) == ("p", 8, 3, 1)
    assert dedup.fresh(got).count() == 5


def test_touch_extends_the_window(spark):
    df = events(spark, [(i, 1500 * i, "a", "x") for i in range(5)], DEDUP)
    assert [r.decision for r in dedup.decide(df, 2000).orderBy("log_index").collect()] == ["Fresh"] + ["Duplicate"] * 4
