import random

import pytest
from pyspark.sql import functions as F

from panewright.functions.aggregates import Family
from panewright.model import AggregationConfig, ConfigError, MetricSpec, ring_budget, upgrade_allowed
from panewright.operators import tiers, windows

SCHEMA = "partition_id string, log_index long, tick_ms long, metric string, lane int, value double, item string, ord int"


def rows(spark, data):
    """data: (log_index, tick, value, item)"""
    return spark.createDataFrame([("p", i, t, "m", 0, v, x, 0) for i, t, v, x in data], SCHEMA)


def per_event(df, kind, panes, pane_ms, param=None, head=False):
    r = windows.with_head(df, pane_ms) if head else windows.with_pane(df, pane_ms)
    return [x.result for x in windows.sliding_events(r, Family(kind, param), panes).orderBy("log_index").collect()]


def test_sliding_sum_forgets_old_panes(spark):
    df = rows(spark, [(1, 100, 5.0, None), (2, 150, 3.0, None), (3, 450, 7.0, None)])
    assert per_event(df, "sum", 2, 100) == [5.0, 8.0, 7.0]


def test_distinct_over_panes(spark):
    df = rows(spark, [(1, 50, None, "user-a"), (2, 75, None, "user-b"), (3, 125, None, "user-c")])
    assert per_event(df, "distinct", 4, 50)[-1] == 3.0


ITEMS = [(1, 0, 1.0, "a"), (2, 1, 2.0, "b"), (3, 2, 3.0, "a"), (4, 3, 4.0, "c")]


@pytest.mark.parametrize(
    ("kind", "param", "expected"),
    [("avg", None, 2.5), ("min", None, 1.0), ("max", None, 4.0), ("quantile", 0.5, 3.0), ("quantile", 0.95, 4.0), ("quantile", 7.0, 4.0), ("topk", 2, 4.0), ("topk", 0, None), ("distinct", None, 3.0), ("sum", None, 10.0), ("count", None, 4.0)],
)
def test_kinds(spark, kind, param, expected):
    assert per_event(rows(spark, ITEMS), kind, 1, 100, param)[-1] == expected


def test_null_values(spark):
    df = rows(spark, [*ITEMS, (5, 4, None, None)])
    assert per_event(df, "sum", 1, 100)[-1] == 10.0
    assert per_event(df, "count", 1, 100)[-1] == 5.0
    assert per_event(rows(spark, [(1, 0, None, None)]), "quantile", 1, 100, 0.5) == [None]
    assert per_event(rows(spark, [(1, 0, None, None)]), "sum", 1, 100) == [0.0]
    assert per_event(rows(spark, [(1, 0, float("nan"), "a"), (2, 1, 2.0, "a")]), "max", 1, 100) == [None, 2.0]


def test_topk_entries(spark):
    got = windows.topk_entries(windows.with_pane(rows(spark, ITEMS), 100), 2)
    assert [(r.item, r.value, r.place) for r in got.orderBy("place").collect()] == [("c", 4.0, 1), ("a", 3.0, 2)]


def test_lanes(spark):
    df = spark.range(1).select(windows.lanes(F.lit(5)).alias("a"), windows.lanes(F.lit(0)).alias("b"), windows.lanes(F.lit(-1 << 63)).alias("c"), windows.lanes(F.lit(None)).alias("d"))
    assert tuple(df.first()) == ([0, 2], [0], [63], [0])
    mask = spark.createDataFrame([(0,), (2,)], "lane int").agg(windows.lane_mask(F.col("lane")).alias("m")).first().m
    assert mask == 5


def test_head_mode_puts_late_events_into_the_head(spark):
    df = rows(spark, [(1, 450, 1.0, None), (2, 120, 2.0, None)])
    assert per_event(df, "sum", 1, 100, head=True) == [1.0, 3.0]
    assert per_event(df, "sum", 1, 100) == [1.0, 2.0]


def model(data, kind, w, pane_ms, q):
    """Panes as dictionaries, one event at a time."""
    panes, head, out = {}, 0, []
    for _, t, v, x in data:
        head = max(head, t // pane_ms)
        panes.setdefault(head, []).append((v, x))
        got = [e for p in range(head - w + 1, head + 1) for e in panes.get(p, [])]
        vs = [v for v, _ in got if v is not None]
        out.append({
            "sum": lambda: sum(vs), "count": lambda: len(got), "avg": lambda: sum(vs) / len(vs) if vs else None, "min": lambda: min(vs, default=None), "max": lambda: max(vs, default=None),
            "quantile": lambda: sorted(vs)[int(q * (len(vs) - 1) + 0.5)] if vs else None, "topk": lambda: max((v for v, x in got if v is not None and x is not None), default=None),
            "distinct": lambda: len({x for _, x in got if x is not None}),
        }[kind]())
    return out


@pytest.mark.parametrize("kind", ["sum", "count", "avg", "min", "max", "quantile", "topk", "distinct"])
def test_against_a_model(spark, kind):
    rng = random.Random(kind)
    data, t = [], 0
    for i in range(300):
        t += rng.randint(0, 60)
        data.append((i, max(0, t - (rng.randint(0, 400) if rng.random() < 0.2 else 0)), rng.choice([None, float(rng.randint(0, 50))]), rng.choice([None, "a", "b", "c", "d"])))
    got = per_event(rows(spark, data), kind, 4, 100, 3 if kind == "topk" else 0.3, head=True)
    for a, b in zip(got, model(data, kind, 4, 100, 0.3), strict=True):
        assert a == (None if b is None else pytest.approx(b))


@pytest.mark.parametrize("kind", ["sum", "count", "avg", "min", "max", "quantile", "topk", "distinct"])
def test_tiers_agree_with_one_pass(spark, kind):
    data = [(i, 100 * i, float(i), f"u{i % 3}") for i in range(1, 7)]
    f = Family(kind, 0.5 if kind == "quantile" else 2)
    states = windows.pane_states(windows.with_pane(rows(spark, data), 100), f)
    whole = tiers.cross_tier(states.where("false"), states, f).first().value
    for ring in (1, 3, 10):
        old, live = tiers.split(states, 100, ring)
        assert tiers.cross_tier(tiers.compact(old, f), live, f).first().value == whole
    if kind == "sum":
        assert whole == 21.0


def test_frontier(spark):
    states = windows.pane_states(windows.with_pane(rows(spark, [(i, 100 * i, float(i), None) for i in range(1, 5)]), 100), Family("sum"))
    assert tiers.frontier(states, 100, 2).first().frontier_ms == 300
    assert tiers.range_query(states.where("pane < 3"), states.where("pane >= 3"), Family("sum"), 2, 4).first().value == 5.0


def test_tier_files_prune_by_day(spark, tmp_path):
    states = windows.pane_states(windows.with_pane(rows(spark, [(i, 86_400_000 * i, 1.0, None) for i in range(5)]), 3_600_000), Family("sum"))
    tiers.write_tier(states, str(tmp_path / "t"), 3_600_000)
    got = tiers.read_tier(spark, str(tmp_path / "t"), 86_400_000, 2 * 86_400_000)
    assert got.count() == 2
    assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().toString()


def test_config_errors():
    ok = AggregationConfig((MetricSpec("a", "sum", 400),), 100, 500, 400)
    assert ok.checked().ring_panes == 5
    with pytest.raises(ConfigError, match="retract"):
        AggregationConfig((MetricSpec("a", "topk", 100, late_policy="retract"),), 100).checked()
    with pytest.raises(ConfigError, match="ring"):
        AggregationConfig((MetricSpec("a", "sum", 400),), 100, 200, 200).checked()
    budget = ring_budget(AggregationConfig((MetricSpec("a", "sum", 400),), 100, 500, 400), 32, 64, 1 << 20)
    assert (budget.longest_ms, budget.panes, budget.slots, budget.bytes) == (500, 5, 160, 10_240)
    with pytest.raises(ConfigError, match="budget"):
        ring_budget(AggregationConfig((MetricSpec("a", "sum", 400),), 100, 500, 400), 64, 1024, 512)
    assert upgrade_allowed(1, 2) and not upgrade_allowed(2, 4)
