import pytest
from pyspark.sql import functions as F

from panewright.model import AggregationConfig, ChannelPolicy, ConfigError, MetricSpec, Rule
from panewright.operators import emit, lanes, series
from panewright.plans import batch, bundle, cel, promql
from panewright.sources import tables
from panewright.sources.registry import Schema, SchemaCache, SchemaRegistry, Settings


def bound(spark):
    b = lambda v, has, labels, flags: F.struct(F.lit(v).cast("double").alias("value"), F.lit(has).alias("has_value"), F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]).cast("map<string,string>").alias("labels"), F.array(*map(F.lit, flags)).cast("array<string>").alias("flags"))
    m = F.create_map(F.lit("a"), b(10.0, True, {"lane": "default"}, ["X"]), F.lit("none"), b(0.0, False, {}, []), F.lit("nan"), b(float("nan"), True, {}, []), F.lit("inf"), b(float("inf"), True, {}, []), F.lit("one"), b(1.0, True, {}, []))
    return spark.range(1).select(m.alias("bindings"), F.lit('{"zone": "z1", "n": 7, "tags": {"hot": true}, "loc": {"zone": "z2"}}').alias("payload"))


def holds(spark, *conditions):
    c = cel.Compiler(cel.in_map(F.col("bindings")), F.col("payload"), {"watermark_ns": F.lit(5)})
    return list(bound(spark).select(*[c.condition(cel.parse(x) if isinstance(x, str) else x).alias(f"c{k}") for k, x in enumerate(conditions)]).first())


def test_conditions_are_two_valued(spark):
    C = cel.Compare
    got = holds(
        spark, cel.Always(True), cel.HasValue("a"), cel.HasValue("none"), cel.HasValue("gone"), C("a", "gt", 5), C("a", "ge", 10), C("a", "lt", 10), C("a", "le", 10), C("a", "eq", 10), C("none", "lt", 5), C("gone", "lt", 5),
        cel.Not(C("gone", "lt", 5)), C("nan", "gt", 5), C("nan", "eq", 5), C("inf", "eq", float("inf")), cel.LabelEquals("a", "lane", "default"), cel.LabelEquals("a", "x", "y"), cel.LabelEquals("gone", "x", "y"), cel.FlagContains("a", "X"),
        cel.FlagContains("gone", "X"), cel.And(()), cel.Or(()), cel.And((cel.Always(True), cel.Always(False))), cel.Or((cel.Always(True), cel.Always(False))),
    )
    assert got == [True, True, False, False, True, True, False, True, True, False, False, True, False, False, False, True, False, False, True, False, True, False, False, True]


def test_text(spark):
    cases = {
        'f["a"].value > 2 * max(1, f["one"].value) + 7': True,
        'f["a"].value >= 3.5 * f["gone"].value': False,
        '!(f["gone"].value >= 1)': True,
        'f["a"].value / 0 > 1': False,
        'safe_div(f["a"].value, 0, 3) == 3': True,
        'clamp(f["a"].value, 0, 4) == 4 && min(3, f["a"].value) == 3': True,
        'coalesce(f["gone"].value, 2) == 2': True,
        "payload.n == 7 && payload.n < 8": True,
        'payload.zone == "z1" && payload.loc.zone != "z1"': True,
        'payload.tags["hot"] == true': True,
        "payload.tags.hot": True,
        "payload.gone == 1 || payload.gone != 1": False,
        'f["a"].labels["lane"] == "default" && f["a"].has_value': True,
        "watermark_ns >= 5 && -1 < 0": True,
        '1 + 2 * 3 == 7 && (1 + 2) * 3 == 9': True,
        '"b" > "a"': True,
    }
    assert holds(spark, *cases) == list(cases.values())


@pytest.mark.parametrize("text", ["", "1 +", 'f["a"]', 'f["a"].size', "now() > 1", "x > 1", '"a" == 1', "true < false", "1", 'f["a"].value', "(true", "clamp(1, 2) > 0", "a ? b", 'select("m", "k") > 1'])
def test_bad_text(spark, text):
    with pytest.raises(cel.CelError):
        cel.Compiler(cel.in_map(F.col("bindings")), F.col("payload")).condition(cel.parse(text))


def test_label_checks():
    e = cel.And((cel.Compare("m", "gt", 1), cel.LabelEquals("m", "region", "eu")))
    cel.check_labels(e, {"m": frozenset({"region"})})
    with pytest.raises(cel.CelError, match="region"):
        cel.check_labels(e, {"m": frozenset({"lane"})})
    with pytest.raises(cel.CelError, match="different labels"):
        cel.check_comparable(cel.parse('a["m"].labels["x"] == b["n"].labels["x"]'), {"m": ("x",), "n": ("x", "y")})


# ---------------------------------------------------------------- metric queries


def test_parse():
    q = promql.parse('sum by (player)(increase(flags_total{queue="ranked", kind!~"a|b"}[15s]))')
    assert q.descriptor == ("sum", ("player",), 15_000)
    assert q.matchers == (promql.Matcher("queue", "=", "ranked"), promql.Matcher("kind", "!~", "a|b"))
    assert promql.parse("topk(3, rate(x[1h30m])) by (z)") == promql.Query("x", (), 5_400_000, "rate", None, "topk", ("z",), 3.0)
    assert promql.parse("quantile_over_time(0.95, x[30s])").func_param == 0.95


@pytest.mark.parametrize(
    "text",
    ["", "sum(x", "sum(x) / count(y)", "sum without (a)(x)", "foo(x[1s])", "rate(x)", "topk(x)", "sum(2, x)", "quantile_over_time(x[1s])", "x[5]", "x[]", 'x{a="b"', "x{a=b}", "sum by (a(x)", "x y", "x{a~\"b\"}"],
)
def test_bad_queries(text):
    with pytest.raises(promql.PromqlError):
        promql.parse(text)


def test_durations():
    assert [promql.duration_ms(t) for t in ("15s", "1h30m", "250ms", "1.5m", "5", " ", "1y", "2w1d", "s")] == [15_000, 5_400_000, 250, None, None, 0, 365 * 86_400_000, 15 * 86_400_000, None]


def test_round_trip():
    for text in ('avg by (zone)(avg_over_time(t_c{state="ON"}[15m]))', 'quantile_over_time(0.95, l{s=~"U.*",x="a\\"b"}[30s])', "topk by (a, b)(2, x)", "rate(x[250ms])", "x"):
        q = promql.parse(text)
        assert promql.parse(promql.unparse(q)) == q


TELE = "partition_id string, log_index long, tick_ms long, metric string, value double, item string, labels map<string,string>"


def test_counters_restart(spark):
    data = [("p", i, t, "c", v, None, {"s": s}) for i, (t, v, s) in enumerate([(0, 10.0, "a"), (1000, 15.0, "a"), (2000, 3.0, "a"), (3000, 4.0, "a"), (0, 7.0, "b"), (2500, None, "b")])]
    df = spark.createDataFrame(data, TELE)
    value = lambda text: {r.pane: r.value for r in series.evaluate(df, promql.parse(text), 1000).where("by_s = 'a'").collect()} if "by" in text else None
    assert value("sum by (s)(increase(c[4s]))") == {0: None, 1: 5.0, 2: 8.0, 3: 9.0}
    assert value("sum by (s)(increase(c[2s]))") == {0: None, 1: 5.0, 2: 3.0, 3: 1.0}
    assert value("sum by (s)(rate(c[4s]))")[3] == 3.0
    b = series.evaluate(df, promql.parse("sum by (s)(increase(c[4s]))"), 1000).where("by_s = 'b'").collect()
    assert all(r.value is None for r in b)


def test_averages_of_averages_and_missing_labels(spark):
    data = [("p", 1, 0, "g", 1.0, None, {"z": "1", "s": "a"}), ("p", 2, 0, "g", 1.0, None, {"z": "1", "s": "a"}), ("p", 3, 0, "g", 4.0, None, {"z": "1", "s": "b"}), ("p", 4, 0, "g", float("nan"), None, {"z": "1"}), ("p", 5, 0, "g", 9.0, None, None)]
    df = spark.createDataFrame(data, TELE)
    got = {r.by_z: r.value for r in series.evaluate(df, promql.parse("avg by (z)(avg_over_time(g[1s]))"), 1000).collect()}
    assert got == {"1": 2.5, None: 9.0}
    assert series.evaluate(df, promql.parse('sum(sum_over_time(g{z=""}[1s]))'), 1000).first().value == 9.0
    assert series.evaluate(df.where("false"), promql.parse("sum(sum_over_time(g[1s]))"), 1000).count() == 0


# ---------------------------------------------------------------- lanes


def test_projection():
    r = lanes.project([("d", ["device"]), ("g", ["gateway", "zone", "zone"]), ("z", ["zone"]), ("u", [])], {"device": 64, "gateway": 32, "zone": 16})
    assert [(p.lanes, p.status) for p in r.projections] == [(64, "Warning"), (512, "Overflow"), (16, "Healthy"), (1, "Healthy")]
    assert r.has_overflow and r.histogram() == {"Healthy": 2, "Warning": 1, "Overflow": 1} and "| total | | 593 | Overflow |" in r.markdown()
    for bad in ({}, {"a": 0}):
        with pytest.raises(lanes.LaneError):
            lanes.project([("m", ["a"])], bad)
    four = lanes.project([(f"m{i}", ["r"]) for i in range(4)], {"r": 12})
    assert four.total == 48 and four.has_warning and not four.has_overflow


def test_admission(spark):
    keys = spark.createDataFrame([("p", i, "m", k) for i, k in enumerate(["a", "b", "c", "d", "e", "a", "e"])], "partition_id string, log_index long, metric string, lane_key string")
    got = lanes.admit(keys, 4)
    assert [r.admitted for r in got.orderBy("log_index").collect()] == [True] * 4 + [False, True, False]
    assert lanes.overflow_audits(got, 4).count() == 2


# ---------------------------------------------------------------- channels


def emissions(spark, n=2, channel="alerts"):
    return spark.createDataFrame([(1, i, 0, channel, f"evt-{i}") for i in range(1, n + 1)], "batch_id long, log_index long, rule_pos int, channel string, derived_event_id string")


def applied(spark, df, policies, **more):
    kept, drops = emit.apply_policies(df, policies, **more)
    return sorted((r.channel, r.log_index) for r in kept.collect()), sorted((r.channel, r.reason) for r in drops.collect())


def test_channel_policies(spark):
    P = ChannelPolicy
    e = emissions(spark)
    assert applied(spark, e, {}) == ([("alerts", 1), ("alerts", 2)], [])
    assert applied(spark, e, {"alerts": P("drop_oldest", 1)}) == ([("alerts", 2)], [("alerts", "QueueFullDropOldest")])
    assert applied(spark, e, {"alerts": P("block", 1)}) == ([("alerts", 1)], [("alerts", "QueueFullBlockTimeout")])
    assert applied(spark, e, {"alerts": P("dead_letter", 1, "lost")}) == ([("alerts", 2), ("lost", 1)], [("alerts", "DeadLetterOverflow")])
    assert applied(spark, e, {"alerts": P("dead_letter", 1, "alerts")}) == ([("alerts", 2)], [("alerts", "DeadLetterLoop")])
    assert applied(spark, e, {"alerts": P("dead_letter", 0, "lost"), "lost": P("drop_oldest", 1)})[0] == [("lost", 2)]
    assert applied(spark, e, {"alerts": P("drop_oldest", 0)})[0] == []
    assert applied(spark, e, {"alerts": P("drop_oldest", 0)}, keep_at_zero=True)[0] == [("alerts", 1), ("alerts", 2)]


def test_dead_letters_travel_and_loop(spark):
    P = ChannelPolicy
    chain = {"a": P("dead_letter", 1, "b"), "b": P("dead_letter", 1, "c"), "c": P("drop_oldest", 1)}
    got, drops = applied(spark, emissions(spark, 4, "a"), chain)
    assert got == [("a", 4), ("b", 3), ("c", 2)]
    assert ("c", "QueueFullDropOldest") in drops and len(drops) == 3 + 2 + 1
    loop = {"a": P("dead_letter", 0, "b"), "b": P("dead_letter", 0, "a")}
    got, drops = applied(spark, emissions(spark, 1, "a"), loop)
    assert got == [] and ("a", "DeadLetterLoop") in drops


def test_write_channels(spark, tmp_path):
    emit.write_channels(emissions(spark, 2, "kafkas://x.y"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().channel == "kafkas://x.y"


# ---------------------------------------------------------------- the whole


def event(spark, data):
    e = spark.createDataFrame(data, "log_index long, tick_ms long, event_id string, payload string, value double, lane string")
    return tables.to_events(e, F.lit("p"), F.col("log_index"), F.col("tick_ms"), F.col("event_id"), F.lit("k"), F.col("payload"), [tables.measurement("m", F.col("value"), labels={"lane": F.col("lane")})])


def test_pipeline(spark):
    e = event(spark, [(1, 100, "evt-1", "alpha", 10.0, "default"), (2, 150, "evt-2", "beta", 20.0, "default"), (3, 160, "evt-1", "alpha", 99.0, "default"), (4, 170, "evt-3", "x", 1.0, "other")])
    config = AggregationConfig((MetricSpec("total", "sum", 1000, labels=("lane",), source="m"), MetricSpec("q", "quantile", 1000, param=0.5, source="m")), 100, 1000)
    rule = Rule("r", "alerts", cel.And((cel.Compare("total", "gt", 5), cel.LabelEquals("total", "lane", "default"))), "v1", {"sum": 'f["total"].value', "who": "payload.none"}, 1, {"total": frozenset({"lane"})})
    out = batch.run(e, config, [rule])
    got = out.derived.orderBy("log_index").collect()
    assert [(r.event_id, r.payload, r.flags) for r in got] == [("evt-1", '{"sum":10.0}', ["DERIVED"]), ("evt-2", '{"sum":30.0}', ["DERIVED"])]
    assert tuple(out.stats.first()) == ("p", 4, 1, 0)
    assert len({r.derived_event_id for r in got}) == 2
    again = batch.run(e, config, [rule]).derived.collect()
    assert {r.derived_event_id for r in again} == {r.derived_event_id for r in got}
    with pytest.raises(cel.CelError):
        batch.run(e, config, [Rule("r", "a", cel.LabelEquals("total", "region", "x"), allowed_labels={"total": frozenset({"lane"})})])


def test_late_measurements_are_bound_without_a_value(spark):
    e = event(spark, [(1, 10_000, "evt-1", "", 1.0, "d"), (2, 100, "evt-2", "", 2.0, "d")])
    out = batch.run(e, AggregationConfig((MetricSpec("m", "quantile", 1000, param=0.5),), 100, 1000), [], lateness_ms=0, guard_ms=0)
    b = {r.log_index: r.bindings["m"] for r in out.bindings.collect()}
    assert b[1].has_value and b[1].value == 1.0
    assert not b[2].has_value and b[2].flags == ["NON_RETRACTABLE_DROPPED"]
    assert [r.event_id for r in out.audits.collect()] == ["evt-2"]


def test_empty_log(spark):
    e = event(spark, []).where("false")
    out = batch.run(e, AggregationConfig((MetricSpec("m", "sum", 100),), 100, 100), [Rule("r", "c", cel.Always(True))], {"c": ChannelPolicy("block", 1)})
    assert out.derived.count() == 0 and out.drops.count() == 0


FLOW = {
    "bundle": {"name": "b", "lane_domains": {"zone": {"max_per_partition": 8}}},
    "workflow": {"phases": [
        {"name": "fast", "type": "aggregate.promql", "options": {"window": "2s", "queries": {"hot": {"expression": 'max by (zone)(max_over_time(temp{state="ON"}[2s]))'}}}},
        {"name": "slow", "type": "aggregate.promql", "options": {"window": "10s", "queries": {"usual": {"expression": "avg by (zone)(avg_over_time(temp[10s]))"}}}},
        {"name": "judge", "type": "classify.cel", "options": {"bindings": {"f": "phase.fast.metrics", "s": "phase.slow.metrics"}, "rules": [
            {"name": "heat", "when": 's["usual"].labels["zone"] == payload.zone && f["hot"].value > s["usual"].value + 5', "emit": {"channel": "out", "payload": {"zone": "payload.zone", "peak": 'f["hot"].value'}}}]}},
    ]},
}


def test_bundle_runs(spark):
    data = [("p", 1, 0, 20.0, "a"), ("p", 2, 1000, 21.0, "a"), ("p", 3, 2000, 40.0, "a"), ("p", 4, 2000, 20.0, "b")]
    t = spark.createDataFrame([(p, i, k, "temp", v, None, {"zone": z, "state": "ON"}) for p, i, k, v, z in data], TELE)
    e = spark.createDataFrame([(p, i, k, {}, f'{{"zone": "{z}"}}', f"e{i}", "k", "s") for p, i, k, v, z in data], "partition_id string, log_index long, tick_ms long, labels map<string,string>, payload string, event_id string, partition_key string, schema_key string")
    got = bundle.run(bundle.load(FLOW), t, e, 1000).collect()
    assert [(r.log_index, r.payload, r.channel) for r in got] == [(3, '{"zone":"a","peak":40.0}', "out")]


def test_bundles_judge_by_what_was_known(spark):
    doc = {"bundle": {"name": "b", "lane_domains": {"zone": {"max_per_partition": 8}}}, "workflow": {"phases": [
        {"name": "m", "type": "aggregate.promql", "options": {"window": "1s", "queries": {"s": "sum by (zone)(sum_over_time(temp[1s]))", "any": "max_over_time(temp[1s])"}}},
        {"name": "judge", "type": "classify.cel", "options": {"rules": [
            {"name": "full", "when": 'm["s"].value > 35', "emit": {"channel": "out", "payload": {"at": "window_end_ns"}}},
            {"name": "one", "when": 'm["any"].has_value', "emit": {"channel": "ones"}}]}},
    ]}}
    data = [(1, 10, 10.0, "u1"), (2, 20, 10.0, "u1"), (3, 30, 10.0, "u2"), (4, 40, 10.0, "u2")]
    t = spark.createDataFrame([("p", i, k, "temp", v, None, {"zone": "a", "user": u}) for i, k, v, u in data], TELE)
    e = spark.createDataFrame([("p", i, k, {}, '{"zone": "a"}', f"e{i}", "k", "s") for i, k, _, _ in data], "partition_id string, log_index long, tick_ms long, labels map<string,string>, payload string, event_id string, partition_key string, schema_key string")
    got = bundle.run(bundle.load(doc), t, e, 1000).collect()
    assert [(r.log_index, r.payload) for r in got if r.rule_id == "full"] == [(4, '{"at":1000000000}')]
    assert sorted(r.log_index for r in got if r.rule_id == "one") == [1, 2]  # from the third event on two series answer


def test_metric_queries_as_of_each_event(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.choice(["p", None]), i, rng.randrange(40), rng.choice([None, 1.0, 2.0, 5.0, 9.0]), rng.choice(["a", "b", None]), rng.choice("xyz")) for i in range(200)]
    t = spark.createDataFrame([(p, i, k * 100, "m", v, u, {"z": z, "u": u}) for p, i, k, v, z, u in rows], TELE)
    events = spark.createDataFrame([(p, i, k // 5, z) for p, i, k, _, z, _ in rows], "partition_id string, log_index long, pane long, by_z string")
    mean = lambda v: sum(v) / len(v) if v else None
    inner = {"avg": mean, "sum": lambda v: sum(v) if v else None, "min": lambda v: min(v, default=None), "max": lambda v: max(v, default=None)}
    for outer in ("sum", "avg", "count", "min", "max"):
        for func in ("avg", "sum", "min", "max"):
            got = series.evaluate_events(t, promql.parse(f"{outer} by (z)({func}_over_time(m[2s]))"), 500, events, "v").collect()
            assert len(got) == len(rows)
            told = {r.log_index: r.v.value for r in got}
            for p, i, k, _, z, _ in rows:
                kept: dict = {}
                for p2, i2, k2, v2, z2, u2 in rows:
                    if (p, z) == (p2, z2) and k // 5 - 4 < k2 // 5 <= k // 5 and (k2 // 5 < k // 5 or i2 <= i):
                        kept.setdefault(u2, []).extend([] if v2 is None else [v2])
                values = [x for x in (inner[func](v) for v in kept.values()) if x is not None]
                want = float(len(values)) if outer == "count" else inner[outer](values)
                assert (told[i] is None) == (want is None) and (want is None or abs(told[i] - want) < 1e-9), (outer, func, i)


def test_bundle_checks():
    import copy

    ok = bundle.validate(bundle.load(FLOW))
    assert ok.queries["fast.hot"].by == ("zone",) and ok.lanes.total == 16 and not ok.warnings

    def broken(change):
        doc = copy.deepcopy(FLOW)
        change(doc["bundle"], doc["workflow"]["phases"])
        return bundle.load(doc)

    cases = [
        (lambda b, p: b.update(lane_domains={}), bundle.BundleError), (lambda b, p: [x["options"].pop("queries", None) for x in p], bundle.BundleError),
        (lambda b, p: p.append({"name": "x", "type": "source.channel", "options": {"channels": ["out"]}}), bundle.ChannelLoop),
        (lambda b, p: b["lane_domains"].update(other={"max_per_partition": 1}) or b["lane_domains"].pop("zone"), lanes.LaneError),
        (lambda b, p: b["lane_domains"]["zone"].update(max_per_partition=65), lanes.LaneError), (lambda b, p: p[0]["options"].update(window="3s"), bundle.BundleError),
        (lambda b, p: p[0]["options"]["queries"]["hot"].update(expression="sum(("), promql.PromqlError), (lambda b, p: p[2]["options"]["rules"][0].update(when='f["cold"].value > 1'), cel.CelError),
        (lambda b, p: p[2]["options"]["rules"][0].update(when='f["hot"].labels["room"] == "1"'), cel.CelError),
    ]
    for change, error in cases:
        with pytest.raises(error):
            bundle.validate(broken(change))
    assert bundle.validate(broken(lambda b, p: p[0]["options"].update(window="3s")), strict=False).warnings
    assert bundle.load("bundle: {name: x}\nworkflow: {phases: []}").name == "x"


def test_phase_types_and_checkpoints():
    import copy

    def with_phase(kind, **options):
        doc = copy.deepcopy(FLOW)
        doc["workflow"]["phases"].append({"name": "keep", "type": kind, "options": options})
        return bundle.load(doc)

    good = with_phase("sink.checkpoint", full_interval="30s", incremental_interval="10s", include=["fast", "slow"])
    assert bundle.validate(good).checkpoints == {"keep": (30_000, 10_000)}
    assert bundle.validate(with_phase("sink.checkpoint")).checkpoints == {"keep": (None, None)}
    for kind, options in (("sink.chekpoint", {}), ("sink.checkpoint", {"full_interval": "10s"}), ("sink.checkpoint", {"incremental_interval": "6m"}), ("sink.checkpoint", {"full_interval": "soon"}), ("sink.checkpoint", {"include": ["none"]})):
        with pytest.raises(bundle.BundleError):
            bundle.validate(with_phase(kind, **options))
    assert bundle.validate(with_phase("sink.checkpoint", full_interval="10s"), strict=False).warnings


def test_null_keys_and_repeated_rows_pass_the_pipeline(spark):
    e = event(spark, [(1, 100, None, "a", 1.0, "d"), (1, 100, None, "a", 1.0, "d"), (2, 150, "x", "b", 2.0, "d"), (3, 160, "y", "c", None, "d")])
    e = e.withColumn("partition_id", F.when(F.col("log_index") != 2, F.col("partition_id"))).withColumn("measurements", F.when(F.col("log_index") != 3, F.col("measurements")))
    out = batch.run(e, AggregationConfig((MetricSpec("m", "sum", 1000),), 100, 1000), [Rule("r", "c", cel.Always(True))])
    got = sorted(((r.log_index, r.partition_id, r.bindings["m"].value if r.bindings else None) for r in out.bindings.collect()), key=str)
    assert [x[0] for x in got] == [1, 1, 2, 3] and sorted(x[2] for x in got if x[0] == 1) == [1.0, 2.0] and (2, None, 2.0) in got and (3, "p", None) in got
    assert out.derived.count() == 4


def test_lint(tmp_path, capsys):
    import yaml

    from panewright.lint import lint

    (tmp_path / "b.yaml").write_text(yaml.safe_dump(FLOW))
    assert lint(str(tmp_path / "b.yaml")) == 0 and "| total | | 16 | Healthy |" in capsys.readouterr().out
    (tmp_path / "c.yaml").write_text("bundle: {name: x}")
    assert lint(str(tmp_path / "c.yaml")) == 1 and lint(str(tmp_path / "none.yaml")) == 1


def test_registries():
    r = SchemaRegistry()
    r.register("k", "json:1.0:aa")
    r.register("k", "json:1.1:bb")
    for bad in ("json:2.0:cc", "json:1.0:aa", "protobuf:1.2:cc", "json:1.1:cc"):
        with pytest.raises(ConfigError):
            r.register("k", bad)
        assert not r.usable("k")
        r.register("k", "json:1.1:bb")
        assert r.usable("k")
    cache = SchemaCache(lambda k: Schema("json", 1, 0, k), 2)
    for k in "abac":
        cache.get(k)
    assert (cache.hits, cache.misses, list(cache.held)) == (1, 3, ["a", "c"])
    s = Settings({"a": 1, "b": 2}, {"b": "restart"})
    assert s.change({"a": 1, "b": 3}) == "restart" and s.change({"a": 5}) == "hot"
    assert s.rollback(1) == {"a": 1, "b": 2} and s.version == 4
