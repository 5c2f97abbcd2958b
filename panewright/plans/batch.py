"""The whole batch pipeline: dedup and lateness once, then panes, bindings, rules and channels as one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DROPPED_FLAG, LATE_REASON, AggregationConfig, ChannelPolicy, MetricSpec, Rule
from ..operators import dedup, emit, timesem, windows
from ..operators.sequence import running_max
from ..operators.series import canonical
from ..sources.shared import staged
from . import cel


@dataclass(frozen=True)
class Outputs:
    """bindings: (partition_id, log_index, event_id, bindings map, lane_bitmap); derived, drops, audits, stats: see run()."""

    bindings: DataFrame
    derived: DataFrame
    drops: DataFrame
    audits: DataFrame
    stats: DataFrame


def measured(judged: DataFrame) -> DataFrame:
    """One row for each measurement and lane of judged events, whose first also carries the event: _row, event_id, payload and lost. An event that has no measurement gives one row without a metric."""
    base = F.struct("event_id", "payload", "lost")
    m = judged.select("_row", "partition_id", "log_index", "pane", base.alias("_base"), F.posexplode_outer("measurements").alias("m_pos", "m"))
    m = m.select("_row", "partition_id", "log_index", "pane", "_base", F.coalesce("m_pos", F.lit(0)).alias("m_pos"), "m", F.posexplode(windows.lanes(F.col("m")["lane_bitmap"])).alias("l_pos", "lane"))
    # a row without a metric is in no window; it gets a pane of its own, so that such rows are not one group
    pane = F.when(F.col("m")["metric"].isNull(), -1 - F.col("_row")).otherwise(F.col("pane"))
    first = F.when((F.col("m_pos") == 0) & (F.col("l_pos") == 0), F.col("_base"))
    return m.select("_row", "partition_id", "log_index", pane.alias("pane"), first.alias("_base"), *[F.col("m")[c].alias(c) for c in ("metric", "value", "item", "labels")], "lane", (F.col("m_pos") * 64 + F.col("lane")).alias("ord"))


def bind(rows: DataFrame, specs: Sequence[MetricSpec], absent: bool = True) -> DataFrame:
    """One row per event, from measured() rows evaluated for specs: partition_id, log_index, event_id, payload, bindings by metric, lane_bitmap.

    If several of an event's rows bind one name, the one with the greatest
    labels, place and lane counts. absent: a metric that an event lost by lateness is bound without a value.
    """
    order = F.struct(canonical(F.col("labels")).alias("l"), F.col("ord").alias("o"))
    best = lambda k: F.max_by(F.when(F.col(f"_spec{k}").isNotNull(), F.struct(F.col(f"_spec{k}")["result"].alias("r"), "labels")), F.when(F.col(f"_spec{k}").isNotNull(), order)).alias(f"_b{k}")
    bound = [F.col(f"_spec{k}").isNotNull() for k in range(len(specs))]
    bit = F.when(reduce(lambda a, b: a | b, bound, F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("lane")))
    e = rows.groupBy("_row").agg(*[F.first(c).alias(c) for c in ("partition_id", "log_index")], F.max("_base").alias("_base"), F.bit_or(bit).alias("_mask"), *[best(k) for k in range(len(specs))])
    none, empty = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    told = lambda r, labels, flags: F.struct(F.coalesce(r, F.lit(0.0)).alias("value"), r.isNotNull().alias("has_value"), F.coalesce(labels, empty).alias("labels"), flags.alias("flags"))
    entries = []
    for k, s in enumerate(specs):
        b, dropped = F.col(f"_b{k}"), F.array(F.lit(DROPPED_FLAG))
        flags = none if s.retractable else F.when(b["r"].isNull(), dropped).otherwise(none)
        entries.append(F.when(b.isNotNull(), F.struct(F.lit(s.name).alias("spec"), told(b["r"], b["labels"], flags).alias("b"))))
    kind = "array<struct<spec:string,b:struct<value:double,has_value:boolean,labels:map<string,string>,flags:array<string>>>>"
    found = F.filter(F.array(*entries), lambda x: x.isNotNull()).cast(kind) if entries else F.array().cast(kind)
    if absent:
        names = F.transform(found, lambda x: x["spec"])
        gone = F.transform(F.array_except(F.col("_base")["lost"], names), lambda m: F.struct(m.alias("spec"), told(F.lit(None).cast("double"), empty, F.array(F.lit(DROPPED_FLAG))).alias("b")))
        found = F.when(F.size(F.col("_base")["lost"]) > 0, F.concat(found, gone.cast(kind))).otherwise(found)
    return e.select("partition_id", "log_index", F.col("_base")["event_id"].alias("event_id"), F.col("_base")["payload"].alias("payload"), F.map_from_entries(found).alias("bindings"), F.coalesce("_mask", F.lit(1).cast("long")).alias("lane_bitmap"))


def fire(bound: DataFrame, rules: Sequence[Rule], bindings: Column | None = None) -> DataFrame:
    """One row for each rule that an event meets, in the rules' order: a single pass, without a join."""
    source = F.col("bindings") if bindings is None else bindings
    compiler = cel.Compiler(cel.in_map(source), F.col("payload"))
    found = []
    for k, r in enumerate(rules):
        e = cel.parse(r.expr) if isinstance(r.expr, str) else r.expr
        if r.allowed_labels:
            cel.check_labels(e, r.allowed_labels)
        body = cel.payload_json(r.payload, compiler) if isinstance(r.payload, Mapping) else F.lit(str(r.payload))
        found.append(F.when(compiler.condition(e), F.struct(F.lit(k).alias("rule_pos"), F.lit(r.channel).alias("channel"), F.lit(r.schema_key).alias("schema_key"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.version).cast("long").alias("rule_version"), body.alias("payload"))))
    if not found:
        found = [F.when(F.lit(False), F.struct(F.lit(0).alias("rule_pos"), F.lit("").alias("channel"), F.lit("").alias("schema_key"), F.lit("").alias("rule_id"), F.lit(0).cast("long").alias("rule_version"), F.lit("").alias("payload")))]
    fired = bound.select("partition_id", "log_index", "event_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("partition_id", "log_index", "event_id", "x.*")
    fired = fired.withColumn("flags", F.array(F.lit(emit.DERIVED_FLAG)))
    return fired.withColumn("derived_event_id", emit.derived_id(F.col("partition_id"), F.col("log_index"), F.col("rule_version"), F.col("rule_id"), F.col("channel")))


def run(
    events: DataFrame,
    config: AggregationConfig,
    rules: Sequence[Rule],
    policies: Mapping[str, ChannelPolicy] | None = None,
    retry_ms: int = 1_800_000,
    lateness_ms: int = timesem.LATENESS_MS,
    guard_ms: int = timesem.GUARD_MS,
    arrival: bool = False,
    batch: tuple[str, ...] = ("partition_id",),
) -> Outputs:
    """events follow model.EVENT. Order as in the log: an event that is rejected for skew has used up its id by then. Events are decided on in this call, and kept in the shared folder.

    stats: (partition_id, total, dedup_skipped, divergent).
    """
    config.checked()
    decided = dedup.decide(events, retry_ms)
    e = dedup.fresh(decided)
    if arrival:
        e = timesem.skew(e)
        skewed = timesem.skew_audits(e)
        e = e.where(F.coalesce(F.col("skew") != timesem.FUTURE_REASON, F.lit(True))).drop("skew")
    e = timesem.judge(e, config.specs, lateness_ms, guard_ms, arrival)
    e = windows.with_pane(e, config.pane_ms)
    if config.pane_assignment == "head":
        head = {"_head": F.when(F.size("measurements") > 0, F.col("pane"))}
        e = running_max(e, head).withColumn("pane", F.col("_head")).drop("_head")
    # what has been decided so far is read by windows, panes and audits: it is computed once
    e = staged(e.select("partition_id", "log_index", "event_id", "payload", "measurements", "pane", "lost").withColumn("_row", F.monotonically_increasing_id()))
    audits = e.select("partition_id", F.explode("lost").alias("metric"), "event_id", "log_index", F.lit(LATE_REASON).alias("reason"))
    bound = bind(windows.evaluated(measured(e), config), config.specs)
    derived = fire(bound, rules)
    kept, drops = emit.apply_policies(derived, policies or {}, batch)
    if arrival:
        audits = audits.unionByName(skewed)
    return Outputs(bound.select("partition_id", "log_index", "event_id", "bindings", "lane_bitmap"), kept, drops, audits, dedup.counters(decided))
