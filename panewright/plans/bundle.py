"""Bundles: a YAML document of metric queries and rules, checked and planned."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ChannelPolicy, ConfigError
from ..operators import emit, lanes, series, timesem
from . import cel, promql


#: The kinds of phases, and the least and most milliseconds between checkpoints.
TYPES = ("source.kafka", "source.channel", "aggregate.promql", "classify.cel", "sink.checkpoint")
FULL_MS, INCREMENTAL_MS = (15_000, 300_000), (5_000, 300_000)


#: The flag of a metric that more than one series answers.
AMBIGUOUS_FLAG = "AMBIGUOUS_SERIES"


class BundleError(ConfigError):
    pass


class ChannelLoop(BundleError):
    """A channel that the bundle both reads and writes."""


@dataclass(frozen=True)
class RuleText:
    name: str
    when: str
    channel: str
    schema_key: str = ""
    payload: Mapping[str, object] = field(default_factory=dict)
    metadata: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Phase:
    name: str
    type: str
    window: str | None = None
    queries: Mapping[str, str] = field(default_factory=dict)
    bindings: Mapping[str, str] = field(default_factory=dict)
    rules: tuple[RuleText, ...] = ()
    consumes: tuple[str, ...] = ()
    options: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Bundle:
    name: str
    def_version: int
    policy_version: int
    lane_domains: Mapping[str, int]
    phases: tuple[Phase, ...]


@dataclass(frozen=True)
class Admission:
    queries: Mapping[str, promql.Query]
    lanes: lanes.LaneReport
    warnings: tuple[str, ...]
    #: phase -> (full, incremental) milliseconds; None where the bundle leaves it open
    checkpoints: Mapping[str, tuple[int | None, int | None]] = field(default_factory=dict)


def load(source: str | Path | Mapping) -> Bundle:
    """A bundle from YAML or JSON text, a path or a mapping. Keys that are unknown are left alone, absent ones have defaults."""
    if isinstance(source, Mapping):
        doc = source
    else:
        import yaml

        text = Path(source).read_text() if isinstance(source, Path) else source
        doc = yaml.safe_load(text) or {}
    if not isinstance(doc, Mapping):
        raise BundleError("not a mapping")
    head, flow = doc.get("bundle") or {}, doc.get("workflow") or {}
    domains = {}
    for label, d in (head.get("lane_domains") or {}).items():
        if not isinstance(d, Mapping) or "max_per_partition" not in d:
            raise BundleError(f"lane domain {label!r} has no max_per_partition")
        domains[str(label)] = int(d["max_per_partition"])
    phases = []
    for p in flow.get("phases") or []:
        o = p.get("options") or {}
        queries = {k: (v if isinstance(v, str) else v.get("expression", "")) for k, v in (o.get("queries") or {}).items()}
        rules = tuple(
            RuleText(r.get("name", ""), r.get("when", "true"), (r.get("emit") or {}).get("channel", ""), (r.get("emit") or {}).get("schema_key", ""), (r.get("emit") or {}).get("payload") or {}, (r.get("emit") or {}).get("metadata") or {})
            for r in o.get("rules") or []
        )
        consumes = tuple(([o["channel"]] if o.get("channel") else []) + list(o.get("channels") or [])) if p.get("type") == "source.channel" else ()
        phases.append(Phase(p.get("name", ""), p.get("type", ""), o.get("window"), queries, o.get("bindings") or {}, rules, consumes, o))
    return Bundle(str(head.get("name", "")), int(head.get("def_version", 1)), int(head.get("policy_version", 1)), domains, tuple(phases))


def validate(bundle: Bundle, strict: bool = True) -> Admission:
    """Checks, in this order: phase types, lane domains, queries, checkpoints, channel loop, lanes, rules. strict also refuses lane overflow, windows that differ from ranges and intervals out of bounds."""
    for p in bundle.phases:
        if p.type not in TYPES:
            raise BundleError(f"{p.name}: unknown type {p.type!r}")
    if not bundle.lane_domains:
        raise BundleError("no lane domains")
    queries: dict[str, promql.Query] = {}
    warnings, groupings = [], []
    found = False
    for p in bundle.phases:
        if p.type != "aggregate.promql":
            continue
        window = promql.duration_ms(p.window) if p.window else None
        if not window:
            warnings.append(f"{p.name}: no valid window")
        for name, text in p.queries.items():
            found = True
            q = promql.parse(text)
            queries[f"{p.name}.{name}"] = q
            groupings.append((name, q.by))
            if q.range_ms is None:
                warnings.append(f"{p.name}.{name}: no range")
            elif window and q.range_ms != window:
                if strict:
                    raise BundleError(f"{p.name}.{name}: range {q.range_ms} ms, window {window} ms")
                warnings.append(f"{p.name}.{name}: range differs from window")
    if not found:
        raise BundleError("no queries")
    checkpoints = {p.name: _intervals(p, bundle, strict, warnings) for p in bundle.phases if p.type == "sink.checkpoint"}
    produced = {r.channel for p in bundle.phases for r in p.rules if r.channel}
    consumed = {c for p in bundle.phases for c in p.consumes}
    if loop := sorted(produced & consumed):
        raise ChannelLoop(f"channel {loop[0]!r} is read and written")
    report = lanes.project(groupings, bundle.lane_domains)
    if report.has_overflow:
        if strict:
            raise lanes.LaneError(f"{report.total} lanes, {lanes.CAP} are allowed")
        warnings.append(f"{report.total} lanes, {lanes.CAP} are allowed")
    elif report.has_warning:
        warnings.append(f"{report.total} lanes")
    for p in bundle.phases:
        for r in p.rules:
            _check_rule(p, r, queries)
    return Admission(queries, report, tuple(warnings), checkpoints)


def _intervals(p: Phase, bundle: Bundle, strict: bool, warnings: list[str]) -> tuple[int | None, int | None]:
    """The intervals of a checkpoint phase; an error for texts that are no duration and names that are no phase."""
    found = []
    for name, (least, most) in (("full_interval", FULL_MS), ("incremental_interval", INCREMENTAL_MS)):
        text = p.options.get(name)
        ms = None if text is None else promql.duration_ms(str(text))
        if text is not None and not ms:
            raise BundleError(f"{p.name}: {name} {text!r} is no duration")
        if ms is not None and not least <= ms <= most:
            if strict:
                raise BundleError(f"{p.name}: {name} of {ms} ms is not within {least} and {most} ms")
            warnings.append(f"{p.name}: {name} is out of bounds")
        found.append(ms)
    for other in p.options.get("include") or []:
        if other not in {x.name for x in bundle.phases}:
            raise BundleError(f"{p.name}: {other!r} is not a phase")
    return found[0], found[1]


def _phase_of(p: Phase, alias: str) -> str:
    target = p.bindings.get(alias, alias)
    return target.removeprefix("phase.").removesuffix(".metrics")


def _check_rule(p: Phase, r: RuleText, queries: Mapping[str, promql.Query]) -> list[str]:
    """The queries that a rule reads; an error for an unknown one, an undeclared label or labels that cannot be compared."""
    e = cel.parse(r.when)
    every = [e, *[cel.parse(v) for v in r.payload.values() if isinstance(v, str)]]
    used = []
    groups: dict[str, tuple[str, ...]] = {}
    for x in (y for part in every for y in cel.walk(part) if isinstance(y, cel.Field)):
        key = f"{_phase_of(p, x.alias)}.{x.metric}"
        if key not in queries:
            raise cel.CelError(f"{r.name}: {x.alias}[{x.metric!r}] is not a query of the bundle")
        used.append(key)
        groups[x.metric] = queries[key].by
    for part in every:
        cel.check_labels(part, {m: frozenset(by) for m, by in groups.items()})
        cel.check_comparable(part, groups)
    return list(dict.fromkeys(used))


def run(bundle: Bundle, telemetry: DataFrame, events: DataFrame, pane_ms: int, policies: Mapping[str, ChannelPolicy] | None = None, strict: bool = True) -> DataFrame:
    """The derived events of a bundle.

    telemetry: rows of operators.series. events: partition_id, log_index, tick_ms, labels, payload (JSON), event_id, partition_key, schema_key. Each event
    is judged once, by every rule. A metric resolves to the series group whose labels are the event's (its labels, else its payload's
    fields of these names), and has the value it had at the event's place in the log. A query without an aggregator that several series answer has no value
    and the flag AMBIGUOUS_FLAG. Queries that agree are evaluated once.
    """
    admission = validate(bundle, strict)
    e = events.withColumn("pane", F.floor(F.col("tick_ms") / pane_ms).cast("long"))
    label = lambda name: F.coalesce(F.col("labels")[name], F.get_json_object("payload", f"$['{name}']"))
    wanted = [(p, r, _check_rule(p, r, admission.queries)) for p in bundle.phases for r in p.rules]
    columns: dict[promql.Query, str] = {}
    for _, _, used in wanted:
        for key in used:
            columns.setdefault(admission.queries[key], f"m{len(columns)}")
    for name in sorted({b for q in columns for b in q.by}):
        e = e.withColumn(f"by_{name}", label(name))
    out = e
    for q, column in columns.items():
        out = series.evaluate_events(telemetry, q, pane_ms, out, column, asked=e)
        labels = F.create_map(*[x for b in q.by for x in (F.lit(b), F.col(f"by_{b}"))]) if q.by else F.create_map().cast("map<string,string>")
        value, n = F.col(column)["value"], F.col(column)["series"]
        flags = F.when((n > 1) & F.lit(q.aggregator is None), F.array(F.lit(AMBIGUOUS_FLAG))).otherwise(F.array().cast("array<string>"))
        out = out.withColumn(column, F.when(n.isNotNull(), F.struct(value.alias("value"), value.isNotNull().alias("has_value"), labels.alias("labels"), flags.alias("flags"))))
    emissions = []
    widest = max((q.range_ms or pane_ms for q in columns), default=pane_ms)
    end = (F.col("pane") + 1) * pane_ms * 1_000_000
    if any("watermark_ns" in str((r.when, r.payload)) for _, r, _ in wanted):
        out = timesem.trace(out, arrival=False).withColumnRenamed("watermark_ms", "_wm")
    else:
        out = out.withColumn("_wm", F.lit(None).cast("long"))
    context: dict[str, Column] = {n: F.col(n) for n in ("partition_key", "partition_id", "log_index", "event_id", "schema_key")}
    context |= {"window_end_ns": end, "window_start_ns": end - widest * 1_000_000, "watermark_ns": F.col("_wm") * 1_000_000, "rule_version": F.lit(bundle.policy_version)}
    for k, (p, r, _) in enumerate(wanted):
        compiler = cel.Compiler(lambda alias, metric, p=p: F.col(columns[admission.queries[f"{_phase_of(p, alias)}.{metric}"]]), F.col("payload"), context)
        body = cel.payload_json(r.payload, compiler)
        emissions.append(F.when(compiler.condition(cel.parse(r.when)), F.struct(F.lit(k).alias("rule_pos"), F.lit(r.channel).alias("channel"), F.lit(r.schema_key).alias("schema_key"), F.lit(r.name).alias("rule_id"), body.alias("payload"), F.lit(_json(r.metadata)).alias("metadata"))))
    if not emissions:
        raise BundleError("no rules")
    fired = out.select("partition_id", "log_index", "event_id", F.explode(F.filter(F.array(*emissions), lambda x: x.isNotNull())).alias("x"))
    derived = fired.select("partition_id", "log_index", "event_id", "x.*", F.lit(bundle.policy_version).cast("long").alias("rule_version"), F.array(F.lit(emit.DERIVED_FLAG)).alias("flags"))
    derived = derived.withColumn("derived_event_id", emit.derived_id(F.col("partition_id"), F.col("log_index"), F.col("rule_version"), F.col("rule_id"), F.col("channel")))
    if policies:
        derived, _ = emit.apply_policies(derived, policies, ("partition_id",))
    return derived


def _json(m: Mapping) -> str:
    import json

    return json.dumps(dict(m), sort_keys=True)
