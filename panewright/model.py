"""Schemas of the data, and the plan-time description of metrics, rules and channels."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import types as T

LABELS = T.MapType(T.StringType(), T.StringType())

MEASUREMENT = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("item", T.StringType()),
    T.StructField("lane_bitmap", T.LongType()),
    T.StructField("labels", LABELS),
])

#: One row per event. tick_ms places it in panes and moves watermarks; arrival_ms, if known, is the clock when it came.
EVENT = T.StructType([
    T.StructField("partition_id", T.StringType()),
    T.StructField("log_index", T.LongType()),
    T.StructField("tick_ms", T.LongType()),
    T.StructField("arrival_ms", T.LongType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("partition_key", T.StringType()),
    T.StructField("schema_key", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("measurements", T.ArrayType(MEASUREMENT)),
])

BINDING = T.StructType([
    T.StructField("value", T.DoubleType()),
    T.StructField("has_value", T.BooleanType()),
    T.StructField("labels", LABELS),
    T.StructField("flags", T.ArrayType(T.StringType())),
])

KINDS = ("sum", "count", "avg", "min", "max", "quantile", "topk", "distinct")
#: Kinds whose state cannot give back a value that was added.
NOT_RETRACTABLE = ("quantile", "topk", "distinct")
DROPPED_FLAG = "NON_RETRACTABLE_DROPPED"
LATE_REASON, FUTURE_REASON, PAST_REASON = "NON_RETRACTABLE_FINALIZED", "FUTURE_SKEW", "PAST_SKEW"
PARTITION_METRIC = "__partition__"


class ConfigError(ValueError):
    """A description that cannot be planned."""


@dataclass(frozen=True)
class MetricSpec:
    """An aggregate over a sliding window of panes. param: q of a quantile, k of a top-k."""

    name: str
    kind: str
    window_ms: int
    correction_ms: int = 0
    labels: tuple[str, ...] = ()
    late_policy: str = "drop"
    param: float | None = None
    source: str | None = None
    lateness_ms: int | None = None
    guard_ms: int | None = None

    @property
    def metric(self) -> str:
        return self.source or self.name

    @property
    def retractable(self) -> bool:
        return self.kind not in NOT_RETRACTABLE


@dataclass(frozen=True)
class AggregationConfig:
    specs: tuple[MetricSpec, ...]
    pane_ms: int = 250
    raw_retention_ms: int = 60_000
    max_window_ms: int | None = None
    pane_assignment: str = "event"

    @property
    def longest_ms(self) -> int:
        widest = self.max_window_ms if self.max_window_ms is not None else max((s.window_ms for s in self.specs), default=self.pane_ms)
        return max(self.raw_retention_ms, widest, self.pane_ms)

    @property
    def ring_panes(self) -> int:
        return math.ceil(self.longest_ms / self.pane_ms)

    def panes(self, spec: MetricSpec) -> int:
        return max(1, math.ceil(spec.window_ms / self.pane_ms))

    def checked(self) -> AggregationConfig:
        if self.pane_ms <= 0:
            raise ConfigError("pane width must be positive")
        if self.pane_assignment not in ("event", "head"):
            raise ConfigError(f"unknown pane assignment {self.pane_assignment!r}")
        names = [s.name for s in self.specs]
        if len(set(names)) != len(names):
            raise ConfigError("metric names repeat")
        for s in self.specs:
            if s.kind not in KINDS:
                raise ConfigError(f"{s.name}: unknown kind {s.kind!r}")
            if s.window_ms > self.longest_ms:
                raise ConfigError(f"{s.name}: window of {s.window_ms} ms does not fit the ring of {self.longest_ms} ms")
            if s.late_policy == "retract" and not s.retractable:
                raise ConfigError(f"{s.name}: {s.kind} cannot retract")
        return self


@dataclass(frozen=True)
class RingBudget:
    longest_ms: int
    panes: int
    slots: int
    bytes: int


def ring_budget(config: AggregationConfig, lanes: int, bytes_per_slot: int, budget: int) -> RingBudget:
    """What the live panes of one partition take at most; an error if it is more than budget."""
    slots = config.ring_panes * max(1, len(config.specs)) * lanes
    found = RingBudget(config.longest_ms, config.ring_panes, slots, slots * bytes_per_slot)
    if found.bytes > budget:
        raise ConfigError(f"ring of {found.bytes} bytes is above the budget of {budget}")
    return found


def upgrade_allowed(old: int, new: int) -> bool:
    """Versions may stay or go up by one."""
    return 0 <= new - old <= 1


@dataclass(frozen=True)
class ChannelPolicy:
    """What a channel does with more than `capacity` rows of a batch: drop_oldest, block or dead_letter (to `target`)."""

    kind: str = "drop_oldest"
    capacity: int | None = None
    target: str | None = None
    timeout_ms: int | None = None


@dataclass(frozen=True)
class Rule:
    """expr is a condition of plans.cel; payload a constant, or a mapping of names to expressions."""

    rule_id: str
    channel: str
    expr: object
    schema_key: str = ""
    payload: object = ""
    version: int = 1
    allowed_labels: dict[str, frozenset[str]] = field(default_factory=dict)
