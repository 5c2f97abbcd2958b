"""Watermarks, skew, late data and finalized horizons. All times are milliseconds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DROPPED_FLAG, FUTURE_REASON, LATE_REASON, PARTITION_METRIC, PAST_REASON, MetricSpec
from .sequence import running_max

LATENESS_MS, GUARD_MS = 2_000, 200
FUTURE_MS, PAST_MS = 5_000, 30 * 60_000


def watermark(tick: Column, clock: Column | None, lateness_ms: int = LATENESS_MS, guard_ms: int = GUARD_MS) -> Column:
    """The watermark, from the greatest tick and arrival so far: the tick less the lateness, but not ahead of the arrival less the guard.

    Both running maxima only rise, so the watermark does without a maximum of its own.
    """
    found = tick - lateness_ms
    return F.greatest(found if clock is None else F.least(found, clock - guard_ms), F.lit(0))


def trace(events: DataFrame, lateness_ms: int = LATENESS_MS, guard_ms: int = GUARD_MS, arrival: bool = True) -> DataFrame:
    """events with watermark_ms, lateness_ms (how far behind it the event is) and lag_ms (how far it is behind the greatest tick)."""
    e = running_max(events, {"_tick": F.col("tick_ms")} | ({"_clock": F.col("arrival_ms")} if arrival else {}))
    e = e.withColumn("watermark_ms", watermark(F.col("_tick"), F.col("_clock") if arrival else None, lateness_ms, guard_ms))
    e = e.withColumn("lateness_ms", F.greatest(F.col("watermark_ms") - F.col("tick_ms"), F.lit(0))).withColumn("lag_ms", F.greatest(F.col("_tick") - F.col("watermark_ms"), F.lit(0)))
    return e.drop("_tick", "_clock")


def skew(events: DataFrame, future_ms: int = FUTURE_MS, past_ms: int = PAST_MS) -> DataFrame:
    """events with skew: FUTURE_SKEW (to be rejected, and to move no watermark), PAST_SKEW (counted only) or null."""
    ahead = F.col("tick_ms") > F.col("arrival_ms") + future_ms
    behind = F.col("tick_ms") < F.greatest(F.col("arrival_ms") - past_ms, F.lit(0))
    return events.withColumn("skew", F.when(ahead, FUTURE_REASON).when(behind, PAST_REASON))


def _watermarks(events: DataFrame, specs: Sequence[MetricSpec], lateness_ms: int, guard_ms: int, arrival: bool, has: Callable[[str], Column]) -> tuple[DataFrame, dict[str, Column], Column]:
    """(events with running maxima in columns that begin with _wm, the watermark of each metric that has its own, the watermark of the others). has: whether a row measures a metric."""
    clocks = {"tick": F.col("tick_ms")} | ({"clock": F.col("arrival_ms")} if arrival else {})
    own = {s.metric: s for s in specs if s.lateness_ms is not None}
    values = {f"_wm_{c}": v for c, v in clocks.items()} | {f"_wm{k}_{c}": F.when(has(m), v) for k, m in enumerate(own) for c, v in clocks.items()}
    found = lambda k, late, guard: watermark(F.col(f"_wm{k}_tick"), F.col(f"_wm{k}_clock") if arrival else None, late, guard)
    marks = {m: found(k, s.lateness_ms or 0, guard_ms if s.guard_ms is None else s.guard_ms) for k, (m, s) in enumerate(own.items())}
    return running_max(events, values), marks, found("", lateness_ms, guard_ms)


def _late(metric: Column, tick: Column, specs: Sequence[MetricSpec], marks: Mapping[str, Column], other: Column) -> Column:
    """Whether a measurement lies strictly before its metric's watermark less its correction horizon. Unknown metrics are never late."""
    horizon = {s.metric: s.correction_ms for s in specs}
    return F.coalesce(*[F.when(metric == m, tick < F.greatest(marks.get(m, other) - h, F.lit(0))) for m, h in horizon.items()], F.lit(False))


def _told(metric: Column, specs: Sequence[MetricSpec]) -> Column:
    """Whether a late measurement gives a reason: that of a metric that can retract goes without a word."""
    silent = sorted({s.metric for s in specs if s.retractable})
    return ~metric.isin(silent) if silent else F.lit(True)


def mark_late(rows: DataFrame, specs: Sequence[MetricSpec], lateness_ms: int = LATENESS_MS, guard_ms: int = GUARD_MS, arrival: bool = False) -> DataFrame:
    """Measurement rows with late, late_reason and watermark_ms.

    A measurement is late if its tick lies strictly before the metric's watermark less its correction horizon. Only metrics that
    cannot retract give a reason; the others' late measurements go without a word, and unknown metrics are never late. A
    metric with a lateness of its own has its own watermark, from its own events. Without specs nothing is late.
    """
    r, marks, other = _watermarks(rows, specs, lateness_ms, guard_ms, arrival, lambda m: F.col("metric") == m)
    mark = F.coalesce(*[F.when(F.col("metric") == m, w) for m, w in marks.items()], other)
    late = _late(F.col("metric"), F.col("tick_ms"), specs, marks, other)
    out = r.select(*rows.columns, late.alias("late"), mark.alias("watermark_ms"))
    return out.withColumn("late_reason", F.when(F.col("late") & _told(F.col("metric"), specs), LATE_REASON)).select(*rows.columns, "late", "late_reason", "watermark_ms")


def judge(events: DataFrame, specs: Sequence[MetricSpec], lateness_ms: int = LATENESS_MS, guard_ms: int = GUARD_MS, arrival: bool = False) -> DataFrame:
    """Events whose late measurements are taken out, with watermark_ms and lost: the metrics of those that give a reason, one for each measurement.

    Every event moves the watermark, whatever it measures.
    """
    e, marks, other = _watermarks(events, specs, lateness_ms, guard_ms, arrival, lambda m: F.exists(F.coalesce("measurements", F.array().cast(events.schema["measurements"].dataType)), lambda x: x["metric"] == m))
    every = F.coalesce("measurements", F.array().cast(events.schema["measurements"].dataType))
    late = lambda m: _late(m["metric"], F.col("tick_ms"), specs, marks, other)
    lost = F.transform(F.filter(every, lambda m: late(m) & _told(m["metric"], specs)), lambda m: m["metric"])
    kept = F.filter(every, lambda m: ~late(m)).alias("measurements")
    return e.select(*[kept if c == "measurements" else c for c in events.columns], other.alias("watermark_ms"), lost.alias("lost"))


def audits(late_rows: DataFrame) -> DataFrame:
    """(partition_id, metric, event_id, log_index, reason) of late measurements that are told."""
    return late_rows.where("late_reason is not null").select("partition_id", "metric", "event_id", "log_index", F.col("late_reason").alias("reason"))


def skew_audits(skewed: DataFrame) -> DataFrame:
    """The same of rejected events, under the partition's own name."""
    return skewed.where(F.col("skew") == FUTURE_REASON).select("partition_id", F.lit(PARTITION_METRIC).alias("metric"), "event_id", "log_index", F.col("skew").alias("reason"))


def late_counters(late_rows: DataFrame, skewed: DataFrame) -> DataFrame:
    """(reason, n) over late measurements and skewed events."""
    reasons = late_rows.where("late_reason is not null").select(F.col("late_reason").alias("reason")).unionByName(skewed.where("skew is not null").select(F.col("skew").alias("reason")))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def retractions(late_rows: DataFrame, specs: Sequence[MetricSpec]) -> DataFrame:
    """(partition_id, log_index, metric, flag) of measurements behind the watermark that a metric with the policy "retract" still takes.

    Panes are recomputed from their rows, so such a measurement counts in its own pane, and every window that holds the
    pane gets its new value: bindings that these events touch are corrections, and carry the flag RETRACT.
    """
    names = sorted(s.metric for s in specs if s.late_policy == "retract")
    behind = late_rows.where(~F.col("late") & (F.col("tick_ms") < F.col("watermark_ms")))
    behind = behind.where(F.col("metric").isin(names)) if names else behind.where("false")
    return behind.select("partition_id", "log_index", "metric", F.lit("RETRACT").alias("flag"))


def latest(traced: DataFrame) -> DataFrame:
    """(partition_id, watermark_ms, lag_ms, applied_index) after each partition's last event, from trace()'s rows."""
    return traced.groupBy("partition_id").agg(F.max_by("watermark_ms", "log_index").alias("watermark_ms"), F.max_by("lag_ms", "log_index").alias("lag_ms"), F.max("log_index").alias("applied_index"))


def dropped_metrics(late_rows: DataFrame) -> DataFrame:
    """(partition_id, log_index, dropped): the metrics that an event lost by lateness and was told of."""
    return late_rows.where("late_reason is not null").groupBy("partition_id", "log_index").agg(F.sort_array(F.collect_set("metric")).alias("dropped"))


def decorate(flags: Column, metric: Column, dropped: Column) -> Column:
    """flags with the mark of a dropped metric, if metric is one."""
    return F.when(F.array_contains(F.coalesce(dropped, F.array().cast("array<string>")), metric), F.array_union(flags, F.array(F.lit(DROPPED_FLAG)))).otherwise(flags)


def finalized_horizon(watermarks: DataFrame) -> DataFrame:
    """(partition_id, finalized_ms) from (partition_id, metric, watermark_ms, correction_ms) rows: the least of the metrics' latest watermarks less corrections."""
    latest = watermarks.groupBy("partition_id", "metric").agg(F.max(F.greatest(F.col("watermark_ms") - F.col("correction_ms"), F.lit(0))).alias("f"))
    return latest.groupBy("partition_id").agg(F.min("f").alias("finalized_ms"))


def stalled(watermark_ms: Column, correction_ms: Column, applied_ms: Column, lateness_ms: Column) -> Column:
    """How far the finalized horizon lags behind what is applied, if that is more than twice the lateness; else null."""
    lag = F.greatest(applied_ms - F.greatest(watermark_ms - correction_ms, F.lit(0)), F.lit(0))
    return F.when(lag > 2 * lateness_ms, lag)
