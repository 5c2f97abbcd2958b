"""Evaluation of metric queries over telemetry.

Telemetry rows: partition_id, log_index, tick_ms, metric, value, item, labels. A series is a metric with a full
set of labels. The inner function makes a value of each series' window, the aggregator one of each group of series, as in PromQL;
so the average of averages weighs series alike.

Samples are summed up per series and pane first. What is asked for, the panes at which a value is wanted, meets these states
in an equi-join on spans as long as the window, of which a pane touches two; nothing is compared across a whole history.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.aggregates import nearest_rank
from ..plans.promql import Matcher, Query


def canonical(labels: Column) -> Column:
    """One text for equal label maps."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(labels, F.create_map().cast("map<string,string>"))))))


def matches(labels: Column, m: Matcher) -> Column:
    """A missing label is the empty text; patterns match whole values."""
    v = F.coalesce(labels[m.label], F.lit(""))
    match m.op:
        case "=":
            return v == m.value
        case "!=":
            return v != m.value
        case "=~":
            return v.rlike(f"^(?:{m.value})\\z")
        case _:
            return ~v.rlike(f"^(?:{m.value})\\z")


def select(telemetry: DataFrame, q: Query) -> DataFrame:
    """The rows of a query's series, with series and the grouping labels as columns; filters stand before any window, so they reach the scan."""
    t = telemetry.where(F.col("metric") == q.metric)
    for m in q.matchers:
        t = t.where(matches(F.col("labels"), m))
    t = t.where(F.col("value").isNull() | ~F.isnan("value"))
    return t.select("partition_id", "log_index", "tick_ms", "value", "item", canonical(F.col("labels")).alias("series"), *[F.col("labels")[b].alias(f"by_{b}") for b in q.by])


def deltas(rows: DataFrame) -> DataFrame:
    """rows with delta: by how much a counter rose since its series' last sample. A fall is a restart, from which the new value counts."""
    before = F.lag("value").over(W.partitionBy("partition_id", "series").orderBy("tick_ms", "log_index"))
    return rows.where("value is not null").withColumn("delta", F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))


def _states(rows: DataFrame, q: Query, pane_ms: int, by: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """One row for each series and pane, and each of the columns in more."""
    if q.func in ("rate", "increase"):
        rows = deltas(rows)
    rows = rows.withColumn("pane", F.floor(F.col("tick_ms") / pane_ms).cast("long"))
    fold: list[Column] = [F.count(F.lit(1)).alias("n"), F.max(F.struct("tick_ms", "log_index", "value")).alias("last")]
    match q.func:
        case "rate" | "increase":
            fold += [F.sum("delta").alias("d"), F.min(F.struct("tick_ms", "log_index", "delta")).alias("first")]
        case "quantile_over_time":
            fold += [F.filter(F.collect_list("value"), lambda v: v.isNotNull()).alias("vs")]
        case None if q.aggregator == "distinct":
            fold += [F.collect_set("item").alias("items")]
        case _:
            fold += [F.sum("value").alias("s"), F.count("value").alias("c"), F.min("value").alias("lo"), F.max("value").alias("hi")]
    return rows.groupBy("partition_id", *by, "series", "pane", *more).agg(*fold)


def _merged(q: Query, over: Callable[[Column], Column] = lambda c: c) -> list[Column]:
    """States put together, as aggregates or, by over, in a frame."""
    both = [over(F.sum("n")).alias("n"), over(F.max("last")).alias("last")]
    match q.func:
        case "rate" | "increase":
            return [*both, over(F.sum("d")).alias("d"), over(F.min("first")).alias("first")]
        case "quantile_over_time":
            return [*both, F.flatten(over(F.collect_list("vs"))).alias("vs")]
        case None if q.aggregator == "distinct":
            return [*both, F.array_distinct(F.flatten(over(F.collect_list("items")))).alias("items")]
    return [*both, over(F.sum("s")).alias("s"), over(F.sum("c")).alias("c"), over(F.min("lo")).alias("lo"), over(F.max("hi")).alias("hi")]


def _inner(q: Query) -> Column:
    """A series' value, from the state of its window."""
    match q.func:
        case "rate" | "increase":
            rise = F.coalesce("d", F.lit(0.0)) - F.coalesce(F.col("first")["delta"], F.lit(0.0))
            if q.func == "increase":
                return F.when(F.col("n") >= 2, rise)
            span = (F.col("last")["tick_ms"] - F.col("first")["tick_ms"]) / 1000.0
            return F.when((F.col("n") >= 2) & (span > 0), rise / F.when(span > 0, span))
        case "count_over_time":
            return F.col("n").cast("double")
        case "sum_over_time":
            return F.col("s")
        case "avg_over_time":
            return F.try_divide("s", "c")
        case "min_over_time":
            return F.col("lo")
        case "max_over_time":
            return F.col("hi")
        case "quantile_over_time":
            return nearest_rank(F.col("vs"), q.func_param or 0.0)
        case None if q.aggregator == "distinct":
            return F.size("items").cast("double")
    return F.col("last")["value"]


def _outer(q: Query) -> Column:
    match q.aggregator:
        case "count":
            return F.count("inner").cast("double")
        case "avg":
            return F.avg("inner")
        case "min":
            return F.min("inner")
        case "max" | "topk":
            return F.max("inner")
        case _:
            return F.sum("inner")


#: (aggregator, function) whose value does not depend on which series a sample is of, as a window over the states of a group's panes.
POOLED = {
    ("sum", "sum_over_time"): lambda w: F.sum("s").over(w),
    ("sum", "count_over_time"): lambda w: F.sum("n").over(w).cast("double"),
    ("max", "max_over_time"): lambda w: F.max("hi").over(w),
    ("min", "min_over_time"): lambda w: F.min("lo").over(w),
}


def _pooled(q: Query) -> bool:
    """Whether all samples of a group are taken together, whatever their series."""
    return (q.func == "quantile_over_time" and q.aggregator is None) or (q.aggregator == "distinct" and q.func is None)


def _width(q: Query, pane_ms: int) -> int:
    return max(1, -(-(q.range_ms or pane_ms) // pane_ms))


def _met(states: DataFrame, asked: DataFrame, panes: int) -> DataFrame:
    """The states in the windows of the panes asked for, which become the column _pane."""
    asked = asked.select(*[F.col(c).alias(f"_{c}") for c in asked.columns])
    span = lambda c: F.floor(c / panes).cast("long")
    want = asked.withColumn("_span", F.explode(F.array(span(F.col("_pane")), span(F.col("_pane")) - 1)))
    keys = [c for c in asked.columns if c != "_pane"]
    met = states.withColumn("span", span(F.col("pane"))).join(want, [F.col("span") == F.col("_span"), *[F.col(k[1:]).eqNullSafe(F.col(k)) for k in keys]])
    return met.where((F.col("pane") <= F.col("_pane")) & (F.col("pane") > F.col("_pane") - panes))


def evaluate(telemetry: DataFrame, q: Query, pane_ms: int, at: DataFrame | None = None) -> DataFrame:
    """(partition_id, by_<label>..., pane, value): the query at the end of each pane that is asked for.

    at: (partition_id, by_<label>..., pane); by default every pane in which the group has samples. The window is the
    newest ceil(range / pane_ms) panes. Groups without a sample in it give no row, and a series with too few no
    value. Without an aggregator, series are their own groups by the label `series`, unless the function is
    quantile_over_time, which then takes all samples together; with one, each series has its own quantile.
    """
    by = [f"by_{b}" for b in q.by]
    rows, panes, pooled = select(telemetry, q), _width(q, pane_ms), _pooled(q)
    if at is None and (q.aggregator, q.func) in POOLED:  # a row for each pane of a group slides, however long the window is
        states = _states(rows.withColumn("series", F.lit("")), q, pane_ms, by)
        frame = W.partitionBy("partition_id", *by).orderBy("pane").rangeBetween(-(panes - 1), 0)
        return states.select("partition_id", *by, "pane", POOLED[q.aggregator, q.func](frame).alias("value"))
    if pooled:
        rows = rows.withColumn("series", F.lit(""))
    states = _states(rows, q, pane_ms, by)
    single = q.aggregator is None and not pooled
    group = ["partition_id", *by, *(["series"] if single else [])]
    asked = (states if at is None else at).select(*(group if at is None else ["partition_id", *by]), "pane").distinct()
    inner = _met(states, asked, panes).groupBy("partition_id", *by, "series", "_pane").agg(*_merged(q))
    if pooled or single:
        out = inner.select(*group, "_pane", _inner(q).alias("value"))
    else:
        out = inner.withColumn("inner", _inner(q)).groupBy(*group, "_pane").agg(_outer(q).alias("value"))
    return out.withColumnRenamed("_pane", "pane")


#: Inner functions that only rise, or only fall, as a window takes in samples.
RISING, FALLING = ("max_over_time", "count_over_time"), ("min_over_time",)


def evaluate_events(telemetry: DataFrame, q: Query, pane_ms: int, events: DataFrame, name: str, asked: DataFrame | None = None) -> DataFrame:
    """events with the column name, a struct (value, series): the query as it stood at each event.

    events: any columns, among them partition_id, by_<label>..., pane and log_index. The window is the older panes whole, and of the
    event's own pane the samples up to its place in the log. series: how many series have a value; null if the
    group has no sample. Without an aggregator a value is given only where a single series has one. asked: rows that hold the events' groups and panes, by default events.

    Each series' window state runs through its pane, and what a sample changes in the group's value is added up along the log, so rows do
    not meet each other; only the greatest (least) of values that may fall (rise) again keeps a pane's values in an array. A null place sees the older panes only.
    """
    by = [f"by_{b}" for b in q.by]
    rows, panes, key = select(telemetry, q), _width(q, pane_ms), ["partition_id", *by, "pane"]
    together = _pooled(q) or (q.aggregator, q.func) in POOLED
    if together:
        rows = rows.withColumn("series", F.lit(""))
    parts = [_states(rows, q, pane_ms, by, ("log_index",)).withColumn("kind", F.lit(1))]
    if panes > 1:
        older = _met(_states(rows, q, pane_ms, by), (events if asked is None else asked).select(*key).distinct(), panes).where("pane < _pane")
        older = older.groupBy("partition_id", *by, "series", "_pane").agg(*_merged(q)).withColumnRenamed("_pane", "pane")
        parts.append(older.withColumn("log_index", F.lit(None).cast("long")).withColumn("kind", F.lit(0)))
    known = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    along = W.partitionBy(*key, "series").orderBy("kind", "log_index")
    so_far = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    known = known.select(*key, "series", "kind", "log_index", *_merged(q, lambda c: c.over(so_far))).withColumn("after", _inner(q))
    known = known.select(*key, "kind", "log_index", "after", F.lag("after").over(along).alias("before"), F.lead("log_index").over(along).alias("until"))
    asks = events.select(*key, F.lit(2).alias("kind"), "log_index", F.struct(*events.columns).alias("_event"))
    frame = W.partitionBy(*key).orderBy("log_index", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum(F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))).over(frame)
    alive = F.sum(F.col("after").isNotNull().cast("long") - F.col("before").isNotNull().cast("long")).over(frame)
    match q.aggregator:
        case _ if together:
            value = F.last("after", ignorenulls=True).over(frame)
        case "count":
            value = alive.cast("double")
        case "avg":
            value = F.when(alive > 0, total / F.when(alive > 0, alive))
        case "max" | "topk" if q.func in RISING:
            value = F.max("after").over(frame)
        case "min" if q.func in FALLING:
            value = F.min("after").over(frame)
        case "max" | "topk" | "min":
            held = F.collect_list(F.when(F.col("kind") < 2, F.struct("until", "after"))).over(frame)
            now = F.transform(F.filter(held, lambda x: x["until"].isNull() | (x["until"] > F.col("log_index"))), lambda x: x["after"])
            value = F.array_min(now) if q.aggregator == "min" else F.array_max(now)
        case None:
            value = F.when(alive == 1, total)
        case _:
            value = F.when(alive > 0, total)
    found = F.max(F.col("kind") < 2).over(frame)
    out = known.unionByName(asks, allowMissingColumns=True).select("kind", "_event", F.struct(value.alias("value"), F.when(found, alive).alias("series")).alias(name))
    return out.where("kind = 2").select("_event.*", name)


def topk_series(telemetry: DataFrame, q: Query, pane_ms: int) -> DataFrame:
    """The series that a topk query takes, with their place from 1: (partition_id, by..., pane, series, value, place)."""
    flat = Query(q.metric, q.matchers, q.range_ms, q.func, q.func_param, None, q.by)
    by = ["partition_id", *[f"by_{b}" for b in q.by], "pane"]
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.col("value").desc(), "series"))
    return evaluate(telemetry, flat, pane_ms).where("value is not null").withColumn("place", place).where(F.col("place") <= int(q.param or 0))
