"""Panes and sliding windows over them.

Rows are measurements: partition_id, log_index, tick_ms, metric, lane, value, item. A pane is
floor(tick / width). A sliding window is the newest w panes up to that of the event, and an event's value reflects the older panes whole and its own
pane up to itself.

Whole panes are summed up first, with map-side combining, so that what slides is a row for each pane and lane
and not for each event; only the running part, inside one pane, orders events. A lane
with a third of all events is therefore spread over its panes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.aggregates import Family
from ..model import AggregationConfig, MetricSpec
from .sequence import running_max

KEY = ("partition_id", "metric", "lane")
ORDER = ("log_index", "ord")


def lanes(bitmap: Column) -> Column:
    """The lanes of a bitmap, as an array of its set bits; lane 0 if none is set."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.coalesce(bitmap, F.lit(0)).cast("long"), i) == 1)
    return F.when(F.coalesce(bitmap, F.lit(0)) == 0, F.array(F.lit(0))).otherwise(bits)


def lane_mask(lane: Column) -> Column:
    """An aggregate: the bitmap of the lanes of a group, bit 0 if there is none."""
    return F.coalesce(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), lane)), F.lit(1).cast("long"))


def explode_measurements(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each measurement and lane; ord tells a lane's place in its event. Events without measurements give none."""
    m = events.select("partition_id", "log_index", "tick_ms", *keep, F.posexplode("measurements").alias("m_pos", "m"))
    rows = m.select("partition_id", "log_index", "tick_ms", *keep, "m_pos", F.col("m.metric").alias("metric"), F.col("m.value").alias("value"), F.col("m.item").alias("item"), F.col("m.labels").alias("labels"), F.explode(lanes(F.col("m.lane_bitmap"))).alias("lane"))
    return rows.withColumn("ord", F.col("m_pos") * 64 + F.col("lane"))


def with_pane(rows: DataFrame, pane_ms: int, tick: str = "tick_ms") -> DataFrame:
    return rows.withColumn("pane", F.floor(F.col(tick) / F.lit(pane_ms)).cast("long"))


def with_head(events: DataFrame, pane_ms: int) -> DataFrame:
    """pane is the newest pane that the partition has seen in log order: an event that comes late counts where the log stands.

    Any event moves the head, whatever it measures, so apply this before measurements are chosen.
    """
    e = with_pane(events, pane_ms)
    return running_max(e, {"_head": F.col("pane")}).withColumn("pane", F.col("_head")).drop("_head")


def pane_states(rows: DataFrame, family: Family, by: Sequence[str] = KEY) -> DataFrame:
    """One row for each key and pane: tumbling windows, with the family's state."""
    return rows.groupBy(*by, "pane").agg(*family.partial(F.col("value"), F.col("item")))


def tumbling(rows: DataFrame, family: Family, by: Sequence[str] = KEY) -> DataFrame:
    states = pane_states(rows, family, by)
    return states.select(*by, "pane", family.finish({n: F.col(n) for n in family.names}).alias("value"))


def sliding_panes(rows: DataFrame, family: Family, panes: int, by: Sequence[str] = KEY) -> DataFrame:
    """The window's value at the end of each pane that has rows."""
    frame = W.partitionBy(*by).orderBy("pane").rangeBetween(-(panes - 1), 0)
    state = family.over({n: F.col(n) for n in family.names}, frame)
    return pane_states(rows, family, by).select(*by, "pane", family.finish(state).alias("value"))


def _slide(rows: DataFrame, wanted: Sequence[tuple[Family, int, Column | None]], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with _r0, _r1, ...: for each (family, panes, which rows it is for) the window's value at each row. All families share one state for each pane and one join."""
    r = rows.withColumn("_k", F.struct(*by, "pane"))  # a struct is equal to another of the same nulls, so rows without a lane or metric are kept
    running = W.partitionBy("_k").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = lambda panes: W.partitionBy(*[F.col("_o")[c] for c in by]).orderBy(F.col("_o")["pane"]).rangeBetween(-(panes - 1), -1)
    only = lambda c, some: F.col(c) if some is None else F.when(some, F.col(c))
    families: dict[Family, tuple[int, Column | None]] = {}
    for f, _, some in wanted:
        families.setdefault(f, (len(families), some))
    now = {f: f.prefix(only("value", some), only("item", some), running) for f, (_, some) in families.items()}
    r = r.select("*", *[c.alias(f"_n{families[f][0]}_{n}") for f, state in now.items() for n, c in state.items()])
    names = lambda f, prefix: {n: F.col(f"{prefix}{families[f][0]}_{n}") for n in f.names}
    older = [(f, panes) for f, panes, _ in wanted if panes > 1]
    if older:
        states = rows.groupBy(F.struct(*by, "pane").alias("_o")).agg(*[c for f in dict.fromkeys(f for f, _ in older) for c in f.partial(only("value", families[f][1]), only("item", families[f][1]), f"_s{families[f][0]}_")])
        olds = [c.alias(f"_o{panes}_{families[f][0]}_{n}") for f, panes in dict.fromkeys(older) for n, c in f.over(names(f, "_s"), before(panes)).items()]
        r = r.join(states.select("_o", *olds), F.col("_k") == F.col("_o"))
    out = [f.finish(names(f, "_n") if panes <= 1 else f.merge(names(f, f"_o{panes}_"), names(f, "_n"))).alias(f"_r{k}") for k, (f, panes, _) in enumerate(wanted)]
    return r.select(*rows.columns, *out)


def sliding_events(rows: DataFrame, family: Family, panes: int, by: Sequence[str] = KEY, order: Sequence[str] = ORDER) -> DataFrame:
    """rows with `result`: the window's value at each row."""
    return _slide(rows, [(family, max(1, panes), None)], by, order).withColumnRenamed("_r0", "result")


def topk_entries(rows: DataFrame, k: int, by: Sequence[str] = (*KEY, "pane")) -> DataFrame:
    """The k items of greatest value of each group, ties in order of item, with their place from 1."""
    best = rows.where(F.col("item").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*by, "item").agg(F.max("value").alias("value"))
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.col("value").desc(), F.col("item")))
    return best.withColumn("place", place).where(F.col("place") <= k)


def approx_panes(rows: DataFrame, kind: str, param: float | None = None, by: Sequence[str] = KEY) -> DataFrame:
    """Pane values from sketches of bounded size: the quantile with a rank error of about 1 %, the number of distinct items within 1.6 %."""
    value = F.percentile_approx("value", 0.5 if param is None else param, 200) if kind == "quantile" else F.hll_sketch_estimate(F.hll_sketch_agg("item", 14)).cast("double")
    return rows.groupBy(*by, "pane").agg(value.alias("value"))


def evaluated(rows: DataFrame, config: AggregationConfig) -> DataFrame:
    """rows with _spec0, _spec1, ...: for each of the config's specs a struct of its result at the row; null if it does not read the row's metric. rows have a pane already.

    The work is done once for each family and window; specs that agree in both share it.
    """
    config.checked()
    groups = list(dict.fromkeys((s.kind, s.param, config.panes(s)) for s in config.specs))
    metrics: dict[tuple, set[str]] = {}
    for s in config.specs:
        metrics.setdefault((s.kind, s.param), set()).add(s.metric)
    wanted = [(Family(kind, param), panes, F.col("metric").isin(sorted(metrics[kind, param]))) for kind, param, panes in groups]
    out = _slide(rows, wanted, KEY, ORDER) if wanted else rows
    of = lambda s: F.col(f"_r{groups.index((s.kind, s.param, config.panes(s)))}")
    return out.select(*rows.columns, *[F.when(F.col("metric") == s.metric, F.struct(of(s).alias("result"))).alias(f"_spec{k}") for k, s in enumerate(config.specs)])


def evaluate(rows: DataFrame, config: AggregationConfig) -> DataFrame:
    """One row for each measurement, lane and spec that reads its metric: rows' columns, result, spec."""
    got = evaluated(rows, config)
    found = [F.when(F.col(f"_spec{k}").isNotNull(), F.struct(F.col(f"_spec{k}")["result"].alias("result"), F.lit(s.name).alias("spec"))) for k, s in enumerate(config.specs)]
    none = F.array().cast("array<struct<result:double,spec:string>>")
    every = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else none
    return got.select(*rows.columns, F.explode(every).alias("_x")).select(*rows.columns, "_x.result", "_x.spec")
