"""Compaction of old panes into a second tier, and queries across both.

A pane's state is the same in either tier, so a query merges what it finds: the answer does not
depend on where the boundary lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import Family
from ..model import ConfigError
from .windows import KEY


def frontier(states: DataFrame, pane_ms: int, ring_panes: int) -> DataFrame:
    """(partition_id, frontier_ms): where the live ring begins; panes before it are compacted. Panes that were never filled count, too."""
    head = states.groupBy("partition_id").agg(F.max("pane").alias("head"))
    return head.select("partition_id", (F.greatest(F.col("head") - ring_panes + 1, F.lit(0)) * pane_ms).alias("frontier_ms"))


def split(states: DataFrame, pane_ms: int, ring_panes: int) -> tuple[DataFrame, DataFrame]:
    """(compacted, live): live panes start at the frontier or later."""
    f = frontier(states, pane_ms, ring_panes)
    both = states.join(f, "partition_id")
    old = F.col("pane") * pane_ms < F.col("frontier_ms")
    return both.where(old).select(*states.columns), both.where(~old).select(*states.columns)


def compact(states: DataFrame, family: Family, by: Sequence[str] = KEY, span_panes: int | None = None) -> DataFrame:
    """The states merged per key: over all time, or over spans of span_panes panes, numbered by `span`, for range queries."""
    keys = [*by, *(["span"] if span_panes else [])]
    s = states.withColumn("span", F.floor(F.col("pane") / span_panes)) if span_panes else states
    return s.groupBy(*keys).agg(*[c.alias(n) for n, c in family.totals({n: F.col(n) for n in family.names}).items()])


def cross_tier(compacted: DataFrame, live: DataFrame, family: Family, by: Sequence[str] = KEY) -> DataFrame:
    """(key, value) over all that either tier holds."""
    names = family.names
    both = compacted.select(*by, *names).unionByName(live.select(*by, *names))
    merged = both.groupBy(*by).agg(*[c.alias(n) for n, c in family.totals({n: F.col(n) for n in names}).items()])
    return merged.select(*by, family.finish({n: F.col(n) for n in names}).alias("value"))


def range_query(compacted: DataFrame, live: DataFrame, family: Family, from_pane: int, to_pane: int, by: Sequence[str] = KEY, span_panes: int | None = None) -> DataFrame:
    """(key, value) over the panes from from_pane up to but not including to_pane, of both tiers; the bounds reach the scans of both.

    compacted: panes, or the spans of span_panes panes that compact() makes. A span cannot be divided, so the bounds must then be those of spans.
    """
    inside = (F.col("pane") >= from_pane) & (F.col("pane") < to_pane)
    if span_panes is None:
        return cross_tier(compacted.where(inside), live.where(inside), family, by)
    if from_pane % span_panes or to_pane % span_panes:
        raise ConfigError(f"{from_pane} and {to_pane} are not bounds of spans of {span_panes} panes")
    spans = (F.col("span") >= from_pane // span_panes) & (F.col("span") < to_pane // span_panes)
    return cross_tier(compacted.where(spans), live.where(inside), family, by)


def write_tier(states: DataFrame, path: str, pane_ms: int, mode: str = "append") -> None:
    """Writes pane states by day, so that a range query reads the days it needs."""
    day = F.floor(F.col("pane") * pane_ms / 86_400_000).cast("int")
    states.withColumn("day", day).write.mode(mode).partitionBy("day").parquet(path)


def read_tier(spark, path: str, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    t = spark.read.parquet(path)
    if from_ms is not None:
        t = t.where(F.col("day") >= from_ms // 86_400_000)
    if to_ms is not None:
        t = t.where(F.col("day") <= to_ms // 86_400_000)
    return t.drop("day")
