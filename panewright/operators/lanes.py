"""Lanes: how many a bundle may need, and which keys get one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import ConfigError

WARN, CAP = 48, 64
MOST = 2**32 - 1
OVERFLOW_REASON = "LANE_OVERFLOW"


class LaneError(ConfigError):
    """A grouping label without a bound, or with a bound of 0."""


@dataclass(frozen=True)
class Projection:
    metric: str
    labels: tuple[str, ...]
    lanes: int

    @property
    def status(self) -> str:
        return "Overflow" if self.lanes > CAP else "Warning" if self.lanes >= WARN else "Healthy"


@dataclass(frozen=True)
class LaneReport:
    projections: tuple[Projection, ...] = field(default=())

    @property
    def total(self) -> int:
        return min(MOST, sum(p.lanes for p in self.projections))

    @property
    def has_overflow(self) -> bool:
        return self.total > CAP or any(p.status == "Overflow" for p in self.projections)

    @property
    def has_warning(self) -> bool:
        return self.total >= WARN or any(p.status != "Healthy" for p in self.projections)

    def histogram(self) -> dict[str, int]:
        found = {"Healthy": 0, "Warning": 0, "Overflow": 0}
        for p in self.projections:
            found[p.status] += 1
        return found

    def markdown(self) -> str:
        rows = [f"| {p.metric} | {', '.join(p.labels) or '-'} | {p.lanes} | {p.status} |" for p in self.projections]
        return "\n".join(["| metric | labels | lanes | status |", "| --- | --- | --- | --- |", *rows, f"| total | | {self.total} | {'Overflow' if self.total > CAP else 'Warning' if self.total >= WARN else 'Healthy'} |"])


def project(groupings: Sequence[tuple[str, Sequence[str]]], bounds: Mapping[str, int]) -> LaneReport:
    """The most lanes that each (metric, labels) can need: the product of its labels' bounds, each label once."""
    found = []
    for metric, labels in groupings:
        n = 1
        for label in sorted(set(labels)):
            if label not in bounds:
                raise LaneError(f"{metric}: label {label!r} has no declared bound")
            if bounds[label] <= 0:
                raise LaneError(f"{metric}: label {label!r} has a bound of 0")
            n = min(MOST, n * bounds[label])
        found.append(Projection(metric, tuple(sorted(set(labels))), n))
    return LaneReport(tuple(found))


def admit(keys: DataFrame, cap: int = CAP) -> DataFrame:
    """keys (partition_id, log_index, metric, lane_key) with admitted.

    Of a partition's different (metric, lane_key), the first `cap` in log order are admitted, for good; a key that was refused never
    comes in later, so it is enough to rank first occurrences. A null key is a key like others. The ranked keys are cut at cap + 1 a partition before they are joined.
    """
    names = ["partition_id", "metric", "lane_key"]
    first = keys.groupBy(*names).agg(F.min("log_index").alias("_first"))
    place = F.row_number().over(W.partitionBy("partition_id").orderBy("_first", "metric", "lane_key"))
    let_in = first.withColumn("_place", place).where(F.col("_place") <= cap).select(F.struct(*names).alias("_in"), F.lit(True).alias("admitted"))
    both = keys.withColumn("_k", F.struct(*names)).join(let_in, F.col("_k") == F.col("_in"), "left")
    return both.select(*keys.columns, F.coalesce("admitted", F.lit(False)).alias("admitted"))


def overflow_audits(admitted: DataFrame, cap: int = CAP) -> DataFrame:
    """(partition_id, metric, lane_key, log_index, reason, observed_lanes) of refused rows."""
    return admitted.where(~F.col("admitted")).select("partition_id", "metric", "lane_key", "log_index", F.lit(OVERFLOW_REASON).alias("reason"), F.lit(cap).alias("observed_lanes"))


def number(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """rows with lane: the place of its label values among those of its partition and metric, sorted by label name."""
    names = [f"_{k}" for k in range(len(labels))]
    r = rows.select("*", *[F.col("labels")[label].alias(n) for n, label in zip(names, sorted(labels), strict=True)])
    both = ["partition_id", "metric", *names]
    keys = r.select(*[F.col(c).alias(f"_k{c}") for c in both]).distinct()
    keys = keys.withColumn("lane", F.dense_rank().over(W.partitionBy("_kpartition_id", "_kmetric").orderBy(*[f"_k{n}" for n in names])) - 1)
    return r.join(keys, [F.col(c).eqNullSafe(F.col(f"_k{c}")) for c in both]).select(*rows.columns, "lane")
