"""Gates over readiness tables, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-9
APPLY_LAG_MS, REPLICATION_LAG_MS = 200, 250


def ready(states: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(n, critical, critical_ready, ratio, ready) of rows (partition_id, critical, apply_lag_ms, replication_lag_ms): a partition is ready within both limits. Without critical partitions the gate is open."""
    fine = (F.col("apply_lag_ms") <= APPLY_LAG_MS) & (F.col("replication_lag_ms") <= REPLICATION_LAG_MS)
    total = states.agg(F.count(F.lit(1)).alias("n"), F.count_if("critical").alias("critical"), F.count_if(F.col("critical") & fine).alias("critical_ready"))
    ratio = F.when(F.col("critical") > 0, F.col("critical_ready") / F.col("critical")).otherwise(F.lit(1.0))
    return total.withColumn("ratio", ratio).withColumn("ready", F.col("ratio") + EPSILON >= threshold)


def activation(states: DataFrame, barrier_index: int) -> DataFrame:
    """(partition_id, state) of rows (partition_id, shadow_state, applied_index): Ready from the barrier on, WaitingForWal before it, else the shadow's own state."""
    done = F.when(F.col("shadow_state") != "Ready", F.col("shadow_state")).when(F.col("applied_index") >= barrier_index, "Ready").otherwise("WaitingForWal")
    return states.select("partition_id", done.alias("state"))
