"""Dedup of retried events by id inside a retry window.

For each id a small machine remembers a payload and when it was last seen: nothing known is Fresh; within the window the same
payload is a Duplicate and refreshes the time, another is Divergent and does not; behind the
window the id is RetryExpired and forgotten, so that its next event is Fresh again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRESH, DUPLICATE, DIVERGENT, EXPIRED = "Fresh", "Duplicate", "Divergent", "RetryExpired"
EXPIRED_REASON = "PERMANENT_RETRY_EXPIRED"


def decide(events: DataFrame, window_ms: int = 1_800_000, by: tuple[str, ...] = ("partition_id", "event_id"), payload: str = "payload") -> DataFrame:
    """events with decision.

    Events without an id, and ids that occur once, nearly all, are Fresh and take no further part. The retried ones pass in order of id
    and log, whole rows as they are, through a fold that remembers the current id only, so an id that is retried without end costs time and no memory.
    Every row is returned once, with null partitions, and equal rows as often as they occur.
    """
    name = by[-1]
    own = F.when(F.col(name).isNull(), F.col("log_index"))  # events without an id are no group
    e = events.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*by, own)))
    alone = (F.col("_n") == 1) | F.col(name).isNull()
    once = e.where(alone).drop("_n").withColumn("decision", F.lit(FRESH))
    hashed = F.xxhash64(F.coalesce(F.col(payload).cast("string"), F.lit("")))
    more = e.where(~alone).drop("_n").withColumn("_h", hashed).repartition(*by).sortWithinPartitions(*by, "log_index")

    def fold(batches):
        current, known, h, t = None, False, 0, 0
        for b in batches:
            said = []
            keys = zip(*[b.column(c).to_pylist() for c in by], strict=True)
            for key, tick, payload_hash in zip(keys, b.column("tick_ms").to_pylist(), b.column("_h").to_pylist(), strict=True):
                if key != current:
                    current, known = key, False
                if not known:
                    known, h, t = True, payload_hash, tick
                    said.append(FRESH)
                elif tick - t > window_ms:
                    known = False
                    said.append(EXPIRED)
                elif payload_hash == h:
                    t = tick
                    said.append(DUPLICATE)
                else:
                    said.append(DIVERGENT)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(said, pa.string())], [*b.schema.names[:-1], "decision"])

    told = more.mapInArrow(fold, T.StructType([*events.schema.fields, T.StructField("decision", T.StringType())]))
    return once.unionByName(told)


def fresh(decided: DataFrame) -> DataFrame:
    return decided.where(F.col("decision") == FRESH).drop("decision")


def counters(decided: DataFrame) -> DataFrame:
    """(partition_id, total, dedup_skipped, divergent)."""
    skipped, apart = F.col("decision") != FRESH, F.col("decision") == DIVERGENT
    return decided.groupBy("partition_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(skipped).alias("dedup_skipped"), F.count_if(apart).alias("divergent"))
