"""Derived events: their ids, their channels' policies, their sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import ChannelPolicy

DERIVED_FLAG = "DERIVED"
DROP_OLDEST, BLOCK, DEAD_LETTER, LOOP = "QueueFullDropOldest", "QueueFullBlockTimeout", "DeadLetterOverflow", "DeadLetterLoop"
MOST_HOPS = 4


def derived_id(partition: Column, log_index: Column, version: Column, rule: Column, channel: Column) -> Column:
    """16 hexadecimal digits that depend on these five and nothing else, so that a replay gives the same."""
    return F.substring(F.sha2(F.concat_ws("|", partition, log_index.cast("string"), version.cast("string"), rule, channel), 256), 1, 16)


def apply_policies(emissions: DataFrame, policies: Mapping[str, ChannelPolicy], batch: tuple[str, ...] = ("batch_id",), order: tuple[str, ...] = ("log_index", "rule_pos"), keep_at_zero: bool = False) -> tuple[DataFrame, DataFrame]:
    """(emissions that stay, drops (batch, channel, reason, derived_event_id)).

    A channel without a policy or capacity keeps all. drop_oldest keeps a batch's last `capacity` rows, block its first. dead_letter
    keeps the last and sends the others on to its target, whose policy they then meet, where they stand when the row
    that displaced them came; after four hops, or if the target is the channel itself, they are dropped. keep_at_zero: a capacity
    of 0 keeps all, and still counts drops.
    """
    b = list(batch)
    named = {c: p for c, p in policies.items() if p.capacity is not None}
    if not named:
        return emissions, emissions.where("false").select(*b, "channel", F.lit("").alias("reason"), "derived_event_id")
    # a place is an order's columns and the hops made since, so no batch is numbered as a whole
    rows = emissions.withColumn("_at", F.struct(*order, F.lit(0).alias("hop")))
    hops = _rounds(named)
    kinds = lambda f, other: F.coalesce(*[F.when(F.col("channel") == c, f(p)) for c, p in named.items()], other)
    dropped = None
    for hop in range(hops):
        by = W.partitionBy(*b, "channel")
        rows = rows.withColumn("_cap", kinds(lambda p: F.lit(p.capacity), F.lit(None).cast("int"))).withColumn("_kind", kinds(lambda p: F.lit(p.kind), F.lit(None).cast("string"))).withColumn("_to", kinds(lambda p: F.lit(p.target).cast("string"), F.lit(None).cast("string")))
        rows = rows.withColumn("_up", F.row_number().over(by.orderBy("_at"))).withColumn("_down", F.row_number().over(by.orderBy(F.col("_at").desc())))
        over = F.col("_cap").isNotNull() & F.when(F.col("_kind") == "block", F.col("_up") > F.col("_cap")).otherwise(F.col("_down") > F.col("_cap"))
        if keep_at_zero:
            over = over & ~((F.col("_kind") == "drop_oldest") & (F.col("_cap") == 0))
        marked = rows.withColumn("_over", over).withColumn("_then", kinds(lambda p: F.lead("_at", p.capacity).over(by.orderBy("_at")), F.lit(None).cast(rows.schema["_at"].dataType)))
        reason = F.when(F.col("_kind") == "block", BLOCK).when(F.col("_kind") == "drop_oldest", DROP_OLDEST).when(F.col("_to").isNull() | (F.col("_to") == F.col("channel")) | F.lit(hop >= MOST_HOPS), LOOP).otherwise(DEAD_LETTER)
        said = marked.where("_over").select(*b, "channel", reason.alias("reason"), "derived_event_id")
        dropped = said if dropped is None else dropped.unionByName(said)
        stays = marked.where("not _over")
        sending = any(p.kind == "dead_letter" for p in named.values()) and hop < MOST_HOPS
        if not sending:
            rows = stays
            break
        # a row that is sent on arrives just after the one that displaced it, which came `capacity` places later
        sent = marked.where(F.col("_over") & (reason == DEAD_LETTER)).withColumn("channel", F.col("_to"))
        sent = sent.withColumn("_at", F.coalesce("_then", "_at").withField("hop", F.lit(hop + 1))).select(*emissions.columns, "_at")
        rows = stays.select(*emissions.columns, "_at").unionByName(sent)
    return rows.select(*emissions.columns), dropped


def _rounds(policies: Mapping[str, ChannelPolicy]) -> int:
    """How often channels have to be looked at: once more for each time that a row can be sent on and meet a limit again."""

    def depth(channel: str | None, hop: int) -> int:
        p = policies.get(channel or "")
        if p is None:
            return 0
        return 1 if p.kind != "dead_letter" or hop >= MOST_HOPS else 1 + depth(p.target, hop + 1)

    return max(depth(c, 0) for c in policies)


def drop_counters(drops: DataFrame) -> DataFrame:
    return drops.groupBy("channel", "reason").agg(F.count(F.lit(1)).alias("n"))


def write_channels(emissions: DataFrame, path: str, mode: str = "append") -> None:
    """One folder for each channel; characters that a path cannot hold are escaped by the writer."""
    emissions.write.mode(mode).partitionBy("channel").parquet(path)
