"""What depends on the order of a partition's log: routing, ticks, rates, versions, retention."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import ConfigError

SO_FAR = (W.unboundedPreceding, W.currentRow)
#: Places of a log that one task puts in order.
CHUNK = 1 << 20


def running_max(df: DataFrame, values: Mapping[str, Column], chunk: int = CHUNK) -> DataFrame:
    """df with a column for each of values: the greatest so far in its partition's log, which log_index orders.

    The greatest of each chunk of a log comes from a plain aggregate; only these few go through a window over whole
    logs. Within a chunk rows are ordered by themselves, so a log is spread over its chunks. Null partitions and places are kept.
    """
    names = list(values)
    key = F.struct("partition_id", F.floor(F.col("log_index") / chunk).alias("chunk"))
    ends = df.groupBy(key.alias("_b")).agg(*[F.max(v).alias(f"_e{k}") for k, v in enumerate(values.values())])
    earlier = W.partitionBy(F.col("_b")["partition_id"]).orderBy(F.col("_b")["chunk"]).rowsBetween(W.unboundedPreceding, -1)
    before = ends.select("_b", *[F.max(f"_e{k}").over(earlier).alias(f"_e{k}") for k in range(len(names))])
    inside = W.partitionBy("_k").orderBy("log_index").rowsBetween(*SO_FAR)
    e = df.select("*", key.alias("_k"), *[v.alias(f"_v{k}") for k, v in enumerate(values.values())])
    e = e.select(*df.columns, "_k", *[F.max(f"_v{k}").over(inside).alias(f"_v{k}") for k in range(len(names))])
    out = e.join(before, F.col("_k") == F.col("_b"))
    return out.select(*df.columns, *[F.greatest(f"_v{k}", f"_e{k}").alias(n) for k, n in enumerate(names)])


def fnv1a(key: Column) -> Column:
    """64-bit FNV-1a of a string's or binary's bytes, as a signed bigint. Null: null.

    Multiplication that wraps has no built-in, so this is an Arrow UDF that goes over byte positions and not over rows.
    """

    @F.pandas_udf("bigint")
    def hashed(s: pd.Series) -> pd.Series:
        raw = [b"" if x is None else x.encode() if isinstance(x, str) else bytes(x) for x in s]
        size = np.array([len(r) for r in raw])
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        start = (np.cumsum(size) - size)[order]
        h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)  # fixed values: FNV's basis and prime
        live = len(raw)
        for k in range(int(size.max(initial=0))):
            while live and size[order[live - 1]] <= k:
                live -= 1
            h[:live] = (h[:live] ^ flat[start[:live] + k]) * np.uint64(0x100000001B3)
        out = np.empty_like(h)
        out[order] = h
        return pd.Series(pd.arrays.IntegerArray(out.view(np.int64), s.isna().to_numpy()))

    return hashed(key)


def route(events: DataFrame, key: Column, partitions: Sequence[str], exact: bool = False) -> DataFrame:
    """events with partition_id, the placement that the key's hash picks in the order given.

    exact: by FNV-1a, as other producers of the same log route; else by xxhash64, which stays in generated code.
    """
    check_topology([(p, None) for p in partitions])
    n = len(partitions)
    if exact:  # the remainder of the unsigned hash: 2^64 mod n is added for negative ones
        h = fnv1a(key)
        slot = F.pmod(F.pmod(h, F.lit(n)) + F.when(h < 0, F.lit(pow(2, 64, n))).otherwise(0), F.lit(n))
    else:
        slot = F.pmod(F.xxhash64(key), F.lit(n))
    return events.withColumn("partition_id", F.element_at(F.array(*[F.lit(p) for p in partitions]), slot.cast("int") + 1))


def check_topology(placements: Sequence[tuple[str, Sequence[str] | None]], replicas: int = 3) -> None:
    """Placements need distinct, non-empty names and, if members are given, `replicas` of them."""
    names = [p for p, _ in placements]
    if not names:
        raise ConfigError("no partitions")
    if any(not n for n in names):
        raise ConfigError("a partition has no name")
    if len(set(names)) != len(names):
        raise ConfigError("a partition is named twice")
    for name, members in placements:
        if members is not None and (len(members) != replicas or len(set(members)) != replicas):
            raise ConfigError(f"{name}: {replicas} different members are needed")


def with_log_index(events: DataFrame, *order: str) -> DataFrame:
    """log_index from 1 in each partition, in the order of the given columns."""
    return events.withColumn("log_index", F.row_number().over(W.partitionBy("partition_id").orderBy(*order)).cast("long"))


def commit_ticks(events: DataFrame, millis: str, out: str = "tick_ms", chunk: int = CHUNK) -> DataFrame:
    """Ticks that follow millis but strictly rise in log order: t = max(millis, last + 1).

    Less its place in the log, a tick is the running maximum of millis less theirs; both are made by chunks, as in running_max().
    """
    e = events.withColumn("_k", F.struct("partition_id", F.floor(F.col("log_index") / chunk).alias("chunk")))
    by = W.partitionBy("_k").orderBy("log_index")
    e = e.withColumn("_i", F.row_number().over(by).cast("long"))
    e = e.withColumn("_m", F.max(F.col(millis) - F.col("_i")).over(by.rowsBetween(*SO_FAR)))
    earlier = W.partitionBy(F.col("_b")["partition_id"]).orderBy(F.col("_b")["chunk"]).rowsBetween(W.unboundedPreceding, -1)
    ends = e.groupBy(F.col("_k").alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.max("_m").alias("_top"))
    ends = ends.withColumn("_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    ends = ends.select("_b", "_n", F.max(F.col("_top") - F.col("_n")).over(earlier).alias("_top"))
    both = e.join(ends, F.col("_k") == F.col("_b"))
    tick = F.greatest(F.col("_m") - F.col("_n"), "_top") + F.col("_n") + F.col("_i")
    return both.withColumn(out, tick).select(*[c for c in events.columns if c != out], out)


def replay_ticks(events: DataFrame, millis: str, out: str = "tick_ms") -> DataFrame:
    """Ticks of a replayed log: time since its first entry, strictly rising."""
    first = events.groupBy(F.struct("partition_id").alias("_p")).agg(F.min_by(millis, "log_index").alias("_first"))
    e = events.withColumn("_q", F.struct("partition_id")).join(first, F.col("_q") == F.col("_p"))
    e = e.withColumn("_m", F.greatest(F.col(millis) - F.col("_first"), F.lit(0))).drop("_p", "_q", "_first")
    return commit_ticks(e, "_m", out).drop("_m")


def last_tick(entries: DataFrame, after: int | None = None) -> DataFrame:
    """(partition_id, log_index, tick_ms) of each partition's last entry, of those behind a checkpoint if one is given."""
    e = entries if after is None else entries.where(F.col("log_index") > after)
    return e.groupBy("partition_id").agg(F.max("log_index").alias("log_index"), F.max_by("tick_ms", "log_index").alias("tick_ms"))


def commit_rate(events: DataFrame, alpha: float = 0.2, seed: DataFrame | None = None) -> DataFrame:
    """events with rate: the moving average of 1000 / max(step, 1) events a second, seeded by the first step.

    seed: (partition_id, tick_ms, rate) of a snapshot, from which a partition's average goes on.

    Folded over runs of events, then over the runs: within a run of n the average is a weighted sum, and what the run
    before leaves decays by (1 - alpha)^n. Runs are so long that what is older than two of them weighs less than a double can show.
    """
    if not 0 < alpha <= 1:
        raise ConfigError(f"alpha must be above 0 and at most 1, not {alpha}")
    columns = events.columns
    e = events.withColumn("_seed", F.lit(None).cast("double"))
    if seed is not None:
        e = e.unionByName(seed.select("partition_id", F.lit(-(1 << 62)).cast("long").alias("log_index"), "tick_ms", F.col("rate").cast("double").alias("_seed")), allowMissingColumns=True)
    by = W.partitionBy("partition_id").orderBy("log_index")
    step = F.col("tick_ms") - F.lag("tick_ms").over(by)
    # the first number of the average is the seed, or else the first step, which the second event has
    e = e.withColumn("_i", F.row_number().over(by) - F.when(F.first("_seed").over(by).isNull(), 2).otherwise(1))
    e = e.withColumn("_x", F.coalesce("_seed", 1000.0 / F.greatest(step, F.lit(1))))
    if alpha == 1:
        return e.where("_seed is null").select(*columns, F.when(F.col("_i") >= 0, F.col("_x")).alias("rate"))
    decay = -math.log2(1 - alpha)
    size = max(1, min(max(64, math.ceil(60 / decay)), int(900 / decay)))
    e = e.withColumn("_run", F.when(F.col("_i") < 0, F.lit(-1)).otherwise(F.floor(F.col("_i") / size))).withColumn("_k", F.pmod(F.col("_i"), F.lit(size)))
    e = e.withColumn("_g", F.struct("partition_id", "_run"))
    weight = F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    # within a run: sum of weight * x * (1 - alpha)^(k - j), from prefix sums of x * (1 - alpha)^-j
    scaled = F.sum(weight * F.col("_x") * F.pow(F.lit(1 - alpha), -F.col("_k"))).over(W.partitionBy("_g").orderBy("_k").rowsBetween(*SO_FAR))
    e = e.withColumn("_own", scaled * F.pow(F.lit(1 - alpha), F.col("_k")))
    ends = e.where("_run >= 0").groupBy(F.col("_g").alias("_r")).agg(F.max_by("_own", "_k").alias("own"), (F.max("_k") + 1).alias("n"))
    back = math.ceil(120 / (size * decay))
    lists = F.sort_array(F.collect_list(F.struct(F.col("_r")["_run"].alias("run"), "own", "n")).over(W.partitionBy(F.col("_r")["partition_id"]).orderBy(F.col("_r")["_run"]).rowsBetween(-back, -1)))
    before = ends.select("_r", F.aggregate(lists, F.lit(0.0), lambda acc, r: acc * F.pow(F.lit(1 - alpha), r["n"]) + r["own"]).alias("_left"))
    out = e.join(before, F.col("_g") == F.col("_r"), "left").where("_seed is null")
    rate = F.col("_own") + F.coalesce("_left", F.lit(0.0)) * F.pow(F.lit(1 - alpha), F.col("_k") + 1)
    return out.select(*columns, F.when(F.col("_i") >= 0, rate).alias("rate"))


def capacity(rate: Column) -> Column:
    """Events a second to make room for: the rate, to a millionth, rounded up."""
    return F.ceil(F.round(rate, 6)).cast("long")


def reconcile_capacity(rates: DataFrame, every_ms: int = 30_000) -> DataFrame:
    """The moments at which a partition's capacity is raised: samples at least every_ms apart that are above all before.

    Which sample counts depends on the last one that did, so each partition is folded in order, in
    batches; no group is held.
    """

    r = rates.select("partition_id", "log_index", "tick_ms", "rate").repartition("partition_id").sortWithinPartitions("partition_id", "log_index")

    def per_task(batches):
        state: dict[str, tuple] = {}
        for b in batches:
            rows = []
            for p, tick, rate in zip(b["partition_id"], b["tick_ms"], b["rate"], strict=True):
                last, top = state.get(p, (None, 0))
                if pd.isna(rate) or (last is not None and tick - last < every_ms):
                    continue
                want = int(np.ceil(round(rate, 6)))
                if want > top:
                    rows.append((p, int(tick), want))
                state[p] = (tick, max(top, want))
            yield pd.DataFrame(rows, columns=["partition_id", "tick_ms", "capacity"])

    return r.mapInPandas(per_task, "partition_id string, tick_ms bigint, capacity bigint")


def last_writer_wins(events: DataFrame, key: str = "partition_key", seq: str = "seqno") -> DataFrame:
    """events with applied and last_seq: an event applies if its number is above all before of its key."""
    before = W.partitionBy("partition_id", key).orderBy("log_index").rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn("last_seq", F.max(seq).over(before)).withColumn("applied", F.col("last_seq").isNull() | (F.col(seq) > F.col("last_seq")))


def select_version(log_index: Column, active: int, staged: int | None, barrier: int | None) -> Column:
    """The version that an entry is judged by: the staged one from the barrier on."""
    if staged is None or barrier is None:
        return F.lit(active)
    return F.when(log_index >= barrier, F.lit(staged)).otherwise(F.lit(active))


def versions_as_of(events: DataFrame, versions: DataFrame, first: int = 0) -> DataFrame:
    """events with version: that of the last row of versions (partition_id, barrier, version) whose barrier is not above log_index.

    Both are sorted as one sequence and the last version is carried on, so nothing is joined.
    """
    e = events.select("*", F.lit(None).cast("bigint").alias("_v"), F.lit(1).alias("_side"), F.col("log_index").alias("_at"))
    v = versions.select("partition_id", F.col("version").cast("bigint").alias("_v"), F.lit(0).alias("_side"), F.col("barrier").alias("_at"))
    both = e.unionByName(v, allowMissingColumns=True)
    carried = F.last("_v", True).over(W.partitionBy("partition_id").orderBy("_at", "_side").rowsBetween(*SO_FAR))
    return both.withColumn("version", F.coalesce(carried, F.lit(first))).where("_side = 1").drop("_v", "_side", "_at")


def retention_plan(state: DataFrame) -> DataFrame:
    """state (full_floor, incremental_floor, horizon, retry_s, rate, learner_floor) with floor, dedup_floor, retain_from, learner_floor raised."""
    floor = F.greatest("full_floor", F.coalesce("incremental_floor", F.lit(0)))
    window = F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(1.0), F.col("retry_s")) * F.greatest(F.lit(1.0), F.col("rate"))))
    out = state.withColumn("floor", floor).withColumn("dedup_floor", F.greatest(F.col("horizon") - window, F.lit(0)))
    out = out.withColumn("retain_from", F.greatest("floor", "dedup_floor"))
    return out.withColumn("learner_floor", F.greatest(F.coalesce("learner_floor", F.lit(0)), "retain_from"))
