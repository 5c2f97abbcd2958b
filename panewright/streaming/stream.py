"""The pipeline over streams.

Pane cadence: built-in window aggregation gives each pane's sums once its watermark has passed; a
foreachBatch step folds the newest panes and runs the rules.

Event cadence: one stateful processor for each partition keeps the ids seen, the greatest ticks and the panes that an event which is not late can still
reach, and gives a binding row for each measurement. Retries, lateness and skew are judged as in the batch plan. Rules
and channels stay column code behind it. Two things differ. An id is forgotten when the log has moved on by two retry windows, so a retry that comes
after that is Fresh and not RetryExpired. And where panes go by event time and ticks come out of order, the batch plan sees in a window's older panes
also what came later in the log, which a stream cannot; with head panes, or ticks in order, the two give the same.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..model import AggregationConfig, MetricSpec
from ..operators import windows
from ..operators.timesem import FUTURE_MS, GUARD_MS, LATENESS_MS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State beyond memory, with changelog checkpoints instead of whole snapshots."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def pane_stream(events: DataFrame, pane_ms: int, late_ms: int) -> DataFrame:
    """(partition_id, metric, lane, pane, s, n, c, lo, hi) of each pane, once, when the watermark has passed it. late_ms: lateness and correction together."""
    timed = events.withColumn("at", F.timestamp_millis("tick_ms")).withWatermark("at", f"{late_ms} milliseconds")
    rows = windows.explode_measurements(timed, ("at",))
    panes = rows.groupBy("partition_id", "metric", "lane", F.window("at", f"{pane_ms} milliseconds").alias("w"))
    v = F.when(~F.isnan("value"), F.col("value"))
    states = panes.agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("s"), F.count(F.lit(1)).alias("n"), F.count("value").alias("c"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    return states.select("partition_id", "metric", "lane", F.floor(F.unix_millis("w.start") / pane_ms).alias("pane"), "s", "n", "c", "lo", "hi")


def write_batches(df: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append", once: bool = True) -> StreamingQuery:
    """Starts a query that hands each micro-batch to handle(); once: stops when all there is has been read."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_parquet(df: DataFrame, checkpoint: str, path: str, once: bool = True) -> StreamingQuery:
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", path)
    return (writer.trigger(availableNow=True) if once else writer).start()


def drop_retries(events: DataFrame, retry_ms: int) -> DataFrame:
    """The first event of each id within the window. Simpler than the batch machine: a retry does not extend the window, and payloads are not compared."""
    timed = events.withColumn("_at", F.timestamp_millis("tick_ms")).withWatermark("_at", f"{retry_ms} milliseconds")
    return timed.dropDuplicatesWithinWatermark(["partition_id", "event_id"]).drop("_at")


BINDING_ROWS = T.StructType([
    T.StructField("partition_id", T.StringType()),
    T.StructField("log_index", T.LongType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("spec", T.StringType()),
    T.StructField("lane", T.IntegerType()),
    T.StructField("ord", T.LongType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("result", T.DoubleType()),
])


class _Pane:
    """The merged state of one (metric, lane, pane), for all kinds at once."""

    @staticmethod
    def add(s: dict, value: float | None, item: str | None) -> None:
        s["n"] = s.get("n", 0) + 1
        if value is not None:
            s["s"] = s.get("s", 0.0) + value
            s["c"] = s.get("c", 0) + 1
            if value == value:
                s["lo"], s["hi"] = min(s.get("lo", value), value), max(s.get("hi", value), value)
                s.setdefault("vs", []).append(value)
                if item is not None:
                    s["top"] = max(s.get("top", value), value)
        if item is not None:
            s.setdefault("items", {})[item] = 1


def _finish(spec: MetricSpec, states: Sequence[dict]) -> float | None:
    got = lambda k: [s[k] for s in states if k in s]
    match spec.kind:
        case "sum":
            return float(sum(got("s")))
        case "count":
            return float(sum(got("n")))
        case "avg":
            n = sum(got("c"))
            return sum(got("s")) / n if n else None
        case "min":
            return min(got("lo"), default=None)
        case "max":
            return max(got("hi"), default=None)
        case "topk":
            return max(got("top"), default=None) if (spec.param or 0) >= 1 else None
        case "quantile":
            values = sorted(v for vs in got("vs") for v in vs)
            q = min(1.0, max(0.0, 0.5 if spec.param is None else spec.param))
            return values[int(q * (len(values) - 1) + 0.5)] if values else None
        case _:
            return float(len({i for items in got("items") for i in items}))


class PartitionProcessor(StatefulProcessor):
    """State: `panes` by "metric|lane|pane"; `seen` by event id with its tick and payload's hash; `clock`: the newest pane, the greatest ticks and arrivals, and where panes and ids were last cleared."""

    def __init__(self, config: AggregationConfig, retry_ms: int, lateness_ms: int = LATENESS_MS, guard_ms: int = GUARD_MS, arrival: bool = False) -> None:
        self.config, self.retry_ms, self.lateness_ms, self.guard_ms, self.arrival = config, retry_ms, lateness_ms, guard_ms, arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.panes = handle.getMapState("panes", "key string", "state string")
        self.seen = handle.getMapState("seen", "id string", "tick bigint, payload bigint")
        self.clock = handle.getValueState("clock", "state string")

    def _fresh(self, r) -> bool:
        """The retry machine, as in operators.dedup."""
        if r.event_id is None:
            return True
        if not self.seen.containsKey((r.event_id,)):
            self.seen.updateValue((r.event_id,), (int(r.tick_ms), int(r.payload)))
            return True
        tick, payload = self.seen.getValue((r.event_id,))
        if r.tick_ms - tick > self.retry_ms:
            self.seen.removeKey((r.event_id,))
        elif payload == r.payload:
            self.seen.updateValue((r.event_id,), (int(r.tick_ms), int(payload)))
        return False

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = [r for pdf in rows for r in pdf.itertuples(index=False)]  # one micro-batch of one partition; maxFilesPerTrigger bounds it
        every.sort(key=lambda r: r.log_index)
        now = json.loads(self.clock.get()[0]) if self.clock.exists() else {"head": -1, "tick": {}, "arrival": {}, "panes": 0, "ids": 0}
        cache: dict[str, dict] = {}
        out = []
        q, specs = self.config.pane_ms, self.config.specs
        own = {s.metric: s for s in specs if s.lateness_ms is not None}
        horizon = {s.metric: s.correction_ms for s in specs}

        def state(name: str) -> dict:
            if name not in cache:
                held = self.panes.getValue((name,)) if self.panes.containsKey((name,)) else None
                cache[name] = json.loads(held[0]) if held else {}
            return cache[name]

        def watermark(metric: str) -> int | None:
            s = own.get(metric)
            name = metric if s else ""
            if name not in now["tick"]:
                return None
            mark = now["tick"][name] - ((s.lateness_ms or 0) if s else self.lateness_ms)
            if name in now["arrival"]:
                mark = min(mark, now["arrival"][name] - (s.guard_ms if s and s.guard_ms is not None else self.guard_ms))
            return max(mark, 0)

        for r in every:
            if not self._fresh(r):
                continue
            came = None if not self.arrival or pd.isna(r.arrival_ms) else int(r.arrival_ms)
            if came is not None and r.tick_ms > came + FUTURE_MS:
                continue
            ms = json.loads(r.measurements)
            for name in {"", *[m["metric"] for m in ms if m["metric"] in own]}:
                now["tick"][name] = max(now["tick"].get(name, int(r.tick_ms)), int(r.tick_ms))
                if came is not None:
                    now["arrival"][name] = max(now["arrival"].get(name, came), came)
            late = lambda m, r=r: m["metric"] in horizon and (w := watermark(m["metric"])) is not None and r.tick_ms < max(w - horizon[m["metric"]], 0)
            kept = [m for m in ms if not late(m)]
            if not kept:
                continue
            pane = r.tick_ms // q
            if self.config.pane_assignment == "head":
                pane = max(pane, now["head"])
            now["head"] = max(int(pane), now["head"])
            for place, m in enumerate(kept):
                bits = m.get("lane_bitmap") or 0
                lanes = [b for b in range(64) if bits >> b & 1] or [0]
                mine = [s for s in specs if s.metric == m["metric"]]
                for lane in lanes if mine else ():
                    _Pane.add(state(f"{m['metric']}|{lane}|{pane}"), m.get("value"), m.get("item"))
                    for s in mine:
                        got = [state(f"{m['metric']}|{lane}|{p}") for p in range(pane - self.config.panes(s) + 1, pane + 1)]
                        out.append((key[0], r.log_index, r.event_id, s.name, lane, place * 64 + lane, m.get("labels") or {}, _finish(s, [g for g in got if g])))
        for name, s in cache.items():
            if s:
                self.panes.updateValue((name,), (json.dumps(s),))
        self._clear(now, {m: watermark(m) for m in horizon})
        self.clock.update((json.dumps(now),))
        yield pd.DataFrame(out, columns=[f.name for f in BINDING_ROWS.fields]).astype({"result": "float64"})

    def _clear(self, now: dict, marks: dict[str, int | None]) -> None:
        """Forgets panes that no event can reach which is not late, and ids behind two retry windows; both are looked through only when they can have grown old by a window's length."""
        c = self.config
        reach = {s.metric: max(c.panes(x) for x in c.specs if x.metric == s.metric) for s in c.specs}
        if c.pane_assignment == "head":
            oldest = {m: now["head"] - n + 1 for m, n in reach.items()}
        else:
            corrections = {s.metric: s.correction_ms for s in c.specs}
            oldest = {m: (max(w - corrections[m], 0) // c.pane_ms - reach[m] + 1) for m, w in marks.items() if w is not None}
        if now["head"] - now["panes"] >= max(reach.values(), default=1):
            now["panes"] = now["head"]
            for (name,) in list(self.panes.keys()):
                metric, _, pane = name.rsplit("|", 2)
                if int(pane) < oldest.get(metric, int(pane)):
                    self.panes.removeKey((name,))
        top = now["tick"].get("", 0)
        if top - now["ids"] > self.retry_ms:
            now["ids"] = top
            for name in list(self.seen.keys()):
                if self.seen.getValue(name)[0] < top - 2 * self.retry_ms:
                    self.seen.removeKey(name)

    def close(self) -> None:
        pass


def event_stream(events: DataFrame, config: AggregationConfig, retry_ms: int = 1_800_000, lateness_ms: int = LATENESS_MS, guard_ms: int = GUARD_MS, arrival: bool = False) -> DataFrame:
    """A binding row for each measurement, lane and spec of a stream of model.EVENT rows, in order of the log within each micro-batch.

    Files must come in log order; ticks may come in any. Retried and late measurements, and with arrival events from the future, give no rows. Null ids are never retries.
    """
    config.checked()
    rows = events.select("partition_id", "log_index", "tick_ms", "arrival_ms", "event_id", F.xxhash64(F.coalesce("payload", F.lit(""))).alias("payload"), F.to_json(F.coalesce("measurements", F.array().cast(events.schema["measurements"].dataType))).alias("measurements"))
    return rows.groupBy("partition_id").transformWithStateInPandas(PartitionProcessor(config, retry_ms, lateness_ms, guard_ms, arrival), BINDING_ROWS, "Append", "None")
