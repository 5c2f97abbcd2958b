"""A query for each operator over the driver's tables, and the same in SQL.

The `events` table is the log: partition = user_id % 8, place = event_id, tick = ts in
milliseconds, lane = event_type, item = user_id, one-hour panes. Where an operator needs late,
repeated or foreign data that the table does not hold, both sides derive it by the same arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.aggregates import Family
from .model import AggregationConfig, ChannelPolicy, MetricSpec, Rule
from .operators import dedup, emit, lanes, readiness, sequence, series, tiers, timesem, windows
from .plans import batch, bundle, cel, promql
from .sources import tables

HOUR = 3_600_000
BY = ("partition_id", "lane")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def log(spark: SparkSession, sf_dir: str, late_hours: int = 0) -> DataFrame:
    """The events as measurement rows. late_hours: every seventh event's tick is moved back by so many."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    if late_hours:
        t = t - F.when(F.col("event_id") % 7 == 0, late_hours * HOUR).otherwise(0)
    return e.select(
        F.pmod("user_id", F.lit(8)).alias("partition_id"), F.col("event_id").alias("log_index"), t.alias("tick_ms"), F.lit("value").alias("metric"),
        F.col("event_type").alias("lane"), "value", F.col("user_id").cast("string").alias("item"), F.lit(0).alias("ord"), F.lit(None).cast("bigint").alias("arrival_ms"), F.concat(F.lit("evt-"), F.col("event_id")).alias("event_id"),
        F.col("props").alias("payload"),
    )


def paned(spark: SparkSession, sf_dir: str, late_hours: int = 0) -> DataFrame:
    return windows.with_pane(log(spark, sf_dir, late_hours), HOUR)


LOG = "WITH e AS (SELECT user_id % 8 AS partition_id, event_id AS log_index, (epoch_us(ts) // 1000) AS tick_ms, event_type AS lane, value, user_id::VARCHAR AS item, (epoch_us(ts) // 1000) // 3600000 AS pane, props FROM events)"
LATE = LOG.replace("(epoch_us(ts) // 1000) // 3600000", "((epoch_us(ts) // 1000) - CASE WHEN event_id % 7 = 0 THEN 32400000 ELSE 0 END) // 3600000").replace("(epoch_us(ts) // 1000) AS tick_ms", "(epoch_us(ts) // 1000) - CASE WHEN event_id % 7 = 0 THEN 32400000 ELSE 0 END AS tick_ms")
FOLDS = {"sum": "sum(value)", "count": "count(*)::DOUBLE", "avg": "avg(value)", "min": "min(value)", "max": "max(value)"}


def r4(c: str):
    return F.round(F.col(c), 8).alias(c)


# ---------------------------------------------------------------- panes and windows


def _tumbling(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return windows.tumbling(paned(spark, sf_dir), Family(kind), BY).select(*BY, "pane", r4("value"))

    query(f"{LOG} SELECT partition_id, lane, pane, round({FOLDS[kind]}, 8) AS value FROM e GROUP BY ALL", f"pane_tumbling_{kind}")(run)


def _sliding(kind: str):
    old, now = {"sum": ("sum(s)", "sum(value)"), "count": ("sum(n)", "count(*)"), "min": ("min(lo)", "min(value)"), "max": ("max(hi)", "max(value)"), "avg": ("sum(s)", "sum(value)")}[kind]
    merge = {"sum": "coalesce(old, 0) + now", "count": "(coalesce(old, 0) + now)::DOUBLE", "min": "least(old, now)", "max": "greatest(old, now)", "avg": "(coalesce(old, 0) + now) / (coalesce(oldn, 0) + nown)"}[kind]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return windows.sliding_events(paned(spark, sf_dir, 9), Family(kind), 6, BY).select(*BY, "log_index", r4("result"))

    query(
        f"""{LATE}, p AS (SELECT partition_id, lane, pane, sum(value) AS s, count(*) AS n, min(value) AS lo, max(value) AS hi FROM e GROUP BY ALL),
        o AS (SELECT partition_id, lane, pane, {old} OVER w AS old, sum(n) OVER w AS oldn FROM p WINDOW w AS (PARTITION BY partition_id, lane ORDER BY pane RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)),
        c AS (SELECT *, {now} OVER w AS now, count(*) OVER w AS nown FROM e WINDOW w AS (PARTITION BY partition_id, lane, pane ORDER BY log_index ROWS UNBOUNDED PRECEDING))
        SELECT partition_id, lane, log_index, round({merge}, 8) AS result FROM c JOIN o USING (partition_id, lane, pane)""",
        f"window_event_{kind}",
    )(run)


for _kind in FOLDS:
    _tumbling(_kind)
    _sliding(_kind)

#: For kinds whose state is a set of rows: each event against the rows of its window so far.
PAIRS = f"""{LATE}, w AS (SELECT a.partition_id, a.lane, a.log_index, b.value, b.item FROM e a JOIN e b ON a.partition_id = b.partition_id AND a.lane = b.lane
  AND b.pane BETWEEN a.pane - 2 AND a.pane AND (b.pane < a.pane OR b.log_index <= a.log_index))"""


@query(f"{PAIRS} SELECT partition_id, lane, log_index, list_sort(list(value))[floor(0.95 * (count(*) - 1) + 0.5)::INT + 1] AS result FROM w GROUP BY ALL")
def window_event_quantile(spark, sf_dir):
    return windows.sliding_events(paned(spark, sf_dir, 9), Family("quantile", 0.95), 3, BY).select(*BY, "log_index", "result")


@query(f"{PAIRS} SELECT partition_id, lane, log_index, count(DISTINCT item)::DOUBLE AS result FROM w GROUP BY ALL")
def window_event_distinct(spark, sf_dir):
    return windows.sliding_events(paned(spark, sf_dir, 9), Family("distinct"), 3, BY).select(*BY, "log_index", "result")


@query(f"{PAIRS} SELECT partition_id, lane, log_index, max(value) AS result FROM w GROUP BY ALL")
def window_event_topk(spark, sf_dir):
    return windows.sliding_events(paned(spark, sf_dir, 9), Family("topk", 3), 3, BY).select(*BY, "log_index", "result")


@query(f"{LOG} SELECT partition_id, lane, pane, list_sort(list(value))[floor(0.5 * (count(*) - 1) + 0.5)::INT + 1] AS value FROM e GROUP BY ALL")
def pane_quantile(spark, sf_dir):
    return windows.tumbling(paned(spark, sf_dir), Family("quantile", 0.5), BY)


@query(f"{LOG} SELECT partition_id, lane, pane, count(DISTINCT item)::DOUBLE AS value FROM e GROUP BY ALL")
def pane_distinct(spark, sf_dir):
    return windows.tumbling(paned(spark, sf_dir), Family("distinct"), BY)


@query(f"""{LOG}, b AS (SELECT partition_id, lane, pane // 24 AS pane, item, max(value) AS value FROM e GROUP BY ALL)
SELECT * FROM (SELECT partition_id, lane, pane, item, value, row_number() OVER (PARTITION BY partition_id, lane, pane ORDER BY value DESC, item)::INT AS place FROM b) WHERE place <= 3""")
def pane_topk_entries(spark, sf_dir):
    daily = paned(spark, sf_dir).withColumn("pane", F.floor(F.col("pane") / 24))
    return windows.topk_entries(daily, 3, (*BY, "pane"))


@query(f"""{LOG}, p AS (SELECT partition_id, lane, pane, sum(value) AS s FROM e GROUP BY ALL)
SELECT partition_id, lane, pane, round(sum(s) OVER (PARTITION BY partition_id, lane ORDER BY pane RANGE BETWEEN 23 PRECEDING AND CURRENT ROW), 8) AS value FROM p""")
def pane_sliding_sum(spark, sf_dir):
    return windows.sliding_panes(paned(spark, sf_dir), Family("sum"), 24, BY).select(*BY, "pane", r4("value"))


def _frames(*hours: int) -> str:
    return ", ".join(f"round(sum(s) OVER (PARTITION BY partition_id, lane ORDER BY pane RANGE BETWEEN {h - 1} PRECEDING AND CURRENT ROW), 8) AS h{h}" for h in hours)


@query(f"{LOG}, p AS (SELECT partition_id, lane, pane, sum(value) AS s FROM e GROUP BY ALL) SELECT partition_id, lane, pane, {_frames(1, 6, 24)} FROM p")
def multi_horizon(spark, sf_dir):
    states = windows.pane_states(paned(spark, sf_dir), Family("sum"), BY)
    over = lambda h: F.round(F.sum("s").over(W.partitionBy(*BY).orderBy("pane").rangeBetween(1 - h, 0)), 8).alias(f"h{h}")
    return states.select(*BY, "pane", *map(over, (1, 6, 24)))


@query(f"{LATE} SELECT partition_id, log_index, max(pane) OVER (PARTITION BY partition_id ORDER BY log_index ROWS UNBOUNDED PRECEDING) AS pane FROM e")
def head_pane_out_of_order(spark, sf_dir):
    return windows.with_head(log(spark, sf_dir, 9), HOUR).select("partition_id", "log_index", "pane")


@query()
def pane_approx(spark, sf_dir):
    rows = paned(spark, sf_dir)
    q = windows.approx_panes(rows, "quantile", 0.95, BY).withColumnRenamed("value", "q95")
    return q.join(windows.approx_panes(rows, "distinct", None, BY).withColumnRenamed("value", "items"), [*BY, "pane"])


# ---------------------------------------------------------------- time


WM = "greatest(max(tick_ms) OVER w - 7200000, 0)"


@query(f"""{LATE} SELECT partition_id, log_index, {WM} AS watermark_ms, greatest({WM} - tick_ms, 0) AS lateness_ms, max(tick_ms) OVER w - {WM} AS lag_ms
FROM e WINDOW w AS (PARTITION BY partition_id ORDER BY log_index ROWS UNBOUNDED PRECEDING)""")
def watermark_trace(spark, sf_dir):
    return timesem.trace(log(spark, sf_dir, 9), 2 * HOUR, 0, arrival=False).select("partition_id", "log_index", "watermark_ms", "lateness_ms", "lag_ms")


def _arrivals(spark, sf_dir):
    """Arrival is the tick as it was, behind by up to a few seconds and, for every hundredth event, an hour before or after."""
    shift = F.when(F.col("log_index") % 100 == 1, -HOUR).when(F.col("log_index") % 100 == 2, HOUR).otherwise(F.col("log_index") % 5000)
    return log(spark, sf_dir).withColumn("arrival_ms", F.col("tick_ms") + shift)


ARRIVE = f"{LOG}, a AS (SELECT *, tick_ms + CASE WHEN log_index % 100 = 1 THEN -3600000 WHEN log_index % 100 = 2 THEN 3600000 ELSE log_index % 5000 END AS arrival_ms FROM e)"


@query(f"""{ARRIVE} SELECT partition_id, log_index, greatest(least(max(tick_ms) OVER w - 2000, max(arrival_ms) OVER w - 200), 0) AS watermark_ms
FROM a WINDOW w AS (PARTITION BY partition_id ORDER BY log_index ROWS UNBOUNDED PRECEDING)""")
def watermark_guarded(spark, sf_dir):
    return timesem.trace(_arrivals(spark, sf_dir)).select("partition_id", "log_index", "watermark_ms")


@query(f"{ARRIVE} SELECT partition_id, log_index, CASE WHEN tick_ms > arrival_ms + 5000 THEN 'FUTURE_SKEW' WHEN tick_ms < greatest(arrival_ms - 1800000, 0) THEN 'PAST_SKEW' END AS skew FROM a")
def future_and_past_skew(spark, sf_dir):
    return timesem.skew(_arrivals(spark, sf_dir)).select("partition_id", "log_index", "skew")


LATE_SPECS = (MetricSpec("value", "quantile", 6 * HOUR, correction_ms=HOUR, param=0.5),)
LATENESS = f"""{LATE}, l AS (SELECT *, tick_ms < greatest({WM} - 3600000, 0) AS late FROM e WINDOW w AS (PARTITION BY partition_id ORDER BY log_index ROWS UNBOUNDED PRECEDING))"""


@query(f"{LATENESS} SELECT partition_id, log_index FROM l WHERE NOT late")
def late_filter(spark, sf_dir):
    return timesem.mark_late(log(spark, sf_dir, 9), LATE_SPECS, 2 * HOUR).where("not late").select("partition_id", "log_index")


@query(f"{LATENESS} SELECT partition_id, 'value' AS metric, 'evt-' || log_index AS event_id, log_index, 'NON_RETRACTABLE_FINALIZED' AS reason FROM l WHERE late")
def late_audits(spark, sf_dir):
    return timesem.audits(timesem.mark_late(log(spark, sf_dir, 9), LATE_SPECS, 2 * HOUR))


@query(f"{LATENESS.replace('AS late FROM', f'AS late, {WM} AS wm FROM')} SELECT partition_id, log_index, 'value' AS metric, 'RETRACT' AS flag FROM l WHERE NOT late AND tick_ms < wm")
def late_retractions(spark, sf_dir):
    specs = (MetricSpec("value", "sum", 6 * HOUR, correction_ms=HOUR, late_policy="retract"),)
    return timesem.retractions(timesem.mark_late(log(spark, sf_dir, 9), specs, 2 * HOUR), specs)


@query(f"""{LATE}, t AS (SELECT partition_id, log_index, {WM} AS wm, max(tick_ms) OVER w - {WM} AS lag FROM e WINDOW w AS (PARTITION BY partition_id ORDER BY log_index ROWS UNBOUNDED PRECEDING))
SELECT partition_id, arg_max(wm, log_index) AS watermark_ms, arg_max(lag, log_index) AS lag_ms, max(log_index) AS applied_index FROM t GROUP BY 1""")
def watermark_latest(spark, sf_dir):
    return timesem.latest(timesem.trace(log(spark, sf_dir, 9), 2 * HOUR, 0, arrival=False))


@query(f"""{LATENESS}, a AS (SELECT tick_ms AS t, tick_ms + CASE WHEN log_index % 100 = 1 THEN -3600000 WHEN log_index % 100 = 2 THEN 3600000 ELSE log_index % 5000 END AS c FROM ({LOG.replace('WITH e AS (', '').removesuffix(')')}) x)
SELECT 'NON_RETRACTABLE_FINALIZED' AS reason, count(*) AS n FROM l WHERE late UNION ALL SELECT 'FUTURE_SKEW', count(*) FROM a WHERE t > c + 5000 UNION ALL SELECT 'PAST_SKEW', count(*) FROM a WHERE t <= c + 5000 AND t < c - 1800000""")
def late_counters(spark, sf_dir):
    return timesem.late_counters(timesem.mark_late(log(spark, sf_dir, 9), LATE_SPECS, 2 * HOUR), timesem.skew(_arrivals(spark, sf_dir)))


@query(f"""{LATE}, f AS (SELECT partition_id, lane, max(greatest(tick_ms - 7200000, 0)) - CASE lane WHEN 'click' THEN 60000 ELSE 600000 END AS v FROM e GROUP BY partition_id, lane)
SELECT partition_id, min(greatest(v, 0)) AS finalized_ms FROM f GROUP BY 1""")
def finalized_horizon(spark, sf_dir):
    e = log(spark, sf_dir, 9)
    wm = e.select("partition_id", F.col("lane").alias("metric"), F.greatest(F.col("tick_ms") - 2 * HOUR, F.lit(0)).alias("watermark_ms"), F.when(F.col("lane") == "click", 60_000).otherwise(600_000).alias("correction_ms"))
    return timesem.finalized_horizon(wm)


@query(f"""{LATE}, s AS (SELECT partition_id, max(tick_ms) AS applied, min(tick_ms) AS wm FROM e GROUP BY 1)
SELECT partition_id, CASE WHEN applied - greatest(wm - 1000, 0) > 60000 THEN applied - greatest(wm - 1000, 0) END AS lag_ms FROM s""")
def stall_detection(spark, sf_dir):
    s = log(spark, sf_dir, 9).groupBy("partition_id").agg(F.max("tick_ms").alias("applied"), F.min("tick_ms").alias("wm"))
    return s.select("partition_id", timesem.stalled(F.col("wm"), F.lit(1000), F.col("applied"), F.lit(30_000)).alias("lag_ms"))


# ---------------------------------------------------------------- order of the log


def _retried(spark, sf_dir):
    """Every 13th event comes again half an hour later, every 39th with another payload, every 65th once more after five hours and again at once."""
    e = log(spark, sf_dir).select("partition_id", (F.col("log_index") * 10).alias("log_index"), "tick_ms", "event_id", "payload")
    again = e.where(F.col("log_index") % 130 == 0).select("partition_id", (F.col("log_index") + 1).alias("log_index"), (F.col("tick_ms") + HOUR // 2).alias("tick_ms"), "event_id", F.when(F.col("log_index") % 390 == 0, "other").otherwise(F.col("payload")).alias("payload"))
    old = e.where(F.col("log_index") % 650 == 0)
    late = old.select("partition_id", (F.col("log_index") + 2).alias("log_index"), (F.col("tick_ms") + 5 * HOUR).alias("tick_ms"), "event_id", "payload")
    last = old.select("partition_id", (F.col("log_index") + 3).alias("log_index"), (F.col("tick_ms") + 5 * HOUR + 1).alias("tick_ms"), "event_id", "payload")
    return e.unionByName(again).unionByName(late).unionByName(last)


RETRY = f"""WITH RECURSIVE {LOG.removeprefix('WITH ')}, b AS (SELECT partition_id, log_index * 10 AS log_index, tick_ms, 'evt-' || log_index AS event_id, props AS payload FROM e),
r AS (SELECT * FROM b UNION ALL SELECT partition_id, log_index + 1, tick_ms + 1800000, event_id, CASE WHEN log_index % 390 = 0 THEN 'other' ELSE payload END FROM b WHERE log_index % 130 = 0
  UNION ALL SELECT partition_id, log_index + 2, tick_ms + 18000000, event_id, payload FROM b WHERE log_index % 650 = 0 UNION ALL SELECT partition_id, log_index + 3, tick_ms + 18000001, event_id, payload FROM b WHERE log_index % 650 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY log_index) AS k FROM r),
m AS (SELECT event_id, k, log_index, partition_id, 'Fresh' AS decision, payload AS h, tick_ms AS t FROM n WHERE k = 1
  UNION ALL SELECT n.event_id, n.k, n.log_index, n.partition_id, CASE WHEN m.decision = 'RetryExpired' THEN 'Fresh' WHEN n.tick_ms - m.t > 7200000 THEN 'RetryExpired' WHEN n.payload = m.h THEN 'Duplicate' ELSE 'Divergent' END,
    CASE WHEN m.decision = 'RetryExpired' THEN n.payload ELSE m.h END,
    CASE WHEN m.decision = 'RetryExpired' OR (n.tick_ms - m.t <= 7200000 AND n.payload = m.h) THEN n.tick_ms ELSE m.t END
  FROM n JOIN m ON n.event_id = m.event_id AND n.k = m.k + 1)"""


@query(f"{RETRY} SELECT partition_id, log_index, event_id, decision FROM m")
def dedup_decisions(spark, sf_dir):
    return dedup.decide(_retried(spark, sf_dir), 2 * HOUR).select("partition_id", "log_index", "event_id", "decision")


@query(f"{RETRY} SELECT partition_id, count(*) AS total, count(*) FILTER (WHERE decision <> 'Fresh') AS dedup_skipped, count(*) FILTER (WHERE decision = 'Divergent') AS divergent FROM m GROUP BY 1")
def batch_stats(spark, sf_dir):
    return dedup.counters(dedup.decide(_retried(spark, sf_dir), 2 * HOUR))


SEQ = "(log_index * 7919) % 1000"


@query(f"""{LOG}, s AS (SELECT *, {SEQ} AS seqno FROM e), l AS (SELECT *, max(seqno) OVER (PARTITION BY partition_id, item ORDER BY log_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_seq FROM s)
SELECT partition_id, log_index, last_seq, last_seq IS NULL OR seqno > last_seq AS applied FROM l""")
def last_writer_wins(spark, sf_dir):
    e = log(spark, sf_dir).withColumn("seqno", F.expr(SEQ))
    return sequence.last_writer_wins(e, "item").select("partition_id", "log_index", "last_seq", "applied")


@query(f"""{LOG}, i AS (SELECT *, tick_ms // 1000000 AS m, row_number() OVER (PARTITION BY partition_id ORDER BY log_index) AS i FROM e)
SELECT partition_id, log_index, i + max(m - i) OVER (PARTITION BY partition_id ORDER BY log_index ROWS UNBOUNDED PRECEDING) AS tick_ms FROM i""")
def commit_ticks(spark, sf_dir):
    e = log(spark, sf_dir).withColumn("m", F.floor(F.col("tick_ms") / 1_000_000))
    return sequence.commit_ticks(e, "m").select("partition_id", "log_index", "tick_ms")


@query(f"""{LOG}, f AS (SELECT *, tick_ms // 1000000 - first_value(tick_ms // 1000000) OVER (PARTITION BY partition_id ORDER BY log_index) AS m, row_number() OVER (PARTITION BY partition_id ORDER BY log_index) AS i FROM e)
SELECT partition_id, log_index, i + max(greatest(m, 0) - i) OVER (PARTITION BY partition_id ORDER BY log_index ROWS UNBOUNDED PRECEDING) AS tick_ms FROM f""")
def replay_ticks(spark, sf_dir):
    e = log(spark, sf_dir).withColumn("m", F.floor(F.col("tick_ms") / 1_000_000))
    return sequence.replay_ticks(e, "m").select("partition_id", "log_index", "tick_ms")


@query(f"{LOG} SELECT partition_id, max(log_index) AS log_index, arg_max(tick_ms, log_index) AS tick_ms FROM e WHERE log_index > 100 GROUP BY 1")
def last_tick(spark, sf_dir):
    return sequence.last_tick(log(spark, sf_dir), 100)


EWMA = f"""WITH RECURSIVE {LOG.removeprefix('WITH ')}, s AS (SELECT partition_id, log_index, row_number() OVER w AS k, 1000.0::DOUBLE / greatest(tick_ms - lag(tick_ms) OVER w, 1) AS x FROM e WINDOW w AS (PARTITION BY partition_id ORDER BY log_index)),
m AS (SELECT partition_id, log_index, k, NULL::DOUBLE AS rate FROM s WHERE k = 1 UNION ALL SELECT s.partition_id, s.log_index, s.k, CASE WHEN m.rate IS NULL THEN s.x ELSE 0.2::DOUBLE * s.x + 0.8::DOUBLE * m.rate END FROM s JOIN m ON s.partition_id = m.partition_id AND s.k = m.k + 1)"""


@query(f"{EWMA} SELECT partition_id, log_index, round(rate, 8) AS rate FROM m")
def commit_rate_ewma(spark, sf_dir):
    return sequence.commit_rate(log(spark, sf_dir)).select("partition_id", "log_index", F.round("rate", 8).alias("rate"))


def _ewma(alpha: float):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sequence.commit_rate(log(spark, sf_dir), alpha).select("partition_id", "log_index", F.round("rate", 8).alias("rate"))

    sql = EWMA.replace("0.2::DOUBLE", f"{alpha}::DOUBLE").replace("0.8::DOUBLE", f"(1 - {alpha}::DOUBLE)")
    query(f"{sql} SELECT partition_id, log_index, round(rate, 8) AS rate FROM m", f"commit_rate_ewma_{alpha}".replace(".", "_"))(run)


for _alpha in (0.01, 0.9):
    _ewma(_alpha)


@query(f"{EWMA} SELECT partition_id, log_index, round(rate, 8) AS rate FROM m WHERE log_index > 500")
def commit_rate_from_snapshot(spark, sf_dir):
    """The average up to place 500 is a snapshot, from which the rest goes on."""
    e = log(spark, sf_dir)
    last = sequence.commit_rate(e.where("log_index <= 500"))
    seed = last.groupBy("partition_id").agg(F.max_by("tick_ms", "log_index").alias("tick_ms"), F.max_by("rate", "log_index").alias("rate"))
    return sequence.commit_rate(e.where("log_index > 500"), seed=seed).select("partition_id", "log_index", F.round("rate", 8).alias("rate"))


@query(f"{EWMA} SELECT partition_id, log_index, ceil(round(rate * 1000, 6))::BIGINT AS capacity FROM m")
def capacity(spark, sf_dir):
    r = sequence.commit_rate(log(spark, sf_dir))
    return r.select("partition_id", "log_index", sequence.capacity(F.col("rate") * 1000).alias("capacity"))


@query(f"""{EWMA}, t AS (SELECT m.partition_id, m.log_index, m.k, e.tick_ms, m.rate * 1000 AS rate FROM m JOIN e USING (partition_id, log_index)),
c AS (SELECT partition_id, k, tick_ms AS last, CASE WHEN rate IS NULL THEN NULL ELSE tick_ms END AS seen, CASE WHEN rate IS NULL THEN 0 ELSE ceil(round(rate, 6))::BIGINT END AS top, rate IS NOT NULL AS raised FROM t WHERE k = 1
  UNION ALL SELECT t.partition_id, t.k, t.tick_ms, CASE WHEN c.seen IS NULL OR t.tick_ms - c.seen >= 30000 THEN t.tick_ms ELSE c.seen END,
    CASE WHEN c.seen IS NULL OR t.tick_ms - c.seen >= 30000 THEN greatest(c.top, ceil(round(t.rate, 6))::BIGINT) ELSE c.top END,
    (c.seen IS NULL OR t.tick_ms - c.seen >= 30000) AND ceil(round(t.rate, 6))::BIGINT > c.top FROM t JOIN c ON t.partition_id = c.partition_id AND t.k = c.k + 1)
SELECT partition_id::VARCHAR AS partition_id, last AS tick_ms, top AS capacity FROM c WHERE raised""")
def capacity_reconciler(spark, sf_dir):
    r = sequence.commit_rate(log(spark, sf_dir)).withColumn("partition_id", F.col("partition_id").cast("string")).withColumn("rate", F.col("rate") * 1000)
    return sequence.reconcile_capacity(r)


@query(f"{LOG} SELECT partition_id, log_index, CASE WHEN log_index >= 500 THEN 2 ELSE 1 END AS version FROM e")
def version_select(spark, sf_dir):
    return log(spark, sf_dir).select("partition_id", "log_index", sequence.select_version(F.col("log_index"), 1, 2, 500).alias("version"))


@query(f"{LOG} SELECT partition_id, log_index, CASE WHEN log_index < 10 * partition_id THEN 0 ELSE least(9, (log_index - 10 * partition_id) // 100) + 1 END AS version FROM e")
def versions_as_of(spark, sf_dir):
    e = log(spark, sf_dir)
    v = e.select("partition_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    v = v.select("partition_id", (F.col("partition_id") * 10 + F.col("k") * 100).alias("barrier"), (F.col("k") + 1).cast("long").alias("version"))
    return sequence.versions_as_of(e, v).select("partition_id", "log_index", "version")


@query(f"""{LOG}, s AS (SELECT partition_id, min(log_index) AS a, max(log_index) AS h, count(*) AS n FROM e GROUP BY 1)
SELECT partition_id, greatest(a, n) AS floor, greatest(h - greatest(1, ceil(30 * greatest(1, n / 100.0)))::BIGINT, 0) AS dedup_floor, greatest(a, n, greatest(h - greatest(1, ceil(30 * greatest(1, n / 100.0)))::BIGINT, 0)) AS retain_from FROM s""")
def retention_plan(spark, sf_dir):
    s = log(spark, sf_dir).groupBy("partition_id").agg(F.min("log_index").alias("full_floor"), F.count(F.lit(1)).alias("incremental_floor"), F.max("log_index").alias("horizon"))
    s = s.withColumn("retry_s", F.lit(30)).withColumn("rate", F.col("incremental_floor") / 100.0).withColumn("learner_floor", F.lit(0).cast("long"))
    return sequence.retention_plan(s).select("partition_id", "floor", "dedup_floor", "retain_from")


PLACES = [f"partition-{c}" for c in "abcdefg"]


@query()
def partition_route(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return sequence.route(e, F.col("user_id").cast("string"), PLACES).groupBy("partition_id").count()


@query("""WITH RECURSIVE u AS (SELECT DISTINCT user_id, user_id::VARCHAR AS s FROM events),
h AS (SELECT user_id, s, 0 AS k, 14695981039346656037::HUGEINT AS h FROM u UNION ALL SELECT user_id, s, k + 1, ((xor(h, ascii(substr(s, k + 1, 1))::HUGEINT)) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT FROM h WHERE k < length(s))
SELECT user_id, 'partition-' || substr('abcdefg', (h % 7)::INT + 1, 1) AS partition_id FROM h WHERE k = length(s)""")
def partition_route_fnv(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    return sequence.route(e, F.col("user_id").cast("string"), PLACES, exact=True)


# ---------------------------------------------------------------- lanes


@query("SELECT event_id, unnest(list_filter(range(64), lambda i: (CASE WHEN event_id % 64 = 0 THEN 1 ELSE event_id % 64 END >> i) & 1 = 1))::INT AS lane FROM events")
def lane_expand(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.explode(windows.lanes(F.col("event_id") % 64)).alias("lane"))


@query("SELECT user_id, bit_or(1::BIGINT << (event_id % 63)::INT) AS lane_bitmap FROM events GROUP BY 1")
def lane_mask(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("user_id").agg(windows.lane_mask((F.col("event_id") % 63).cast("int")).alias("lane_bitmap"))


ADMIT = f"""{LOG}, f AS (SELECT partition_id, lane AS metric, item AS lane_key, min(log_index) AS f FROM e GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY f, metric, lane_key) AS place FROM f)"""


def _admitted(spark, sf_dir):
    return lanes.admit(log(spark, sf_dir).select("partition_id", "log_index", F.col("lane").alias("metric"), F.col("item").alias("lane_key")), 20)


@query(f"{ADMIT} SELECT e.partition_id, e.log_index, k.place <= 20 AS admitted FROM e JOIN k ON e.partition_id = k.partition_id AND e.lane = k.metric AND e.item = k.lane_key")
def lane_admission(spark, sf_dir):
    return _admitted(spark, sf_dir).select("partition_id", "log_index", "admitted")


@query(f"{ADMIT} SELECT e.partition_id, k.metric, k.lane_key, e.log_index, 'LANE_OVERFLOW' AS reason, 20 AS observed_lanes FROM e JOIN k ON e.partition_id = k.partition_id AND e.lane = k.metric AND e.item = k.lane_key WHERE k.place > 20")
def lane_overflow_audits(spark, sf_dir):
    return lanes.overflow_audits(_admitted(spark, sf_dir), 20)


@query(f"{LOG} SELECT partition_id, log_index, (dense_rank() OVER (PARTITION BY partition_id ORDER BY lane, item) - 1)::INT AS lane FROM e")
def lane_numbers(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("labels", F.create_map(F.lit("user"), F.col("item"), F.lit("kind"), F.col("lane"))).drop("lane")
    return lanes.number(rows, ["user", "kind"]).select("partition_id", "log_index", "lane")


# ---------------------------------------------------------------- rules


def _bound(spark, sf_dir):
    """value: the event's own; big: bound for values over 50 only; flags for errors."""
    b = lambda v, has, flags: F.struct(v.alias("value"), has.alias("has_value"), F.create_map(F.lit("kind"), F.col("lane")).alias("labels"), flags.alias("flags"))
    none = F.array().cast("array<string>")
    flags = F.when(F.col("lane") == "error", F.array(F.lit("BAD"))).otherwise(none)
    big = F.when(F.col("value") > 50, b(F.col("value"), F.col("log_index") % 2 == 0, none))
    e = log(spark, sf_dir)
    return e.withColumn("bindings", F.map_filter(F.create_map(F.lit("value"), b(F.col("value"), F.lit(True), flags), F.lit("big"), big), lambda _, v: v.isNotNull()))


def _ruled(sql: str, name: str, condition: object):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = cel.Compiler(cel.in_map(F.col("bindings")), F.col("payload")).condition(condition)
        return _bound(spark, sf_dir).select("log_index", c.alias("met"))

    query(f"{LOG} SELECT log_index, {sql} AS met FROM e", name)(run)


_ruled("value > 40 AND value <= 90", "rule_compare", cel.And((cel.Compare("value", "gt", 40), cel.Compare("value", "le", 90))))
_ruled("lane = 'click' OR lane = 'error'", "rule_label_flag", cel.Or((cel.LabelEquals("value", "kind", "click"), cel.FlagContains("value", "BAD"))))
_ruled("NOT (value > 50 AND log_index % 2 = 0 AND value > 80)", "rule_not_missing", cel.Not(cel.Compare("big", "gt", 80)))
_ruled("value > 50 AND log_index % 2 = 0", "rule_has_value", cel.HasValue("big"))
_ruled(
    "coalesce(greatest(1, value) * 2 > 60 + CASE WHEN value > 50 AND log_index % 2 = 0 THEN value END, false) OR json_extract_string(props, '$.k')::INT >= 50 AND lane <> 'view'",
    "rule_text",
    cel.parse('2 * max(1, f["value"].value) > 60 + f["big"].value || payload.k >= 50 && f["value"].labels["kind"] != "view"'),
)

RULES = (
    Rule("over", "alerts", cel.Compare("total", "gt", 150), "over_v1", {"total": 'f["total"].value'}),
    Rule("busy", "audit", cel.And((cel.Compare("n", "ge", 3), cel.LabelEquals("n", "event_type", "click"))), "busy_v1", "busy"),
)
CONFIG = AggregationConfig((MetricSpec("total", "sum", 6 * HOUR, HOUR, ("event_type",), source="value"), MetricSpec("n", "count", 2 * HOUR, HOUR, ("event_type",), source="value")), HOUR, 6 * HOUR)


def pipeline_outputs(spark: SparkSession, sf_dir: str, policies: dict | None = None) -> batch.Outputs:
    e = tables.read_events_table(spark, sf_dir)
    kind = F.col("measurements")[0]["labels"]["event_type"]
    lane = F.expr("array_position(array('click','error','purchase','signup','view'), measurements[0].labels['event_type'])").cast("int")
    m = tables.measurement("value", F.col("measurements")[0]["value"], F.col("partition_key"), {"event_type": kind}, F.call_function("shiftleft", F.lit(1).cast("long"), lane))
    e = e.withColumn("measurements", F.array(m).cast(e.schema["measurements"].dataType))
    return batch.run(e, CONFIG, RULES, policies)


FIRED = f"""{LOG}, p AS (SELECT partition_id, lane, pane, sum(value) AS s, count(*) AS n FROM e GROUP BY ALL),
o AS (SELECT partition_id, lane, pane, sum(s) OVER (PARTITION BY partition_id, lane ORDER BY pane RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING) AS s, sum(n) OVER (PARTITION BY partition_id, lane ORDER BY pane RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS n FROM p),
c AS (SELECT e.*, coalesce(o.s, 0) + sum(value) OVER w AS total, coalesce(o.n, 0) + count(*) OVER w AS n FROM e JOIN o USING (partition_id, lane, pane) WINDOW w AS (PARTITION BY partition_id, lane, pane ORDER BY log_index ROWS UNBOUNDED PRECEDING)),
f AS (SELECT partition_id::VARCHAR AS partition_id, log_index, 0 AS rule_pos, 'alerts' AS channel, 'over' AS rule_id FROM c WHERE total > 150 UNION ALL SELECT partition_id::VARCHAR, log_index, 1, 'audit', 'busy' FROM c WHERE n >= 3 AND lane = 'click'),
d AS (SELECT *, substr(sha256(partition_id || '|' || log_index || '|1|' || rule_id || '|' || channel), 1, 16) AS derived_event_id FROM f)"""


@query(f"{FIRED} SELECT partition_id, log_index, rule_pos, channel, rule_id, derived_event_id FROM d")
def derived_events(spark, sf_dir):
    return pipeline_outputs(spark, sf_dir).derived.select("partition_id", "log_index", "rule_pos", "channel", "rule_id", "derived_event_id")


@query(f"{FIRED} SELECT channel, count(*) AS n FROM d GROUP BY 1")
def derived_totals(spark, sf_dir):
    return pipeline_outputs(spark, sf_dir).derived.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


def _emissions(spark, sf_dir):
    """An emission for each event: batches of 100 places, channel by event type."""
    e = log(spark, sf_dir).withColumn("batch_id", F.floor(F.col("log_index") / 100)).withColumn("rule_pos", F.lit(0))
    return e.select("batch_id", "log_index", "rule_pos", F.col("lane").alias("channel"), F.concat(F.lit("d-"), F.col("log_index")).alias("derived_event_id"))


EMIT = f"{LOG}, m AS (SELECT log_index // 100 AS batch_id, log_index, lane AS channel FROM e)"


@query(f"{EMIT} SELECT batch_id, log_index, channel FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, channel ORDER BY log_index DESC) AS k FROM m) WHERE channel <> 'click' OR k <= 5")
def channel_drop_oldest(spark, sf_dir):
    return emit.apply_policies(_emissions(spark, sf_dir), {"click": ChannelPolicy("drop_oldest", 5)})[0].select("batch_id", "log_index", "channel")


@query(f"{EMIT} SELECT batch_id, log_index, channel FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, channel ORDER BY log_index) AS k FROM m) WHERE channel <> 'view' OR k <= 7")
def channel_block(spark, sf_dir):
    return emit.apply_policies(_emissions(spark, sf_dir), {"view": ChannelPolicy("block", 7, timeout_ms=200)})[0].select("batch_id", "log_index", "channel")


@query(f"""{EMIT}, k AS (SELECT *, row_number() OVER (PARTITION BY batch_id, channel ORDER BY log_index DESC) AS k FROM m)
SELECT batch_id, log_index, CASE WHEN channel = 'click' AND k > 4 THEN 'lost' ELSE channel END AS channel FROM k""")
def channel_dead_letter(spark, sf_dir):
    return emit.apply_policies(_emissions(spark, sf_dir), {"click": ChannelPolicy("dead_letter", 4, "lost")})[0].select("batch_id", "log_index", "channel")


@query(f"""{EMIT}, k AS (SELECT *, row_number() OVER (PARTITION BY batch_id, channel ORDER BY log_index DESC) AS k FROM m)
SELECT channel, CASE channel WHEN 'click' THEN 'DeadLetterOverflow' ELSE 'QueueFullDropOldest' END AS reason, count(*) AS n FROM k WHERE (channel = 'click' AND k > 4) OR (channel = 'view' AND k > 6) GROUP BY 1""")
def channel_drops(spark, sf_dir):
    return emit.drop_counters(emit.apply_policies(_emissions(spark, sf_dir), {"click": ChannelPolicy("dead_letter", 4, "lost"), "view": ChannelPolicy("drop_oldest", 6)})[1])


# ---------------------------------------------------------------- tiers


@query(f"{LOG}, h AS (SELECT partition_id, max(pane) AS h FROM e GROUP BY 1) SELECT e.partition_id, lane, round(sum(value), 8) AS s FROM e JOIN h USING (partition_id) WHERE pane < h - 47 GROUP BY ALL")
def tier_compaction(spark, sf_dir):
    old, _ = tiers.split(windows.pane_states(paned(spark, sf_dir), Family("sum"), BY), HOUR, 48)
    return tiers.compact(old, Family("sum"), BY).select(*BY, r4("s"))


def _cross(kind: str, sql: str, param: float | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = Family(kind, param)
        old, live = tiers.split(windows.pane_states(paned(spark, sf_dir), f, BY), HOUR, 48)
        return tiers.cross_tier(tiers.compact(old, f, BY), live, f, BY).select(*BY, r4("value"))

    query(f"{LOG} SELECT partition_id, lane, round({sql}, 8) AS value FROM e GROUP BY ALL", f"cross_tier_{kind}")(run)


for _kind, _sql in FOLDS.items():
    _cross(_kind, _sql)
_cross("quantile", "list_sort(list(value))[floor(0.9 * (count(*) - 1) + 0.5)::INT + 1]", 0.9)
_cross("distinct", "count(DISTINCT item)::DOUBLE")
_cross("topk", "max(value)", 5)


@query(f"{LOG} SELECT partition_id, lane, round(avg(value), 8) AS value FROM e WHERE pane >= 473400 AND pane < 473500 GROUP BY ALL")
def tier_range(spark, sf_dir):
    old, live = tiers.split(windows.pane_states(paned(spark, sf_dir), Family("avg"), BY), HOUR, 48)
    spans = tiers.compact(old, Family("avg"), BY, 20)
    return tiers.range_query(spans, live, Family("avg"), 473_400, 473_500, BY, 20).select(*BY, r4("value"))


@query(f"{LOG} SELECT partition_id, greatest(max(pane) - 47, 0) * 3600000 AS frontier_ms FROM e GROUP BY 1")
def tier_frontier(spark, sf_dir):
    return tiers.frontier(windows.pane_states(paned(spark, sf_dir), Family("count"), BY), HOUR, 48)


# ---------------------------------------------------------------- metric queries


def _telemetry(spark, sf_dir):
    """The events as gauges `reading`, and as counters `work_total` that restart every tenth sample of a series. Labels: kind, user, shard."""
    e = log(spark, sf_dir)
    labels = F.create_map(F.lit("kind"), F.col("lane"), F.lit("user"), F.col("item"), F.lit("shard"), (F.col("item").cast("int") % 3).cast("string"))
    base = e.select("partition_id", "log_index", "tick_ms", "value", "item", labels.alias("labels"))
    n = F.row_number().over(W.partitionBy("partition_id", F.col("labels")["kind"], F.col("labels")["user"]).orderBy("log_index"))
    count = base.withColumn("value", (F.pmod(n, F.lit(10)) * 5).cast("double"))
    return base.withColumn("metric", F.lit("reading")).unionByName(count.withColumn("metric", F.lit("work_total")))


TELE = f"""{LOG}, g AS (SELECT partition_id, log_index, tick_ms, pane, value, item, lane AS kind, item AS "user", (item::INT % 3)::VARCHAR AS shard FROM e),
c AS (SELECT *, ((row_number() OVER (PARTITION BY partition_id, kind, "user" ORDER BY log_index)) % 10 * 5)::DOUBLE AS total FROM g),
d AS (SELECT *, CASE WHEN total < lag(total) OVER s THEN total ELSE total - lag(total) OVER s END AS delta FROM c WINDOW s AS (PARTITION BY partition_id, kind, "user" ORDER BY tick_ms, log_index))"""


def _promql(name: str, text: str, sql: str, names: dict[str, str], places: int = 8):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = series.evaluate(_telemetry(spark, sf_dir), promql.parse(text), HOUR)
        return got.select("partition_id", *[F.col(k).alias(v) for k, v in names.items()], "pane", F.round("value", places).alias("value"))

    query(f"{TELE} {sql}", name)(run)


def _windowed(hours: int, inner: str, outer: str, by: str, where: str = "true", having: str = "true") -> str:
    """Two levels in SQL: each series' value over the window of each pane of its group, then over the series."""
    return f"""SELECT partition_id, {by}, pane, round({outer}, 8) AS value FROM (SELECT a.partition_id, a.{by}, a.pane, b.kind AS _k, b."user" AS _u, {inner} AS x
    FROM (SELECT DISTINCT partition_id, {by}, pane FROM d WHERE {where}) a JOIN (SELECT * FROM d WHERE {where}) b ON a.partition_id = b.partition_id AND a.{by} = b.{by} AND b.pane BETWEEN a.pane - {hours - 1} AND a.pane GROUP BY ALL) GROUP BY ALL"""


_promql("promql_sum_by", 'sum by (kind)(sum_over_time(reading[6h]))', _windowed(6, "sum(b.value)", "sum(x)", "kind"), {"by_kind": "kind"})
_promql("promql_avg_of_avg", 'avg by (shard)(avg_over_time(reading[12h]))', _windowed(12, "avg(b.value)", "avg(x)", "shard"), {"by_shard": "shard"})
_promql("promql_count_by", 'count by (kind)(count_over_time(reading[6h]))', _windowed(6, "count(*)", "count(x)::DOUBLE", "kind"), {"by_kind": "kind"})
_promql("promql_max_of_min", 'max by (kind)(min_over_time(reading[6h]))', _windowed(6, "min(b.value)", "max(x)", "kind"), {"by_kind": "kind"})
_promql("promql_min_of_max", 'min by (kind)(max_over_time(reading[6h]))', _windowed(6, "max(b.value)", "min(x)", "kind"), {"by_kind": "kind"})
_promql("promql_last", 'sum by (kind)(reading[6h])', _windowed(6, "arg_max(b.value, b.log_index)", "sum(x)", "kind"), {"by_kind": "kind"})
_promql("promql_matchers", 'sum by (kind)(sum_over_time(reading{kind=~"click|view", shard!="1", user!~"1.*"}[6h]))', _windowed(6, "sum(b.value)", "sum(x)", "kind", "kind IN ('click', 'view') AND shard <> '1' AND \"user\" NOT LIKE '1%'"), {"by_kind": "kind"})
_RISE = "CASE WHEN count(*) >= 2 THEN sum(coalesce(b.delta, 0)) - coalesce(arg_min(coalesce(b.delta, 0), b.log_index), 0) END"
_promql("promql_increase", 'sum by (kind)(increase(work_total[24h]))', _windowed(24, _RISE, "sum(x)", "kind"), {"by_kind": "kind"})
_promql("promql_rate", 'avg by (kind)(rate(work_total[24h]))', _windowed(24, _RISE.replace("END", "END / nullif((max(b.tick_ms) - min(b.tick_ms)) / 1000.0::DOUBLE, 0)"), "avg(x)", "kind").replace(", 8)", ", 8)"), {"by_kind": "kind"}, 8)
_promql("promql_quantile", 'quantile_over_time(0.95, reading{kind="click"}[6h])', """SELECT a.partition_id, a.pane, round(list_sort(list(b.value))[floor(0.95 * (count(*) - 1) + 0.5)::INT + 1], 8) AS value
FROM (SELECT DISTINCT partition_id, pane FROM g WHERE kind = 'click') a JOIN (SELECT * FROM g WHERE kind = 'click') b ON a.partition_id = b.partition_id AND b.pane BETWEEN a.pane - 5 AND a.pane GROUP BY ALL""", {})
_promql("promql_avg_of_quantile", 'avg by (kind)(quantile_over_time(0.5, reading[12h]))', _windowed(12, "list_sort(list(b.value))[floor(0.5 * (count(*) - 1) + 0.5)::INT + 1]", "avg(x)", "kind"), {"by_kind": "kind"})
_promql("promql_sum_of_counts", 'sum by (kind)(count_over_time(reading[24h]))', _windowed(24, "count(*)", "sum(x)::DOUBLE", "kind"), {"by_kind": "kind"})
_promql("promql_max_of_max", 'max by (kind)(max_over_time(reading[24h]))', _windowed(24, "max(b.value)", "max(x)", "kind"), {"by_kind": "kind"})
_promql("promql_distinct", 'distinct by (kind)(reading[12h])', """SELECT a.partition_id, a.kind, a.pane, count(DISTINCT b.item)::DOUBLE AS value
FROM (SELECT DISTINCT partition_id, kind, pane FROM g) a JOIN g b ON a.partition_id = b.partition_id AND a.kind = b.kind AND b.pane BETWEEN a.pane - 11 AND a.pane GROUP BY ALL""", {"by_kind": "kind"})
_promql("promql_topk", 'topk by (kind)(2, max_over_time(reading[6h]))', _windowed(6, "max(b.value)", "max(x)", "kind"), {"by_kind": "kind"})


@query(f"""{TELE}, s AS (SELECT a.partition_id, a.kind, a.pane, '{{"kind":"' || b.kind || '","shard":"' || b.shard || '","user":"' || b."user" || '"}}' AS series, max(b.value) AS value
  FROM (SELECT DISTINCT partition_id, kind, "user", pane FROM g) a JOIN g b ON a.partition_id = b.partition_id AND a.kind = b.kind AND a."user" = b."user" AND b.pane BETWEEN a.pane - 5 AND a.pane GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY partition_id, kind, pane ORDER BY value DESC, series)::INT AS place FROM s) WHERE place <= 2""")
def promql_topk_series(spark, sf_dir):
    got = series.topk_series(_telemetry(spark, sf_dir), promql.parse("topk by (kind)(2, max_over_time(reading[6h]))"), HOUR)
    return got.select("partition_id", F.col("by_kind").alias("kind"), "pane", "series", "value", "place")


#: The log with every 11th lane, every 13th partition and every 17th item missing.
HOLES = LATE.replace("user_id % 8 AS partition_id", "CASE WHEN event_id % 13 <> 0 THEN user_id % 8 END AS partition_id").replace("event_type AS lane", "CASE WHEN event_id % 11 <> 0 THEN event_type END AS lane").replace("user_id::VARCHAR AS item", "CASE WHEN event_id % 17 <> 0 THEN user_id::VARCHAR END AS item")


def _holes(spark, sf_dir):
    gone = lambda c, n: F.when(F.col("log_index") % n != 0, F.col(c)).alias(c)
    e = log(spark, sf_dir, 9)
    return e.select(*[gone(c, {"lane": 11, "partition_id": 13, "item": 17}[c]) if c in ("lane", "partition_id", "item") else c for c in e.columns])


@query(f"""{HOLES}, p AS (SELECT partition_id, lane, pane, sum(value) AS s FROM e GROUP BY ALL),
o AS (SELECT partition_id, lane, pane, sum(s) OVER (PARTITION BY partition_id, lane ORDER BY pane RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING) AS old FROM p),
c AS (SELECT *, sum(value) OVER (PARTITION BY partition_id, lane, pane ORDER BY log_index ROWS UNBOUNDED PRECEDING) AS now FROM e)
SELECT c.log_index, round(coalesce(old, 0) + now, 8) AS result FROM c JOIN o ON c.partition_id IS NOT DISTINCT FROM o.partition_id AND c.lane IS NOT DISTINCT FROM o.lane AND c.pane = o.pane""")
def window_event_sum_null_keys(spark, sf_dir):
    rows = windows.with_pane(_holes(spark, sf_dir), HOUR)
    return windows.sliding_events(rows, Family("sum"), 6, BY).select("log_index", r4("result"))


@query(f"""{HOLES}, f AS (SELECT partition_id, lane AS metric, item AS lane_key, min(log_index) AS f FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY f, metric, lane_key) AS place FROM f)
SELECT e.log_index, k.place <= 20 AS admitted FROM e JOIN k ON e.partition_id IS NOT DISTINCT FROM k.partition_id AND e.lane IS NOT DISTINCT FROM k.metric AND e.item IS NOT DISTINCT FROM k.lane_key""")
def lane_admission_null_keys(spark, sf_dir):
    return lanes.admit(_holes(spark, sf_dir).select("partition_id", "log_index", F.col("lane").alias("metric"), F.col("item").alias("lane_key")), 20).select("log_index", "admitted")


@query(f"{HOLES} SELECT log_index, greatest(max(tick_ms) OVER (PARTITION BY partition_id ORDER BY log_index ROWS UNBOUNDED PRECEDING) - 7200000, 0) AS watermark_ms FROM e")
def watermark_null_partitions(spark, sf_dir):
    return timesem.trace(_holes(spark, sf_dir), 2 * HOUR, 0, arrival=False).select("log_index", "watermark_ms")


# ---------------------------------------------------------------- bundles


SPIKES = """
bundle: {name: spikes, def_version: 3, policy_version: 2, lane_domains: {kind: {max_per_partition: 5}, shard: {max_per_partition: 3}}}
workflow:
  phases:
    - {name: read, type: source.kafka, options: {connector: events}}
    - name: short
      type: aggregate.promql
      options:
        window: 3h
        queries:
          recent: 'sum by (kind)(sum_over_time(reading[3h]))'
          work: 'sum by (shard)(increase(work_total[3h]))'
    - name: long
      type: aggregate.promql
      options:
        window: 24h
        queries:
          usual: 'avg by (kind)(avg_over_time(reading[24h]))'
    - name: judge
      type: classify.cel
      options:
        bindings: {now: phase.short.metrics, before: phase.long.metrics}
        rules:
          - name: spike
            when: now["recent"].value > 2 * max(1, before["usual"].value) && now["recent"].labels["kind"] == before["usual"].labels["kind"]
            emit: {channel: alerts, schema_key: spike_v1, payload: {kind: 'now["recent"].labels["kind"]', recent: 'now["recent"].value', usual: 'before["usual"].value', k: payload.k}}
          - name: idle
            when: '!now["work"].has_value || now["work"].value < 1'
            emit: {channel: audit, payload: {at: window_end_ns}}
"""


def _known(hours: int, inner: str, outer: str, by: str) -> str:
    """Two levels in SQL: each series' value as it stood at each event of its group, then over the series."""
    return f"""SELECT log_index, {outer} AS v FROM (SELECT a.log_index, b.kind AS _k, b."user" AS _u, {inner} AS x FROM g a JOIN d b ON a.partition_id = b.partition_id AND a.{by} = b.{by}
    AND b.pane BETWEEN a.pane - {hours - 1} AND a.pane AND (b.pane < a.pane OR b.log_index <= a.log_index) GROUP BY ALL) GROUP BY ALL"""


SPIKE_SQL = f"""{TELE}, recent AS ({_known(3, "sum(b.value)", "sum(x)", "kind")}), usual AS ({_known(24, "avg(b.value)", "avg(x)", "kind")}), work AS ({_known(3, _RISE, "sum(x)", "shard")}),
j AS (SELECT g.log_index, g.pane, g.kind, r.v AS recent, u.v AS usual, w.v AS work FROM g JOIN recent r USING (log_index) JOIN usual u USING (log_index) LEFT JOIN work w USING (log_index))"""


@query(f"""{SPIKE_SQL} SELECT log_index, 'alerts' AS channel, 'spike' AS rule_id, 'spike_v1' AS schema_key, 2::BIGINT AS rule_version, kind, round(recent, 8) AS recent, round(usual, 8) AS usual, NULL::BIGINT AS at FROM j WHERE recent > 2 * greatest(1, usual)
UNION ALL SELECT log_index, 'audit', 'idle', '', 2, NULL, NULL, NULL, (pane + 1) * 3600000000000 FROM j WHERE work IS NULL OR work < 1""")
def bundle_spikes(spark, sf_dir):
    e = tables.read_events_table(spark, sf_dir)
    user = F.col("partition_key").cast("int")
    labels = F.create_map(F.lit("kind"), F.col("measurements")[0]["labels"]["event_type"], F.lit("shard"), (user % 3).cast("string"))
    t = _telemetry(spark, sf_dir).withColumn("partition_id", F.col("partition_id").cast("string"))
    got = bundle.run(bundle.load(SPIKES), t, e.withColumn("labels", labels), HOUR)
    told = lambda name, kind: F.get_json_object("payload", f"$.{name}").cast(kind)
    return got.select("log_index", "channel", "rule_id", "schema_key", "rule_version", told("kind", "string").alias("kind"), *[F.round(told(n, "double"), 8).alias(n) for n in ("recent", "usual")], told("at", "long").alias("at"))


@query(f"{SPIKE_SQL} SELECT log_index FROM j WHERE recent > 2 * greatest(1, usual)")
def bundle_spike_alerts(spark, sf_dir):
    return bundle_spikes(spark, sf_dir).where("channel = 'alerts'").select("log_index")


# ---------------------------------------------------------------- other tables


@query("SELECT o_orderpriority AS lane, (epoch_us(o_orderdate) // 1000) // 86400000 AS pane, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL")
def order_flow_panes(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("lane"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("tick_ms"), F.col("o_totalprice").alias("value"), F.lit(None).cast("string").alias("item"))
    return windows.tumbling(windows.with_pane(o, 86_400_000), Family("sum"), ("lane",)).select("lane", "pane", F.round("value", 2).alias("value"))


@query("""WITH p AS (SELECT l_returnflag AS lane, (epoch_us(l_shipdate) // 1000) // 86400000 AS pane, max(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT lane, pane, max(q) OVER (PARTITION BY lane ORDER BY pane RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS value FROM p""")
def lineitem_ship_panes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("lane"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("tick_ms"), F.col("l_quantity").alias("value"), F.lit(None).cast("string").alias("item"))
    return windows.sliding_panes(windows.with_pane(rows, 86_400_000), Family("max"), 7, ("lane",))


@query("SELECT event_id AS log_index, 1.0::DOUBLE AS ingest_events_total, octet_length(encode(props))::DOUBLE AS ingest_payload_bytes FROM events")
def builtin_measurements(spark, sf_dir):
    e = tables.builtin_measurements(tables.read_events_table(spark, sf_dir))
    pick = lambda name: F.filter("measurements", lambda m: m["metric"] == name)[0]["value"].alias(name)
    return e.select("log_index", pick("ingest_events_total"), pick("ingest_payload_bytes"))


@query("""WITH s AS (SELECT user_id % 8 AS p, count(*) % 400 AS a, count(*) % 300 AS r FROM events GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (WHERE p < 5) AS critical, count(*) FILTER (WHERE p < 5 AND a <= 200 AND r <= 250) AS critical_ready, count(*) FILTER (WHERE p < 5 AND a <= 200 AND r <= 250) / count(*) FILTER (WHERE p < 5)::DOUBLE AS ratio,
count(*) FILTER (WHERE p < 5 AND a <= 200 AND r <= 250) / count(*) FILTER (WHERE p < 5)::DOUBLE + 1e-9 >= 0.5 AS ready FROM s""")
def readiness_gate(spark, sf_dir):
    s = log(spark, sf_dir).groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"))
    s = s.select("partition_id", (F.col("partition_id") < 5).alias("critical"), (F.col("n") % 400).alias("apply_lag_ms"), (F.col("n") % 300).alias("replication_lag_ms"))
    return readiness.ready(s, 0.5)
