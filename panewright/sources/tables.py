"""From tables to event rows: column adapters, the built-in measurements, files and Kafka."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EVENT, MEASUREMENT, ConfigError


def measurement(metric: str, value: Column | None = None, item: Column | None = None, labels: Mapping[str, Column] | None = None, lane_bitmap: Column | None = None) -> Column:
    pairs = [x for k, v in (labels or {}).items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        F.lit(metric).alias("metric"),
        (F.lit(None) if value is None else value).cast("double").alias("value"),
        (F.lit(None) if item is None else item).cast("string").alias("item"),
        (F.lit(0) if lane_bitmap is None else lane_bitmap).cast("long").alias("lane_bitmap"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("labels"),
    )


def to_events(df: DataFrame, partition: Column, log_index: Column, tick_ms: Column, event_id: Column, key: Column, payload: Column, measurements: list[Column] | Column, schema_key: str = "", arrival_ms: Column | None = None) -> DataFrame:
    """df as rows of model.EVENT."""
    m = F.array(*measurements) if isinstance(measurements, list) else measurements
    return df.select(
        partition.cast("string").alias("partition_id"),
        log_index.cast("long").alias("log_index"),
        tick_ms.cast("long").alias("tick_ms"),
        (F.lit(None) if arrival_ms is None else arrival_ms).cast("long").alias("arrival_ms"),
        event_id.cast("string").alias("event_id"),
        key.cast("string").alias("partition_key"),
        F.lit(schema_key).alias("schema_key"),
        payload.cast("string").alias("payload"),
        m.cast(EVENT["measurements"].dataType).alias("measurements"),
    )


def read_events_table(spark: SparkSession, sf_dir: str, partitions: int = 8) -> DataFrame:
    """The `events` table: partition by user, metric `value`, label event_type, item user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return to_events(
        e,
        F.pmod("user_id", F.lit(partitions)),
        F.col("event_id"),
        F.unix_millis(F.col("ts").cast("timestamp")),
        F.concat(F.lit("evt-"), F.col("event_id")),
        F.col("user_id"),
        F.col("props"),
        [measurement("value", F.col("value"), F.col("user_id"), {"event_type": F.col("event_type")})],
        "events_v1",
    )


def builtin_measurements(events: DataFrame) -> DataFrame:
    """events with the two measurements that every event has: one event, and its payload's bytes."""
    labels = {"partition_id": F.col("partition_id"), "schema_key": F.col("schema_key")}
    own = F.array(
        measurement("ingest_events_total", F.lit(1.0), labels=labels, lane_bitmap=F.lit(1)),
        measurement("ingest_payload_bytes", F.octet_length(F.coalesce("payload", F.lit(""))), labels=labels, lane_bitmap=F.lit(1)),
    ).cast(EVENT["measurements"].dataType)
    return events.withColumn("measurements", F.concat(F.coalesce("measurements", F.array().cast(EVENT["measurements"].dataType)), own))


def read_files(spark: SparkSession, path: str, fmt: str = "parquet", schema=EVENT) -> DataFrame:
    """A log of events in files, of a given schema: nothing is inferred by reading data twice."""
    return spark.read.format(fmt).schema(schema).load(path)


def stream_files(spark: SparkSession, path: str, fmt: str = "parquet", schema=EVENT, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, partitions: int = 8, **options: str) -> DataFrame:
    """A topic of JSON events; needs Spark's Kafka connector on the class path. The topic's offset is the place in the log."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    for k, v in options.items():
        reader = reader.option(k, v)
    try:
        raw = reader.load()
    except Exception as e:
        if "Failed to find data source: kafka" in str(e):
            raise ConfigError("the Kafka connector is not on the class path") from e
        raise
    body = F.from_json(F.col("value").cast("string"), EVENT)
    return raw.select(F.col("partition").cast("string").alias("partition_id"), F.col("offset").alias("log_index"), body["tick_ms"].alias("tick_ms"), F.unix_millis("timestamp").alias("arrival_ms"), body["event_id"].alias("event_id"), F.col("key").cast("string").alias("partition_key"), body["schema_key"].alias("schema_key"), body["payload"].alias("payload"), body["measurements"].alias("measurements"))


def telemetry(events: DataFrame) -> DataFrame:
    """Event rows as rows of operators.series, one for each measurement."""
    m = events.select("partition_id", "log_index", "tick_ms", F.explode("measurements").alias("m"))
    return m.select("partition_id", "log_index", "tick_ms", *[F.col(f"m.{f.name}").alias(f.name) for f in MEASUREMENT.fields if f.name != "lane_bitmap"])
