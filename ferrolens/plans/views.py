"""Equipment data as views of the tables at hand: once for Spark, once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor readings: one row for each event."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("equipment_id"), F.col("event_type").alias("sensor_id"), "ts", "event_id", "value")


READINGS = "readings as (select user_id as equipment_id, event_type as sensor_id, ts, event_id, value from events)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of five lines of equipment: fewer and longer series."""
    return readings(spark, sf_dir).withColumn("equipment_id", F.col("equipment_id") % 5)


LINES = "readings as (select user_id % 5 as equipment_id, event_type as sensor_id, ts, event_id, value from events)"


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms: one of twelve codes; those whose number isn't divisible by five were cleared after `value` minutes."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("equipment_id"), F.concat(F.lit("A"), (F.lit(100) + k % 12).cast("string")).alias("code"), "ts", "event_id",
        F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.make_interval(secs=F.round(F.col("value") * 60).cast("decimal(18,6)"))).alias("cleared_at"),
    )


ALARMS = (
    "alarms as (select user_id as equipment_id, 'A' || cast(100 + cast(json_extract(props, '$.k') as int) % 12 as varchar) as code, ts, event_id,"
    " case when event_id % 5 <> 0 then ts + to_seconds(cast(round(value * 60) as bigint)) end as cleared_at from events)"
)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service logs: level by kind of event, six services, a correlation id for every seven events."""
    kind = F.col("event_type")
    level = F.when(kind == "error", "Error").when(kind == "purchase", "Warning").when(kind == "view", "Debug").otherwise("Information")
    return table(spark, sf_dir, "events").select(
        "ts", level.alias("level"), F.concat(F.lit("svc"), (F.col("user_id") % 6).cast("string")).alias("service"), kind.alias("template"),
        F.concat(F.lit("c"), F.expr("event_id div 7").cast("string")).alias("correlation_id"), "event_id", "value", "user_id", "props",
    )


LOGS = (
    "logs as (select ts, case event_type when 'error' then 'Error' when 'purchase' then 'Warning' when 'view' then 'Debug' else 'Information' end as level,"
    " 'svc' || cast(user_id % 6 as varchar) as service, event_type as template, 'c' || cast(event_id // 7 as varchar) as correlation_id, event_id, value, user_id, props from events)"
)
