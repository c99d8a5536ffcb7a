"""Alarm patterns: by equipment unless `by` says otherwise; `by=()` treats all alarms as one list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrolens.functions.numbers import micros, seconds_between

BY = ("equipment_id",)


def top_alarms(df: DataFrame, n: int) -> DataFrame:
    """The n most frequent codes with their share of all alarms; ties go by code."""
    counts = df.groupBy("code").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("code", "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), "code").limit(n)


def _all_of(df: DataFrame, numbers: DataFrame, place, by) -> DataFrame:
    counts = df.groupBy(*by, place.cast("long").alias("at")).agg(F.count("*").alias("n"))
    every = df.select(*by).distinct().join(F.broadcast(numbers)) if by else numbers
    return every.join(counts, [*by, "at"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def hourly(df: DataFrame, by=()) -> DataFrame:
    """Alarms of each hour of the day, 0 to 23, also of hours without any."""
    return _all_of(df, df.sparkSession.range(24).withColumnRenamed("id", "at"), F.hour("ts"), by)


def weekday(df: DataFrame, by=()) -> DataFrame:
    """Alarms of each day of the week, Sunday being 0, also of days without any."""
    return _all_of(df, df.sparkSession.range(7).withColumnRenamed("id", "at"), F.dayofweek("ts") - 1, by)


def cascades(df: DataFrame, minutes: float = 10, least: int = 2, longest: int = 5, by=BY) -> DataFrame:
    """Sequences of 2 to `longest` consecutive codes, each within `minutes` of the one before, and how often they occur."""
    w = Window.partitionBy(*by).orderBy("ts", "event_id")
    steps = df
    for k in range(1, longest):
        steps = steps.withColumn(f"code{k}", F.lead("code", k).over(w)).withColumn(f"ts{k}", F.lead("ts", k).over(w))
    before, chains, fine = "ts", [], F.lit(True)
    for k in range(1, longest):
        fine = fine & F.coalesce(micros(f"ts{k}") - micros(before) <= int(minutes * 60e6), F.lit(False))
        chains.append(F.when(fine, F.concat_ws(">", "code", *(f"code{i}" for i in range(1, k + 1)))))
        before = f"ts{k}"
    found = steps.select(*by, F.explode(F.array_compact(F.array(*chains))).alias("sequence"))
    return found.groupBy(*by, "sequence").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def mtbf(df: DataFrame, by=BY) -> DataFrame:
    """Mean hours between alarms of one code, where there are two or more."""
    span = df.groupBy(*by, "code").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).filter("n >= 2")
    return span.select(*by, "code", "n", (seconds_between("a", "b") / 3600 / (F.col("n") - 1)).alias("hours"))


def mttr(df: DataFrame, by=BY) -> DataFrame:
    """Mean minutes from an alarm to its clearing, of cleared alarms."""
    return df.filter("cleared_at is not null").groupBy(*by, "code").agg(F.count("*").alias("n"), F.avg(seconds_between("ts", "cleared_at") / 60).alias("minutes"))


def co_occurrence(df: DataFrame, minutes: float = 30, by=BY) -> DataFrame:
    """Pairs of different codes within `minutes`, counted by pair of alarms.

    Alarms meet by time bucket: each in its own and the next, so the join is on equal keys and a
    bucket's rows are bounded by the alarms of two windows.
    """
    width = int(minutes * 60e6)
    keyed = df.select(*by, "code", "event_id", micros("ts").alias("at"))
    left = keyed.withColumn("bucket", F.floor(F.col("at") / width))
    right = left.select(*by, F.col("code").alias("other"), F.col("event_id").alias("other_id"), F.col("at").alias("other_at"), F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    # the later alarm looks back: the earlier stands in the same bucket or the one before
    order = (F.col("other_at") < F.col("at")) | ((F.col("other_at") == F.col("at")) & (F.col("other_id") < F.col("event_id")))
    pairs = left.join(right, [*by, "bucket"]).filter(order & (F.col("at") - F.col("other_at") <= width) & (F.col("code") != F.col("other")))
    return pairs.groupBy(*by, F.least("code", "other").alias("first"), F.greatest("code", "other").alias("second")).agg(F.count("*").alias("n"))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, before: float, after: float) -> DataFrame:
    """Pairs of rows with equal keys whose right time lies from `before` to `after` seconds around the left time.

    Times go into buckets of the band's width, and left rows into every bucket that their band touches
    (two, or three at an edge), so that the join is on equal keys.
    """
    width = max(int((before + after) * 1e6), 1)
    a, b = micros(left_at) - int(before * 1e6), micros(left_at) + int(after * 1e6)
    spread = left.withColumn("band", F.explode(F.sequence(F.floor(a / width), F.floor(b / width))))
    placed = right.withColumn("band", F.floor(micros(right_at) / width))
    return spread.join(placed, [*keys, "band"]).filter((micros(right_at) >= a) & (micros(right_at) <= b)).drop("band")


def alarm_windows(triggers: DataFrame, records: DataFrame, before: float = 300, after: float = 300) -> DataFrame:
    """For each trigger (equipment_id, trigger_id, trigger_ts), the records around it: all, warnings, errors."""
    level = F.lower("level")
    found = band_join(triggers, records, ["equipment_id"], "trigger_ts", "ts", before, after)
    counts = found.groupBy("equipment_id", "trigger_id").agg(F.count("*").alias("records"), F.count_if(level == "warning").alias("warnings"), F.count_if(level == "error").alias("errors"))
    return triggers.join(counts, ["equipment_id", "trigger_id"], "left").fillna(0, ["records", "warnings", "errors"])


def time_window(records: DataFrame, equipment: int, start: str, end: str, channels: list[str] | None = None) -> DataFrame:
    """Records of an equipment from start to end, of some channels or all."""
    found = records.filter((F.col("equipment_id") == equipment) & (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(end).cast("timestamp_ntz")))
    return found.filter(F.col("channel").isin(channels)) if channels else found


def rca_evidence(triggers: DataFrame, records: DataFrame, readings: DataFrame, anomalies: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """Evidence for each trigger (equipment_id, trigger_id, trigger_ts) from its own equipment: records from 300 s before to 60 s
    behind, readings (sensor_id, value) from 600 s before to 120 s behind as mean by sensor, anomalies from 900 s before
    to 120 s behind, and the passages (trigger_id, chunk_id, place) retrieved for it."""
    keys = ["equipment_id", "trigger_id"]
    asked = triggers.select(*keys, "trigger_ts")
    near = lambda df, before, after: band_join(asked, df, ["equipment_id"], "trigger_ts", "ts", before, after)
    ids = lambda df, name: df.groupBy(*keys).agg(F.sort_array(F.collect_list("event_id")).alias(name))
    means = near(readings, 600, 120).groupBy(*keys, "sensor_id").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    series = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("sensor_id", "mean", "n"))).alias("series"))
    out = triggers
    for part in (ids(near(records, 300, 60), "records"), series, ids(near(anomalies, 900, 120), "anomalies")):
        out = out.join(part, keys, "left")
    if passages is not None:
        told = passages.groupBy("trigger_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]).alias("passages"))
        out = out.join(told, "trigger_id", "left")
    return out
