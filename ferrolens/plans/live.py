"""Live queries: the events table as a stream, run over what is there; what the watermark has passed comes out.

A stream's watermark is the latest event time it has seen, in whole milliseconds, less the delay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolens.functions.numbers import r6
from ferrolens.plans.registry import query
from ferrolens.plans.retrieval import INDEX, text_index
from ferrolens.plans.views import ALARMS, LOGS, READINGS, table
from ferrolens.runtime import shared_path
from ferrolens.sources.chunkstore import ChunkStore
from ferrolens.streaming import folds, live, ordered

#: Microseconds that the watermark has passed in SQL, for a delay of one hour.
PASSED = "passed as (select epoch_us(max(ts)) // 1000 * 1000 - 3600000000 as us from events)"
DELAY = "1 hour"


def streamed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, times as timestamps. The table is a folder of files, or one file."""
    path = f"{sf}/{name}.parquet"
    rows = table(spark, sf, name)
    one_file = all(f.endswith(f"/{name}.parquet") for f in rows.inputFiles())
    reader = spark.readStream.schema(rows.schema)
    found = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf) if one_file else reader.parquet(path)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def local(name: str):
    return F.col(name).cast("timestamp_ntz").alias(name)


def live_readings(spark: SparkSession, sf: str) -> DataFrame:
    events = streamed(spark, sf, "events")
    return events.select(F.col("user_id").alias("equipment_id"), F.col("event_type").alias("sensor_id"), "ts", "event_id", "value")


@query("str2_trigger_passages", f"with {INDEX} select query_id as trigger_id, chunk_id, round(score, 5) + 0.0 as score, place from bm25 where place <= 3")
def str2(spark, sf):
    """Benchmark passages as live triggers, in two deliveries; each gets its three best documents."""
    folder = shared_path(spark)
    index = text_index(spark, sf)
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("trigger_id"), F.col("text").alias("description"))
    for part in range(2):
        items.filter(F.pmod(F.hash("trigger_id"), F.lit(2)) == part).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(items.schema).parquet(f"{folder}/in")
        writer = live.with_passages(source, index, 3, f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{folder}/out").drop("batch")
    return found.withColumn("score", F.round("score", 5) + 0.0)


STR1 = """
select item_id as document_id, 0 as chunk_index, case when item_id % 3 = 0 then 'New: ' || text else text end as text from benchmark where item_id % 5 > 0
"""


@query("str1_ingest", STR1)
def str1(spark, sf):
    """A live corpus of passages, each of one chunk: all of them, then a third anew, then a fifth removed; what the store holds."""
    folder = shared_path(spark)
    store = ChunkStore(spark, f"{folder}/store", buckets=4)
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("document_id"), "text")
    files = items.withColumn("changed", F.lit(1))
    anew = items.filter("document_id % 3 = 0").select("document_id", F.concat(F.lit("New: "), "text").alias("text"), F.lit(2).alias("changed"))
    gone = items.filter("document_id % 5 = 0").select("document_id")
    for k, (name, rows) in enumerate((("files", files), ("files", anew), ("gone", gone))):
        rows.write.mode("append").parquet(f"{folder}/{name}")
        writers = live.ingest(
            spark.readStream.schema(files.schema).parquet(f"{folder}/files"), store,
            spark.readStream.schema(gone.schema).parquet(f"{folder}/gone") if k == 2 else None, markdown=False,
        )
        for i, writer in enumerate(writers):
            writer.option("checkpointLocation", f"{folder}/checkpoint{i}").trigger(availableNow=True).start().awaitTermination()
    return store.read().select("document_id", "chunk_index", "text")


STR3 = f"""
with recursive {ALARMS}, {PASSED},
o as (
    select code, ts, event_id, row_number() over (partition by code order by ts, event_id) as k
    from alarms, passed where epoch_us(ts) < us
), w as (
    select code, ts, event_id, k, ts as last, true as issued from o where k = 1
    union all
    select o.code, o.ts, o.event_id, o.k,
        case when epoch_us(o.ts) - epoch_us(w.last) >= 21600000000 then o.ts else w.last end,
        epoch_us(o.ts) - epoch_us(w.last) >= 21600000000
    from w join o on o.code = w.code and o.k = w.k + 1
)
select 0::bigint as equipment_id, code as hypothesis, event_id as alert_id, ts from w where issued
"""


@query("str3_suppress", STR3)
def str3(spark, sf):
    events = streamed(spark, sf, "events")
    code = F.concat(F.lit("A"), (100 + F.get_json_object("props", "$.k").cast("int") % 12).cast("string"))
    raised = events.select(F.lit(0).cast("long").alias("equipment_id"), code.alias("hypothesis"), "ts", F.col("event_id").alias("alert_id"))
    tagged = ordered.in_order(raised, folds.ALERT_KEYS, "alert_id", folds.Suppress(360), DELAY)
    issued = folds.times(ordered.on_time(ordered.run_available(tagged, shared_path(spark))))
    return issued.select("equipment_id", "hypothesis", "alert_id", local("ts"))


STR4 = f"""
with {LOGS}, {PASSED},
w as (select *, epoch_us(ts) // 3600000000 * 3600000000 as us_ from logs)
select make_timestamp(us_) as start, service, count(*) filter (level = 'Error') as errors,
    count(*) filter (level = 'Warning') as warnings, count(*) as n
from w, passed where us_ + 3600000000 <= us group by us_, service
"""


@query("str4_error_rates", STR4)
def str4(spark, sf):
    events = streamed(spark, sf, "events")
    kind = F.col("event_type")
    level = F.when(kind == "error", "Error").when(kind == "purchase", "Warning").otherwise("Information")
    logs = events.select("ts", level.alias("level"), F.concat(F.lit("svc"), (F.col("user_id") % 6).cast("string")).alias("service"))
    rates = ordered.run_available(live.error_rates(logs, "1 hour", DELAY), shared_path(spark))
    return rates.select(local("start"), "service", "errors", "warnings", "n")


STR5 = f"""
with recursive {READINGS}, {PASSED},
t as (
    select equipment_id, sensor_id, event_id, value, row_number() over w as k,
        count(*) over before_ as n, avg(value) over before_ as mean, stddev_pop(value) over before_ as std
    from readings, passed where value is not null and epoch_us(ts) < us
    window w as (partition by equipment_id, sensor_id order by ts, event_id),
        before_ as (partition by equipment_id, sensor_id order by ts, event_id rows between unbounded preceding and 1 preceding)
), e as (
    select equipment_id, sensor_id, event_id, k, value as ema from t where k = 1
    union all
    select t.equipment_id, t.sensor_id, t.event_id, t.k, 2.0 / 11 * t.value + (1 - 2.0 / 11) * e.ema
    from e join t on t.equipment_id = e.equipment_id and t.sensor_id = e.sensor_id and t.k = e.k + 1
), z as (
    select event_id, case when n >= 5 and std > 1e-10 then (value - mean) / std else 0 end as z from t
)
select equipment_id, sensor_id, event_id, round(ema, 6) + 0.0 as ema, round(z, 6) + 0.0 as z, abs(z) >= 3 as odd
from e join z using (event_id)
"""


@query("str5_detect", STR5)
def str5(spark, sf):
    tagged = ordered.in_order(live_readings(spark, sf), folds.READING_KEYS, "event_id", folds.Detect(), DELAY)
    found = ordered.on_time(ordered.run_available(tagged, shared_path(spark)))
    return found.withColumns({"ema": r6("ema"), "z": r6("z")})


# A small rule base with durations.
HELD = [(1, "view", 20.0, None, 36_000.0), (2, "click", None, 60.0, 0.0), (3, "error", 5.0, 80.0, 200_000.0)]
STR6 = f"""
with {READINGS}, {PASSED},
triggers(trigger_id, sensor_id, low, high, need) as (
    values (1, 'view', 20.0, null, 36000.0), (2, 'click', null, 60.0, 0.0), (3, 'error', 5.0, 80.0, 200000.0)
), met as (
    select equipment_id, trigger_id, event_id, epoch_us(ts) as at_, cast(need * 1000000 as bigint) as need,
        coalesce(value >= coalesce(low, value) and value <= coalesce(high, value), false) as holds
    from readings join triggers using (sensor_id), passed where epoch_us(ts) < us
), marked as (
    select *, coalesce(lag(holds) over w, false) as before_,
        min(case when not holds then at_ end) over (w rows between 1 following and unbounded following) as broken
    from met window w as (partition by equipment_id, trigger_id order by at_, event_id)
)
select equipment_id, trigger_id::bigint as trigger_id, make_timestamp(at_) as since, make_timestamp(at_ + need) as told
from marked, passed where holds and not before_ and coalesce(broken, us) - at_ >= need
"""


@query("str6_rules", STR6)
def str6(spark, sf):
    triggers = spark.createDataFrame(HELD, "trigger_id long, sensor_id string, low double, high double, duration_seconds double")
    met = folds.conditions(live_readings(spark, sf), triggers)
    tagged = ordered.in_order(met, folds.RULE_KEYS, "event_id", folds.Hold(), DELAY)
    told = folds.times(ordered.on_time(ordered.run_available(tagged, shared_path(spark))))
    return told.select("equipment_id", "trigger_id", local("since"), local("told"))


STR8 = """
with parts as (
    select event_id % 3 as part, epoch_us(max(ts)) // 1000 * 1000 - 432000000000 as us from events group by 1
), passed as (
    select part, max(us) over (order by part rows between unbounded preceding and 1 preceding) as us from parts
)
select event_id, coalesce(epoch_us(ts) < us, false) as late,
    case when epoch_us(ts) < us then us - epoch_us(ts) end as late_us
from events join passed on part = event_id % 3
"""


@query("str8_late_rows", STR8)
def str8(spark, sf):
    """Events come in three deliveries; what lies five days behind the latest event of those before is late."""
    folder = shared_path(spark)
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    for part in range(3):
        events.filter(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        on_time = ordered.run_available(ordered.split_late(source, "event_id", "5 days"), f"{folder}/out", f"{folder}/late")
    late = spark.read.parquet(f"{folder}/late")
    every = on_time.select("event_id", F.lit(None).cast("double").alias("late_by")).unionByName(late.select("event_id", "late_by"))
    return every.select("event_id", F.col("late_by").isNotNull().alias("late"), F.round(F.col("late_by") * 1e6).cast("long").alias("late_us"))
