"""Alarm queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolens.functions.numbers import r6
from ferrolens.operators import alarms as A
from ferrolens.plans.registry import query
from ferrolens.plans.views import ALARMS, LOGS, alarms, logs


@query("alm1_top_alarms", f"with {ALARMS} select code, count(*) as n, round(count(*) / (select count(*) from alarms), 6) + 0.0 as share from alarms group by code order by n desc, code limit 5")
def alm1(spark, sf):
    return A.top_alarms(alarms(spark, sf), 5).withColumn("share", r6("share"))


@query("alm2_hourly", f"with {ALARMS} select h.r as \"at\", count(event_id) as n from range(24) h(r) left join alarms on hour(ts) = h.r group by h.r")
def alm2(spark, sf):
    return A.hourly(alarms(spark, sf))


@query("alm3_weekday", f"with {ALARMS} select d.r as \"at\", count(event_id) as n from range(7) d(r) left join alarms on dayofweek(ts) = d.r group by d.r")
def alm3(spark, sf):
    return A.weekday(alarms(spark, sf))


@query(
    "alm4_cascades",
    f"""with recursive {ALARMS}, o as (select *, row_number() over (partition by equipment_id order by ts, event_id) as k from alarms),
    c as (select equipment_id, k, ts, code as sequence, 1 as n from o union all select o.equipment_id, o.k, o.ts, c.sequence || '>' || o.code, c.n + 1 from c join o on o.equipment_id = c.equipment_id and o.k = c.k + 1 where c.n < 5 and epoch_us(o.ts) - epoch_us(c.ts) <= 36000000000)
    select equipment_id, sequence, count(*) as n from c where n >= 2 group by 1, 2 having count(*) >= 2""",
)
def alm4(spark, sf):
    return A.cascades(alarms(spark, sf), minutes=600)


@query("alm5_mtbf", f"with {ALARMS} select equipment_id, code, count(*) as n, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 3600e6 / (count(*) - 1), 6) + 0.0 as hours from alarms group by 1, 2 having count(*) >= 2")
def alm5(spark, sf):
    return A.mtbf(alarms(spark, sf)).withColumn("hours", r6("hours"))


@query("alm6_mttr", f"with {ALARMS} select equipment_id, code, count(*) as n, round(avg((epoch_us(cleared_at) - epoch_us(ts)) / 60e6), 6) + 0.0 as minutes from alarms where cleared_at is not null group by 1, 2")
def alm6(spark, sf):
    return A.mttr(alarms(spark, sf)).withColumn("minutes", r6("minutes"))


@query(
    "alm7_co_occurrence",
    f"""with {ALARMS} select a.equipment_id, least(a.code, b.code) as first, greatest(a.code, b.code) as second, count(*) as n from alarms a join alarms b on a.equipment_id = b.equipment_id and a.code <> b.code and (b.ts < a.ts or b.ts = a.ts and b.event_id < a.event_id)
    and epoch_us(a.ts) - epoch_us(b.ts) <= 7200000000 group by all""",
)
def alm7(spark, sf):
    return A.co_occurrence(alarms(spark, sf), 120)


@query(
    "alm8_alarm_windows",
    f"""with {LOGS}, t as (select user_id as equipment_id, event_id as trigger_id, ts as trigger_ts from logs where level = 'Error')
    select t.equipment_id, t.trigger_id, count(l.event_id) as records, count(*) filter (l.level = 'Warning') as warnings, count(*) filter (l.level = 'Error') as errors from t left join logs l on l.user_id = t.equipment_id and epoch_us(l.ts) between epoch_us(trigger_ts) - 36000000000 and epoch_us(trigger_ts) + 7200000000 group by all""",
)
def alm8(spark, sf):
    records = logs(spark, sf).withColumnRenamed("user_id", "equipment_id")
    triggers = records.filter("level = 'Error'").select("equipment_id", F.col("event_id").alias("trigger_id"), F.col("ts").alias("trigger_ts"))
    return A.alarm_windows(triggers, records, 36_000, 7200).drop("trigger_ts")


@query("alm10_time_window", f"with {LOGS} select event_id, ts, level from logs where user_id = 8 and ts >= '2024-01-01' and ts <= '2024-01-15' and template in ('error', 'view')")
def alm10(spark, sf):
    records = logs(spark, sf).withColumnRenamed("user_id", "equipment_id").withColumn("channel", F.col("template"))
    return A.time_window(records, 8, "2024-01-01", "2024-01-15", ["error", "view"]).select("event_id", "ts", "level")


@query(
    "alm9_rca_evidence",
    f"""with {LOGS}, t as (select user_id as equipment_id, event_id as trigger_id, epoch_us(ts) as at_ from logs where level = 'Error'), r as (select user_id as equipment_id, event_id, template, value, epoch_us(ts) as at_ from logs),
    a as (select t.trigger_id, string_agg(cast(event_id as varchar), ',' order by event_id) as records from t join r on r.equipment_id = t.equipment_id and r.at_ between t.at_ - 300000000 and t.at_ + 60000000 group by 1),
    s as (select trigger_id, string_agg(template || ':' || n, ',' order by template) as series from (select t.trigger_id, template, count(*) as n from t join r on r.equipment_id = t.equipment_id and r.at_ between t.at_ - 600000000 and t.at_ + 120000000 group by 1, 2) group by 1),
    o as (select t.trigger_id, string_agg(cast(event_id as varchar), ',' order by event_id) as anomalies from t join r on r.equipment_id = t.equipment_id and r.at_ between t.at_ - 900000000 and t.at_ + 120000000 and value > 50 group by 1)
    select trigger_id, records, series, anomalies, 'p1,p2' as passages from t left join a using (trigger_id) left join s using (trigger_id) left join o using (trigger_id)""",
)
def alm9(spark, sf):
    records = logs(spark, sf).withColumnRenamed("user_id", "equipment_id")
    triggers = records.filter("level = 'Error'").select("equipment_id", F.col("event_id").alias("trigger_id"), F.col("ts").alias("trigger_ts"))
    readings_ = records.withColumnRenamed("template", "sensor_id")
    passages = triggers.select("trigger_id", F.explode(F.array(F.lit(2), F.lit(1))).alias("place")).withColumn("chunk_id", F.concat(F.lit("p"), F.col("place").cast("string")))
    found = A.rca_evidence(triggers, records, readings_, readings_.filter("value > 50"), passages)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    series = F.array_join(F.transform("series", lambda x: F.concat(x["sensor_id"], F.lit(":"), x["n"].cast("string"))), ",")
    return found.select("trigger_id", text("records").alias("records"), series.alias("series"), text("anomalies").alias("anomalies"), F.array_join("passages", ",").alias("passages"))
