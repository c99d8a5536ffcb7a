"""Remaining-life queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolens.functions.numbers import r6
from ferrolens.operators import life as R
from ferrolens.plans.registry import query
from ferrolens.plans.views import READINGS, readings

KEY = "equipment_id, sensor_id"
FIT = f"""with {READINGS}, h as (select *, (epoch_us(ts) - min(epoch_us(ts)) over (partition by {KEY})) / 3600e6 as hours from readings where value is not null),
    f as (select {KEY}, count(*) as n, coalesce(regr_slope(value, hours), 0) as slope, coalesce(regr_intercept(value, hours), avg(value)) as intercept, case when var_pop(value) > 0 then coalesce(regr_r2(value, hours), 0) else 0 end as r2, max(hours) as span, arg_max(value, (ts, event_id)) as last from h group by {KEY}),
    l as (select *, case when n >= 3 and abs(slope) >= 1e-12 and slope > 0 then greatest((100 - intercept) / slope - span, 0) end as remaining, case when n >= 3 and abs(slope) >= 1e-12 and slope > 0 then least(greatest(r2, 0), 1) end as confidence from f)"""


@query("rul1_linear_fit", FIT + f" select {KEY}, n, round(slope, 6) + 0.0 as slope, round(intercept, 5) + 0.0 as intercept, round(r2, 6) + 0.0 as r2 from f")
def rul1(spark, sf):
    return R.linear_fit(readings(spark, sf)).select("equipment_id", "sensor_id", "n", r6("slope").alias("slope"), (F.round("intercept", 5) + 0.0).alias("intercept"), r6("r2").alias("r2"))


@query("rul2_linear_life", FIT + f" select {KEY}, last, round(remaining, 2) + 0.0 as remaining, round(confidence, 6) + 0.0 as confidence from l")
def rul2(spark, sf):
    return R.linear_life(readings(spark, sf), 100.0, False).select("equipment_id", "sensor_id", "last", (F.round("remaining", 2) + 0.0).alias("remaining"), r6("confidence").alias("confidence"))


@query(
    "rul3_exponential_life",
    FIT + f""", c as (select {KEY}, count(*) as m, regr_slope(ln(value), hours) as b, regr_intercept(ln(value), hours) as a, coalesce(regr_r2(ln(value), hours), 0) as s, max(hours) as until from h where value > 0 group by {KEY}),
    u as (select l.*, c.*, coalesce(m >= 3 and abs(b) >= 1e-12 and s >= r2, false) as usable from l left join c using ({KEY}))
    select {KEY}, case when usable then 'exponential' else 'linear' end as model, round(case when usable then greatest((ln(100) - a) / b - until, 0) else remaining end, 2) + 0.0 as remaining, round(case when usable then least(s, 1) else confidence end, 6) + 0.0 as confidence from u""",
)
def rul3(spark, sf):
    return R.exponential_life(readings(spark, sf), 100.0, False).withColumns({"remaining": F.round("remaining", 2) + 0.0, "confidence": r6("confidence")})


@query("rul4_urgency", FIT + f" select {KEY}, case when remaining <= 0 then 'critical' when remaining <= 24 then 'urgent' when remaining <= 168 then 'warning' else 'info' end as urgency from l where remaining is not null")
def rul4(spark, sf):
    found = R.linear_life(readings(spark, sf), 100.0, False).filter("remaining is not null")
    return found.select("equipment_id", "sensor_id", R.urgency("remaining").alias("urgency"))
