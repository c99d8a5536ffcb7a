"""Queries on series that are longer than a task: all readings of the table as one series, or one for each sensor."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolens.functions.numbers import r6
from ferrolens.operators import segments as G
from ferrolens.operators import series as S
from ferrolens.plans.registry import query
from ferrolens.plans.views import READINGS, readings

#: One series of the whole table.
ONE = "one as (select 0::bigint as line, ts, event_id, value from events)"
KEYS, ORDER = ["line"], ["ts", "event_id"]


def one(spark, sf):
    return readings(spark, sf).select(F.lit(0).cast("long").alias("line"), *ORDER, "value")


PERCENTILES = f"""
with {READINGS}
select sensor_id, count(value) as n, percentile_disc(0.05) within group (order by value) as p5,
    percentile_disc(0.5) within group (order by value) as median, percentile_disc(0.95) within group (order by value) as p95
from readings group by sensor_id
"""


@query("ts1_long_percentiles", PERCENTILES)
def ts1(spark, sf):
    return G.percentiles(readings(spark, sf), ["sensor_id"], "value", {"p5": 0.05, "median": 0.5, "p95": 0.95})


TS2 = f"""
with {ONE}, t as (
    select event_id, row_number() over (order by ts, event_id) as k, avg(value) over (order by ts, event_id rows between 24 preceding and current row) as average from one
)
select event_id, round(average, 6) + 0.0 as average from t where k >= 25
"""


@query("ts2_long_series", TS2)
def ts2(spark, sf):
    return G.moving_average(one(spark, sf), 25, KEYS, ORDER, size=4096).select("event_id", r6("average").alias("average"))


TS3 = f"""
with recursive {ONE}, t as (
    select event_id, value, row_number() over (order by ts, event_id) as k from one where value is not null
), e as (
    select k, value as ema from t where k = 1
    union all
    select t.k, 2.0 / 21 * t.value + (1 - 2.0 / 21) * e.ema from e join t on t.k = e.k + 1
)
select event_id, round(ema, 6) + 0.0 as ema from e join t using (k)
"""


@query("ts3_long_series", TS3)
def ts3(spark, sf):
    return G.ema(one(spark, sf), 20, KEYS, ORDER, size=4096).select("event_id", r6("ema").alias("ema"))


TS4 = f"""
with {ONE}, t as (
    select value, row_number() over (order by ts, event_id) - 1 as x from one
), f as (
    select count(*) as n, coalesce(regr_slope(value, x), 0) as slope, avg(value) as mean from t
)
select 0::bigint as line, n, round(slope, 9) + 0.0 as slope,
    case when abs(round(slope / abs(mean), 9)) < 0.001 then 'Stable' when slope > 0 then 'Increasing' else 'Decreasing' end as direction from f
"""


@query("ts4_long_series", TS4)
def ts4(spark, sf):
    return G.trend(one(spark, sf), KEYS, ORDER).withColumn("slope", F.round("slope", 9) + 0.0)


TS8 = f"""
with {ONE}, t as (
    select event_id, value, row_number() over (order by ts, event_id) as k, count(*) over () as n,
        (sum(value) over w - value) / 20 as mean, (sum(value * value) over w - value * value) / 20 as square
    from one window w as (order by ts, event_id rows between 10 preceding and 10 following)
)
select event_id, round(abs(value - mean) / sqrt(greatest(square - mean * mean, 0)), 6) + 0.0 as score from t
where n >= 40 and k > 10 and k <= n - 10 and sqrt(greatest(square - mean * mean, 0)) > 1e-10 and abs(value - mean) / sqrt(greatest(square - mean * mean, 0)) > 2.5
"""


@query("ts8_long_series", TS8)
def ts8(spark, sf):
    return G.local_anomalies(one(spark, sf), KEYS, ORDER, size=4096).select("event_id", r6("score").alias("score"))


LOG3 = f"""
with {ONE}
select event_id, row_number() over w as place, round(coalesce(epoch_us(ts) - lag(epoch_us(ts)) over w, 0) / 1000, 6) + 0.0 as gap_ms
from one window w as (order by ts, event_id)
"""


@query("log3_long_flow", LOG3)
def log3(spark, sf):
    return G.gaps(one(spark, sf), KEYS, ORDER, "ts", size=4096).select("event_id", "place", r6("gap_ms").alias("gap_ms"))


ASOF = f"""
with {READINGS}
select r.event_id, s.value as step from readings r asof left join (
    select sensor_id, ts, max_by(value, event_id) as value from readings where event_id % 10 = 3 group by 1, 2
) s on r.sensor_id = s.sensor_id and r.ts >= s.ts
"""


@query("if2_asof_steps", ASOF)
def asof(spark, sf):
    """Each reading with the latest step of its sensor: steps are every tenth reading."""
    df = readings(spark, sf)
    steps = df.filter("event_id % 10 = 3").select("sensor_id", "ts", "event_id", F.col("value").alias("step"))
    return G.asof_join(df.select("sensor_id", "ts", "event_id"), steps, ["sensor_id"], "ts", ["step"], "event_id").select("event_id", "step")


FRAME = f"""
with {READINGS}, m as (
    select equipment_id, sensor_id, epoch_us(ts) // 21600000000 * 21600 as bucket, avg(value) as value from readings where sensor_id in ('view', 'click', 'error') group by 1, 2, 3
), spine as (
    select equipment_id, unnest(range(min(bucket), max(bucket) + 1, 21600)) as bucket from m group by 1
), x as (
    select s.equipment_id, s.bucket, n.sensor_id, m.value, case when m.value is not null then s.bucket end as known
    from spine s cross join (select unnest(['view', 'click', 'error']) as sensor_id) n left join m on m.equipment_id = s.equipment_id and m.sensor_id = n.sensor_id and m.bucket = s.bucket
), y as (
    select *, last_value(value ignore nulls) over b as v0, last_value(known ignore nulls) over b as t0, first_value(value ignore nulls) over a as v1, first_value(known ignore nulls) over a as t1
    from x window b as (partition by equipment_id, sensor_id order by bucket rows between unbounded preceding and current row),
        a as (partition by equipment_id, sensor_id order by bucket rows between current row and unbounded following)
), z as (
    select *, coalesce(value, v0 + (bucket - t0) / (t1 - t0) * (v1 - v0)) as shown from y
)
select equipment_id, bucket, round(max(shown) filter (sensor_id = 'view') + 1e-9, 6) + 0.0 as view, round(max(shown) filter (sensor_id = 'click') + 1e-9, 6) + 0.0 as click,
    round(max(shown) filter (sensor_id = 'error') + 1e-9, 6) + 0.0 as error, count(*) filter (value is null) / 3 as missing_ratio, bool_or(value is null and shown is not null) as interpolated
from z group by 1, 2
"""


@query("ts10_interpolated_frame", FRAME)
def ts10(spark, sf):
    frame = S.interpolated_frame(readings(spark, sf), ["view", "click", "error"], 21_600)
    # 1e-9 keeps exact halves, which lines between hundredths often are, on one side in both engines
    return frame.withColumns({s: r6(F.col(s) + 1e-9) for s in ("view", "click", "error")})
