"""Time series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolens.functions.numbers import micros, r6, rounded_sql
from ferrolens.operators import series as S
from ferrolens.plans.registry import query
from ferrolens.plans.views import LINES, READINGS, lines, readings

KEY = "equipment_id, sensor_id"


@query(
    "ts1_series_stats",
    f"""with {READINGS} select {KEY}, count(value) as n, round(avg(value), 6) + 0.0 as mean, round(stddev_pop(value), 6) + 0.0 as std, min(value) as low, max(value) as high,
    percentile_disc(0.05) within group (order by value) as p5, percentile_disc(0.5) within group (order by value) as median, percentile_disc(0.95) within group (order by value) as p95 from readings group by {KEY}""",
)
def ts1(spark, sf):
    return S.series_stats(readings(spark, sf)).withColumns({"mean": r6("mean"), "std": r6("std")})


@query(
    "ts2_moving_average",
    f"""with {READINGS}, t as (select *, row_number() over w as k, count(*) over (partition by {KEY}) as n, avg(value) over (partition by {KEY} order by ts, event_id rows between 4 preceding and current row) as a
    from readings window w as (partition by {KEY} order by ts, event_id)) select {KEY}, event_id, round(a, 6) + 0.0 as average from t where k >= least(5, n)""",
)
def ts2(spark, sf):
    return S.moving_average(readings(spark, sf), 5).select(*S.KEYS, "event_id", r6("average").alias("average"))


@query(
    "ts3_ema",
    f"""with recursive {READINGS}, t as (select {KEY}, event_id, value, row_number() over (partition by {KEY} order by ts, event_id) as k from readings where value is not null),
    e as (select {KEY}, event_id, k, value as ema from t where k = 1 union all select t.equipment_id, t.sensor_id, t.event_id, t.k, 2.0 / 11 * t.value + (1 - 2.0 / 11) * e.ema from e join t on t.equipment_id = e.equipment_id and t.sensor_id = e.sensor_id and t.k = e.k + 1)
    select {KEY}, event_id, round(ema, 6) + 0.0 as ema from e""",
)
def ts3(spark, sf):
    return S.ema(readings(spark, sf), 10).withColumn("ema", r6("ema"))


TREND = f"""with {READINGS}, t as (select *, row_number() over (partition by {KEY} order by ts, event_id) - 1 as x from readings), f as (select {KEY}, count(*) as n, coalesce(regr_slope(value, x), 0) as slope, avg(value) as mean from t group by {KEY}),
    g as (select *, round(case when mean = 0 then slope else slope / abs(mean) end, 9) as share from f) select {KEY}, n, {rounded_sql("slope", 6)} as slope, case when abs(share) < 0.001 then 'Stable' when share > 0 then 'Increasing' else 'Decreasing' end as direction from g"""


@query("ts4_trend", TREND)
def ts4(spark, sf):
    return S.trend(readings(spark, sf)).withColumn("slope", r6(F.round("slope", 10)))


CUSUM = f"""{LINES}, s as (select {KEY}, avg(value) as mean, stddev_pop(value) as std, count(value) as n from readings group by {KEY}),
    o as (select {KEY}, event_id, ts, value, (value - mean) / std as z, row_number() over (partition by {KEY} order by ts, event_id) as k from readings join s using ({KEY}) where value is not null and n >= 10 and std >= 1e-10),
    w as (select {KEY}, 0::bigint as k, 0::double as up, 0::double as down, null::varchar as direction from s union all
        select {KEY}, k, case when direction is null then u else 0 end, case when direction is null then d else 0 end, direction
        from (select {KEY}, k, u, d, case when u > 5 then 'up' when d > 5 then 'down' end as direction from (select o.equipment_id, o.sensor_id, o.k, greatest(0, w.up + z - 0.5) as u, greatest(0, w.down - z - 0.5) as d from w join o on o.equipment_id = w.equipment_id and o.sensor_id = w.sensor_id and o.k = w.k + 1))),
    points as (select {KEY}, event_id, ts, value, direction from w join o using ({KEY}, k) where direction is not null)"""


@query("ts5_cusum", f"with recursive {CUSUM} select * from points")
def ts5(spark, sf):
    return S.cusum(lines(spark, sf))


@query(
    "ts6_change_segments",
    f"""with recursive {CUSUM}, m as (select r.*, sum((p.event_id is not null)::int) over (partition by {KEY} order by r.ts, r.event_id) as segment from readings r left join (select {KEY}, event_id, 1 as one from points) p using ({KEY}, event_id))
    select {KEY}, cast(segment as bigint) as segment, count(*) as n, round(avg(value), 6) + 0.0 as mean, min(ts) as since from m group by {KEY}, segment""",
)
def ts6(spark, sf):
    df = lines(spark, sf)
    return S.change_segments(df, S.cusum(df)).withColumn("mean", r6("mean"))


@query(
    "ts7_sigma_anomalies",
    f"""with {READINGS}, s as (select {KEY}, avg(value) as mean, stddev_pop(value) as std, count(value) as n from readings group by {KEY}) select {KEY}, event_id, value, round((value - mean) / std, 6) + 0.0 as z,
    case when abs((value - mean) / std) >= 3 then 'Anomaly' else 'Caution' end as severity from readings join s using ({KEY}) where n >= 5 and std > 1e-10 and abs((value - mean) / std) >= 2""",
)
def ts7(spark, sf):
    return S.sigma_anomalies(readings(spark, sf)).select(*S.KEYS, "event_id", "value", r6("z").alias("z"), "severity")


@query(
    "ts8_local_anomalies",
    f"""with {LINES}, t as (select *, row_number() over (partition by {KEY} order by ts, event_id) as k, count(*) over (partition by {KEY}) as n, sum(value) over w - value as s, sum(value * value) over w - value * value as q from readings
    window w as (partition by {KEY} order by ts, event_id rows between 10 preceding and 10 following)), u as (select *, sqrt(greatest(q / 20 - (s / 20) * (s / 20), 0)) as std from t where n >= 40 and k > 10 and k <= n - 10)
    select {KEY}, event_id, value, round(abs(value - s / 20) / std, 6) + 0.0 as score from u where std > 1e-10 and abs(value - s / 20) / std > 2.5""",
)
def ts8(spark, sf):
    return S.local_anomalies(lines(spark, sf)).select(*S.KEYS, "event_id", "value", r6("score").alias("score"))


@query(
    "ts9_cross_correlation",
    f"""with {READINGS}, t as (select *, row_number() over (partition by {KEY} order by ts, event_id) as k from readings), p as (select a.equipment_id, a.value as x, b.value as y from t a join t b on a.equipment_id = b.equipment_id and a.k = b.k where a.sensor_id = 'view' and b.sensor_id = 'click')
    select equipment_id, count(*) as n, round(case when stddev_pop(x) > 1e-10 and stddev_pop(y) > 1e-10 then corr(x, y) else 0 end, 6) + 0.0 as correlation from p group by equipment_id""",
)
def ts9(spark, sf):
    return S.cross_correlation(readings(spark, sf), "view", "click").withColumn("correlation", r6("correlation"))


@query(
    "ts10_series_frame",
    f"""with {READINGS}, b as (select *, epoch_us(ts) // 86400000000 * 86400 as bucket from readings where sensor_id in ('view', 'click', 'error')), w as (select equipment_id, bucket, avg(value) filter (sensor_id = 'view') as view, avg(value) filter (sensor_id = 'click') as click, avg(value) filter (sensor_id = 'error') as error from b group by 1, 2),
    s as (select equipment_id, unnest(generate_series(min(bucket), max(bucket), 86400)) as bucket from b group by equipment_id)
    select s.equipment_id, s.bucket, round(view, 6) + 0.0 as view, round(click, 6) + 0.0 as click, round(error, 6) + 0.0 as error, round(((view is null)::int + (click is null)::int + (error is null)::int) / 3.0, 6) + 0.0 as missing_ratio, view is null and click is null and error is null as interpolated
    from s left join w on s.equipment_id = w.equipment_id and s.bucket = w.bucket""",
)
def ts10(spark, sf):
    frame = S.series_frame(readings(spark, sf), ["view", "click", "error"], 86_400)
    return frame.withColumns({c: r6(c) for c in ("view", "click", "error", "missing_ratio")})


@query(
    "ts11_retention",
    f"""with {READINGS}, m as (select max(epoch_us(ts)) as now from readings), a as (select r.*, (now - epoch_us(ts)) / 86400e6 as age from readings r, m), t as (select *, case when age <= 7 then 0 when age <= 90 then 60 when age <= 365 then 300 end as step from a)
    select {KEY}, step, case when step = 0 then epoch_us(ts) else epoch_us(ts) // (step * 1000000) * step * 1000000 end as at_micros, case when step = 0 then event_id end as event_id, round(avg(value), 6) + 0.0 as value, count(*) as n from t where step is not null group by all""",
)
def ts11(spark, sf):
    df = readings(spark, sf)
    last = df.agg(F.max("ts").alias("now"))
    return S.apply_retention(df.join(F.broadcast(last)), F.col("now")).withColumn("value", r6("value"))


@query("ts12_trend_report")
def ts12(spark, sf):
    """Statistics, trend and change points of every series in one row."""
    df = lines(spark, sf)
    points = S.cusum(df).groupBy(*S.KEYS).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "direction"))).alias("change_points"))
    period = df.groupBy(*S.KEYS).agg(F.min("ts").alias("since"), F.max("ts").alias("until"))
    return S.series_stats(df).join(S.trend(df).drop("n"), list(S.KEYS)).join(period, list(S.KEYS)).join(points, list(S.KEYS), "left")


@query(
    "ts13_summary",
    f"""with {READINGS} select {KEY}, count(*) as n, round(max(value) - min(value), 6) + 0.0 as peak_to_peak, max(epoch_us(ts)) - min(epoch_us(ts)) as span_micros from readings group by {KEY}""",
)
def ts13(spark, sf):
    return readings(spark, sf).groupBy(*S.KEYS).agg(F.count("*").alias("n"), r6(F.max("value") - F.min("value")).alias("peak_to_peak"), (F.max(micros("ts")) - F.min(micros("ts"))).alias("span_micros"))


@query(
    "ts14_zone_balance",
    f"""with {READINGS}, z as (select {KEY}, stddev_pop(value) as std from readings group by {KEY}), m as (select equipment_id, median(std) as middle, max(std) as most from z group by 1)
    select equipment_id, round(case when most > 1e-10 then 1 - middle / most else 0 end, 6) + 0.0 as imbalance, coalesce(string_agg(sensor_id, ',' order by sensor_id) filter (std >= 1.5 * middle), '') as worst_zones from z join m using (equipment_id) group by equipment_id, middle, most""",
)
def ts14_zones(spark, sf):
    return S.zone_balance(readings(spark, sf)).withColumn("imbalance", r6("imbalance"))


@query(
    "ts14_jumps",
    f"""with {READINGS}, t as (select *, avg(value) over w as m, stddev_pop(value) over w as s, count(*) over w as n from readings window w as (partition by {KEY} order by ts, event_id rows between 10 preceding and 1 preceding))
    select {KEY}, event_id, round((value - m) / s, 5) + 0.0 as step from t where n = 10 and s > 1e-10 and (value - m) / s >= 3""",
)
def ts14_jumps(spark, sf):
    return S.jumps(readings(spark, sf)).select(*S.KEYS, "event_id", (F.round("step", 5) + 0.0).alias("step"))


@query(
    "ts14_drifts",
    f"""with {LINES}, t as (select *, row_number() over (partition by {KEY} order by ts, event_id) - 1 as at_ from readings), p as (select {KEY}, at_ // 20 as part, regr_slope(value, at_) as slope, count(*) as m from t group by all), s as (select {KEY}, stddev_pop(value) as std from readings group by {KEY})
    select {KEY}, cast(part as bigint) as part, round(slope, 6) + 0.0 as slope, case when slope > 0 then 'up' else 'down' end as direction from p join s using ({KEY}) where m = 20 and std > 1e-10 and abs(slope * 19) >= 1.5 * std""",
)
def ts14_drifts(spark, sf):
    return S.drifts(lines(spark, sf)).withColumn("slope", r6("slope"))


@query(
    "ts14_starvation",
    f"""with {LINES}, b as (select equipment_id, epoch_us(ts) // 86400000000 * 86400 as bucket, avg(value) filter (sensor_id = 'view') as flow, avg(value) filter (sensor_id = 'click') as torque from readings group by 1, 2 having count(*) filter (sensor_id = 'view') > 0 and count(*) filter (sensor_id = 'click') > 0),
    l as (select *, lag(flow) over w as f, lag(torque) over w as t from b window w as (partition by equipment_id order by bucket)) select equipment_id, bucket, round(flow, 6) + 0.0 as flow, round(torque, 6) + 0.0 as torque from l where flow <= 0.9 * f and torque >= 1.1 * t""",
)
def ts14_starvation(spark, sf):
    return S.starvation(lines(spark, sf), "view", "click", 86_400).withColumns({c: r6(c) for c in ("flow", "torque")})


WINDOW = "r as (select * from readings where equipment_id = 3 and ts >= '2024-01-02' and ts <= '2024-12-25')"


@query(
    "if5_detect_anomalies",
    f"""with {LINES}, {WINDOW}, s as (select {KEY}, avg(value) as mean, stddev_pop(value) as std, count(value) as n from r group by {KEY}), t as (select *, row_number() over (partition by {KEY} order by ts, event_id) as k, count(*) over (partition by {KEY}) as n, sum(value) over w - value as s, sum(value * value) over w - value * value as q from r
    window w as (partition by {KEY} order by ts, event_id rows between 10 preceding and 10 following)), u as (select *, sqrt(greatest(q / 20 - (s / 20) * (s / 20), 0)) as std from t where n >= 40 and k > 10 and k <= n - 10)
    select {KEY}, event_id, 'sigma' as method, round(abs((value - mean) / std), 6) + 0.0 as score from r join s using ({KEY}) where n >= 5 and std > 1e-10 and abs((value - mean) / std) >= 2
    union all select {KEY}, event_id, 'local', round(abs(value - s / 20) / std, 6) + 0.0 from u where std > 1e-10 and abs(value - s / 20) / std > 2.5""",
)
def if5(spark, sf):
    found = S.detect_anomalies(lines(spark, sf), 3, F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-12-25").cast("timestamp_ntz"))
    return found.select(*S.KEYS, "event_id", "method", r6("score").alias("score"))
