"""Log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolens.functions.numbers import r6
from ferrolens.operators import logs as L
from ferrolens.plans.registry import query
from ferrolens.plans.views import LOGS, logs

SHORT = "case lower(level) when 'error' then 'ERR' when 'warning' then 'WRN' when 'debug' then 'DBG' else 'INF' end"


@query("fil3_log_search", f"""with {LOGS}, f as (select *, template || ' ' || props as message from logs), g as (select * from f where ts >= '2024-01-05' and {SHORT} in ('ERR', 'WRN') and contains(lower(message), '5'))
    select event_id, place, total from (select event_id, row_number() over (order by ts desc, event_id) as place, count(*) over () as total from g) where place > 20 and place <= 40""")
def fil3(spark, sf):
    df = logs(spark, sf).withColumn("message", F.concat_ws(" ", "template", "props"))
    return L.search(df, start="2024-01-05", levels=["ERR", "WRN"], keyword="5", page=2, size=20).select("event_id", "place", "total")


@query("fil9_display_level", f"with {LOGS} select level, {SHORT} as display_level, count(*) as n from logs group by 1, 2")
def fil9(spark, sf):
    return logs(spark, sf).groupBy("level", L.display_level("level").alias("display_level")).agg(F.count("*").alias("n"))


@query("fil10_rendered_message", f"with {LOGS} select event_id, 'user ' || cast(user_id as varchar) || ' did ' || template || ' with {{Other}}' as message from logs")
def fil10(spark, sf):
    extra = F.create_map(F.lit("User"), F.col("user_id").cast("string"), F.lit("Kind"), F.col("template"))
    return logs(spark, sf).select("event_id", L.rendered(F.lit("user {User} did {Kind} with {Other}"), extra).alias("message"))


@query("fil11_log_question", "select conv_id, turn, " + " or ".join(f"contains(lower(text), '{w}')" for w in L.LOG_WORDS) + " as is_log_question from conversations")
def fil11(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", L.is_log_question("text").alias("is_log_question"))


@query("log1_error_rates", f"with {LOGS} select epoch_us(ts) // 3600000000 * 3600 as bucket, service, count(*) filter (level = 'Error') as errors, count(*) filter (level = 'Warning') as warnings, count(*) as n from logs group by 1, 2")
def log1(spark, sf):
    return L.error_rates(logs(spark, sf), 3600)


@query("log2_top_errors", f"with {LOGS} select service, template, count(*) as n, min(ts) as first, max(ts) as last from logs where level = 'Error' group by 1, 2 order by n desc, service, template limit 20")
def log2(spark, sf):
    return L.top_errors(logs(spark, sf))


@query("log3_request_flow", f"""with {LOGS} select correlation_id, event_id, row_number() over w as place, round(coalesce(epoch_us(ts) - lag(epoch_us(ts)) over w, 0) / 1000, 6) + 0.0 as gap_ms,
    round((max(epoch_us(ts)) over (partition by correlation_id) - min(epoch_us(ts)) over (partition by correlation_id)) / 1000, 6) + 0.0 as total_ms from logs window w as (partition by correlation_id order by ts, event_id)""")
def log3(spark, sf):
    return L.request_flow(logs(spark, sf)).select("correlation_id", "event_id", "place", r6("gap_ms").alias("gap_ms"), r6("total_ms").alias("total_ms"))


@query("log4_service_health", f"with {LOGS} select lower(service) as service, count(*) as total, count(*) filter ({SHORT} = 'ERR') as err, count(*) filter ({SHORT} = 'WRN') as wrn, count(*) filter ({SHORT} = 'INF') as inf, count(*) filter ({SHORT} = 'DBG') as dbg from logs group by 1")
def log4(spark, sf):
    return L.service_health(logs(spark, sf))


@query("log5_correlated", f"with {LOGS} select correlation_id, event_id, place from (select *, row_number() over (partition by correlation_id order by ts desc, event_id desc) as place from logs) where place <= 3")
def log5(spark, sf):
    return L.latest(logs(spark, sf), ["correlation_id"], 3).select("correlation_id", "event_id", "place")


@query("log6_tail", f"with {LOGS} select service, event_id, place from (select *, row_number() over (partition by service order by ts desc, event_id desc) as place from logs where level = 'Error') where place <= 10")
def log6(spark, sf):
    return L.latest(logs(spark, sf).filter("level = 'Error'"), ["service"], 10).select("service", "event_id", "place")


@query("log7_search_stats", f"with {LOGS} select count(*) filter (level = 'Error') as errors, count(*) filter (level = 'Warning') as warnings, count(distinct correlation_id) as correlations, count(distinct service) as services from logs")
def log7(spark, sf):
    return L.search_stats(logs(spark, sf))


@query("log8_line_class", f"with {LOGS} select case when regexp_matches(lower(template), 'fail|error|exception') then 'error' when contains(lower(template), 'warn') then 'warning' else 'info' end as line_class, count(*) as n from logs group by 1")
def log8(spark, sf):
    return logs(spark, sf).groupBy(L.line_class("template").alias("line_class")).agg(F.count("*").alias("n"))


@query("log9_metric_rollup", f"with {LOGS} select template as name, epoch_us(ts) // 86400000000 * 86400 as bucket, count(*) as n, round(sum(value), 6) + 0.0 as sum, round(avg(value), 6) + 0.0 as mean, min(value) as low, max(value) as high from logs group by 1, 2")
def log9(spark, sf):
    return L.metric_rollup(logs(spark, sf).withColumnRenamed("template", "name"), 86_400).withColumns({"sum": r6("sum"), "mean": r6("mean")})


@query(
    "fil12_log_context",
    f"""with {LOGS}, m as (select max(ts) as now from logs), r as (select logs.* from logs, m where ts <= now and ts >= now - interval 600 hours),
    e as (select service, template, count(*) as n from r where level in ('Error', 'Fatal', 'Critical') group by 1, 2 order by n desc, service, template limit 10), h as (select lower(service) as service, count(*) as n, count(*) filter (level = 'Error') as err, count(*) filter (level = 'Warning') as wrn from r group by 1)
    select '## 최근 Top 에러:' || chr(10) || (select string_agg('- [' || n || '회] ' || service || ': ' || template, chr(10) order by n desc, service) from e) || chr(10) || chr(10) || '## 서비스 헬스:' || chr(10) || (select string_agg('- ' || service || ': Total=' || n || ', ERR=' || err || ', WRN=' || wrn, chr(10) order by service) from h) as context""",
)
def fil12(spark, sf):
    df = logs(spark, sf)
    now = df.agg(F.max("ts").alias("now"))
    return L.log_context(df.join(F.broadcast(now)), F.col("now"), 600)
