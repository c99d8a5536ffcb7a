"""Boards, life cycles, gates, metrics and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolens.functions.numbers import r6, shown_sql
from ferrolens.operators import evaluation, fusion, life
from ferrolens.operators import knowledge as K
from ferrolens.operators import logs as L
from ferrolens.operators import retrieval as R
from ferrolens.operators import series as S
from ferrolens.operators import tables as T
from ferrolens.plans.registry import query
from ferrolens.plans.retrieval import ARM
from ferrolens.plans.tables import EVIDENCE, GRAPH, evidence, graph, matched
from ferrolens.plans.views import LOGS, READINGS, logs, readings, table

FEATURES = [*T.FEATURE_ROLES, "Unknown"]
ROLES = ", ".join(f"('{name}', {role})" for name, role in T.FEATURE_ROLES.items())
FIL7 = f"""
with roles(feature, least_role) as (values {ROLES}), asked as (
    select distinct user_id, list_extract({FEATURES!r}, cast(event_id % 16 as integer) + 1) as feature from events
)
select user_id, feature from asked join roles using (feature) where user_id % 5 >= least_role
"""


@query("fil7_all_features", FIL7)
def fil7(spark, sf):
    events = table(spark, sf, "events")
    feature = F.array(*map(F.lit, FEATURES))[(F.col("event_id") % 16).cast("int")]
    users = events.select("user_id", (F.col("user_id") % 5).alias("role")).distinct()
    return T.authorized(events.select("user_id", feature.alias("feature")).distinct(), users, T.feature_roles(spark))


TAB4 = """
with e as (
    select user_id as equipment_id, event_id, substr(props || event_type, 1, 12) as data, row_number() over (partition by user_id order by ts desc, event_id desc) as a,
        row_number() over (order by ts desc, event_id desc) as b
    from events
)
select equipment_id, event_id, data, 'equipment' as scope from e where a <= 15 union all select equipment_id, event_id, data, 'global' from e where b <= 15
"""


@query("tab4_audit_scopes", TAB4)
def tab4(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("equipment_id"), "event_id", "ts", F.concat("props", "event_type").alias("data"))
    return T.trim_audit(events, 15, 12).drop("ts")


# a year of changes: times twelve times as far apart; ten objects for each user
TAB6 = """
with changes as (
    select user_id * 10 + event_id % 10 as id, event_id as event_no, 'u' || event_id % 9 as who, epoch_us(timestamp '2024-01-01') + (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) * 12 as at_,
        case event_id % 7 when 0 then 'Draft' when 1 then 'PendingReview' when 2 then 'PendingReview' when 3 then 'Approved' when 4 then 'Approved' when 5 then 'Rejected' else 'Archived' end as status
    from events
), made as (
    select *, count(*) filter (status = 'Draft') over (partition by id order by at_, event_no) as made, at_ + case when status = 'Draft' then 30 else 90 end * 86400000000 as until_ from changes
), told as (
    select *, coalesce(at_ >= lag(until_) over (partition by id, made order by at_, event_no), false) as dead from made where made > 0
), alive as (
    select *, bool_or(dead) over (partition by id, made order by at_, event_no) as gone from told
), newest as (
    select *, max(made) over (partition by id) as last from alive where not gone
), current_ as (
    select id, arg_max(status, (at_, event_no)) as status, max(at_) as changed, arg_max(who, (at_, event_no)) filter (status = 'Approved') as approved_by, max(at_) filter (status = 'Approved') as approved,
        arg_max(until_, (at_, event_no)) as until_
    from newest where made = last group by id
)
select id, status, make_timestamp(changed) as changed_at, approved_by, make_timestamp(approved) as approved_at, make_timestamp(until_) as expires_at from current_, (select max(at_) as now_ from changes) where until_ > now_
"""


def knowledge(spark, sf):
    base = F.lit("2024-01-01").cast("timestamp")
    us = F.unix_micros(base)
    at = F.timestamp_micros(us + (F.unix_micros(F.col("ts").cast("timestamp")) - us) * 12).cast("timestamp_ntz")
    k = F.col("event_id") % 7
    status = F.when(k == 0, "Draft").when(k <= 2, "PendingReview").when(k <= 4, "Approved").when(k == 5, "Rejected").otherwise("Archived")
    changes = table(spark, sf, "events").select(
        (F.col("user_id") * 10 + F.col("event_id") % 10).alias("id"), F.col("event_id").alias("event_no"), F.concat(F.lit("u"), (F.col("event_id") % 9).cast("string")).alias("by"), at.alias("at"), status.alias("status")
    )
    now = changes.agg(F.max("at").alias("now"))
    return K.knowledge_current(changes.join(F.broadcast(now)), F.col("now"))


@query("tab6_life_cycle", TAB6)
def tab6(spark, sf):
    return knowledge(spark, sf)


@query("tab6_pending_review", f"select * from ({TAB6}) where status = 'PendingReview'")
def tab6_pending(spark, sf):
    return K.pending_review(knowledge(spark, sf))


@query("tab6_approved", f"select * from ({TAB6}) where status = 'Approved'")
def tab6_approved(spark, sf):
    return K.approved_objects(knowledge(spark, sf))


FUS5 = f"""
with {EVIDENCE}, now_values as (
    select equipment_id, sensor_id, arg_max(value, (ts, event_id)) as latest, max(ts) as at_, avg(value) as mean, stddev_pop(value) as std from readings where value is not null group by 1, 2
), gauge as (
    select equipment_id, sensor_id, 100 * remaining / (remaining + span) as percent from life where remaining + span <> 0
), severe as (
    select equipment_id, bool_or(confidence >= 0.7) as critical from ranked where confidence >= 0.4 group by 1
), hits as (
    select equipment_id, count(*) as rule_hits from matched group by 1
)
select n.equipment_id, n.sensor_id, latest, at_ as at, case when std > 1e-10 and abs(latest - mean) / std >= 3 then 'Anomaly' when std > 1e-10 and abs(latest - mean) / std >= 2 then 'Caution' else 'Normal' end as status,
    round(percent, 6) + 0.0 as life_percent, case when percent > 50 then 'ok' when percent > 20 then 'caution' when percent is not null then 'danger' end as life_band,
    case when critical then 'Critical' when critical is not null then 'Caution' else 'Normal' end as health, coalesce(rule_hits, 0) as rule_hits
from now_values n left join gauge using (equipment_id, sensor_id) left join severe using (equipment_id) left join hits using (equipment_id)
"""


@query("fus5_board", FUS5)
def fus5(spark, sf):
    df = readings(spark, sf)
    alerts = fusion.make_alerts(evidence(spark, sf))
    return T.equipment_board(df, life.linear_life(df, 100.0, False), alerts, matched(spark, sf)).withColumn("life_percent", r6("life_percent"))


EDGES = [None, *L.BOUNDS, None]
COUNTS = ", ".join(
    "count(*) filter (" + " and ".join([f"v > {a}"] * (a is not None) + [f"v <= {b}"] * (b is not None)) + ")" for a, b in zip(EDGES, EDGES[1:], strict=False)
)
LOG9 = f"""
with {LOGS}, m as (select template as name, epoch_us(ts) // 86400000000 * 86400 as bucket, value * 20 - 10 as v from logs where value is not null)
select name, bucket, count(*) as n, round(sum(v), 4) + 0.0 as sum, min(v) as low, max(v) as high, array_to_string([{COUNTS}], ',') as counts from m group by 1, 2
"""


def metrics(spark, sf, value):
    return logs(spark, sf).select(F.col("template").alias("name"), "ts", value.alias("value"))


@query("log9_histograms", LOG9)
def log9(spark, sf):
    told = L.metric_histograms(metrics(spark, sf, F.col("value") * 20 - 10), 86_400)
    return told.withColumns({"sum": F.round("sum", 4) + 0.0, "counts": F.array_join(F.col("counts").cast("array<string>"), ",")})


@query(
    "log9_counters",
    f"""with {LOGS}, m as (select template as name, epoch_us(ts) // 86400000000 * 86400 as bucket, cast(sum(case when event_id % 4 = 0 then 1 else event_id % 4 end) as bigint) as added from logs group by 1, 2)
    select name, bucket, added, cast(sum(added) over (partition by name order by bucket) as bigint) as total from m""",
)
def log9_counters(spark, sf):
    return L.metric_counters(metrics(spark, sf, F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 4)), 86_400)


@query("exp2_mean_results", f"select {ARM} as arm, count(*) as n, round(avg(event_id % 7), 6) + 0.0 as results from events group by 1")
def exp2(spark, sf):
    rows = table(spark, sf, "events").select(
        evaluation.variant(F.col("user_id").cast("string"), 0.3).alias("arm"), F.col("value").alias("latency"), F.lit(1.0).alias("score"), F.lit(True).alias("positive"), (F.col("event_id") % 7).alias("results")
    )
    return evaluation.arm_report(rows).select("arm", "n", r6("results").alias("results"))


@query("exp5_token_rates", "select event_type as name, round(sum(event_id % 50) * 1000.0 / sum(value), 6) + 0.0 as tokens_per_second from events group by 1")
def exp5(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_type").alias("name"), (F.col("event_id") % 50).alias("tokens"), F.col("value").alias("latency"))
    return evaluation.token_rates(runs).withColumn("tokens_per_second", r6("tokens_per_second"))


RULES = "rules as (select s_suppkey as rule_id, s_acctbal as confidence, s_suppkey % 4 > 0 as is_active, case s_nationkey % 3 when 0 then 'CMP' when 1 then 'cmp' else 'Etch' end as equipment_type from supplier)"


def rules(spark, sf):
    k = F.col("s_nationkey") % 3
    kind = F.when(k == 0, "CMP").when(k == 1, "cmp").otherwise("Etch")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("rule_id"), F.col("s_acctbal").alias("confidence"), (F.col("s_suppkey") % 4 > 0).alias("is_active"), kind.alias("equipment_type"))


@query("exr4_rule_types", f"with {RULES} select equipment_type, count(*) as n, count(*) filter (is_active) as active from rules group by 1")
def exr4(spark, sf):
    return K.rule_types(rules(spark, sf))


@query("exr5_list_rules", f"with {RULES} select rule_id, row_number() over (order by confidence desc, rule_id) as place from rules where lower(equipment_type) = 'cmp' and is_active")
def exr5(spark, sf):
    return K.list_rules(rules(spark, sf), "Cmp", True).select("rule_id", "place")


EXR2 = """
with met as (
    select user_id as equipment_id, event_type as rule_id, count(*) filter (event_id % 3 = 0) as matched, count(*) as total from events group by 1, 2
)
select equipment_id, rule_id, round(matched / total, 6) + 0.0 as ratio, round(0.8 * matched / total, 6) + 0.0 as confidence, matched, total from met
where matched > 0 and rule_id <> 'purchase' and (rule_id <> 'view' or 'm' || equipment_id % 3 = 'm1')
"""


@query("exr2_match_models", EXR2)
def exr2(spark, sf):
    """Rules of a model: that of views is for model M1 alone; that of purchases is off."""
    events = table(spark, sf, "events")
    met = events.select(F.col("user_id").alias("equipment_id"), F.col("event_type").alias("rule_id"), (F.col("event_id") % 3 == 0).alias("met"))
    kind = F.col("rule_id")
    base = met.select("rule_id").distinct().select("rule_id", F.lit(0.8).alias("confidence"), (kind != "purchase").alias("is_active"), F.when(kind == "view", "M1").alias("equipment_model"))
    equipment = met.select("equipment_id", F.concat(F.lit("m"), (F.col("equipment_id") % 3).cast("string")).alias("model")).distinct()
    return T.match_rules(met, base, equipment).withColumns({"ratio": r6("ratio"), "confidence": r6("confidence")})


ANS1 = """
with results as (select user_id as query_id, value / 100 as score from events where event_type <> 'view' and user_id % 4 > 0), asked as (select distinct user_id as query_id from events)
select query_id, round(max(score), 6) + 0.0 as max_score, coalesce(max(score) >= {0}, true) as confident from asked left join results using (query_id) group by 1
"""


def gate(spark, sf, strict):
    events = table(spark, sf, "events")
    results = events.filter("event_type != 'view' and user_id % 4 > 0").select(F.col("user_id").alias("query_id"), (F.col("value") / 100).alias("score"))
    return R.gate_a(events.select(F.col("user_id").alias("query_id")).distinct(), results, strict).withColumn("max_score", r6("max_score"))


@query("ans1_gate", ANS1.format(0.4))
def ans1(spark, sf):
    return gate(spark, sf, False)


@query("ans1_gate_strict", ANS1.format(0.75))
def ans1_strict(spark, sf):
    return gate(spark, sf, True)


ASKED = "asked as (select upper(n_name) as name from nation where n_regionkey = 2)"


@query("gra8_get_entities", f"with {GRAPH}, {ASKED} select entity_id, name, type from entities where lower(name) in (select lower(name) from asked)")
def gra8_get(spark, sf):
    return K.get_entities(graph(spark, sf)[0], table(spark, sf, "nation").filter("n_regionkey = 2").select(F.upper("n_name").alias("name")))


@query("gra8_delete_entities", f"with {GRAPH}, {ASKED} select entity_id, name, type from entities where lower(name) not in (select lower(name) from asked)")
def gra8_delete(spark, sf):
    return K.delete_entities(graph(spark, sf)[0], table(spark, sf, "nation").filter("n_regionkey = 2").select(F.upper("n_name").alias("name")))


TS12 = f"""
with {READINGS}, t as (select *, row_number() over (partition by equipment_id, sensor_id order by ts desc, event_id desc) as k from readings where value is not null)
select equipment_id, sensor_id, round(avg(value) filter (k <= 5), 6) + 0.0 as average_5, round(avg(value) filter (k <= 10), 6) + 0.0 as average_10, round(avg(value) filter (k <= 20), 6) + 0.0 as average_20 from t group by 1, 2
"""


@query("ts12_last_averages", TS12)
def ts12(spark, sf):
    return S.last_averages(readings(spark, sf)).withColumns({f"average_{n}": r6(f"average_{n}") for n in (5, 10, 20)})


TS13 = f"""
with {READINGS}, {LOGS}, l as (
    select user_id as equipment_id, level, count(*) as m from logs group by 1, 2
), levels as (
    select equipment_id, string_agg(level || '=' || m, ', ' order by m desc, level) as levels from l group by 1
), t as (
    select *, row_number() over (partition by equipment_id, sensor_id order by ts, event_id) - 1 as x from readings
), f as (
    select equipment_id, sensor_id, max(value) - min(value) as spread, coalesce(regr_slope(value, x), 0) as slope, avg(value) as mean, stddev_pop(value) as std, count(value) as n from t group by 1, 2
), signals as (
    select equipment_id, string_agg(sensor_id || ': p2p ' || {shown_sql("spread", 3)} || ', ' || case when abs(round(case when mean = 0 then slope else slope / abs(mean) end, 9)) < 0.001 then 'Stable' when slope > 0 then 'Increasing' else 'Decreasing' end, '; ' order by sensor_id) as signals
    from f group by 1
), odd as (
    select equipment_id, sensor_id, event_id, value, (value - mean) / std as z from readings join f using (equipment_id, sensor_id) where n >= 5 and std > 1e-10 and abs((value - mean) / std) >= 3
), placed as (
    select *, row_number() over (partition by equipment_id order by round(abs(z), 9) desc, event_id) as place from odd
), highlights as (
    select equipment_id, string_agg(sensor_id || ' ' || {shown_sql("value", 3)} || ' (z ' || {shown_sql("z", 2)} || ')', '; ' order by place) as highlights from placed where place <= 3 group by 1
)
select equipment_id, coalesce(levels, '') as levels, coalesce(signals, '') as signals, coalesce(highlights, '') as highlights
from (select distinct user_id as equipment_id from events) left join levels using (equipment_id) left join signals using (equipment_id) left join highlights using (equipment_id)
"""


@query("ts13_window_summary", TS13)
def ts13(spark, sf):
    lines = logs(spark, sf).select(F.col("user_id").alias("equipment_id"), "level")
    return S.summarize_window(readings(spark, sf), lines)


RUL5 = """
select event_id as document_id, case event_id % 2 when 0 then 'Polishing Pad' else 'the belt' end as said, cast(event_id % 1000 as double) as amount, case event_id % 3 when 0 then 'hour' when 1 then 'day' else 'wafer' end as unit,
    case event_id % 3 when 0 then event_id % 1000 * 1.0::double when 1 then event_id % 1000 * 24.0::double end as hours
from events
"""


@query("rul5_component_lives", f"select document_id, case said when 'the belt' then 'belt' else said end as component, amount, unit, hours from ({RUL5})")
def rul5(spark, sf):
    unit = F.when(F.col("event_id") % 3 == 0, "hours").when(F.col("event_id") % 3 == 1, "days").otherwise("wafers")
    named = F.when(F.col("event_id") % 2 == 0, "clean the Polishing Pad").otherwise("check the belt")
    text = F.concat(named, F.lit(": expected life: "), (F.col("event_id") % 1000).cast("string"), F.lit(" "), unit, F.lit(" of use."))
    return K.component_lives(table(spark, sf, "events").select(F.col("event_id").alias("document_id"), text.alias("text")))
