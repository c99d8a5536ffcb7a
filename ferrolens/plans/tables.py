"""Table queries: equipment, conversations, graph, rules, fusion, alerts; and the flagship, a diagnosis of all equipment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolens.functions.numbers import r6, seconds_between, shown_sql
from ferrolens.operators import fusion, life, series
from ferrolens.operators import tables as T
from ferrolens.plans.registry import query
from ferrolens.plans.views import ALARMS, READINGS, alarms, readings, table


@query("src5_equipment_alarms", f"with {ALARMS} select equipment_id, event_id, place from (select *, row_number() over (partition by equipment_id order by ts desc, event_id desc) as place from alarms) where place <= 100")
def src5(spark, sf):
    return T.latest_per_key(alarms(spark, sf), ["equipment_id"], 100, [F.desc("ts"), F.desc("event_id")]).select("equipment_id", "event_id", "place")


@query("snk2_delete_documents", "select doc_id from documents where doc_id not in (select doc_id from labels where toxic = 1 and doc_id is not null) and source <> 'src3'")
def snk2(spark, sf):
    doomed = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return table(spark, sf, "documents").join(doomed, "doc_id", "left_anti").filter("source != 'src3'").select("doc_id")


@query("snk4_stable_id", "select doc_id, case when doc_id % 3 = 0 then '00000000-0000-4000-8000-' || lpad(cast(doc_id as varchar), 12, '0') else md5(source || ':' || cast(doc_id as varchar)) end as stable_id from documents")
def snk4(spark, sf):
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return table(spark, sf, "documents").select("doc_id", T.stable_id(F.when(F.col("doc_id") % 3 == 0, uuid).otherwise(F.concat_ws(":", "source", F.col("doc_id").cast("string")))).alias("stable_id"))


@query("fil1_score_floor", "select vec_id, embedding[1]::double as score from embeddings where embedding[1]::double >= 0.1")
def fil1(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("score")).filter("score >= 0.1")


@query("fil2_payload_filter", "select doc_id from documents where lang = 'en' and source = 'src1' and contains(lower(text), 'the')")
def fil2(spark, sf):
    return T.payload_filter(table(spark, sf, "documents"), {"lang": "en", "source": "src1"}, ("The",)).select("doc_id")


@query("fil4_equipment_log_search", "select event_id from events where user_id = 8 and event_type in ('error', 'view') and regexp_matches(lower(props), '1|2') order by ts desc, event_id limit 5000")
def fil4(spark, sf):
    found = table(spark, sf, "events").filter(F.col("user_id") == 8).filter(F.col("event_type").isin("error", "view") & F.lower("props").rlike("1|2"))
    return found.orderBy(F.desc("ts"), "event_id").limit(5000).select("event_id")


@query("fil5_list_equipment", "select s_suppkey as equipment_id, n_name as fab from supplier join nation on s_nationkey = n_nationkey where n_regionkey < 3 and s_acctbal > 0")
def fil5(spark, sf):
    return table(spark, sf, "supplier").filter("s_acctbal > 0").join(table(spark, sf, "nation").filter("n_regionkey < 3"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("equipment_id"), F.col("n_name").alias("fab"))


@query("fil6_query_policy", "select event_id, round(b * case when b + a > 120 then 120.0 / (b + a) else 1.0 end, 6) + 0.0 as minutes_before, round(a * case when b + a > 120 then 120.0 / (b + a) else 1.0 end, 6) + 0.0 as minutes_after, least(r, 5000) as rows from (select event_id, value as b, value * 2 as a, event_id * 3 as r from events where user_id is not null)")
def fil6(spark, sf):
    asked = table(spark, sf, "events").select("event_id", F.col("user_id").alias("equipment_id"), F.col("value").alias("minutes_before"), (F.col("value") * 2).alias("minutes_after"), (F.col("event_id") * 3).alias("rows"))
    return T.clamp_requests(asked).select("event_id", r6("minutes_before").alias("minutes_before"), r6("minutes_after").alias("minutes_after"), "rows")


FEATURES = [("view", 0), ("click", 1), ("error", 2), ("purchase", 3)]


@query("fil7_role_gate", "with f(feature, least_role) as (values ('view', 0), ('click', 1), ('error', 2), ('purchase', 3)) select distinct user_id, feature from events join f on f.feature = event_type where user_id % 5 >= least_role")
def fil7(spark, sf):
    events = table(spark, sf, "events")
    requests = events.select("user_id", F.col("event_type").alias("feature")).distinct()
    users = events.select("user_id").distinct().withColumn("role", F.col("user_id") % 5)
    return T.authorized(requests, users, spark.createDataFrame(FEATURES, "feature string, least_role int"))


FIL8 = """
with users as (
    select n_nationkey as user_id, n_nationkey % 5 as role, timestamp '2024-01-10' + to_days(cast(n_nationkey as integer)) as expires,
        case when n_nationkey % 3 = 0 then [] when n_nationkey % 7 = 0 then null else ['eq' || n_nationkey, 'Eq' || 2 * n_nationkey, 'EQ' || n_nationkey] end as access
    from nation
), valid as (
    select * from users where timestamp '2024-01-15' < expires
)
select v.user_id, e.event_id from valid v join events e
    on v.role >= 4 or v.access is null or len(v.access) = 0 or list_contains(list_transform(v.access, lambda x: lower(x)), 'eq' || e.user_id)
"""


@query("fil8_row_scope", FIL8)
def fil8(spark, sf):
    """Users of all roles: admins, empty and missing access lists, lists in other case, and sessions that are over."""
    k = F.col("n_nationkey")
    listed = F.array(F.concat(F.lit("eq"), k.cast("string")), F.concat(F.lit("Eq"), (2 * k).cast("string")), F.concat(F.lit("EQ"), k.cast("string")))
    access = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 7 != 0, listed)
    expires = F.lit("2024-01-10").cast("timestamp_ntz") + F.make_dt_interval(days=k.cast("int"))
    users = table(spark, sf, "nation").select(k.alias("user_id"), (k % 5).alias("role"), access.alias("access"), expires.alias("session_expires_at"))
    rows = table(spark, sf, "events").select(F.concat(F.lit("EQ"), F.col("user_id").cast("string")).alias("equipment_id"), "event_id")
    return T.scope_rows(rows, users, F.lit("2024-01-15").cast("timestamp_ntz")).select("user_id", "event_id")


# -- conversations, audit, knowledge ---------------------------------------------------------------


@query("tab1_conversations", "select conv_id, count(*) as n, max(turn) as last_turn, md5(string_agg(role || ':' || text, '|' order by turn, text)) as digest from conversations group by 1")
def tab1(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", "text", "role")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"), F.md5(F.array_join(F.transform(turns, lambda t: F.concat_ws(":", t["role"], t["text"])), "|")).alias("digest"))


@query("tab2_conversation_list", "with c as (select conv_id, conv_id % 10 as equipment_id, max(turn) as last, count(*) as n, substr(arg_min(text, turn) filter (role = 'user'), 1, 30) as title from conversations group by 1) select * from (select *, row_number() over (partition by equipment_id order by last desc, conv_id) as place from c) where place <= 20")
def tab2(spark, sf):
    listed = table(spark, sf, "conversations").groupBy("conv_id", (F.col("conv_id") % 10).alias("equipment_id")).agg(F.max("turn").alias("last"), F.count("*").alias("n"), F.substring(F.expr("min_by(text, turn) filter (where role = 'user')"), 1, 30).alias("title"))
    return T.latest_per_key(listed, ["equipment_id"], 20, [F.desc("last"), F.asc("conv_id")])


@query("tab3_prompt_history", "select conv_id, string_agg(role, ',' order by turn) as roles from conversations where role in ('user', 'assistant', 'system') group by 1")
def tab3(spark, sf):
    kept = table(spark, sf, "conversations").filter(F.col("role").isin("user", "assistant", "system"))
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]), ",").alias("roles"))


@query("tab4_trim_audit", "select user_id, event_id, substr(props, 1, 500) as data from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as place from events) where place <= 20")
def tab4(spark, sf):
    return T.latest_per_key(table(spark, sf, "events"), ["user_id"], 20, [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", F.substring("props", 1, 500).alias("data"))


@query("tab5_recent_audit", "select event_type, event_id, place from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as place from events) where place <= 5")
def tab5(spark, sf):
    return T.latest_per_key(table(spark, sf, "events"), ["event_type"], 5, [F.desc("ts"), F.desc("event_id")]).select("event_type", "event_id", "place")


@query("tab6_knowledge_current", "select user_id as id, event_type as status, event_id as version from (select *, row_number() over (partition by user_id order by event_id desc) as k from events) where k = 1 and event_type <> 'error'")
def tab6(spark, sf):
    changes = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("event_id").alias("version"))
    return T.last_write(changes, [F.col("id")], "version", F.col("status") == "error")


@query("tab7_embedding_text", "select s_suppkey, concat_ws('. ', 'Equipment: ' || s_name, case when s_acctbal > 0 then 'Symptom: ' || cast(s_nationkey as varchar) end) as embedding_text from supplier")
def tab7(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.concat_ws(". ", F.concat(F.lit("Equipment: "), "s_name"), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("Symptom: "), F.col("s_nationkey").cast("string")))).alias("embedding_text"))


@query("tab9_equipment_current", "select o_custkey as equipment_id, o_orderstatus as status from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as k from orders) where k = 1 and o_orderstatus <> 'P'")
def tab9(spark, sf):
    changes = table(spark, sf, "orders").select(F.col("o_custkey").alias("equipment_id"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    return T.last_write(changes, [F.col("equipment_id")], "o_orderkey", F.col("status") == "P").drop("o_orderkey")


@query("tab10_feedback_stats", "select user_id as equipment_id, count(*) as n, round(avg((event_type = 'purchase')::int), 6) + 0.0 as positive from events where event_type in ('purchase', 'error') group by 1")
def tab10(spark, sf):
    return table(spark, sf, "events").filter(F.col("event_type").isin("purchase", "error")).groupBy(F.col("user_id").alias("equipment_id")).agg(F.count("*").alias("n"), r6(F.avg((F.col("event_type") == "purchase").cast("double"))).alias("positive"))


# -- graph -----------------------------------------------------------------------------------------

GRAPH = """entities as (select 'r' || r_regionkey as entity_id, r_name as name, 'Region' as type from region union all select 'n' || n_nationkey, n_name, 'Nation' from nation union all select 's' || s_suppkey, s_name, 'Supplier' from supplier),
    relations as (select 'n' || n_nationkey as source, 'r' || n_regionkey as target from nation union all select 's' || s_suppkey, 'n' || s_nationkey from supplier)"""


def graph(spark, sf):
    region, nation, supplier = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    entities = [(region, "r", "r_regionkey", "r_name", "Region"), (nation, "n", "n_nationkey", "n_name", "Nation"), (supplier, "s", "s_suppkey", "s_name", "Supplier")]
    parts = [df.select(key(p, k).alias("entity_id"), F.col(n).alias("name"), F.lit(t).alias("type")) for df, p, k, n, t in entities]
    relations = nation.select(key("n", "n_nationkey").alias("source"), key("r", "n_regionkey").alias("target")).unionByName(supplier.select(key("s", "s_suppkey").alias("source"), key("n", "s_nationkey").alias("target")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]), relations


@query("gra1_upsert_entities", f"with {GRAPH}, c as (select *, 1 as version from entities union all select entity_id, lower(name), 'Changed', 2 from entities where type = 'Nation') select entity_id, name, type from (select *, row_number() over (partition by lower(name) order by version desc) as k from c) where k = 1")
def gra1(spark, sf):
    entities, _ = graph(spark, sf)
    delta = entities.filter("type = 'Nation'").select("entity_id", F.lower("name").alias("name"), F.lit("Changed").alias("type"), F.lit(2).alias("version"))
    return T.last_write(entities.withColumn("version", F.lit(1)).unionByName(delta), [F.lower("name")], "version").drop("version")


@query("gra3_keyword_index", f"with {GRAPH} select word, count(*) as n from (select entity_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(name), '[\\s_\\-#]+'), lambda w: length(w) >= 2))) as word from entities) group by 1")
def gra3(spark, sf):
    return T.keyword_index(graph(spark, sf)[0]).groupBy("word").agg(F.count("*").alias("n"))


@query("gra4_neighbours", f"""with recursive {GRAPH}, both_ as (select source, target from relations union select target, source from relations), w as (select 'n' || n_nationkey as seed, 'n' || n_nationkey as entity_id, 0 as distance from nation union select w.seed, b.target, w.distance + 1 from w join both_ b on b.source = w.entity_id where w.distance < 2)
    select seed, entity_id, cast(min(distance) as bigint) as distance from w group by 1, 2""")
def gra4(spark, sf):
    entities, relations = graph(spark, sf)
    return T.neighbours(entities.filter("type = 'Nation'").select(F.col("entity_id").alias("seed")), relations, 2)


@query("gra7_graph_stats", f"with {GRAPH} select lower(type) as type, count(*) as entities, (select count(*) from relations) as relations from entities group by 1")
def gra7(spark, sf):
    entities, relations = graph(spark, sf)
    return entities.groupBy(F.lower("type").alias("type")).agg(F.count("*").alias("entities")).join(F.broadcast(relations.agg(F.count("*").alias("relations"))))


# -- rules, fusion, alerts -------------------------------------------------------------------------

# A small rule base.
TRIGGERS = [(1, "T0", 1, "sensor", "view", "gt", 40.0, None), (1, "T0", 2, "alarm", "A103", None, None, None), (2, "T1", 3, "sensor", "error", "between", 5.0, 60.0), (2, "T1", 4, "sensor", "click", "lt", 10.0, None), (3, "T1", 5, "error", "A107", None, None, None), (3, "T1", 6, "other", "x", None, None, None)]
RULES = [(1, 0.9, True, "High view", "View runs high", ["Inspect view", "Clean view"]), (2, 0.7, True, "Restless", "Errors and slow clicks", ["Restart"]), (3, 0.8, False, "Old", "Retired rule", [])]
RULE_COLUMNS = "rule_id int, confidence double, is_active boolean, name string, hypothesis string, actions array<string>"
RULE_SQL = f"""{READINGS}, {ALARMS}, triggers(rule_id, equipment_type, trigger_id, kind, source, operator, low, high) as (values (1, 'T0', 1, 'sensor', 'view', 'gt', 40.0, null), (1, 'T0', 2, 'alarm', 'A103', null, null, null), (2, 'T1', 3, 'sensor', 'error', 'between', 5.0, 60.0), (2, 'T1', 4, 'sensor', 'click', 'lt', 10.0, null), (3, 'T1', 5, 'error', 'A107', null, null, null), (3, 'T1', 6, 'other', 'x', null, null, null)),
    rules(rule_id, confidence, is_active, name, hypothesis, actions) as (values (1, 0.9, true, 'High view', 'View runs high', ['Inspect view', 'Clean view']), (2, 0.7, true, 'Restless', 'Errors and slow clicks', ['Restart']), (3, 0.8, false, 'Old', 'Retired rule', [])),
    now_ as (select equipment_id, sensor_id as source, arg_max(value, (ts, event_id)) as value from readings group by 1, 2), active as (select distinct equipment_id, code as source from alarms where cleared_at is null),
    met as (select e.equipment_id, t.rule_id, t.trigger_id, case kind when 'sensor' then coalesce(case operator when 'gt' then value > low when 'lt' then value < low when 'between' then value between low and high end, false) when 'other' then false else a.source is not null end as met
        from (select distinct equipment_id from now_) e join triggers t on t.equipment_type = 'T' || e.equipment_id % 2 left join now_ n on n.equipment_id = e.equipment_id and n.source = t.source left join active a on a.equipment_id = e.equipment_id and a.source = t.source),
    matched as (select equipment_id, rule_id, avg(met::int) as ratio, any_value(confidence) * avg(met::int) as confidence, count(*) filter (met) as matched, count(*) as total, any_value(name) as name, any_value(hypothesis) as hypothesis, any_value(actions) as actions from met join rules using (rule_id) where is_active group by 1, 2 having avg(met::int) > 0)"""


def met(spark, sf):
    now = readings(spark, sf).groupBy("equipment_id", F.col("sensor_id").alias("source")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    active = alarms(spark, sf).filter("cleared_at is null").select("equipment_id", F.col("code").alias("source"))
    triggers = spark.createDataFrame(TRIGGERS, "rule_id int, equipment_type string, trigger_id int, kind string, source string, operator string, low double, high double")
    equipment = now.select("equipment_id").distinct().withColumn("equipment_type", F.concat(F.lit("T"), (F.col("equipment_id") % 2).cast("string")))
    return T.eval_triggers(equipment, triggers, now, active)


def matched(spark, sf):
    return T.match_rules(met(spark, sf), spark.createDataFrame(RULES, RULE_COLUMNS))


@query("exr1_eval_triggers", f"with {RULE_SQL} select equipment_id, rule_id, trigger_id, met from met")
def exr1(spark, sf):
    return met(spark, sf)


@query("exr2_match_rules", f"with {RULE_SQL} select equipment_id, rule_id, round(ratio, 6) + 0.0 as ratio, round(confidence, 6) + 0.0 as confidence from matched")
def exr2(spark, sf):
    return matched(spark, sf).select("equipment_id", "rule_id", r6("ratio").alias("ratio"), r6("confidence").alias("confidence"))


EVIDENCE = f"""
{RULE_SQL}, stats as (
    select equipment_id, sensor_id, avg(value) as mean, stddev_pop(value) as std, count(value) as n from readings group by 1, 2
), codes as (
    select event_id, code from alarms
), anomalies as (
    select r.equipment_id, r.sensor_id, case when value > mean then 'SpikeUp' else 'SpikeDown' end as type, least(abs((value - mean) / std) / 4, 1) as confidence,
        r.sensor_id || ' reading, see ' || lower(code) || '.' as description
    from readings r join stats using (equipment_id, sensor_id) join codes using (event_id)
    where n >= 5 and std > 1e-10 and abs((value - mean) / std) >= 2
), h as (
    select *, (epoch_us(ts) - min(epoch_us(ts)) over (partition by equipment_id, sensor_id)) / 3600e6 as hours from readings
), f as (
    select equipment_id, sensor_id, count(*) as n, regr_slope(value, hours) as slope, regr_intercept(value, hours) as intercept, regr_r2(value, hours) as r2, max(hours) as span,
        arg_max(value, (ts, event_id)) as last
    from h group by 1, 2
), life as (
    select equipment_id, sensor_id, last, span, greatest((100 - intercept) / slope - span, 0) as remaining, least(greatest(r2, 0), 1) as confidence from f where n >= 3 and slope >= 1e-12
), entries as (
    select n_nationkey as entry_id, case when n_nationkey < 12 then 'a' || (100 + n_nationkey) else '' end as error_code, case n_nationkey % 4 when 0 then null else 'T' || n_nationkey % 2 end as equipment_type,
        case n_nationkey % 3 when 0 then 'Overview is odd' when 1 then 'no ERROR, purchase' else 'none' end as symptom,
        case when n_nationkey % 5 = 0 then '' else 'Worn ' || lower(n_name) end as cause, case when n_nationkey % 6 = 0 then '' else 'Check ' || n_name end as action,
        'manual-' || n_regionkey as source_document, 0.5 + n_regionkey / 10 as confidence
    from nation
), causal as (
    select a.equipment_id, e.* from active a join entries e on lower(a.source) = e.error_code where e.equipment_type is null or e.equipment_type = 'T' || a.equipment_id % 2
), pairs as (
    select a.equipment_id, a.sensor_id, a.type, c.entry_id, any_value(c.cause) as cause, any_value(c.action) as action, any_value(c.source_document) as source_document,
        any_value(c.confidence) as confidence, count(*) as n
    from anomalies a join causal c on a.equipment_id = c.equipment_id and (contains(lower(c.symptom), lower(a.sensor_id)) or contains(lower(a.description), c.error_code)) group by 1, 2, 3, 4
), evidence as (
    select equipment_id, 'anomaly:' || sensor_id || ':' || type as key, any_value(sensor_id || ' ' || type || ' detected') as hypothesis, 0.0 as place, 1 as tier, 'anomaly' as kind,
        any_value(sensor_id) as source, min(description) as description, max(confidence) as confidence, count(*) as n, []::varchar[] as actions
    from anomalies group by 1, 2
    union all
    select equipment_id, 'rul:' || case when remaining <= 0 then 'critical' when remaining <= 24 then 'urgent' when remaining <= 168 then 'warning' else 'info' end,
        'Component approaching end of life (' || cast(round(remaining) as bigint) || 'h remaining)', remaining, 1, 'rul', 'RUL Predictor',
        case when remaining <= 0 then 'Component has reached end of life (current: ' || {shown_sql("last", 1)} || ', threshold: 100.0)'
            else 'Estimated ' || cast(round(remaining) as bigint) || ' hours remaining (confidence: ' || cast(round(round(confidence * 100, 9)) as bigint) || '%)' end,
        confidence * case when remaining <= 24 then 1 else 0.6 end, 1, ['Schedule replacement within ' || cast(round(remaining) as bigint) || ' hours']
    from life
    union all
    select equipment_id, 'expert:' || rule_id, hypothesis, 0.0, 2, 'expert_rule', 'Rule ' || rule_id || ': ' || name, 'Matched ' || matched || '/' || total || ' triggers', confidence, 1, actions from matched
    union all
    select equipment_id, 'doc:' || case when error_code <> '' then error_code else cast(entry_id as varchar) end, case when cause <> '' then cause else symptom end, entry_id, 3, 'document', source_document,
        'Document evidence: ' || symptom || ' → ' || cause, confidence, 1, case when action <> '' then [action] else [] end
    from causal
    union all
    select equipment_id, 'anomaly:' || sensor_id || ':' || type, sensor_id || ' ' || type || ' detected', entry_id, 3, 'document', source_document,
        'Correlated: ' || cause, 0.8 * confidence, n, case when action <> '' then [action] else [] end
    from pairs
), w as (
    select equipment_id, key, arg_min(hypothesis, (tier, place, hypothesis)) as hypothesis, max(confidence) filter (tier = 1 and confidence > 0) as t1, max(confidence) filter (tier = 2 and confidence > 0) as t2,
        max(confidence) filter (tier = 3 and confidence > 0) as t3, cast(coalesce(sum(n) filter (tier = 1), 0) as bigint) as n1, cast(coalesce(sum(n) filter (tier = 2), 0) as bigint) as n2,
        cast(coalesce(sum(n) filter (tier = 3), 0) as bigint) as n3, flatten(list(actions order by tier, place, source)) as told
    from evidence group by 1, 2
), fused as (
    select equipment_id, key, hypothesis, n1, n2, n3, list_transform(list_filter(list_zip(told, range(1, len(told) + 1)), lambda x: list_position(told, x[1]) = x[2]), lambda x: x[1]) as actions,
        case when t1 is null and t2 is null and t3 is null then 0 else least((coalesce(t1 * 0.35, 0) + coalesce(t2 * 0.4, 0) + coalesce(t3 * 0.25, 0))
            / ((t1 is not null)::int * 0.35 + (t2 is not null)::int * 0.4 + (t3 is not null)::int * 0.25::double)
            * case (t1 is not null)::int + (t2 is not null)::int + (t3 is not null)::int when 3 then 1.1 * 1.1 when 2 then 1.1 else 1.0 end, 1) end as confidence
    from w
), ranked as (
    select *, row_number() over (partition by equipment_id order by round(confidence, 9) desc, key) as rank, count(*) over (partition by equipment_id) as n_hypotheses,
        cast(round(round(confidence * 100, 9)) as bigint) || '%' as percent
    from fused where confidence >= 0.2
)
"""


def causal_entries(spark, sf):
    k, text = F.col("n_nationkey"), lambda c: F.lit(c)
    blank = lambda test, c: F.when(test, text("")).otherwise(c)
    symptom = F.when(k % 3 == 0, "Overview is odd").when(k % 3 == 1, "no ERROR, purchase").otherwise("none")
    return table(spark, sf, "nation").select(
        k.alias("entry_id"), F.when(k < 12, F.concat(text("a"), (100 + k).cast("string"))).otherwise("").alias("error_code"), F.when(k % 4 != 0, F.concat(text("T"), (k % 2).cast("string"))).alias("equipment_type"),
        symptom.alias("symptom"), blank(k % 5 == 0, F.concat(text("Worn "), F.lower("n_name"))).alias("cause"), blank(k % 6 == 0, F.concat(text("Check "), "n_name")).alias("action"),
        F.concat(text("manual-"), F.col("n_regionkey").cast("string")).alias("source_document"), (0.5 + F.col("n_regionkey") / 10).alias("confidence"),
    )


def evidence(spark, sf):
    """Evidence of all equipment: anomalies, remaining life, matched rules, and causal entries of active codes."""
    df, events = readings(spark, sf), alarms(spark, sf)
    odd = series.sigma_anomalies(df).join(events.select("event_id", "code"), "event_id")
    anomalies = odd.select(
        "equipment_id", "sensor_id", F.when(F.col("z") > 0, "SpikeUp").otherwise("SpikeDown").alias("type"), F.least(F.abs("z") / 4, F.lit(1.0)).alias("confidence"),
        F.concat("sensor_id", F.lit(" reading, see "), F.lower("code"), F.lit(".")).alias("description"),
    )
    lives = life.linear_life(df, 100.0, False).filter("remaining is not null").withColumn("summary", life.life_summary(100.0))
    equipment = df.select("equipment_id", F.concat(F.lit("T"), (F.col("equipment_id") % 2).cast("string")).alias("equipment_type")).distinct()
    active = events.filter("cleared_at is null").select("equipment_id", F.col("code").alias("source"))
    causal = fusion.relevant_causal(causal_entries(spark, sf), equipment, active)
    return fusion.evidence(anomalies, lives, matched(spark, sf), causal)


@query("fus1_evidence", f"with {EVIDENCE} select equipment_id, key, hypothesis, tier, kind, source, description, round(confidence, 6) + 0.0 as confidence, n, array_to_string(actions, ';') as actions from evidence")
def fus1(spark, sf):
    return evidence(spark, sf).drop("place").withColumns({"confidence": r6("confidence"), "actions": F.array_join("actions", ";")})


@query("fus2_linked_evidence", f"with {EVIDENCE} select equipment_id, sensor_id, type, entry_id, n from pairs")
def fus2_linked(spark, sf):
    rows = evidence(spark, sf).filter("tier = 3 and key like 'anomaly:%'")
    part = F.split("key", ":")
    return rows.select("equipment_id", part[1].alias("sensor_id"), part[2].alias("type"), F.col("place").cast("int").alias("entry_id"), "n")


@query("fus3_fuse", f"with {EVIDENCE} select equipment_id, key, hypothesis, n1, n2, n3, round(confidence, 6) + 0.0 as fused, array_to_string(actions, ';') as actions from fused")
def fus3(spark, sf):
    told = fusion.fuse(evidence(spark, sf))
    return told.select("equipment_id", "key", "hypothesis", "n1", "n2", "n3", r6("confidence").alias("fused"), F.array_join("actions", ";").alias("actions"))


FUS4 = f"""
with {EVIDENCE}, r as (
    select equipment_id, max(confidence) as top, count(*) as n, string_agg(hypothesis || ' (' || percent || ')', ' | ' order by rank) filter (rank <= 3) as summary from ranked group by 1
), c as (
    select equipment_id, cast(coalesce(sum(n) filter (kind = 'anomaly'), 0) as bigint) as anomalies, cast(coalesce(sum(n) filter (kind = 'expert_rule'), 0) as bigint) as rules from evidence group by 1
)
select e.equipment_id, case when r.n is null then 'Normal' when top >= 0.7 then 'Critical' when top >= 0.5 then 'Warning' else 'Caution' end as health, round(coalesce(top, 0), 6) + 0.0 as top,
    coalesce(r.n, 0) as n, coalesce(summary, 'No anomalies or issues detected. Equipment operating normally.') as summary, coalesce(anomalies, 0) as anomalies, coalesce(rules, 0) as rules
from (select distinct equipment_id from readings) e left join r using (equipment_id) left join c using (equipment_id)
"""


@query("fus4_diagnose", FUS4)
def fus4(spark, sf):
    """The flagship: anomalies, remaining life, expert rules and causal knowledge of all equipment, fused to one report each."""
    return fusion.diagnose(readings(spark, sf).select("equipment_id"), evidence(spark, sf)).withColumn("top", r6("top"))


ALR1 = f"""
with {EVIDENCE}, a as (
    select *, case when confidence >= 0.7 then 'Critical' when confidence >= 0.4 then 'Warning' end as severity from ranked
)
select equipment_id, key, severity, '[' || upper(severity) || '] ' || hypothesis as title, array_to_string(actions, ';') as actions, concat_ws(chr(10),
    'Equipment: ' || equipment_id, 'Confidence: ' || percent, 'Rank: #' || rank || ' of ' || n_hypotheses || ' hypotheses',
    case when n1 > 0 then 'Statistical evidence: ' || n1 || ' indicators' end, case when n2 > 0 then 'Expert rules matched: ' || n2 end, case when n3 > 0 then 'Document references: ' || n3 end,
    case when len(actions) > 0 then 'Recommended actions:' end, case when len(actions) > 0 then array_to_string(list_transform(actions[1:3], lambda x: '  - ' || x), chr(10)) end) as message
from a where severity is not null
"""


@query("alr1_make_alerts", ALR1)
def alr1(spark, sf):
    return fusion.make_alerts(evidence(spark, sf)).withColumn("actions", F.array_join("actions", ";"))


@query("alr2_suppress", f"""with recursive {ALARMS}, o as (select code, ts, event_id, row_number() over (partition by code order by ts, event_id) as k from alarms), w as (select code, ts, event_id, k, ts as last, true as issued from o where k = 1
    union all select o.code, o.ts, o.event_id, o.k, case when epoch_us(o.ts) - epoch_us(w.last) >= 21600000000 then o.ts else w.last end, epoch_us(o.ts) - epoch_us(w.last) >= 21600000000 from w join o on o.code = w.code and o.k = w.k + 1) select code as hypothesis, event_id as alert_id from w where issued""")
def alr2(spark, sf):
    raised = alarms(spark, sf).select(F.lit(0).cast("long").alias("equipment_id"), F.col("code").alias("hypothesis"), "ts", F.col("event_id").alias("alert_id"))
    return T.suppress(raised, 360).select("hypothesis", "alert_id")


@query("alr3_alert_counts", f"with {ALARMS} select code, count(*) filter (cleared_at is null) as active, count(*) as n from alarms group by 1")
def alr3(spark, sf):
    return alarms(spark, sf).groupBy("code").agg(F.count_if(F.col("cleared_at").isNull()).alias("active"), F.count("*").alias("n"))


@query("fus5_equipment_board", f"with {READINGS} select equipment_id, sensor_id, arg_max(value, (ts, event_id)) as latest, case when arg_max(value, (ts, event_id)) > 50 then 'ok' when arg_max(value, (ts, event_id)) > 20 then 'caution' else 'danger' end as band, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) + 0.0 as seconds from readings group by 1, 2")
def fus5(spark, sf):
    now = F.max_by("value", F.struct("ts", "event_id"))
    board = readings(spark, sf).groupBy("equipment_id", "sensor_id").agg(now.alias("latest"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    band = F.when(F.col("latest") > 50, "ok").when(F.col("latest") > 20, "caution").otherwise("danger")
    return board.select("equipment_id", "sensor_id", "latest", band.alias("band"), (F.round(seconds_between("a", "b"), 3) + 0.0).alias("seconds"))


RAISED = "raised as (select event_id as alert_id, case when event_type = 'error' then 'Critical' when event_type = 'purchase' then 'Warning' else 'Caution' end as severity, ts from events), done as (select event_id as alert_id from events where event_id % 4 = 0)"


def raised(spark, sf):
    events = table(spark, sf, "events")
    severity = F.when(F.col("event_type") == "error", "Critical").when(F.col("event_type") == "purchase", "Warning").otherwise("Caution")
    return events.select(F.col("event_id").alias("alert_id"), severity.alias("severity"), "ts"), events.filter("event_id % 4 = 0").select(F.col("event_id").alias("alert_id"))


@query("alr3_active_alerts", f"with {RAISED} select * from raised where alert_id not in (select alert_id from done)")
def alr3_active(spark, sf):
    return T.active_alerts(*raised(spark, sf))


@query("alr3_alert_history", f"with {RAISED} select * from raised order by ts desc, alert_id desc limit 100")
def alr3_history(spark, sf):
    return T.alert_history(raised(spark, sf)[0])


@query("alr3_counts_by_severity", f"with {RAISED} select severity, count(*) as n, count(*) filter (done.alert_id is null) as active from raised left join done using (alert_id) group by 1")
def alr3_severity(spark, sf):
    return T.alert_counts(*raised(spark, sf))


@query("alr3_acknowledge", f"with {RAISED} select alert_id, 'first' as \"by\", timestamp '2024-01-01' as at from done union all select event_id, 'second', timestamp '2024-06-01' from events where event_id % 6 = 0 and event_id % 4 <> 0")
def alr3_acknowledge(spark, sf):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    every, done = raised(spark, sf)
    done = done.withColumns({"by": F.lit("first"), "at": at("2024-01-01")})
    return T.acknowledge(done, every.filter("alert_id % 6 = 0").select("alert_id"), "second", at("2024-06-01"))


@query("str7_expire", "select event_id, ts from events where ts > (select max(ts) from events) - interval 30 hours")
def str7(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    return T.expire(events.join(F.broadcast(events.agg(F.max("ts").alias("now")))), F.col("now"), 30).drop("now")
