"""Queries of knowledge operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolens.functions.numbers import r6
from ferrolens.operators import knowledge as K
from ferrolens.operators import tables as T
from ferrolens.plans.registry import query
from ferrolens.plans.retrieval import VECTORS, vectors
from ferrolens.plans.tables import GRAPH, graph
from ferrolens.plans.views import table

ASKED = "'E' || cast(1000 + event_id % 900 as varchar) || ' at ' || cast(event_id % 90 as varchar) || ' rpm, ' || cast(event_id % 7 as varchar) || '.5um'"


@query("qry6_correct_patterns", f"select event_id, regexp_replace(regexp_replace(regexp_replace({ASKED}, '\\b([A-Z]{{1,3}})(\\d{{3,5}})\\b', '\\1-\\2', 'g'), '(?i)(\\d+(?:\\.\\d+)?)\\s*um\\b', '\\1 μm', 'g'), '(?i)(\\d+(?:\\.\\d+)?)\\s*rpm\\b', '\\1 RPM', 'g') as query from events")
def qry6(spark, sf):
    number = lambda n: (F.col("event_id") % n).cast("string")
    asked = F.concat(F.lit("E"), (1000 + F.col("event_id") % 900).cast("string"), F.lit(" at "), number(90), F.lit(" rpm, "), number(7), F.lit(".5um"))
    return table(spark, sf, "events").select("event_id", K.correct_patterns(asked).alias("query"))


@query("qry4_expand_keywords", """with w as (select distinct user_id as query_id, event_type as keyword from events), s(group_id, term) as (values (1, 'View'), (1, 'look'), (1, 'see'), (2, 'click'), (2, 'see'), (3, 'other')),
    g as (select distinct query_id, group_id from w join s on lower(term) = lower(keyword)) select query_id, keyword as term from w union select query_id, term from g join s using (group_id)""")
def qry4(spark, sf):
    words = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("keyword")).distinct()
    return K.expand_keywords(words, spark.createDataFrame([(1, "View"), (1, "look"), (1, "see"), (2, "click"), (2, "see"), (3, "other")], "group_id int, term string"))


@query("doc12_prefix_parts", "select page_id, 'site' as chapter, case when page_id % 2 = 0 then 'p' || cast(page_id as varchar) end as section, case when page_id % 2 = 0 then 'site > p' || cast(page_id as varchar) else 'site' end as parent_context from pages where page_id % 3 <> 0 union all select page_id, null, null, null from pages where page_id % 3 = 0")
def doc12(spark, sf):
    lead = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("[# site"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" > ## p"), F.col("page_id").cast("string"))).otherwise(""), F.lit("]\ntext"))).otherwise("text")
    chapter, section, path = K.prefix_parts(lead)
    return table(spark, sf, "pages").select("page_id", chapter.alias("chapter"), section.alias("section"), path.alias("parent_context"))


@query("rul5_life_spans", "select user_id as document_id, cast(event_id % 1000 as double) as amount, case event_id % 3 when 0 then 'hour' when 1 then 'day' else 'wafer' end as unit, case event_id % 3 when 0 then event_id % 1000 * 1.0::double when 1 then event_id % 1000 * 24.0::double end as hours, case when event_id % 3 = 2 then cast(event_id % 1000 as double) end as wafers from events")
def rul5(spark, sf):
    unit = F.when(F.col("event_id") % 3 == 0, "hours").when(F.col("event_id") % 3 == 1, "days").otherwise("wafers")
    text = F.concat(F.lit("The pad. Expected life: "), (F.col("event_id") % 1000).cast("string"), F.lit(" "), unit, F.lit(" of use."))
    return K.life_spans(table(spark, sf, "events").select(F.col("user_id").alias("document_id"), text.alias("text")))


@query("ret7_rerank_from_scores", f"""with {VECTORS}, said as (select query_id, chunk_id, place, case when place <= 10 then place % 4 end as said from vector) select query_id, chunk_id, row_number() over (partition by query_id order by said desc nulls last, place) as new_place from said""")
def ret7(spark, sf):
    found = vectors(spark, sf)
    items = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(i.alias("index"), ((i + 1) % 4).cast("double").alias("score")))
    responses = found.select("query_id").distinct().withColumn("response", F.concat(F.lit("Here:\n```json\n"), F.to_json(items), F.lit("\n```")))
    return K.rerank_from_scores(found, responses).select("query_id", "chunk_id", "new_place")


@query("gra2_upsert_relations", f"with {GRAPH}, c as (select source, 'in' as kind, target, 1 as version from relations union all select upper(source), 'IN', target, 2 from relations where source like 'n%') select source, kind, target from (select *, row_number() over (partition by lower(source), lower(kind), lower(target) order by version desc) as k from c) where k = 1")
def gra2(spark, sf):
    relations = graph(spark, sf)[1].select("source", F.lit("in").alias("kind"), "target", F.lit(1).alias("version"))
    changed = relations.filter("source like 'n%'").select(F.upper("source").alias("source"), F.lit("IN").alias("kind"), "target", F.lit(2).alias("version"))
    return T.last_write(relations.unionByName(changed), [F.lower("source"), F.lower("kind"), F.lower("target")], "version").drop("version")


@query("gra5_resolve_keywords", f"with {GRAPH}, i as (select entity_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(name), '[\\s_\\-#]+'), lambda w: length(w) >= 2))) as word from entities), q as (select n_nationkey as query_id, lower(n_name) as keyword from nation) select query_id, entity_id from q join entities on lower(name) = keyword union select query_id, entity_id from q join i on word = keyword")
def gra5(spark, sf):
    entities = graph(spark, sf)[0]
    asked = table(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), F.lower("n_name").alias("keyword"))
    exact = asked.join(entities, F.lower("name") == F.col("keyword")).select("query_id", "entity_id")
    return exact.unionByName(asked.join(T.keyword_index(entities), F.col("word") == F.col("keyword")).select("query_id", "entity_id")).distinct()


@query("gra8_list_entities", f"with {GRAPH} select entity_id, name from entities where lower(type) = 'nation' and lower(name) not in (select lower(n_name) from nation where n_regionkey = 1)")
def gra8(spark, sf):
    gone = table(spark, sf, "nation").filter("n_regionkey = 1").select(F.lower("n_name").alias("low"))
    return graph(spark, sf)[0].filter("lower(type) = 'nation'").withColumn("low", F.lower("name")).join(gone, "low", "left_anti").select("entity_id", "name")


@query("exr3_apply_feedback", """with recursive r as (select distinct user_id as rule_id from events), f as (select user_id as rule_id, event_type <> 'error' as right_, row_number() over (partition by user_id order by event_id) as k from events),
    s as (select rule_id, 0 as k, 0.5::double as confidence, 0 as hits, 0 as confirms, true as is_active from r union all select f.rule_id, f.k, 0.9 * s.confidence + 0.1 * right_::int, s.hits + 1, s.confirms + right_::int, s.is_active and not (s.hits + 1 >= 10 and (s.confirms + right_::int) / (s.hits + 1) < 0.7) from s join f on f.rule_id = s.rule_id and f.k = s.k + 1)
    select rule_id, round(arg_max(confidence, k), 6) + 0.0 as confidence, cast(max(hits) as bigint) as hits, cast(max(confirms) as bigint) as confirms, arg_max(is_active, k) as is_active from s group by 1""")
def exr3(spark, sf):
    events = table(spark, sf, "events")
    rules = events.select(F.col("user_id").alias("rule_id")).distinct().withColumns({"confidence": F.lit(0.5), "hits": F.lit(0), "confirms": F.lit(0), "is_active": F.lit(True)})
    feedback = events.select(F.col("user_id").alias("rule_id"), F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("right"))
    return K.apply_feedback(rules, feedback).withColumn("confidence", r6("confidence"))


@query("exr4_rule_stats", "select count(*) as n, count(*) filter (user_id % 3 > 0) as active, round(avg(value), 6) + 0.0 as confidence, cast(sum(event_id) as bigint) as hits, round(sum(event_id // 2) / sum(event_id), 6) + 0.0 as precision from events")
def exr4(spark, sf):
    rules = table(spark, sf, "events").select((F.col("user_id") % 3 > 0).alias("is_active"), F.col("value").alias("confidence"), F.col("event_id").alias("hits"), F.expr("event_id div 2").alias("confirms"))
    return K.rule_stats(rules).withColumns({"confidence": r6("confidence"), "precision": r6("precision")})


@query("exr5_current_rules", "select o_custkey as rule_id, o_orderkey as version, o_totalprice as confidence from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as k from orders) where k = 1 and o_orderpriority <> '5-LOW' order by confidence desc")
def exr5(spark, sf):
    changes = table(spark, sf, "orders").select(F.col("o_custkey").alias("rule_id"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("confidence"), "o_orderpriority")
    return T.last_write(changes, [F.col("rule_id")], "version", F.col("o_orderpriority") == "5-LOW").drop("o_orderpriority")


@query("fus2_link_documents", "with a as (select user_id as equipment_id, event_type as sensor_id, max(value) / 1000 as confidence from events group by 1, 2), c as (select n_nationkey as entry_id, case n_nationkey % 3 when 0 then 'view is odd' when 1 then 'no ERROR, purchase' else 'none' end as symptom, n_name as action from nation) select equipment_id, sensor_id, entry_id, action, round(0.8 * confidence, 6) + 0.0 as confidence from a join c on list_contains(regexp_split_to_array(lower(symptom), '[^a-z0-9_]+'), lower(sensor_id))")
def fus2(spark, sf):
    odd = table(spark, sf, "events").groupBy(F.col("user_id").alias("equipment_id"), F.col("event_type").alias("sensor_id")).agg((F.max("value") / 1000).alias("confidence"))
    symptom = F.when(F.col("n_nationkey") % 3 == 0, "view is odd").when(F.col("n_nationkey") % 3 == 1, "no ERROR, purchase").otherwise("none")
    causal = table(spark, sf, "nation").select(F.col("n_nationkey").alias("entry_id"), symptom.alias("symptom"), F.col("n_name").alias("action"))
    return K.link_documents(odd, causal).withColumn("confidence", r6("confidence"))


@query(
    "fus2_link_codes",
    """with a as (select user_id as equipment_id, event_type as sensor_id, event_id % 30 as k, max(value) / 1000 as confidence from events group by 1, 2, 3), c as (select n_nationkey as entry_id, 'E-' || n_nationkey as code, n_name as action, case when n_nationkey = 3 then 'view' else 'no' end as symptom from nation)
    select distinct equipment_id, sensor_id, entry_id, action, round(0.8 * confidence, 6) + 0.0 as confidence from a join c on (symptom = 'view' and sensor_id = 'view') or entry_id = k""",
)
def fus2_codes(spark, sf):
    """Anomalies whose description quotes a code, next to those whose sensor a symptom names."""
    odd = table(spark, sf, "events").groupBy(F.col("user_id").alias("equipment_id"), F.col("event_type").alias("sensor_id"), (F.col("event_id") % 30).alias("k")).agg((F.max("value") / 1000).alias("confidence"))
    odd = odd.withColumn("description", F.concat(F.lit("Spike, see e-"), F.col("k").cast("string"), F.lit(". Then E-99-1")))
    causal = table(spark, sf, "nation").select(F.col("n_nationkey").alias("entry_id"), F.concat(F.lit("E-"), F.col("n_nationkey").cast("string")).alias("error_code"), F.when(F.col("n_nationkey") == 3, "View").otherwise("no").alias("symptom"), F.col("n_name").alias("action"))
    return K.link_documents(odd, causal).withColumn("confidence", r6("confidence"))


@query("alr4_alert_ids", "select event_id, 'PA-' || lpad(cast(row_number() over (order by ts, event_id) as varchar), cast(greatest(6, length(cast(row_number() over (order by ts, event_id) as varchar))) as integer), '0') as alert_id from events")
def alr4(spark, sf):
    return T.alert_ids(table(spark, sf, "events").select("event_id", "ts")).select("event_id", F.col("alert_no").alias("alert_id"))


@query("ans5_citations", """select answer_id, document_id, concat_ws('-', cast(document_id as varchar), 'C' || cast(document_id % 5 as varchar), case when document_id % 2 = 0 then 'S' || cast(document_id % 3 as varchar) end, case when line_start is not null then '{Line:' || line_start || '-' || line_start + 4 || '}' else '{Page:' || event_id % 9 || '}' end) as shown, score
    from (select user_id as answer_id, event_id % 20 as document_id, case when event_id % 4 > 0 then event_id end as line_start, event_id, value as score, row_number() over (partition by user_id, event_id % 20 order by value desc, case when event_id % 4 > 0 then event_id end nulls first, event_id % 9) as k from events) where k = 1""")
def ans5(spark, sf):
    document, line = F.col("event_id") % 20, F.when(F.col("event_id") % 4 > 0, F.col("event_id"))
    passages = table(spark, sf, "events").select(
        F.col("user_id").alias("answer_id"), document.alias("document_id"), F.concat(F.lit("C"), (document % 5).cast("string")).alias("chapter"), F.when(document % 2 == 0, (document % 3).cast("string")).alias("section"),
        line.alias("line_start"), (line + 4).alias("line_end"), (F.col("event_id") % 9).alias("page"), F.col("value").alias("score"),
    )
    return K.citations(passages)


@query("exp4_benchmark_summary", "select event_type as mode, count(*) as n, round(avg(value), 6) + 0.0 as total_ms, round(avg(length(props)), 6) + 0.0 as chars, round(avg(event_id % 4), 6) + 0.0 as citations, round(avg(value / 100), 6) + 0.0 as score from events group by 1")
def exp4(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_type").alias("mode"), F.col("value").alias("total_ms"), F.char_length("props").alias("chars"), (F.col("event_id") % 4).alias("citations"), (F.col("value") / 100).alias("score"))
    return K.benchmark_summary(runs).withColumns({c: r6(c) for c in ("total_ms", "chars", "citations", "score")})


@query("qry6_corrections", """select event_id, 'E' || (1000 + event_id % 900) || '>E-' || (1000 + event_id % 900) || ';' || event_id % 7 || '.5um>' || event_id % 7 || '.5 μm;' || event_id % 90 || ' rpm>' || event_id % 90 || ' RPM' as said from events""")
def qry6_corrections(spark, sf):
    number = lambda n: (F.col("event_id") % n).cast("string")
    asked = F.concat(F.lit("E"), (1000 + F.col("event_id") % 900).cast("string"), F.lit(" at "), number(90), F.lit(" rpm, "), number(7), F.lit(".5um"))
    said = F.array_join(F.transform(K.corrections(asked), lambda c: F.concat(c["original"], F.lit(">"), c["corrected"])), ";")
    return table(spark, sf, "events").select("event_id", said.alias("said"))


SYNONYMS = [(1, 0, "View"), (1, 1, "look"), (1, 2, "see"), (2, 0, "click"), (2, 1, "see"), (3, 0, "other")]


@query("qry5_canonical_terms", "select event_id as query_id, case event_type when 'view' then 'View' else event_type end || ' View, the View ' || user_id as canonical from events")
def qry5(spark, sf):
    synonyms = spark.createDataFrame(SYNONYMS, "group_id int, place int, term string")
    asked = table(spark, sf, "events").select(F.col("event_id").alias("query_id"), F.concat("event_type", F.lit("  SEE  ,the look "), F.col("user_id").cast("string")).alias("query"))
    asked = asked.withColumn("query", F.regexp_replace("query", r"\s+,the", ", the"))
    return K.canonical_terms(asked.withColumn("query", F.regexp_replace("query", r",", " ,")), synonyms).select("query_id", F.regexp_replace("canonical", r" ,", ",").alias("canonical"))


@query(
    "qry4_related_keywords",
    """with w as (select distinct user_id as query_id, case event_id % 3 when 0 then '원인' when 1 then '주기' else event_type end as keyword from events), r(keyword, term) as (values ('원인', '이유'), ('원인', '문제'), ('원인', '발생'), ('주기', '기준'), ('주기', '시간'), ('주기', '수명'))
    select query_id, keyword as term from w union select query_id, term from w join r using (keyword)""",
)
def qry4_related(spark, sf):
    word = F.when(F.col("event_id") % 3 == 0, "원인").when(F.col("event_id") % 3 == 1, "주기").otherwise(F.col("event_type"))
    return K.expand_keywords(table(spark, sf, "events").select(F.col("user_id").alias("query_id"), word.alias("keyword")).distinct())


RESOLVED = """i as (
        select entity_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(name), '[\\s_\\-#]+'), lambda w: length(w) >= 2))) as word from entities union select entity_id, lower(name) from entities
    ), seeds as (select distinct n_nationkey as query_id, entity_id as seed from nation join i on word = lower(n_name)),
    both_ as (select source, target from relations union select target, source from relations)"""


def asked_nations(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("keyword"))


@query(
    "gra10_graph_search",
    f"""with recursive {GRAPH}, {RESOLVED}, w as (select query_id, seed as entity_id, 0 as distance from seeds union select w.query_id, b.target, w.distance + 1 from w join both_ b on b.source = w.entity_id where w.distance < 2)
    select query_id, entity_id, cast(min(distance) as bigint) as distance from w group by 1, 2""",
)
def gra10(spark, sf):
    return T.graph_search(asked_nations(spark, sf), *graph(spark, sf))


@query(
    "gra6_graph_context",
    f"""with {GRAPH}, {RESOLVED}, first as (select query_id, seed from (select *, row_number() over (partition by query_id order by seed) as k from seeds) where k <= 10),
    near as (select query_id, entity_id, min(d) as d from (select query_id, seed as entity_id, 0 as d from first union all select query_id, target, 1 from first join both_ on source = seed) group by 1, 2),
    named as (select query_id, d, name, type, row_number() over (partition by query_id order by d, name) as k from (select query_id, lower(name) as low, min((d, name, type)) as e, e[1] as d, e[2] as name, e[3] as type from near join entities using (entity_id) group by 1, 2)),
    around as (select *, row_number() over (partition by query_id order by source, target) as k from (select distinct query_id, source, target from near join relations on entity_id in (source, target) where d = 0)),
    a as (select query_id, string_agg('- ' || name || ' [' || type || ']', chr(10) order by k) as a from named where k <= 20 group by 1), b as (select query_id, string_agg('- ' || source || ' -[in]-> ' || target, chr(10) order by k) as b from around where k <= 30 group by 1)
    select query_id, '[관련 지식 그래프]' || chr(10) || chr(10) || '엔티티:' || chr(10) || a || coalesce(chr(10) || chr(10) || '관계:' || chr(10) || b, '') as context from a left join b using (query_id)""",
)
def gra6(spark, sf):
    entities, relations = graph(spark, sf)
    return T.graph_context(asked_nations(spark, sf), entities, relations.withColumn("kind", F.lit("in")), 1)
