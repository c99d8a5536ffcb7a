"""Text queries over conversations, documents, pages and passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolens.functions.numbers import r6
from ferrolens.operators import text as X
from ferrolens.plans.registry import query
from ferrolens.plans.views import table

#: Conversations seeded with ids and values, the same in both engines, so that patterns occur.
SEED = "text || ' CMP-' || cast(turn % 3 as varchar) || ' yield: 9' || cast(turn as varchar) || '.5% and etch_' || cast(length(text) % 4 as varchar) || ' from 10.0.0.' || cast(turn as varchar)"


def said(spark, sf):
    s = lambda c: F.col(c).cast("string")
    seeded = F.concat("text", F.lit(" CMP-"), (F.col("turn") % 3).cast("string"), F.lit(" yield: 9"), s("turn"), F.lit(".5% and etch_"), (F.char_length("text") % 4).cast("string"), F.lit(" from 10.0.0."), s("turn"))
    return table(spark, sf, "conversations").withColumn("said", seeded)


@query("qry1_intent", "select conv_id, turn, case " + " ".join(f"when regexp_matches(text, '(?i){p}') then '{n}'" for n, p in X.INTENTS) + " else 'General' end as intent from conversations")
def qry1(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.intent("text").alias("intent"))


@query("qry2_preferred_types", "with i as (select conv_id, turn, case " + " ".join(f"when regexp_matches(text, '(?i){p}') then '{n}'" for n, p in X.INTENTS) + " else 'General' end as intent from conversations) select conv_id, turn, case intent " + " ".join(f"when '{k}' then '{','.join(v)}'" for k, v in X.PREFERRED.items()) + " end as types from i")
def qry2(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(X.preferred_types(X.intent("text")), ",").alias("types"))


@query("qry3_keywords", f"select item_id, len(list_distinct(list_filter(string_split(regexp_replace(text, '{X.PARTICLES}', ' ', 'g'), ' '), lambda w: length(w) >= 2))) as n, list_min(list_filter(string_split(regexp_replace(text, '{X.PARTICLES}', ' ', 'g'), ' '), lambda w: length(w) >= 2)) as first from benchmark")
def qry3(spark, sf):
    words = X.keywords("text")
    return table(spark, sf, "benchmark").select("item_id", F.size(words).cast("long").alias("n"), F.array_min(words).alias("first"))


@query("qry7_unchanged_ratio", "with t as (select conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as a, list_filter(regexp_split_to_array(replace(text, 'the', 'THE'), '\\s+'), lambda w: w <> '') as b, text = replace(text, 'the', 'THE') as same from conversations) select conv_id, turn, round(case when same or len(a) = 0 then 1.0 else len(list_filter(a, lambda w: list_contains(b, w))) / len(a) end, 6) + 0.0 as ratio from t")
def qry7(spark, sf):
    changed = F.replace("text", F.lit("the"), F.lit("THE"))
    return table(spark, sf, "conversations").select("conv_id", "turn", r6(X.unchanged_ratio("text", changed)).alias("ratio"))


@query("qry8_acceptance", "select role, count(*) as n, round(avg((turn % 3 <> 0)::int), 6) + 0.0 as rate, count(*) >= 20 and avg((turn % 3 <> 0)::int) >= 0.9 as automatic from conversations group by 1")
def qry8(spark, sf):
    rate = F.avg((F.col("turn") % 3 != 0).cast("double"))
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), r6(rate).alias("rate"), ((F.count("*") >= 20) & (rate >= 0.9)).alias("automatic"))


KEY = "upper(substr(sha256(cast(conv_id % 7 as varchar) || '|General|' || lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))), 1, 16))"


@query("qry9_request_key", f"select conv_id, turn, {KEY} as request_key from conversations")
def qry9(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.request_key((F.col("conv_id") % 7).cast("string"), F.lit("General"), "text").alias("request_key"))


@query("qry10_split_cached", "with c as (select user_id, max(ts) as stored_at from events where event_type = 'view' group by 1), n as (select max(ts) as now from events) select u.user_id as key, coalesce(epoch_us(now) - epoch_us(stored_at) < 86400000000, false) as cached from (select distinct user_id from events) u left join c using (user_id), n")
def qry10(spark, sf):
    events = table(spark, sf, "events")
    now = events.agg(F.max("ts").alias("now"))
    cache = events.filter("event_type = 'view'").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("stored_at")).join(F.broadcast(now))
    hits, misses = X.split_cached(events.select(F.col("user_id").alias("key")).distinct(), cache, F.col("now"))
    return hits.withColumn("cached", F.lit(True)).unionByName(misses.withColumn("cached", F.lit(False)))


PATH = "'docs/' || replace(split_part(url, '/', 3), '.', '/') || case page_id % 4 when 0 then '/alarm/' when 1 then '/Data/spec-sheet/' when 2 then '/parts/' else '/x/' end || cast(page_id as varchar) || '.md'"


def paths(spark, sf):
    kind = F.when(F.col("page_id") % 4 == 0, "/alarm/").when(F.col("page_id") % 4 == 1, "/Data/spec-sheet/").when(F.col("page_id") % 4 == 2, "/parts/").otherwise("/x/")
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("docs/"), F.replace(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("."), F.lit("/")), kind, F.col("page_id").cast("string"), F.lit(".md")).alias("path"))


TAGS = f"list_filter(list_filter(string_split(lower({PATH}), '/'), lambda p: p <> '')[1:-2], lambda p: p not in ({', '.join(repr(g) for g in X.GENERIC_FOLDERS)}))"


@query("doc10_folder_tags", f"select page_id, array_to_string({TAGS}, ',') as tags from pages")
def doc10(spark, sf):
    return paths(spark, sf).select("page_id", F.array_join(X.folder_tags("path"), ",").alias("tags"))


def _case(name: str) -> str:
    return "case " + " ".join(f"when regexp_matches({name}, '{'|'.join(w)}') then '{k}'" for k, w in X.DOC_TYPES) + " else 'general' end"


@query("doc9_doc_type", f"select page_id, {_case(f'lower({PATH})')} as doc_type from pages")
def doc9(spark, sf):
    return paths(spark, sf).select("page_id", X.doc_type("path").alias("doc_type"))


@query("doc8_highlight_type", r"select doc_id, case when len(list_filter(string_split(text, chr(10)), lambda l: length(l) - length(replace(l, '|', '')) >= 3)) >= 3 then 'table' when regexp_matches(lower(text), '\[image\]|<<image>>|\[figure\]') then 'image' else 'text' end as highlight_type from documents")
def doc8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.highlight_type("text").alias("highlight_type"))


@query("doc11_language", "with c as (select doc_id, len(regexp_extract_all(text, '[가-힣]')) as k, len(regexp_extract_all(text, '[A-Za-z]')) as l from documents) select doc_id, case when k + l = 0 then 'unknown' when k > l then 'ko' else 'en' end as language from c")
def doc11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.language("text").alias("language"))


def _redacted(x: str, kinds) -> str:
    for k in kinds:
        x = f"regexp_replace({x}, '{X.SENSITIVE[k][0]}', '{X.SENSITIVE[k][1]}', 'gi')"
    return x


KINDS = tuple(X.SENSITIVE)


@query("red2_redact_output", f"select conv_id, turn, md5({_redacted(SEED, KINDS)}) as digest from conversations")
def red2(spark, sf):
    return said(spark, sf).select("conv_id", "turn", F.md5(X.redact("said", KINDS)[0]).alias("digest"))


@query("red1_mask_input", f"""with s as (select conv_id, turn, {SEED} as said from conversations), f as (select conv_id, turn, unnest(regexp_extract_all(said, '(?i){X.EQUIPMENT_ID}')) as id, generate_subscripts(regexp_extract_all(said, '(?i){X.EQUIPMENT_ID}'), 1) as at_ from s),
    g as (select conv_id, upper(id) as id, min((turn, at_)) as first from f group by 1, 2), n as (select conv_id, id, chr(cast(64 + row_number() over (partition by conv_id order by first) as int)) as letter from g) select conv_id, string_agg(id || '=' || letter, ',' order by letter) as aliases from n group by 1""")
def red1(spark, sf):
    masked = X.mask_equipment(said(spark, sf), "said", ["conv_id"], ["turn"])
    one = masked.groupBy("conv_id").agg(F.first("aliases").alias("aliases"))
    return one.select("conv_id", F.array_join(F.transform(F.array_sort(F.transform("aliases", lambda a: F.struct(a["alias"].alias("alias"), a["id"].alias("id")))), lambda a: F.concat(a["id"], F.lit("="), F.substring(a["alias"], 8, 1))), ",").alias("aliases"))


@query("red3_unmask")
def red3(spark, sf):
    """Masked and restored again: only the case of ids and the addresses differ from what was said."""
    masked = X.mask_equipment(said(spark, sf), "said", ["conv_id"], ["turn"])
    return masked.select("conv_id", "turn", "masked", X.unmask("masked", "aliases").alias("restored"))


@query("red4_hash_fields", "select event_id, substr(sha256(cast(user_id as varchar)), 1, 12) as user, event_type as kind from events")
def red4(spark, sf):
    fields = X.hash_fields(F.create_map(F.lit("UserId"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type")))
    return table(spark, sf, "events").select("event_id", fields["UserId"].alias("user"), fields["kind"].alias("kind"))


@query(
    "ans1_gate_a",
    """select q.vec_id as query_id, coalesce(max(list_cosine_similarity(list_transform(q.embedding, lambda x: x::double), list_transform(v.embedding, lambda x: x::double))) >= 0.4, true) as confident
    from embeddings q left join embeddings v on v.vec_id <> q.vec_id where q.vec_id % 50 = 0 group by 1""",
)
def ans1(spark, sf):
    """Whether some other vector is near enough."""
    from ferrolens.operators import retrieval as R

    every = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = every.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    top = R.vector_search(asked, every, 2).filter("chunk_id != query_id").groupBy("query_id").agg(F.max("score").alias("score"))
    return asked.select("query_id").join(top, "query_id", "left").select("query_id", (F.col("score").isNull() | (F.col("score") >= 0.4)).alias("confident"))


HITS = """p as (select c.conv_id * 100 + c.turn as answer_id, item_id as passage_id, list_filter(list_distinct(regexp_split_to_array(lower(b.text), '[^a-z]+')), lambda w: length(w) >= 4) as keywords, lower(c.text) as answer from conversations c join benchmark b on b.item_id = (c.conv_id + c.turn) % (select count(*) from benchmark) where c.role = 'assistant'),
    h as (select answer_id, passage_id, len(keywords) as n, len(list_filter(keywords, lambda k: contains(answer, k))) as hits from p), r as (select * from h where n = 0 or hits >= 3 or hits >= 0.3 * n)"""


def answers(spark, sf):
    n = table(spark, sf, "benchmark").agg(F.count("*").alias("n"))
    said_ = table(spark, sf, "conversations").filter("role = 'assistant'").join(F.broadcast(n)).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), F.col("text").alias("answer"), ((F.col("conv_id") + F.col("turn")) % F.col("n")).alias("passage_id")
    )
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("passage_id"), F.filter(F.array_distinct(F.split(F.lower("text"), "[^a-z]+")), lambda w: F.length(w) >= 4).alias("keywords"))
    return said_.select("answer_id", "answer"), said_.select("answer_id", "passage_id").join(items, "passage_id")


@query("ans2_reflected", f"with {HITS} select answer_id, passage_id, hits from r")
def ans2(spark, sf):
    return X.reflected(*answers(spark, sf))


@query("ans3_gate_b", f"with {HITS} select h.answer_id, count(*) as n, count(r.answer_id) as k, case when count(r.answer_id) = 0 then 'disclaimer' when count(r.answer_id) < 0.5 * count(*) then 'partial' else 'passed' end as gate from h left join r on r.answer_id = h.answer_id and r.passage_id = h.passage_id group by 1")
def ans3(spark, sf):
    said_, passages = answers(spark, sf)
    return X.gate_b(passages, X.reflected(said_, passages))


@query("ans4_answer_check")
def ans4(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.answer_check("text").alias("gate"))


@query(
    "ans6_clean_answer",
    r"""select conv_id, turn, case (conv_id + turn) % 6 when 5 then trim(text) || chr(10) || '출처 없음' else regexp_replace(trim(text), '\s+$', '') end as answer from conversations""",
)
def ans6(spark, sf):
    """Answers with a think block, a control token and, five times of six, a reference section and more."""
    n = (F.col("conv_id") + F.col("turn")) % 6
    tail = (
        F.when(n == 0, "\n---\n📚 **참고 문서:**\n- a.md").when(n == 1, "\n## 참조 \na\n## 출처\nb").when(n == 2, "\n\n# 신뢰도\nhigh").when(n == 3, "\n---\n**참고 정보**\n## 참고문서\n").when(n == 4, "\n---\n- 📄 a.md").otherwise("\n출처 없음")
    )
    raw = F.concat(F.lit("<think>"), "role", F.lit("\n</think>"), F.trim("text"), tail, F.lit("<|end|>"))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.clean_answer(raw).alias("answer"))


@query(
    "red5_mask_text",
    """select event_id, case when event_id % 2 = 0 then 'Tool [EQUIP_A] then [EQUIP_B], [EQUIP_A]. ' else 'Tool [EQUIP_A] then [EQUIP_A], [EQUIP_A]. ' end || '[YIELD_REDACTED] of [RECIPE_REDACTED] [YIELD_REDACTED], AB1 A-12 ' || event_type as masked from events""",
)
def red5(spark, sf):
    first = F.concat(F.lit("CMP-0"), (F.col("event_id") % 9).cast("string"))
    other = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("ETCH-1"), (F.col("event_id") % 90).cast("string"))).otherwise(first)
    text = F.concat(F.lit("Tool "), first, F.lit(" then "), other, F.lit(", "), first, F.lit(". Yield: 9"), (F.col("event_id") % 10).cast("string"), F.lit(".5% of recipe = R7-x.1 수율 88, AB1 A-12 "), "event_type")
    return table(spark, sf, "events").select("event_id", X.mask_text(text).alias("masked"))
