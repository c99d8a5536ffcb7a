"""Queries that write files made of the tables to the shared folder, and read them back through the sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrolens.operators import knowledge as N
from ferrolens.plans.registry import query
from ferrolens.plans.views import table
from ferrolens.runtime import shared_path
from ferrolens.sources import files as S
from ferrolens.sources.chunkstore import ChunkStore

def k() -> Column:
    return F.col("event_id").cast("string")


@query(
    "src1_service_logs",
    "select ts, event_type as template, case when event_id % 2 = 0 then 'Error' end as level, 'svc' || user_id % 6 as service, 'c' || event_id as correlation_id, cast(user_id as varchar) as \"user\" from events where event_id % 5 <> 0",
)
def src1(spark, sf):
    """Lines of which every fifth is broken, and as many blank ones."""
    path = shared_path(spark)
    row = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("@t"), F.col("event_type").alias("@mt"), F.when(F.col("event_id") % 2 == 0, "Error").alias("@l"),
        F.concat(F.lit("svc"), (F.col("user_id") % 6).cast("string")).alias("ServiceName"), F.concat(F.lit("c"), k()).alias("CorrelationId"), F.col("user_id").cast("string").alias("User"),
    )
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"@t": "2024'), k())).otherwise(F.to_json(row))
    table(spark, sf, "events").select(F.explode(F.array(line, F.lit(" "))).alias("value")).write.text(path)
    read = S.read_service_logs(spark, path)
    return read.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "template", "level", "service", "correlation_id", F.col("extra")["User"].alias("user"))


@query("snk1_upsert_chunks", "select doc_id as document_id, case when doc_id % 3 = 0 then 1 else 0 end as chunk_index, case when doc_id % 3 = 0 then 'new' else source end as text from documents")
def snk1(spark, sf):
    """A third of the documents come again with other chunks."""
    path = shared_path(spark)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("source").alias("text"))
    S.write_chunks(docs, path)
    S.write_chunks(docs.filter("document_id % 3 = 0").withColumns({"chunk_index": F.lit(1), "text": F.lit("new")}), path)
    return spark.read.parquet(path).select("document_id", "chunk_index", "text")


SNK1 = """
select doc_id as document_id, case when doc_id % 3 = 0 then 1 else 0 end as chunk_index, case when doc_id % 3 = 0 then 'new' else source end as text from documents where doc_id % 5 > 0
"""


@query("snk1_versioned_store", SNK1)
def snk1_versioned(spark, sf):
    """A third of the documents come again with other chunks, then a fifth goes: the newest version."""
    store = ChunkStore(spark, shared_path(spark))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("source").alias("text"))
    store.write(docs)
    store.write(docs.filter("document_id % 3 = 0").withColumns({"chunk_index": F.lit(1), "text": F.lit("new")}))
    store.delete(docs.filter("document_id % 5 = 0"))
    return store.read()


@query("snk5_index_alias", "select 'active' as what, count(*) as n from documents union all select 'promoted', count(*) filter (doc_id % 2 = 0) from documents union all select 'standby', count(*) from documents union all select 'back', count(*) from documents")
def snk5(spark, sf):
    """Rows that searches see: at first, while another index is written, after it is promoted and after going back."""
    alias = S.IndexAlias(spark, shared_path(spark))
    docs = table(spark, sf, "documents").select("doc_id", "source")
    alias.prepare(docs)
    alias.promote()
    seen = lambda what: alias.read().agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    out = seen("active")
    alias.prepare(docs.filter("doc_id % 2 = 0"))
    out = out.unionByName(seen("standby"))
    alias.promote()
    out = out.unionByName(seen("promoted"))
    alias.rollback()
    return out.unionByName(seen("back"))


@query(
    "src6_ground_truth",
    "select 'q' || item_id as query_id, case when item_id % 2 = 0 then 'ko' else 'en' end as language, md5(text) as digest, 2 as documents from benchmark",
)
def src6(spark, sf):
    path = shared_path(spark)
    entry = F.struct(
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("query"), F.when(F.col("item_id") % 2 == 0, "ko").otherwise("en").alias("language"), F.array(F.lit("a.md"), F.lit("b.md")).alias("expected_docs"),
    )
    lists = table(spark, sf, "benchmark").groupBy((F.col("item_id") % 8).alias("file")).agg(F.collect_list(entry).alias("entries"))
    lists.select("file", F.lit("1.0").alias("version"), "entries").write.partitionBy("file").json(path)
    return S.load_ground_truth(spark, f"{path}/*/*.json").select("query_id", "language", F.md5("query").alias("digest"), F.size("documents").alias("documents"))


@query("tab8_candidates", "select event_id as response_id, coalesce(nullif(event_type, 'view'), 'unknown') as type, 's' || event_id as symptom, case when event_id % 3 = 0 then 0.9 else 0.5 end::double as confidence, 'PendingReview' as status from events where event_id % 5 <> 0")
def tab8(spark, sf):
    """Answers with fences; every fifth is no JSON."""
    one = F.struct(F.when(F.col("event_type") != "view", F.col("event_type")).alias("type"), F.concat(F.lit("s"), k()).alias("symptom"), F.when(F.col("event_id") % 3 == 0, 0.9).alias("confidence"))
    answer = F.when(F.col("event_id") % 5 == 0, "no idea").otherwise(F.concat(F.lit("Here:\n```json\n"), F.to_json(F.array(one)), F.lit("\n```\n")))
    found = N.parse_candidates(table(spark, sf, "events").select(F.col("event_id").alias("response_id"), answer.alias("response")))
    return found.select("response_id", "type", "symptom", "confidence", "status")


@query("gra9_parse_graph", "select 'Pump ' || user_id as source, 'uses' as kind, 'Valve ' || user_id % 7 as target, count(*) as n from events where event_id % 4 <> 0 group by all")
def gra9(spark, sf):
    """Relations whose ends are spelt otherwise than the entities."""
    n = F.col("user_id").cast("string")
    name = lambda lead, x: F.concat(F.lit(lead), x)
    m = (F.col("user_id") % 7).cast("string")
    entities = F.array(F.struct(name("Pump ", n).alias("name"), F.lit("pump").alias("type")), F.struct(name("Valve ", m).alias("name"), F.lit("valve").alias("type")))
    relations = F.array(F.struct(name("PUMP ", n).alias("source"), name("valve ", m).alias("target"), F.lit("uses").alias("type")))
    answer = F.when(F.col("event_id") % 4 == 0, "{broken").otherwise(F.to_json(F.struct(entities.alias("entities"), relations.alias("relations"))))
    return N.parse_graph(table(spark, sf, "events").select(answer.alias("response")))[1].groupBy("source", "kind", "target").agg(F.count("*").alias("n"))
