"""Queries of fitted models and of chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolens.functions.numbers import r6
from ferrolens.operators import chunks as C
from ferrolens.operators import forest
from ferrolens.plans.registry import query
from ferrolens.plans.views import lines, table


@query("if1_to_3_forest")
def forest_scores(spark, sf):
    """Readings that the forest of their series finds odd."""
    df = lines(spark, sf)
    scored = forest.score(df, forest.fit_forest(df))
    return scored.withColumn("severity", forest.severity("score")).filter("severity != 'Normal'")


@query("doc2_chunk_sliding")
def doc2(spark, sf):
    return C.chunk(table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text"))


@query("doc3_chunk_markdown")
def doc3(spark, sf):
    """Sections of documents whose lines with a colon are headers."""
    marked = F.regexp_replace("text", r"(?m)^([^\n|]{3,60}:)$", "## $1")
    return C.chunk(table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), marked.alias("text")), markdown=True)




@query("cau1_causal_from_tables", "select user_id as document_id, 'E' || cast(100 + event_id % 50 as varchar) as error_code, event_type as symptom, 'value ' || cast(event_id as varchar) as cause, 'check' as action, 0.9::double as confidence from events where event_id % 3 <> 0")
def cau1(spark, sf):
    cause = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("value "), F.col("event_id").cast("string"))).otherwise("")
    row = F.concat(F.lit("intro\n| E"), (100 + F.col("event_id") % 50).cast("string"), F.lit(" | "), "event_type", F.lit(" | "), cause, F.lit(" | check |\n"))
    return C.causal_from_tables(table(spark, sf, "events").select(F.col("user_id").alias("document_id"), row.alias("text")))


@query("doc13_line_range", "select doc_id, length(text) - length(replace(text, chr(10), '')) + 1 as lines from documents where length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 0")
def doc13(spark, sf):
    """Last line of each document, by its chunks' line ranges."""
    chunks = C.chunk(table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text"))
    return chunks.groupBy(F.col("document_id").alias("doc_id")).agg(F.max("line_end").cast("long").alias("lines"))


@query("if2_path_length", "select user_id, count(*) as n, round(case when count(*) <= 1 then 0 when count(*) = 2 then 1 else 2 * (ln(count(*) - 1) + 0.5772156649) - 2 * (count(*) - 1) / count(*) end, 6) + 0.0 as c from events group by 1")
def if2(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("c", r6(forest.path_length("n")))


@query("if4_list_models", "select user_id as equipment_id, event_type as sensor_id, arg_max(event_id % 5, (ts, event_id % 5)) as version, max(ts) as trained_at, count(*) as n from events group by 1, 2")
def if4(spark, sf):
    models = table(spark, sf, "events").select(F.col("user_id").alias("equipment_id"), F.col("event_type").alias("sensor_id"), (F.col("event_id") % 5).alias("version"), F.col("ts").alias("trained_at"))
    return forest.list_models(models)
