"""Sources, sinks and pipelines that are read back: corpora of files, reports, model answers, the advanced pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolens.functions.numbers import r6
from ferrolens.operators import evaluation as E
from ferrolens.operators import pipelines as P
from ferrolens.operators import text as X
from ferrolens.plans.registry import query
from ferrolens.plans.retrieval import MEASURES, corpus, measures, requests
from ferrolens.plans.views import table
from ferrolens.runtime import shared_path
from ferrolens.sources import files as S


@query("qry11_sub_questions", "select event_id, case when event_id % 5 > 0 then event_type || ' one?|two ' || event_id else '' end as questions from events")
def qry11(spark, sf):
    """Answers with an array between other words; every fifth has none."""
    listed = F.to_json(F.array(F.concat("event_type", F.lit(" one?")), F.concat(F.lit("two "), F.col("event_id").cast("string"))))
    answer = F.when(F.col("event_id") % 5 == 0, "no questions").otherwise(F.concat(F.lit("Sure:\n"), listed, F.lit("\nDone")))
    return table(spark, sf, "events").select("event_id", F.array_join(X.sub_questions(answer), "|").alias("questions"))


@query("src3_corpus_files", "select 'item-' || item_id || '.md' as document_id, text || chr(10) as text from benchmark")
def src3(spark, sf):
    """Each passage as a file in a folder of its own, and files of other kinds beside them, which are no documents."""
    path = shared_path(spark)
    items = table(spark, sf, "benchmark").select(F.concat(F.lit("Item-"), F.col("item_id").cast("string")).alias("folder"), "text")
    items.write.partitionBy("folder").option("lineSep", "\n").text(f"{path}/corpus")
    items.limit(1).select("text").write.text(f"{path}/corpus/other")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    place = spark._jvm.org.apache.hadoop.fs.Path
    for part in fs.globStatus(place(f"{path}/corpus/folder=*/part-*.txt")):  # a benchmark's items are few
        name = part.getPath().getParent().getName().removeprefix("folder=")
        fs.rename(part.getPath(), place(f"{path}/corpus/{name}.md"))
    for part in fs.globStatus(place(f"{path}/corpus/other/part-*")):
        fs.rename(part.getPath(), place(f"{path}/corpus/other.pdf"))
    return S.read_corpus(spark, f"{path}/corpus")


NAMES = ("recall", "precision", "mrr", "ndcg", "map")


@query("snk3_report_measures", MEASURES + " select query_id, " + ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in NAMES) + ", hit from m")
def snk3(spark, sf):
    """The measures of a written report, read back from its JSON."""
    path, told = shared_path(spark), measures(spark, sf)
    report = E.report(told.withColumns({"intent": F.lit("General"), "language": F.lit("en")}))
    S.write_report(told, report, path)
    back = spark.read.schema(told.schema).json(f"{path}/measures")
    return back.select("query_id", *(r6(c).alias(c) for c in NAMES), "hit")


@query("ret9_advanced")
def ret9_advanced(spark, sf):
    """Ordered by a model's answers for two questions of three, else by keywords."""
    asked = requests(spark, sf)
    items = F.to_json(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.struct(i.alias("index"), ((i * 3) % 7).cast("double").alias("score"))))
    responses = asked.filter("query_id % 3 > 0").select("query_id", F.concat(F.lit("```json\n"), items, F.lit("\n```")).alias("response"))
    return P.retrieve(asked, corpus(spark, sf), P.ADVANCED, 5, 0.05, responses=responses)
