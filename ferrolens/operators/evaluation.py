"""Evaluation of ranked results: ranked (query_id, item, place from 1), truth (query_id, item), both without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_measures(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """For each query with a truth: recall, precision, reciprocal rank, NDCG, hit and average precision at k.

    One join of the top k with the truth; all measures come from one aggregate.
    """
    sizes = truth.groupBy("query_id").agg(F.count("*").alias("relevant"))
    w = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    hits = ranked.filter(F.col("place") <= k).join(truth, ["query_id", "item"]).withColumn("found", F.count("*").over(w))
    sums = hits.groupBy("query_id").agg(
        F.count("*").alias("hits"), F.min("place").alias("first"), F.sum(1 / F.log2(F.col("place") + 1)).alias("gain"), F.sum(F.col("found") / F.col("place")).alias("precisions")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    at = lambda c: F.coalesce(c, F.lit(0.0))
    return sizes.join(sums, "query_id", "left").select(
        "query_id", at(F.col("hits") / F.col("relevant")).alias("recall"), at(F.col("hits") / k).alias("precision"), at(1 / F.col("first")).alias("mrr"), at(F.col("gain") / ideal).alias("ndcg"),
        F.coalesce(F.col("hits") > 0, F.lit(False)).alias("hit"), at(F.col("precisions") / F.col("relevant")).alias("map"),
    )


def keyword_coverage(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """Share of each query's keywords (query_id, keyword) that some retrieved text (query_id, text) contains."""
    found = keywords.join(texts, "query_id", "left").groupBy("query_id", "keyword").agg(F.max(F.coalesce(F.contains(F.lower("text"), F.lower("keyword")), F.lit(False))).alias("there"))
    return found.groupBy("query_id").agg(F.avg(F.col("there").cast("double")).alias("coverage"))


def chunks_to_documents(hits: DataFrame) -> DataFrame:
    """Documents by the place of their first chunk: (query_id, item, place) from (query_id, document_id, place)."""
    first = hits.groupBy("query_id", "document_id").agg(F.min("place").alias("first"))
    return first.select("query_id", F.col("document_id").alias("item"), F.row_number().over(Window.partitionBy("query_id").orderBy("first", "document_id")).cast("long").alias("place"))


def report(measures: DataFrame) -> DataFrame:
    """Means over all queries, by intent and by language, and whether they pass."""
    means = measures.groupingSets([[], ["intent"], ["language"]], "intent", "language").agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("recall", "mrr", "ndcg")), F.avg(F.col("hit").cast("double")).alias("hit_rate")
    )
    return means.withColumn("passed", (F.col("recall") >= 0.8) & (F.col("mrr") >= 0.6) & (F.col("ndcg") >= 0.6))


def variant(key, share: float):
    """Arm of a stable split by the key's MD5: 'variant' for the given share (0.01 to 0.99), else 'control'."""
    share = min(max(share, 0.01), 0.99)
    return F.when(F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("long") % 100 < share * 100, "variant").otherwise("control")


def arm_report(df: DataFrame) -> DataFrame:
    """Each arm's number of answers, latency (mean, nearest-rank median and 95 %), mean top score, share of good feedback, and
    mean number of results where there is a column `results`."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by latency)")
    more = [F.avg("results").alias("results")] if "results" in df.columns else []
    return df.groupBy("arm").agg(F.count("*").alias("n"), F.avg("latency").alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.avg("score").alias("score"), F.avg(F.col("positive").cast("double")).alias("positive"), *more)


def attach_feedback(results: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback of a conversation goes to its first result; a feedback without a verdict is positive."""
    first = F.row_number().over(Window.partitionBy("conversation_id").orderBy("ts", "result_id")) == 1
    marked = results.withColumn("first", first)
    said = feedback.select("conversation_id", F.coalesce("positive", F.lit(True)).alias("verdict"), F.lit(True).alias("given"))
    return marked.join(said, "conversation_id", "left").withColumn("positive", F.when(F.col("first") & F.col("given"), F.col("verdict"))).drop("first", "verdict", "given")


def latency_summary(df: DataFrame) -> DataFrame:
    """Mean, extremes and the values at places floor(n * p) of each group's (name) sorted latencies, exactly.

    However few the names, no group is sorted whole: approximate percentiles bound a narrow band around each place, what
    lies below it is counted, and only the band is sorted.
    """
    places, near = {"p50": 0.5, "p95": 0.95}, 0.002
    bounds = [q for p in places.values() for q in (max(p - near, 0.0), min(p + near, 1.0))]
    sizes = df.groupBy("name").agg(
        F.count("*").alias("n"), F.avg("latency").alias("mean"), F.min("latency").alias("low"), F.max("latency").alias("high"), F.percentile_approx("latency", bounds, 10_000).alias("b")
    )
    joined = df.filter("latency is not null").join(F.broadcast(sizes.select("name", "n", "b")), "name")
    out = sizes.drop("b")
    for i, (name, p) in enumerate(places.items()):
        a, b = F.col("b")[2 * i], F.col("b")[2 * i + 1]
        below = joined.groupBy("name").agg(F.count_if(F.col("latency") < a).alias("below"))
        w = Window.partitionBy("name").orderBy("latency")
        band = joined.filter((F.col("latency") >= a) & (F.col("latency") <= b)).groupBy("name", "n", "latency").agg(F.count("*").alias("m"))
        upto = band.withColumn("upto", F.sum("m").over(w)).join(F.broadcast(below), "name")
        found = upto.filter(F.col("below") + F.col("upto") > F.floor(F.col("n") * p)).groupBy("name").agg(F.min("latency").alias(name))
        out = out.join(F.broadcast(found), "name", "left")
    return out.select("name", "n", "mean", "p50", "p95", "low", "high")


def token_rates(df: DataFrame) -> DataFrame:
    """(name, tokens_per_second): tokens of all runs over their latencies (ms) together; null without any time."""
    return df.groupBy("name").agg(F.try_divide(F.sum("tokens") * 1000.0, F.sum("latency")).alias("tokens_per_second"))
