"""The retrieval pipelines, composed of the stages in `retrieval`, `knowledge`, `text` and `tables`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolens.operators import retrieval as R
from ferrolens.operators.evaluation import chunks_to_documents, ranking_measures
from ferrolens.operators.knowledge import correct_patterns, expand_keywords, rerank_from_scores
from ferrolens.operators.tables import graph_context
from ferrolens.operators.termscan import bm25
from ferrolens.operators.text import keywords as keywords_of
from ferrolens.runtime import shared_path

NAIVE, ADVANCED, GRAPH, AGENTIC = "naive", "advanced", "graph", "agentic"


@dataclass
class Corpus:
    """What is searched: chunks (chunk_id, text) and vectors (chunk_id, vector)."""

    chunks: DataFrame
    vectors: DataFrame

    @classmethod
    def of(cls, chunks: DataFrame, vectors: DataFrame) -> Corpus:
        return cls(chunks, vectors)


def candidates(requests: DataFrame, corpus: Corpus, k: int, least: float) -> DataFrame:
    """(query_id, chunk_id, score, place), stored: vector hits above the floor, merged with BM25 by reciprocal rank."""
    spark, path = requests.sparkSession, shared_path(requests.sparkSession)
    found = R.vector_search(requests, corpus.vectors, max(10 * k, 100)).filter(F.col("score") >= least)
    R.rrf_merge(found, bm25(requests, corpus.chunks, 10 * k)).write.parquet(path)
    return spark.read.parquet(path)


def boosted(requests: DataFrame, found: DataFrame, corpus: Corpus, synonyms: DataFrame | None) -> DataFrame:
    """Candidates in the order of their keyword-boosted score, with query and text."""
    words = requests.select("query_id", F.explode(keywords_of("query")).alias("keyword"))
    terms = expand_keywords(words, synonyms).groupBy("query_id").agg(F.sort_array(F.collect_set("term")).alias("keywords"))
    with_text = found.join(corpus.chunks, "chunk_id").join(requests.select("query_id", "query"), "query_id").join(terms, "query_id", "left")
    ranked = R.keyword_boost(with_text.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>"))))
    return ranked.select("query_id", "chunk_id", F.col("boosted").alias("score"), "place", "query", "text")


def retrieve(
    requests: DataFrame,
    corpus: Corpus,
    mode: str = NAIVE,
    k: int = 5,
    least: float = 0.0,
    synonyms: DataFrame | None = None,
    responses: DataFrame | None = None,
    graph: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(query_id, chunk_id, score, place[, context]) for requests (query_id, query, vector).

    All modes mend the query, search by vector and words, rerank and choose k diverse results. ADVANCED and GRAPH order
    by a model's answers (`responses`: query_id, response) where there are any, else by keywords; GRAPH adds the text of
    the entities and relations (`graph`) that the query names. AGENTIC takes requests with a sub_id: each sub-question is
    answered by itself, and a request's results are united.
    """
    if mode == AGENTIC:
        asked = requests.select(F.struct("query_id", "sub_id").alias("query_id"), "query", "vector")
        parts = retrieve(asked.withColumn("query_id", F.to_json("query_id")), corpus, NAIVE, k, least, synonyms)
        kind = f"struct<query_id: {requests.schema['query_id'].dataType.simpleString()}, sub_id: {requests.schema['sub_id'].dataType.simpleString()}>"
        return R.merge_subquestions(parts.withColumn("query_id", F.from_json("query_id", kind)["query_id"]), k)
    requests = requests.select("query_id", correct_patterns("query").alias("query"), "vector")
    found = candidates(requests, corpus, k, least)
    ranked = boosted(requests, found, corpus, synonyms)
    if mode in (ADVANCED, GRAPH) and responses is not None:
        by_model = rerank_from_scores(R.best(found.drop("place"), 2 * k), responses)
        answered = responses.select("query_id").distinct()
        with_text = by_model.join(answered, "query_id", "left_semi").join(corpus.chunks, "chunk_id").join(requests.select("query_id", "query"), "query_id")
        # the model's order as a falling score
        with_text = with_text.select("query_id", "chunk_id", (1.0 / F.col("new_place")).alias("score"), F.col("new_place").alias("place"), "query", "text")
        ranked = ranked.join(answered, "query_id", "left_anti").unionByName(with_text)
    chosen = R.mmr_select(ranked, k)
    if mode == GRAPH and graph is not None:
        words = requests.select("query_id", F.explode(keywords_of("query")).alias("keyword"))
        chosen = chosen.join(graph_context(words, *graph), "query_id", "left")
    return chosen


def evaluate_bm25(chunks: DataFrame, truth: DataFrame, k: int = 10, overfetch: int = 5) -> DataFrame:
    """Measures at k of BM25 over chunks (document_id, chunk_index, text) for truth (query_id, query, item): chunks are searched,
    and documents ranked by their first chunk. One row for each query."""
    named = chunks.withColumn("chunk_id", F.struct("document_id", "chunk_index"))
    asked = truth.select("query_id", "query").distinct()
    hits = bm25(asked, named, overfetch * k).withColumn("document_id", F.col("chunk_id.document_id"))
    ranked = chunks_to_documents(hits.select("query_id", "document_id", "place")).filter(F.col("place") <= k)
    return ranking_measures(ranked, truth.select("query_id", "item").distinct(), k)
