"""The scan of chunks for few questions: the same results as a sum over postings, without a table of all postings."""

import random

import pytest
from pyspark.sql import functions as F

from ferrolens.operators import pipelines, retrieval, termscan

QUESTIONS = [(1, "w1 w2 w900"), (2, "w3 w77 w5"), (3, "nothing here"), (4, None), (5, "w1"), (6, "w41 w41 w12 w2 w8"), (7, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (8, "한글과 w2")]


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(5)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(20_000)]
    texts = [" ".join(words[i * 40 : i * 40 + r.randint(1, 40)]) for i in range(500)]
    rows = list(enumerate([*texts, "", None, "w2 한글 한글과", *[texts[5]] * 60]))
    return spark.createDataFrame(rows, "chunk_id long, text string").repartition(5).cache()


def rows(df):
    return sorted((r["query_id"], r["place"], str(r["chunk_id"]), round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize(("k", "most", "cells"), [(1, 3, 50), (10, 20_000, 2_000_000), (1000, 2, 300)])
def test_scan_equals_a_sum_over_postings(spark, chunks, k, most, cells, monkeypatch):
    monkeypatch.setattr(termscan, "MOST_QUERIES", most)
    monkeypatch.setattr(termscan, "CELLS", cells)
    asked = spark.createDataFrame(QUESTIONS, "query_id long, query string")
    for some in (chunks, chunks.withColumn("chunk_id", F.struct((F.col("chunk_id") % 7).alias("a"), F.col("chunk_id").cast("string").alias("b")))):
        want = retrieval.bm25_search(asked, retrieval.postings(some), some, k)
        assert rows(termscan.bm25(asked, some, k)) == rows(want)


def test_nothing_asked_and_nothing_there(spark, chunks):
    asked = spark.createDataFrame(QUESTIONS, "query_id long, query string")
    assert termscan.bm25(asked.limit(0), chunks, 3).collect() == []
    assert termscan.bm25(asked, chunks.limit(0), 3).collect() == []
    assert termscan.bm25(asked.filter("query_id = 3"), chunks, 3).collect() == []


def test_containing_texts_whose_ends_are_parts_of_words(spark):
    texts = ["xone two three four", "one two threeX", "two", "one two", "", None, "a two b one two three"]
    asked = [(1, "one two three"), (2, "ne two thre"), (3, "tw"), (4, None), (5, "one  two"), (6, "two b one")]
    found = termscan.Scan.of(spark.createDataFrame(asked, "query_id long, query string"), spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")).containing()
    want = {(q, i) for q, a in asked for i, t in enumerate(texts) if a is not None and t is not None and a in t}
    assert {tuple(r) for r in found.select("query_id", "chunk_id").collect()} == want


def test_the_evaluation_stores_no_table_of_all_postings(spark, chunks, monkeypatch):
    def refuse(*_):
        raise AssertionError("all postings")

    monkeypatch.setattr(retrieval, "postings", refuse)
    parts = chunks.select((F.col("chunk_id") % 100).alias("document_id"), F.col("chunk_id").alias("chunk_index"), "text")
    truth = spark.createDataFrame([(1, "w1 w2 w900", 5), (2, "w3 w77 w5", 6)], "query_id long, query string, item long")
    assert pipelines.evaluate_bm25(parts, truth, 3).count() == 2
