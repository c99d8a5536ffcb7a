"""A training-data pipeline: quality, near duplicates, repeated substrings, benchmarks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of docs. Stages are pure functions of their input: `run` writes every stage's result as Parquet to
the shared folder and hands the reread table to the next.

1. quality: texts that the classifier (trained on labels.quality) rejects go.
2. near_duplicates: of each cluster of texts linked by Jaccard similarity of 0.8 or more one row stays.
3. repeats: bytes covered by 100-byte strings that also start earlier are cut out of the texts; where a cut leaves
   a part of a character at an edge, that part goes too. A text that nothing is left of goes.
4. benchmarks: documents contaminated by the benchmark's 13-word windows go.
5. tokens: every text gets its BPE ids and their number.

Extra columns pass through all stages. Null texts are scored and kept like empty ones; empty
tables give empty tables. n_chars, where there is such a column, follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolens.llm.bpe import encode_bpe, tokenizer_path
from ferrolens.llm.decontamination import contaminated, contamination
from ferrolens.llm.frames import fresh, shared_folder, table
from ferrolens.llm.jaccardjoin import keep_one
from ferrolens.llm.quality import score_quality, train_quality
from ferrolens.llm.suffixdedup import cut_repeats

#: Texts scored below are rejected.
QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.filter(F.col(scored.columns[-1]) >= QUALITY).drop(scored.columns[-1])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut_repeats(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    n_words, n_hit, items, spans = found.columns[-4:]
    return found.filter(~contaminated(n_words, n_hit)).drop(n_words, n_hit, items, spans)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = encode_bpe(docs, tokenizer_path())
    return coded.withColumn(fresh("n_tokens", coded.columns), F.size(coded[coded.columns[-1]]).cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("benchmarks", benchmarks),
    ("tokens", tokens),
]

#: The stages' models and exact substring order are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
