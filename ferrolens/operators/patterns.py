"""Which of many words occur anywhere in a text: a multi-pattern automaton over whole texts, in one pass for each block of words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of patterns that one automaton holds; it takes some fifty bytes for each.
BLOCK_CHARS = 2_000_000


def with_contained(df: DataFrame, text: str, patterns: DataFrame, pattern: str, out: str) -> DataFrame:
    """df with an array<string> `out`: the distinct lower-cased values of `pattern` that the text contains, ignoring case, sorted.

    An occurrence may lie inside a word. Null texts contain nothing; null and empty patterns are left out. Patterns are
    dealt into blocks of BLOCK_CHARS characters at most on average; each block is collected and broadcast on its own and passes all
    texts once, so what the driver and a task hold is bounded.
    """
    import ahocorasick

    words = patterns.select(F.lower(pattern).alias("word")).filter("word != ''").distinct()
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    spark, found = df.sparkSession, df.withColumns({out: F.array().cast("array<string>"), "_lower": F.lower(text)})
    schema = found.schema

    def search(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = ahocorasick.Automaton()
            for word in shared.value:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for batch in batches:
                told = [sorted({*old, *(w for _, w in automaton.iter(t))}) if t else list(old) for t, old in zip(batch["_lower"], batch[out], strict=True)]
                yield batch.assign(**{out: told})

        return run

    for k in range(blocks):
        some = [r["word"] for r in words.filter(F.pmod(F.xxhash64("word"), F.lit(blocks)) == k).collect()]
        if some:
            found = found.mapInPandas(search(spark.sparkContext.broadcast(some)), T.StructType(schema.fields))
    return found.drop("_lower")
