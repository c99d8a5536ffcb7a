"""Batch retrieval: a table of queries (query_id, query) against a table of chunks (chunk_id, text)."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokenize(text: Column | str) -> Column:
    """Terms: lower-cased words of two or more characters between white space and punctuation; a run
    of Hangul gives its bigrams, or itself if it is a single character."""
    text = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    simple = F.filter(F.split(text, r"(?U)[\s\p{P}]+"), lambda w: F.length(w) >= 2)
    # in texts with Hangul, it is taken apart from other letters first
    apart = F.regexp_replace(F.regexp_replace(text, r"([가-힣])([^가-힣])", "$1 $2"), r"([^가-힣])([가-힣])", "$1 $2")
    words = F.split(apart, r"(?U)[\s\p{P}]+")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2)))
    korean = lambda w: w.rlike(r"^[가-힣]+$")
    terms = F.transform(words, lambda w: F.when(korean(w) & (F.length(w) > 1), grams(w)).when(korean(w) | (F.length(w) >= 2), F.array(w)).otherwise(F.array().cast("array<string>")))
    return F.when(text.rlike("[가-힣]"), F.flatten(terms)).otherwise(simple)


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, length): how often each chunk has each term, and its number of terms."""
    terms = chunks.select("chunk_id", tokenize("text").alias("terms")).withColumn("length", F.size("terms").cast("long"))
    return terms.select("chunk_id", "length", F.explode("terms").alias("term")).groupBy("term", "chunk_id", "length").agg(F.count("*").alias("tf"))


def bm25_search(queries: DataFrame, index: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, place): the k best chunks of each query; ties go by chunk_id.

    Queries' distinct terms meet postings on the term. Statistics are three small aggregates; only
    postings of asked terms go on to the sum.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokenize("query"))).alias("term"))
    sizes = chunks.agg(F.count("*").alias("n_chunks")).join(F.broadcast(index.agg(F.sum("tf").alias("terms")))).select("n_chunks", (F.col("terms") / F.col("n_chunks")).alias("mean_length"))
    wanted = index.join(asked.select("term").distinct(), "term", "left_semi")
    rarity = wanted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    weighed = wanted.join(rarity, "term").join(F.broadcast(sizes)).select("term", "chunk_id", weight.alias("weight"))
    scores = asked.join(weighed, "term").groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("score"))
    return best(scores, k)


def best(scores: DataFrame, k: int, by=("query_id",), tie="chunk_id", digits: int | None = 9) -> DataFrame:
    """The k rows of the highest score of each query, with their place."""
    order = F.round("score", digits) if digits is not None else F.col("score")
    w = Window.partitionBy(*by).orderBy(order.desc(), tie)
    return scores.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= k)


def unit(vector: Column | str) -> Column:
    """The vector at length one; a zero vector stays."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


#: Query vectors that are broadcast at once, and cells of a matrix of scores.
MOST_QUERIES, CELLS = 20_000, 4_000_000


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, score, place): exact search by cosine. queries: query_id, vector; vectors: chunk_id, vector.

    Queries go to every block of vectors as arrays of broadcasts of MOST_QUERIES at most, one scan of
    the vectors for each; a task keeps the k best of each query of its own rows, so what is shuffled is
    k rows a query and task.
    """
    import numpy as np
    import pandas as pd

    spark = vectors.sparkSession
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, score double"
    rows = vectors.filter(where) if where is not None else vectors
    rows = rows.select("chunk_id", unit("vector").alias("vector"))

    def search(shared) -> DataFrame:
        def top(some: pd.DataFrame) -> pd.DataFrame:
            some["r"] = some["score"].round(9)
            return some.sort_values(["query_id", "r", "chunk_id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k).drop(columns="r")

        def run(batches):
            ids, matrix = shared.value
            held = None
            for batch in batches:
                if not len(batch):
                    continue
                chunks, columns = batch["chunk_id"].to_numpy(), np.array(batch["vector"].tolist()).T
                found = [] if held is None else [held]
                step = max(1, CELLS // len(chunks))
                for a in range(0, len(ids), step):
                    scores = matrix[a : a + step] @ columns
                    rounded = scores.round(9)
                    # all that tie with the k-th stay until they are ordered by chunk_id
                    least = np.partition(rounded, -k, axis=1)[:, -k] if k < len(chunks) else np.full(len(rounded), -np.inf)
                    q, c = np.nonzero(rounded >= least[:, None])
                    found.append(top(pd.DataFrame({"query_id": ids[a + q], "chunk_id": chunks[c], "score": scores[q, c]})))
                held = top(pd.concat(found))
            if held is not None:
                yield held

        return rows.mapInPandas(run, kinds)

    found = None
    asked = queries.select("query_id", unit("vector").alias("vector")).toLocalIterator()
    while block := list(islice(asked, MOST_QUERIES)):
        arrays = pd.Series([r["query_id"] for r in block]).to_numpy(), np.array([r["vector"] for r in block])
        some = search(spark.sparkContext.broadcast(arrays))
        found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], f"{kinds}, place long")
    return best(found, k)


def rrf_merge(vector: DataFrame, keyword: DataFrame, weight_v: float = 1.0, weight_k: float = 1.0, k: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked results; chunks that only the keyword search found are left out."""
    both = vector.select("query_id", "chunk_id", F.col("place").alias("v")).join(keyword.select("query_id", "chunk_id", F.col("place").alias("k")), ["query_id", "chunk_id"], "left")
    score = weight_v / (k + F.col("v")) + F.coalesce(weight_k / (k + F.col("k")), F.lit(0.0))
    return best(both.select("query_id", "chunk_id", score.alias("score")), 1 << 30)


def keyword_boost(results: DataFrame) -> DataFrame:
    """New places by score plus 0.1 for each of the array `keywords` that the text contains, 0.2 at most."""
    hits = F.size(F.filter("keywords", lambda w: F.contains(F.lower("text"), F.lower(w))))
    return best(results.drop("place").withColumn("boosted", F.col("score") + F.least(F.lit(0.2), 0.1 * hits)).withColumnsRenamed({"score": "kept", "boosted": "score"}), 1 << 30).withColumnsRenamed({"score": "boosted", "kept": "score"})


def mmr_select(results: DataFrame, k: int, trade: float = 0.7) -> DataFrame:
    """Diverse selection by maximal marginal relevance over each query's candidates.

    results: query_id, chunk_id, score, query, text. Relevance is half min-max score, half TF-IDF
    cosine with the query; candidates are bounded by the search before (`MOST_CANDIDATES`).
    """
    import numpy as np
    import pandas as pd

    bounded = best(results.drop("place"), MOST_CANDIDATES).select("query_id", "chunk_id", "score", tokenize("query").alias("q"), tokenize("text").alias("t"))
    kind = {n: results.schema[n].dataType.simpleString() for n in ("query_id", "chunk_id")}

    def select(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk_id").reset_index(drop=True)
        lists = [list(x) for x in rows["t"]] + [list(rows["q"].iloc[0])]
        terms = sorted({x for t in lists for x in t})
        column = {t: i for i, t in enumerate(terms)}
        tf = np.zeros((len(lists), len(terms)))
        for i, t in enumerate(lists):
            for x in t:
                tf[i, column[x]] += 1
        df = (tf[:-1] > 0).sum(0)
        weights = tf * np.log((len(rows) + 1) / (df + 1)) + tf * 1e-12
        norm = np.linalg.norm(weights, axis=1, keepdims=True)
        weights = np.divide(weights, norm, out=np.zeros_like(weights), where=norm > 0)
        score = rows["score"].to_numpy()
        spread = score.max() - score.min()
        relevance = 0.5 * ((score - score.min()) / spread if spread > 0 else np.ones(len(score))) + 0.5 * (weights[:-1] @ weights[-1])
        like = weights[:-1] @ weights[:-1].T
        chosen: list[int] = []
        left = list(range(len(rows)))
        while left and len(chosen) < k:
            gain = [trade * relevance[i] - (1 - trade) * (like[i, chosen].max() if chosen else 0.0) for i in left]
            chosen.append(left.pop(int(np.argmax(np.round(gain, 9)))))
        return rows.loc[chosen, ["query_id", "chunk_id", "score"]].assign(place=range(1, len(chosen) + 1))

    return bounded.groupBy("query_id").applyInPandas(select, f"query_id {kind['query_id']}, chunk_id {kind['chunk_id']}, score double, place long")


MOST_CANDIDATES = 100


def merge_subquestions(results: DataFrame, k: int) -> DataFrame:
    """Results of a request's sub-questions: each chunk once with its best score, the k best."""
    return best(results.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k)


def confidence(requests: DataFrame, results: DataFrame, least: float) -> DataFrame:
    """Best score of each request, 0 without results, and whether it is enough."""
    top = results.groupBy("query_id").agg(F.max("score").alias("top"))
    return requests.select("query_id").join(top, "query_id", "left").select("query_id", F.coalesce("top", F.lit(0.0)).alias("max_score"), (F.coalesce("top", F.lit(0.0)) >= least).alias("is_confident"))


# The least best score of an answer, and that of strict mode.
CONFIDENT, STRICT = 0.40, 0.75


def gate_a(requests: DataFrame, results: DataFrame, strict: bool = False) -> DataFrame:
    """(query_id, max_score, confident): requests without results, or whose best result (score) is good enough. max_score is null without results."""
    top = results.groupBy("query_id").agg(F.max("score").alias("max_score"))
    told = requests.select("query_id").join(top, "query_id", "left")
    return told.withColumn("confident", F.col("max_score").isNull() | (F.col("max_score") >= (STRICT if strict else CONFIDENT)))
