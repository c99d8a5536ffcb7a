"""Operator 6: a quality classifier of hashed word n-grams, trained by FTRL.

A text is read as two streams of tokens: words and punctuation runs as they stand, lower-cased,
and their shapes (case, digits, length, the punctuation itself). Word 1- and 2-grams and shape
1- to 3-grams are hashed into one weight table; a text's value at an index is its share of the
stream's n-grams, so texts of any length compare. A score is the sigmoid of one sparse dot product.

Texts without tokens (null, empty, blank) have the bias alone. Repeated texts score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolens.llm.bytewords import BYTE_VALUE, INK_BYTE, LOWER, WORD_BYTE, flat_bytes, mix, ngrams, prefix_hash, span_hash, tokens
from ferrolens.llm.frames import map_text, pick, slices, table
from ferrolens.llm.ftrl import Ftrl, documents_and_labels, fit_in_one_task, fold, labelled_sample, sigmoid

BITS = 18
#: Labelled rows that training reads at most; the parameter of the bounded sample.
TRAIN_ROWS = 8000
#: Values are shares of a stream's n-grams times this.
SCALE = 20.0

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
MARK_BYTE = INK_BYTE & ~(WORD_BYTE | UPPER)


def _share(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return sums[ends] - sums[starts]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table index, text number and value of every n-gram occurrence of the texts."""
    raw, bounds = flat_bytes(texts)
    word = tokens(raw, bounds, WORD_BYTE | UPPER)
    mark = tokens(raw, bounds, MARK_BYTE)
    starts, ends, owner = (np.concatenate([a, b]) for a, b in zip(word, mark, strict=True))
    is_mark = np.concatenate([np.zeros(len(word[0]), bool), np.ones(len(mark[0]), bool)])
    order = np.argsort(starts, kind="stable")
    starts, ends, owner, is_mark = starts[order], ends[order], owner[order], is_mark[order]
    content = span_hash(prefix_hash(LOWER[raw]), starts, ends)
    size = np.minimum(np.ceil(np.log2(1 + ends - starts)).astype(np.int64), 7)
    caps = np.minimum(_share(UPPER[raw], starts, ends), 3)
    digits = np.minimum(_share(DIGIT[raw], starts, ends), 2)
    first = UPPER[raw[starts]].astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    shape = np.where(is_mark, content, mix(((size * 4 + caps) * 3 + digits) * 2 + first + 1))
    found = []
    for stream, values in ((0, content), (1, shape)):
        for n in (1, 2) if stream == 0 else (1, 2, 3):
            h, who = ngrams(values, owner, n)
            counts = np.bincount(who, minlength=len(texts))
            found.append(((mix(h + BYTE_VALUE[3 * stream + n]) >> np.uint64(64 - BITS)).astype(np.int64), who, SCALE / counts[who]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def fit_quality(texts: pa.Array, labels: list[int]) -> bytes:
    """float32 weights of the hashed table, then the bias."""
    rows, at = [], 0
    batch = pa.RecordBatch.from_arrays([texts], names=["t"])
    for piece in slices(batch, 0):
        index, owner, value = features(piece.column(0))
        keys, back = np.unique(owner << BITS | index, return_inverse=True)
        sums = np.bincount(back, value, minlength=len(keys))
        cut = np.searchsorted(keys >> BITS, np.arange(piece.num_rows + 1))
        rows += [(keys[a:b] & ((1 << BITS) - 1), sums[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        at += piece.num_rows
    weights, bias = Ftrl(alpha=0.5, l1=0.05, l2=0.01, epochs=2).fit(rows, labels, 1 << BITS)
    return np.append(weights, bias).astype(np.float32).tobytes()


def train_quality(documents: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> bytes:
    """A model from labels.quality, of rows whose crc32(doc_id) mod 5 is not 0, `most` rows at most."""
    docs, marks = documents_and_labels(documents, labels, "quality")
    sample = labelled_sample(docs, marks, "quality", fold(F.col("id"), 5) != 0, most)
    return fit_in_one_task(sample, lambda texts, y: fit_quality(texts.fill_null(""), y))


def score_quality(df: DataFrame, model: bytes, text: str = "text", out: str = "score") -> DataFrame:
    """df with the probability that a text is good. The model is 2**18 weights: a bounded broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        weights = np.frombuffer(shared.value, np.float32).astype(np.float64)

        def apply(texts: pa.Array) -> list[pa.Array]:
            index, owner, value = features(texts)
            dots = np.bincount(owner, weights[index] * value, minlength=len(texts))
            return [pa.array(sigmoid(dots + weights[-1]))]

        return apply

    return map_text(df, text, make, [(out, T.DoubleType())], limit=1 << 20)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train_quality(documents, table(spark, sf_dir, "labels"))
    scored = score_quality(pick(documents, doc_id="doc_id", text="text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
