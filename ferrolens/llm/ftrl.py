"""Logistic regression by follow-the-regularised-leader (FTRL-proximal) updates over sparse rows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolens.llm.frames import pick


@dataclass
class Ftrl:
    """Per-coordinate learning rates, L1 and L2 penalties; the bias isn't penalised."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 1e-3
    epochs: int = 2

    def fit(self, rows: Iterable[tuple[np.ndarray, np.ndarray]], labels: list[int], size: int) -> tuple[np.ndarray, float]:
        """Weights and bias after passes over (distinct indices, values) rows in the given order."""
        rows = list(rows)
        z, n = np.zeros(size), np.zeros(size)
        bias_z = bias_n = 0.0
        for _ in range(self.epochs):
            for (at, x), y in zip(rows, labels, strict=True):
                w = self._weights(z[at], n[at])
                bias = -bias_z / ((self.beta + bias_n**0.5) / self.alpha)
                p = 1 / (1 + np.exp(-np.clip(w @ x + bias, -35, 35)))
                g = (p - y) * x
                n_new = n[at] + g * g
                z[at] += g - (np.sqrt(n_new) - np.sqrt(n[at])) / self.alpha * w
                n[at] = n_new
                g0 = p - y
                bias_z += g0 - ((bias_n + g0 * g0) ** 0.5 - bias_n**0.5) / self.alpha * bias
                bias_n += g0 * g0
        return self._weights(z, n), float(-bias_z / ((self.beta + bias_n**0.5) / self.alpha))

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """(text, label, turn): documents that carry a training label, `most` labels at most.

    docs has id and text; labels has id and the label column. Labels are drawn in the order of a
    hash of their id, so the sample is the same at every run; null labels and ids don't count, and
    of several labels of one id the largest does. The sample is bounded by `most`, so it is joined
    as a broadcast.
    """
    drawn = (
        labels.filter(F.col("id").isNotNull() & F.col(label).isNotNull()).filter(train).groupBy("id").agg(F.max(label).cast("int").alias("label"))
        .withColumn("turn", F.xxhash64("id", F.lit(17))).orderBy("turn", "id").limit(most)
    )
    return docs.join(F.broadcast(drawn), "id").select("text", "label", "turn")


def fit_in_one_task(sample: DataFrame, fit) -> bytes:
    """Run fit(texts, labels) -> bytes over the bounded sample in a task; the model alone comes back."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        rows = pa.Table.from_batches(got).sort_by("turn") if got else None
        texts = rows.column("text").combine_chunks() if rows else pa.array([], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([fit(texts, rows.column("label").to_pylist() if rows else [])], pa.binary())], names=["model"])

    model = sample.repartition(1).mapInArrow(run, "model binary").first()
    return bytes(model["model"]) if model else fit(pa.array([], pa.string()), [])  # without any row no task runs


def documents_and_labels(documents: DataFrame, labels: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    return pick(documents, id="doc_id", text="text"), pick(labels, id="doc_id", **{label: label})
