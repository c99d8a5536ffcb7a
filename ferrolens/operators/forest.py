"""Isolation forests of one-dimensional series.

A tree over one number is a step function of it, and so is a forest. Fitting reads a bounded sample
of each series (POOL rows, by a hash of their ids) and gives steps: from which value on, and how
long the mean path is. Scoring merges readings and steps in order of value, without a model in
any task's memory.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolens.operators.series import KEYS
from ferrolens.operators.segments import filled
from ferrolens.operators.tables import latest_per_key

TREES, SAMPLE = 100, 256
#: Readings that trees draw from: as many as all of them can draw.
POOL = TREES * SAMPLE
EULER = 0.5772156649


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


def path_length(n: Column | str) -> Column:
    """`mean_path` of a column of counts."""
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2 * (F.ln(n - 1) + EULER) - 2 * (n - 1) / n)


def grow(values: np.ndarray, most: int, rng: np.random.Generator) -> list[tuple[float, float]]:
    """Steps (from value, path length) of one tree, in order of value."""
    out: list[tuple[float, float]] = []
    todo = [(np.sort(values), -math.inf, 0)]
    while todo:
        some, start, depth = todo.pop()
        if depth >= most or len(some) <= 1 or some[0] == some[-1]:
            out.append((start, depth + mean_path(len(some))))
            continue
        cut = rng.uniform(some[0], some[-1])
        k = int(np.searchsorted(some, cut))
        todo += [(some[k:], cut, depth + 1), (some[:k], start, depth + 1)]
    return sorted(out)


def fit_forest(df: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """(equipment_id, sensor_id, since, path, c): the forest's steps by series; since is null for the lowest."""
    pool = latest_per_key(df.filter("value is not null"), list(KEYS), POOL, [F.xxhash64("event_id", F.lit(seed)), F.col("event_id")]).select(*KEYS, "event_id", "value")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_id")
        key = tuple(rows[k].iloc[0] for k in KEYS)
        values = rows["value"].to_numpy()
        rng = np.random.default_rng([seed, zlib.crc32(repr([str(k) for k in key]).encode())])
        n = min(sample, len(values))
        steps = [grow(rng.choice(values, n), max(1, math.ceil(math.log2(max(n, 2)))), rng) for _ in range(trees)]
        since = np.unique([s for tree in steps for s, _ in tree])
        path = np.zeros(len(since))
        for tree in steps:
            starts = np.array([s for s, _ in tree])
            path += np.array([p for _, p in tree])[np.searchsorted(starts, since, "right") - 1]
        return pd.DataFrame({KEYS[0]: key[0], KEYS[1]: key[1], "since": [None if s == -math.inf else s for s in since], "path": path / trees, "c": mean_path(n)})

    return pool.groupBy(*KEYS).applyInPandas(fit, "equipment_id long, sensor_id string, since double, path double, c double")


def score(df: DataFrame, steps: DataFrame) -> DataFrame:
    """df with `score` (0.5 for series without a forest).

    Each reading takes the last step that is not above its value: steps and readings lie in one range partitioning, and the
    last step before a range is carried into it (`segments.filled`), so a series of any length is scored by many tasks.
    """
    marks = steps.select(*KEYS, F.col("since").alias("value"), F.lit(0).alias("kind"), F.struct("path", "c").alias("step"))
    rows = df.select(*KEYS, "value", F.lit(1).alias("kind"), F.lit(None).cast("struct<path: double, c: double>").alias("step"), "event_id")
    both = marks.withColumn("event_id", F.lit(None).cast("long")).unionByName(rows)
    found = filled(both, list(KEYS), ["value", "kind", "event_id"], "step").filter("kind = 1").withColumn("step", F.col("before"))
    value = F.when(F.col("step.c") > 0, F.pow(F.lit(2.0), -F.col("step.path") / F.col("step.c"))).otherwise(0.5)
    return found.select(*KEYS, "event_id", "value", F.coalesce(value, F.lit(0.5)).alias("score"))


def severity(score_: Column | str, caution: float = 0.6, anomaly: float = 0.75) -> Column:
    score_ = F.col(score_) if isinstance(score_, str) else score_
    return F.when(score_ >= anomaly, "Anomaly").when(score_ >= caution, "Caution").otherwise("Normal")


def list_models(models: DataFrame) -> DataFrame:
    """(equipment_id, sensor_id, version, trained_at, n): the newest model of each series, and how many it has."""
    newest = F.max(F.struct("trained_at", "version")).alias("m")
    return models.groupBy("equipment_id", "sensor_id").agg(newest, F.count("*").alias("n")).select("equipment_id", "sensor_id", "m.version", "m.trained_at", "n")
