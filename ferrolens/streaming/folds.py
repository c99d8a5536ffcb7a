"""Folds over the ordered rows of a key, for `ordered.in_order` and `ordered.in_batch`: alerts, deviations, change points, rules.

`streaming.live` has the same operators without a reorder buffer: at once, in the order of each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolens.streaming.ordered import Fold

READING_KEYS, ALERT_KEYS, RULE_KEYS = ["equipment_id", "sensor_id"], ["equipment_id", "hypothesis"], ["equipment_id", "trigger_id"]


class Suppress(Fold):
    """Alerts less those within `minutes` of the last one issued for their key. Tie-break: alert_id."""

    columns, state = "ts_us long, alert_id long", "issued long"

    def __init__(self, minutes: float = 60):
        self.forget = minutes * 60  # silent for that long, a key issues anew anyway

    def step(self, state, row):
        at, alert = row
        if state is None or at - state[0] >= self.forget * 1e6:
            return (at,), [(at, alert)]
        return state, []


class Detect(Fold):
    """The running moving average, and the deviation from the running mean of what came before. Tie-break: event_id.

    A null value changes nothing and gives no row. forget: seconds of silence after which a series starts anew.
    """

    columns, state, needs = "event_id long, ema double, z double, odd boolean", "ema double, n long, mean double, squares double", ("value",)

    def __init__(self, span: int = 10, caution: float = 3.0, least: int = 5, forget: float | None = None):
        self.alpha, self.caution, self.least, self.forget = 2 / (span + 1), caution, least, forget

    def step(self, state, row):
        _, event, x = row
        ema, n, mean, squares = state or (None, 0, 0.0, 0.0)
        if x is None or x != x:
            return (ema, n, mean, squares), []
        std = (squares / n) ** 0.5 if n else 0.0
        z = (x - mean) / std if n >= self.least and std > 1e-10 else 0.0
        ema = x if ema is None else self.alpha * x + (1 - self.alpha) * ema
        moved = mean + (x - mean) / (n + 1)
        return (ema, n + 1, moved, squares + (x - mean) * (x - moved)), [(event, ema, z, abs(z) >= self.caution)]


class Changes(Fold):
    """Change points by a two-sided cumulative sum of deviations from a known mean, which starts anew at each. Tie-break: event_id.

    A null value changes nothing. forget: seconds of silence after which both sums start anew.
    """

    columns, state, needs = "event_id long, ts_us long, direction string", "up double, down double", ("value",)

    def __init__(self, mean: float, std: float, threshold: float = 5.0, drift: float = 0.5, forget: float | None = None):
        self.mean, self.std, self.threshold, self.drift, self.forget = mean, std, threshold, drift, forget

    def step(self, state, row):
        at, event, x = row
        up, down = state or (0.0, 0.0)
        if x is None or x != x:
            return (up, down), []
        z = (x - self.mean) / self.std
        up, down = max(0.0, up + z - self.drift), max(0.0, down - z - self.drift)
        if up > self.threshold or down > self.threshold:
            return (0.0, 0.0), [(event, at, "up" if up > self.threshold else "down")]
        return (up, down), []


class Hold(Fold):
    """Stretches in which a condition holds for a duration, each told once: since when, and the moment at which it had held
    for that long. Tie-break: event_id. A stretch ends at the first row that doesn't hold; it is told by the
    next row, or by time alone when the watermark has passed that moment."""

    columns, state, needs = "since_us long, told_us long", "since long, told boolean, need long", ("duration_seconds", "holds")

    def step(self, state, row):
        at, _, seconds, holds = row
        if not holds:
            return None, []
        need = int(seconds * 1_000_000)
        since, told, _ = state or (at, False, need)
        if not told and at - since >= need:
            return (since, True, need), [(since, since + need)]
        return (since, told, need), []

    def wake(self, state):
        since, told, need = state
        return None if told else since + need

    def pass_time(self, state, until):
        since, told, need = state
        if not told and until - since >= need:
            return (since, True, need), [(since, since + need)]
        return state, []


def conditions(readings: DataFrame, triggers: DataFrame) -> DataFrame:
    """Readings (equipment_id, sensor_id, ts, event_id, value) met with the triggers of their sensor (trigger_id, sensor_id, low, high,
    duration_seconds): one row each, with whether the value lies from low to high. A null bound is open; a null value doesn't hold.

    The rule base is a static table; Spark broadcasts it while it is small.
    """
    holds = (F.col("value") >= F.coalesce("low", F.col("value"))) & (F.col("value") <= F.coalesce("high", F.col("value")))
    met = readings.join(triggers, "sensor_id")
    return met.select("equipment_id", "trigger_id", "ts", "event_id", F.col("duration_seconds").cast("double").alias("duration_seconds"), F.coalesce(holds, F.lit(False)).alias("holds"))


def times(df: DataFrame) -> DataFrame:
    """df with its columns <name>_us as timestamps <name>."""
    return df.select(*(F.timestamp_micros(c).alias(c.removesuffix("_us")) if c.endswith("_us") else F.col(c) for c in df.columns))
