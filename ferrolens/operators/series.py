"""Time series: every operator works on all series of a table, a series being the rows of one key.

A series is ordered by time, then by a unique tie-break. Null values take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolens.functions.numbers import micros, shown

KEYS = ("equipment_id", "sensor_id")
ORDER = ("ts", "event_id")


def over(keys=KEYS, order=ORDER):
    return Window.partitionBy(*keys).orderBy(*order)


def series_stats(df: DataFrame, keys=KEYS) -> DataFrame:
    """Count, mean, population deviation, extremes and nearest-rank percentiles."""
    p = lambda q: F.percentile_approx if q is None else F.expr(f"percentile_disc({q}) within group (order by value)")
    return df.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"),
        p(0.05).alias("p5"), p(0.5).alias("median"), p(0.95).alias("p95"),
    )


def moving_average(df: DataFrame, n: int, keys=KEYS, order=ORDER) -> DataFrame:
    """Means of full windows of n values; in a shorter series of all its values."""
    w = over(keys, order)
    numbered = df.withColumn("at", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    return numbered.withColumn("average", F.avg("value").over(w.rowsBetween(1 - n, 0))).filter(F.col("at") >= F.least(F.lit(n), F.col("n"))).drop("at", "n")


def scan(df: DataFrame, keys, order, schema: str, step: Callable) -> DataFrame:
    """Run an order-dependent recursion over every series, streaming over sorted partitions.

    step(state, rows) takes the state so far (None at a series' start) and the next rows of the series, those that one
    batch holds of it, as arrays by column; it returns the new state and arrays of the columns of `schema`. Only a batch and
    one state are in memory, so a series may be of any length.
    """
    keys, order = list(keys), list(order)
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            for k in keys:
                x = batch[k].to_numpy()
                new[1:] |= ~((x[1:] == x[:-1]) | (pd.isna(x[1:]) & pd.isna(x[:-1])))
            starts = [0, *np.flatnonzero(new).tolist(), len(batch)]
            columns = {c: batch[c].to_numpy() for c in batch.columns}
            out = []
            for a, b in zip(starts, starts[1:], strict=False):
                if a == b:
                    continue
                rows = {c: x[a:b] for c, x in columns.items()}
                key = tuple(None if rows[k][0] != rows[k][0] else rows[k][0] for k in keys)
                if key != current:
                    current, state = key, None
                state, made = step(state, rows)
                if len(made[names[0]]):
                    out.append(made)
            if out:
                yield pd.DataFrame({c: np.concatenate([x[c] for x in out]) for c in names})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def smoothed(x: np.ndarray, alpha: float, start: float) -> np.ndarray:
    """alpha * x + (1 - alpha) * (the value before), from `start` on, in blocks whose powers stay exact enough."""
    keep = 1 - alpha
    block = max(1, min(len(x), int(-20 / np.log(keep)))) if 0 < keep < 1 else 1
    out = np.empty(len(x))
    powers = keep ** np.arange(1, block + 1)
    for a in range(0, len(x), block):
        some = x[a : a + block]
        w = powers[: len(some)]
        out[a : a + block] = w * (start + np.cumsum(alpha * some / w))
        start = out[a + len(some) - 1]
    return out


def ema(df: DataFrame, span: int) -> DataFrame:
    """Exponential moving average with alpha 2 / (span + 1), from the first value on."""
    alpha = 2 / (span + 1)

    def step(now, rows):
        x = rows["value"]
        found = smoothed(x, alpha, x[0] if now is None else now)
        return found[-1], {**rows, "ema": found}

    rows = df.filter("value is not null").select(*KEYS, *ORDER, "value")
    return scan(rows, KEYS, ORDER, "equipment_id long, sensor_id string, event_id long, ema double", step)


def crossings(z: np.ndarray, up: float, down: float, threshold: float, drift: float, block: int = 1024) -> tuple[float, float, list[tuple[int, bool]]]:
    """Sums after the deviations z, and (place, upward) of each time one of the sums passes the threshold and both start anew."""
    found = []
    a = 0
    while a < len(z):
        some = z[a : a + block]
        rise, fall = up + np.cumsum(some - drift), down + np.cumsum(-some - drift)
        # a sum that never goes below 0 is the running total less its least value so far, if that is below 0
        rise, fall = rise - np.minimum(np.minimum.accumulate(rise), 0), fall - np.minimum(np.minimum.accumulate(fall), 0)
        over_ = np.flatnonzero(np.maximum(rise, fall) > threshold)
        if len(over_):
            k = int(over_[0])
            found.append((a + k, bool(rise[k] > threshold)))
            up = down = 0.0
            a += k + 1
        else:
            up, down = float(rise[-1]), float(fall[-1])
            a += len(some)
    return up, down, found


def cusum(df: DataFrame, threshold: float = 5.0, drift: float = 0.5, least: int = 10) -> DataFrame:
    """Change points of a two-sided cumulative sum that starts anew at each; bounds in deviations of the series."""
    stats = df.groupBy(*KEYS).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))
    joined = df.filter("value is not null").join(stats.filter((F.col("n") >= least) & (F.col("std") >= 1e-10)), list(KEYS)).select(*KEYS, *ORDER, "value", "mean", "std")

    def step(state, rows):
        z = (rows["value"] - rows["mean"]) / rows["std"]
        up, down, found = crossings(z, *(state or (0.0, 0.0)), threshold, drift)
        at = np.array([k for k, _ in found], int)
        return (up, down), {**{c: x[at] for c, x in rows.items()}, "direction": np.array(["up" if u else "down" for _, u in found], object)}

    schema = "equipment_id long, sensor_id string, event_id long, ts timestamp_ntz, value double, direction string"
    return scan(joined, KEYS, ORDER, schema, step)


def trend(df: DataFrame, keys=KEYS, order=ORDER, flat: float = 0.001) -> DataFrame:
    """Least-squares slope of the value over its place in the series, and its direction."""
    placed = df.withColumn("x", (F.row_number().over(over(keys, order)) - 1).cast("double"))
    fitted = placed.groupBy(*keys).agg(F.count("*").alias("n"), F.expr("regr_slope(value, x)").alias("slope"), F.avg("value").alias("mean"))
    slope = F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce("slope", F.lit(0.0)))
    share = F.when(F.col("mean") == 0, slope).otherwise(slope / F.abs("mean"))
    share = F.round(share, 9)  # noise of the sums decides nothing
    return fitted.select(*keys, "n", slope.alias("slope"), F.when(F.abs(share) < flat, "Stable").when(share > 0, "Increasing").otherwise("Decreasing").alias("direction"))


def change_segments(df: DataFrame, points: DataFrame) -> DataFrame:
    """Count and mean of every stretch between change points: readings count the points up to them."""
    marks = points.select(*KEYS, *ORDER, F.lit(1).alias("mark"))
    marked = df.join(marks, [*KEYS, *ORDER], "left").withColumn("segment", F.sum(F.coalesce("mark", F.lit(0))).over(over().rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*KEYS, "segment").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("ts").alias("since"))


def sigma_anomalies(df: DataFrame, caution: float = 2.0, anomaly: float = 3.0, least: int = 5) -> DataFrame:
    """Readings that are far from the mean of their series, in deviations."""
    stats = df.groupBy(*KEYS).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n")).filter((F.col("n") >= least) & (F.col("std") > 1e-10))
    z = (F.col("value") - F.col("mean")) / F.col("std")
    scored = df.join(stats, list(KEYS)).withColumn("z", z)
    return scored.filter(F.abs("z") >= caution).withColumn("severity", F.when(F.abs("z") >= anomaly, "Anomaly").otherwise("Caution"))


def local_anomalies(df: DataFrame, window: int = 20, threshold: float = 2.5) -> DataFrame:
    """Readings far from the `window` readings around them; edges and series of under 2 * window don't count."""
    half = window // 2
    w = over()
    around = w.rowsBetween(-half, half)
    n = F.count("*").over(Window.partitionBy(*KEYS))
    sums = df.withColumn("n", n).withColumn("at", F.row_number().over(w)).withColumn("s", F.sum("value").over(around) - F.col("value")).withColumn("q", F.sum(F.col("value") * F.col("value")).over(around) - F.col("value") * F.col("value"))
    mean = F.col("s") / (2 * half)
    variance = F.greatest(F.col("q") / (2 * half) - mean * mean, F.lit(0.0))
    scored = sums.filter((F.col("n") >= 2 * window) & (F.col("at") > half) & (F.col("at") <= F.col("n") - half)).withColumn("std", F.sqrt(variance)).withColumn("score", F.abs(F.col("value") - mean) / F.col("std"))
    return scored.filter((F.col("std") > 1e-10) & (F.col("score") > threshold)).drop("n", "at", "s", "q")


def cross_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of two signals of each equipment, reading by reading, over the shorter one; 0 for flat signals."""
    placed = df.filter(F.col("sensor_id").isin(a, b)).withColumn("at", F.row_number().over(over()))
    left, right = placed.filter(F.col("sensor_id") == a), placed.filter(F.col("sensor_id") == b)
    both = left.select("equipment_id", "at", F.col("value").alias("x")).join(right.select("equipment_id", "at", F.col("value").alias("y")), ["equipment_id", "at"])
    r = F.when((F.stddev_pop("x") > 1e-10) & (F.stddev_pop("y") > 1e-10), F.corr("x", "y")).otherwise(0.0)
    return both.groupBy("equipment_id").agg(F.count("*").alias("n"), F.coalesce(r, F.lit(0.0)).alias("correlation"))


def bucket(ts: Column | str, seconds: int) -> Column:
    """Start of the bucket that a time falls into, in seconds since 1970."""
    return F.floor(micros(ts) / (seconds * 1_000_000)) * seconds


def series_frame(df: DataFrame, signals: list[str], seconds: int) -> DataFrame:
    """Signals as columns of means on a fixed step from each equipment's first to last bucket;
    the share of signals that a row lacks, and whether it lacks all."""
    bucketed = df.filter(F.col("sensor_id").isin(signals)).withColumn("bucket", bucket("ts", seconds))
    wide = bucketed.groupBy("equipment_id", "bucket").pivot("sensor_id", signals).agg(F.avg("value"))
    spine = bucketed.groupBy("equipment_id").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).select("equipment_id", F.explode(F.expr(f"sequence(a, b, cast({seconds} as bigint))")).alias("bucket"))
    missing = sum((F.col(f"`{s}`").isNull().cast("int") for s in signals), F.lit(0)) / len(signals)
    return spine.join(wide, ["equipment_id", "bucket"], "left").withColumn("missing_ratio", missing).withColumn("interpolated", F.col("missing_ratio") == 1)


AGGREGATES = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}


def interpolated_frame(df: DataFrame, signals: list[str], seconds: int, start: int | None = None, end: int | None = None, agg: str = "mean") -> DataFrame:
    """Signals as columns on a fixed step, gaps filled: equipment_id, bucket, a column for each signal, missing_ratio, interpolated.

    start and end (seconds since 1970, multiples of the step) bound the buckets of every equipment, both included; by default they are its first
    and last bucket. A bucket without readings of a signal lies on the line in time between the last bucket before and the
    first after that have some; before the first and after the last it stays null. missing_ratio is the share of signals
    without readings of their own, interpolated whether any was filled in.

    Known neighbours are carried over segments of a signal's buckets (`segments.filled`), so a signal may have any length.
    """
    from ferrolens.operators.segments import filled

    some = df.filter(F.col("sensor_id").isin(signals)).withColumn("bucket", bucket("ts", seconds))
    inside = [F.lit(True)] + ([F.col("bucket") >= start] if start is not None else []) + ([F.col("bucket") <= end] if end is not None else [])
    for test in inside:
        some = some.filter(test)
    means = some.groupBy("equipment_id", "sensor_id", "bucket").agg(AGGREGATES[agg]("value").alias("value")).filter("value is not null")
    ends = some.groupBy("equipment_id").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    first, last = (F.lit(start) if start is not None else F.col("a")), (F.lit(end) if end is not None else F.col("b"))
    steps = F.sequence(first.cast("long"), last.cast("long"), F.lit(seconds).cast("long"))
    spine = ends.select("equipment_id", F.explode(steps).alias("bucket")).select("*", F.explode(F.array(*map(F.lit, signals))).alias("sensor_id"))
    rows = spine.join(means, ["equipment_id", "sensor_id", "bucket"], "left")
    known = F.when(F.col("value").isNotNull(), F.struct("bucket", "value"))
    told = filled(rows, ["equipment_id", "sensor_id"], ["bucket"], known)
    share = (F.col("bucket") - F.col("before.bucket")) / (F.col("after.bucket") - F.col("before.bucket"))
    line = F.col("before.value") + share * (F.col("after.value") - F.col("before.value"))
    told = told.withColumn("shown", F.coalesce("value", line))
    columns = [F.max(F.when(F.col("sensor_id") == s, F.col("shown"))).alias(s) for s in signals]
    missing = (F.count_if(F.col("value").isNull()) / len(signals)).alias("missing_ratio")
    gap = F.coalesce(F.bool_or(F.col("value").isNull() & F.col("shown").isNotNull()), F.lit(False)).alias("interpolated")
    return told.groupBy("equipment_id", "bucket").agg(*columns, missing, gap)


def last_averages(df: DataFrame, lengths: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Means of each series' last n values, of all if it is shorter, as average_<n>."""
    w = Window.partitionBy(*KEYS).orderBy(*(F.desc(c) for c in ORDER))
    latest = df.filter("value is not null").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= max(lengths))
    return latest.groupBy(*KEYS).agg(*(F.avg(F.when(F.col("k") <= n, F.col("value"))).alias(f"average_{n}") for n in lengths))


def summarize_window(readings: DataFrame, logs: DataFrame, n: int = 3) -> DataFrame:
    """One row for each equipment: `levels`, `signals` and `highlights` as text.

    levels: log lines (equipment_id, level) by level, the most frequent first. signals: peak-to-peak and trend of each sensor, by name. highlights:
    the n readings farthest from their sensor's mean, from three deviations on.
    """
    joined = lambda order, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), sep)
    counts = logs.groupBy("equipment_id", "level").agg(F.count("*").alias("m")).withColumns({"line": F.concat_ws("=", "level", F.col("m").cast("string")), "first": -F.col("m")})
    levels = counts.groupBy("equipment_id").agg(joined(["first", "level"], ", ").alias("levels"))
    spread = readings.groupBy(*KEYS).agg((F.max("value") - F.min("value")).alias("spread")).join(trend(readings), list(KEYS))
    spread = spread.withColumn("line", F.concat("sensor_id", F.lit(": p2p "), shown("spread", 3), F.lit(", "), "direction"))
    signals = spread.groupBy("equipment_id").agg(joined(["sensor_id"], "; ").alias("signals"))
    odd = sigma_anomalies(readings, 3.0, 3.0).withColumn("far", F.round(F.abs("z"), 9))
    place = F.row_number().over(Window.partitionBy("equipment_id").orderBy(F.desc("far"), "event_id"))
    told = odd.withColumn("place", place).filter(F.col("place") <= n).withColumn("line", F.concat("sensor_id", F.lit(" "), shown("value", 3), F.lit(" (z "), shown("z", 2), F.lit(")")))
    highlights = told.groupBy("equipment_id").agg(joined(["place"], "; ").alias("highlights"))
    every = readings.select("equipment_id").unionByName(logs.select("equipment_id")).distinct()
    filled = every.join(levels, "equipment_id", "left").join(signals, "equipment_id", "left").join(highlights, "equipment_id", "left")
    return filled.fillna("", ["levels", "signals", "highlights"])


#: (oldest age in days, seconds of a mean); 0 keeps the readings.
RETENTION = ((7, 0), (90, 60), (365, 300))


def apply_retention(df: DataFrame, now: Column, policy=RETENTION) -> DataFrame:
    """Readings by age: kept, averaged by bucket, or gone."""
    age = (micros(now) - micros("ts")) / F.lit(86_400e6)
    tier = F.lit(None).cast("int")
    for days, seconds in reversed(policy):
        tier = F.when(age <= days, seconds).otherwise(tier)
    tiered = df.withColumn("step", tier).filter(F.col("step").isNotNull())
    at = F.when(F.col("step") == 0, micros("ts")).otherwise(F.floor(micros("ts") / (F.col("step") * 1_000_000)) * F.col("step") * 1_000_000)
    raw = F.when(F.col("step") == 0, F.col("event_id"))
    return tiered.groupBy(*KEYS, "step", at.cast("long").alias("at_micros"), raw.alias("event_id")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


# -- patterns --------------------------------------------------------------------------------------


def drifts(df: DataFrame, n: int = 20, least: float = 1.5) -> DataFrame:
    """(keys, part, slope, direction): stretches of n consecutive readings whose least-squares line rises or falls by at
    least `least` deviations of the series over the stretch. Shorter rests at the end don't count."""
    std = df.groupBy(*KEYS).agg(F.stddev_pop("value").alias("std")).filter("std > 1e-10")
    at = F.row_number().over(over()) - 1
    parts = df.withColumn("at", at).withColumn("part", F.floor(F.col("at") / n)).groupBy(*KEYS, "part").agg(F.count("*").alias("m"), F.regr_slope("value", "at").alias("slope"))
    rise = F.col("slope") * (n - 1)
    found = parts.filter(F.col("m") == n).join(std, list(KEYS)).filter(F.abs(rise) >= least * F.col("std"))
    return found.select(*KEYS, "part", "slope", F.when(F.col("slope") > 0, "up").otherwise("down").alias("direction"))


def jumps(df: DataFrame, n: int = 10, least: float = 3.0) -> DataFrame:
    """Readings with `step`, in deviations of the n readings before, of those that stand `least` or more above their mean."""
    before = over().rowsBetween(-n, -1)
    told = df.withColumns({"mean_": F.avg("value").over(before), "std_": F.stddev_pop("value").over(before), "n_": F.count("*").over(before)})
    step = (F.col("value") - F.col("mean_")) / F.col("std_")
    return told.filter((F.col("n_") == n) & (F.col("std_") > 1e-10)).withColumn("step", step).filter(F.col("step") >= least).drop("mean_", "std_", "n_")


def starvation(df: DataFrame, flow: str, torque: str, seconds: int, change: float = 0.1) -> DataFrame:
    """(equipment_id, bucket, flow, torque): time buckets in which the mean flow fell and the mean torque rose by `change` or
    more against the bucket with readings of both before."""
    of = lambda s: F.avg(F.when(F.col("sensor_id") == s, F.col("value")))
    wide = df.groupBy("equipment_id", bucket("ts", seconds).alias("bucket")).agg(of(flow).alias("flow"), of(torque).alias("torque")).filter("flow is not null and torque is not null")
    w = Window.partitionBy("equipment_id").orderBy("bucket")
    before = wide.withColumns({"flow_": F.lag("flow").over(w), "torque_": F.lag("torque").over(w)})
    return before.filter((F.col("flow") <= (1 - change) * F.col("flow_")) & (F.col("torque") >= (1 + change) * F.col("torque_"))).drop("flow_", "torque_")


def zone_balance(df: DataFrame, worst: float = 1.5) -> DataFrame:
    """(equipment_id, imbalance, worst_zones): how far the most restless zone (sensor_id) is above the median of the zones'
    deviations, as 1 - median / greatest, and the zones at `worst` times the median or more."""
    zones = df.groupBy("equipment_id", "sensor_id").agg(F.stddev_pop("value").alias("std"))
    middle = zones.groupBy("equipment_id").agg(F.median("std").alias("middle"), F.max("std").alias("most"))
    told = zones.join(middle, "equipment_id").groupBy("equipment_id", "middle", "most").agg(F.sort_array(F.collect_list(F.when(F.col("std") >= worst * F.col("middle"), F.col("sensor_id")))).alias("zones"))
    return told.select("equipment_id", F.when(F.col("most") > 1e-10, 1 - F.col("middle") / F.col("most")).otherwise(0.0).alias("imbalance"), F.array_join("zones", ",").alias("worst_zones"))


def detect_anomalies(df: DataFrame, equipment, start: Column, end: Column) -> DataFrame:
    """(equipment_id, sensor_id, event_id, ts, value, method, score, since, until): what both tests find odd in the readings of
    an equipment from start to end, with that window."""
    some = df.filter((F.col("equipment_id") == F.lit(equipment)) & (F.col("ts") >= start) & (F.col("ts") <= end))
    names = [*KEYS, "event_id", "ts", "value"]
    sigma = sigma_anomalies(some).select(*names, F.lit("sigma").alias("method"), F.abs("z").alias("score"))
    local = local_anomalies(some).select(*names, F.lit("local").alias("method"), "score")
    return sigma.unionByName(local).withColumns({"since": start, "until": end})
