"""Series over segments and blocks equal the same series in one sorted task, and one hot series uses many tasks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ferrolens.operators import segments, series

KEYS, ORDER = ["equipment_id", "sensor_id"], ["ts", "event_id"]


@pytest.fixture(scope="module")
def df(spark):
    """One series of two thirds of the rows, short ones, one of a null key, ties in time, null values."""
    r = random.Random(8)
    rows = []
    for i in range(3000):
        key = (1, "hot") if i % 3 else (r.choice([2, 3, None]), r.choice(["a", "b"]))
        value = None if r.random() < 0.02 else r.gauss(0, 1) + (9 if r.random() < 0.01 else 0)
        rows.append((*key, datetime(2024, 1, 1) + timedelta(seconds=r.randint(0, 2000)), i, value))
    rows += [(7, "single", datetime(2024, 1, 1), 9000, 1.0), (8, "pair", datetime(2024, 1, 1), 9001, 1.0), (8, "pair", datetime(2024, 1, 2), 9002, 3.0)]
    return spark.createDataFrame(rows, "equipment_id long, sensor_id string, ts timestamp_ntz, event_id long, value double").repartition(4).cache()


def rows(frame, *columns, digits=9):
    plain = lambda x: round(x, digits) if isinstance(x, float) else x
    return sorted((tuple(map(plain, r)) for r in frame.select(*columns).collect()), key=str)


def test_places(df):
    from pyspark.sql import Window

    want = df.withColumn("at", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*ORDER)).cast("long") - 1).withColumn("n", F.count("*").over(Window.partitionBy(*KEYS)))
    assert rows(segments.positioned(df, KEYS, ORDER), "event_id", "at", "n") == rows(want, "event_id", "at", "n")


@pytest.mark.parametrize("size", [7, 64, 1 << 16])
def test_moving_average(df, size):
    want = rows(series.moving_average(df, 7), "event_id", "average")
    assert rows(segments.moving_average(df, 7, KEYS, ORDER, size), "event_id", "average") == want


@pytest.mark.parametrize("size", [1, 10, 1 << 16])
def test_ema(df, size):
    assert rows(segments.ema(df.filter("equipment_id is not null"), 10, KEYS, ORDER, size), "event_id", "ema") == rows(series.ema(df.filter("equipment_id is not null"), 10), "event_id", "ema")


def test_trend_and_local_anomalies(df):
    full = df.fillna(0.0, ["value"])
    assert rows(segments.trend(full, KEYS, ORDER), "equipment_id", "n", "slope", "direction") == rows(series.trend(full), "equipment_id", "n", "slope", "direction")
    got = rows(segments.local_anomalies(full, KEYS, ORDER, size=32), "event_id", "score", digits=6)
    assert got == rows(series.local_anomalies(full), "event_id", "score", digits=6) and got


def test_filled_and_asof(spark, df):
    from pyspark.sql import Window

    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    sparse = df.withColumn("value", F.when(F.col("event_id") % 40 == 0, F.col("value")))
    before, after = F.last("value", True).over(w), F.first("value", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    want = sparse.withColumns({"before": before, "after": after})
    got = segments.filled(sparse, KEYS, ORDER, "value", tasks=9)
    assert rows(got, "event_id", "before", "after") == rows(want, "event_id", "before", "after")
    left = spark.createDataFrame([("a", t) for t in (0, 1, 2, 5, 9)] + [("b", 3), (None, 3)], "k string, at int")
    right = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 12, "y"), ("a", 5, 3, None), ("c", 0, 4, "z"), (None, 2, 5, "n")], "k string, at int, id int, v string")
    found = segments.asof_join(left, right, ["k"], "at", ["v", "id"], "id")
    assert rows(found, "k", "at", "v", "id") == sorted([("a", 0, None, None), ("a", 1, "y", 12), ("a", 2, "y", 12), ("a", 5, None, 3), ("a", 9, None, 3), ("b", 3, None, None), (None, 3, "n", 5)], key=str)


def test_a_hot_series_uses_many_tasks(spark, df):
    hot = df.filter("equipment_id = 1")
    stored = segments.segmented(hot, KEYS, ORDER, tasks=8)
    sizes = [r["count"] for r in stored.groupBy("segment_").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * sum(sizes) / 8
    spread = segments.blocks(segments.positioned(hot, KEYS, ORDER), before=4, size=100)
    assert max(r["count"] for r in spread.groupBy("block").count().collect()) <= 104


def test_empty_tables(df):
    none = df.limit(0)
    assert segments.positioned(none, KEYS, ORDER).count() == 0
    assert segments.ema(none, 10, KEYS, ORDER).count() == 0
    assert segments.moving_average(none, 3, KEYS, ORDER).count() == 0


def test_interpolated_frame(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    data = [(1, "a", at(0), 1, 10.0), (1, "a", at(3), 2, 40.0), (1, "b", at(1), 3, 5.0), (1, "b", at(1), 4, 7.0), (1, "c", at(9), 5, 1.0), (2, "a", at(2), 6, None)]
    df = spark.createDataFrame(data, "equipment_id long, sensor_id string, ts timestamp_ntz, event_id long, value double")
    base = 1_704_067_200
    frame = series.interpolated_frame(df, ["a", "b"], 60, agg="max")
    got = [(r["equipment_id"], (r["bucket"] - base) // 60, r["a"], r["b"], r["missing_ratio"], r["interpolated"]) for r in frame.orderBy("equipment_id", "bucket").collect()]
    assert got == [(1, 0, 10.0, None, 0.5, False), (1, 1, 20.0, 7.0, 0.5, True), (1, 2, 30.0, None, 1.0, True), (1, 3, 40.0, None, 0.5, False), (2, 2, None, None, 1.0, False)]
    wide = series.interpolated_frame(df, ["a", "b"], 60, base + 60, base + 240).filter("equipment_id = 1").orderBy("bucket").collect()
    assert [(r["bucket"] - base) // 60 for r in wide] == [1, 2, 3, 4] and [r["a"] for r in wide] == [None, None, 40.0, None]


def test_percentiles(df):
    got = segments.percentiles(df, KEYS, "value", {"a": 0.0, "b": 0.05, "c": 0.5, "d": 1.0}, tasks=7)
    p = lambda q, c: F.expr(f"percentile_disc({q}) within group (order by value)").alias(c)
    want = df.groupBy(*KEYS).agg(F.count("value").alias("n"), p(0.0, "a"), p(0.05, "b"), p(0.5, "c"), p(1.0, "d"))
    assert rows(got, *KEYS, "n", "a", "b", "c", "d") == rows(want, *KEYS, "n", "a", "b", "c", "d")


def test_forest_scores_over_segments(df):
    """Each reading takes the last step not above it, as one window over its series would give."""
    from pyspark.sql import Window

    from ferrolens.operators import forest

    steps = forest.fit_forest(df.filter("equipment_id is not null"), trees=5)
    w = Window.partitionBy(*KEYS).orderBy(F.col("value").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    marks = steps.select(*KEYS, F.col("since").alias("value"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("event_id"), F.struct("path", "c").alias("step"))
    both = marks.unionByName(df.select(*KEYS, "value", F.lit(1).alias("kind"), "event_id", F.lit(None).cast("struct<path: double, c: double>").alias("step")))
    want = both.withColumn("step", F.last("step", True).over(w)).filter("kind = 1").withColumn("score", F.coalesce(F.when(F.col("step.c") > 0, F.pow(F.lit(2.0), -F.col("step.path") / F.col("step.c"))), F.lit(0.5)))
    assert rows(forest.score(df, steps), "event_id", "score") == rows(want, "event_id", "score")
