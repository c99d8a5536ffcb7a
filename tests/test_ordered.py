"""Live folds: batches cut at random from shuffled rows give what the table gives; late rows come out beside."""

import math
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ferrolens.streaming import folds, ordered

BEGIN = datetime(2024, 1, 1)
SCHEMA = "equipment_id long, sensor_id string, event_id long, ts timestamp, value double"


def made(seed=1, n=240):
    """Readings of three series, one every few seconds, with ties and nulls, and a last row long after that moves the watermark on."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        at = BEGIN + timedelta(seconds=5 * (i // 2) + (0 if i % 10 else 1))
        value = None if i % 50 == 7 else round(math.sin(i / 9) * 4 + r.random() + (30 if i == 150 else 0), 3)
        rows.append((i % 3, "flow", i, at, value))
    return rows


LAST = [(9, "flow", 10_000, BEGIN + timedelta(days=3), 0.0)]


def live(spark, rows, tmp_path, seed, delay=60):
    """A stream of the rows, each moved back by less than the delay, in batches of random sizes; the last row comes alone."""
    r = random.Random(seed)
    moved = sorted(rows, key=lambda x: x[3] + timedelta(seconds=r.random() * (delay - 1)))
    folder, k = str(tmp_path / f"in{seed}"), 0
    while moved:
        n = r.randint(1, 60)
        part = f"{folder}/{k:03d}"
        spark.createDataFrame(moved[:n], SCHEMA).coalesce(1).write.parquet(part)
        os.utime(part, (1_700_000_000 + k, 1_700_000_000 + k))
        for f in os.listdir(part):
            os.utime(f"{part}/{f}", (1_700_000_000 + k, 1_700_000_000 + k))
        moved, k = moved[n:], k + 1
    part = f"{folder}/{k:03d}"
    spark.createDataFrame(LAST, SCHEMA).coalesce(1).write.parquet(part)
    for f in os.listdir(part):
        os.utime(f"{part}/{f}", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def rows_of(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.filter("equipment_id < 9").collect())


TRIGGERS = [(1, "flow", 2.0, None, 30), (2, "flow", None, 0.0, 0), (3, "flow", -9.0, 9.0, 200)]


def cases(spark):
    triggers = spark.createDataFrame(TRIGGERS, "trigger_id long, sensor_id string, low double, high double, duration_seconds long")
    alerts = lambda df: df.select("equipment_id", F.col("sensor_id").alias("hypothesis"), "ts", F.col("event_id").alias("alert_id"))
    return {
        "suppress": (alerts, folds.ALERT_KEYS, "alert_id", folds.Suppress(1)),
        "detect": (lambda df: df, folds.READING_KEYS, "event_id", folds.Detect()),
        "changes": (lambda df: df, folds.READING_KEYS, "event_id", folds.Changes(0.0, 2.0, forget=36000)),
        "hold": (lambda df: folds.conditions(df, triggers), folds.RULE_KEYS, "event_id", folds.Hold()),
    }


@pytest.mark.parametrize("name", ["suppress", "detect", "changes", "hold"])
def test_random_batches_equal_the_table(name, spark, tmp_path):
    prepare, keys, tie, fold = cases(spark)[name]
    table = prepare(spark.createDataFrame(made() + LAST, SCHEMA))
    want = rows_of(ordered.in_batch(table, keys, tie, fold, until="2024-01-03"))
    assert len(want) > 3
    tagged = ordered.in_order(prepare(live(spark, made(), tmp_path, 5)), keys, tie, fold, "60 seconds")
    got = ordered.run_available(tagged, str(tmp_path / "out"))
    assert got.filter("late_by is not null").count() == 0
    assert rows_of(ordered.on_time(got)) == want


def test_hold_by_time_alone(spark):
    """A condition that goes on silently past its duration is told at that moment; by the next row or by time."""
    fold = folds.Hold()
    s = 1_000_000
    assert fold.run(None, None, [(0, 1, 30.0, True)], 29 * s)[2] == []
    assert fold.run(None, None, [(0, 1, 30.0, True)], 30 * s)[2] == [(0, 30 * s)]
    assert fold.run(None, None, [(0, 1, 30.0, True), (40 * s, 2, 30.0, False), (50 * s, 3, 30.0, True)], 60 * s)[2] == [(0, 30 * s)]


def test_forgotten_keys_start_anew():
    fold, s = folds.Changes(0.0, 1.0, forget=100), 1_000_000
    rows = [(0, 1, 4.0), (99 * s, 2, 4.0)]
    assert [r[0] for r in fold.run(None, None, rows, None)[2]] == [2]
    assert fold.run(None, None, [(0, 1, 4.0), (100 * s, 2, 4.0)], None)[2] == []
    assert fold.run(None, None, [(0, 1, 4.0)], 100 * s)[0] is None


def test_late_rows_come_out_beside(spark, tmp_path):
    """Rows far behind the watermark go to the second sink; none is lost, none is folded."""
    rows, late = made(), [(0, "flow", 20_000 + i, BEGIN + timedelta(seconds=i), 1.0) for i in range(5)]
    source = live(spark, rows, tmp_path, 6)
    part = f"{tmp_path}/in6/900"
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.parquet(part)
    for f in os.listdir(part):
        os.utime(f"{part}/{f}", (1_800_000_000, 1_800_000_000))
    tagged = ordered.in_order(source, folds.READING_KEYS, "event_id", folds.Detect(), "60 seconds")
    ordered.run_available(tagged, str(tmp_path / "out"), str(tmp_path / "late"))
    told = spark.read.parquet(str(tmp_path / "late"))
    assert sorted(r["event_id"] for r in told.collect()) == [20_000 + i for i in range(5)]
    assert all(r["late_by"] > 3600 for r in told.collect())
    on_time = spark.read.parquet(str(tmp_path / "out" / "rows"))
    assert {r["event_id"] for r in on_time.collect()} == {r[2] for r in rows if r[4] is not None}


def test_split_late_keeps_every_row(spark, tmp_path):
    source = live(spark, made(), tmp_path, 7, delay=600)  # out of order by far more than the watermark allows
    tagged = ordered.split_late(source, "event_id", "20 seconds")
    on_time = ordered.run_available(tagged, str(tmp_path / "out"), str(tmp_path / "late"))
    late = spark.read.parquet(str(tmp_path / "late"))
    a, b = [{r["event_id"]: r["value"] for r in df.collect()} for df in (on_time, late)]
    assert b and not set(a) & set(b)
    assert a | b == {r[2]: r[4] for r in made() + LAST}
    assert late.filter("late_by <= 0").count() == 0
