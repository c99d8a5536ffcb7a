"""Results that earlier hung on ties, noise of sums or the rounding of binary values: both engines state the same rule."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ferrolens.functions.numbers import rounded_sql, shown, shown_sql
from ferrolens.operators import knowledge, life, series


def test_numbers_are_shown_alike(spark):
    values = [1.45, 0.25, 2.675, 1.005, 0.0, 100.0, 12.35, 10.0125, 0.1 + 0.2, -1.45, 562.2499999999999]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 2, 3):
        got = [r[0] for r in df.select(shown("x", digits)).collect()]
        con = duckdb.connect()
        assert got == [con.execute(f"select {shown_sql('?::double', digits)}", [v]).fetchone()[0] for v in values]
    assert [r[0] for r in df.select(shown("x", 1)).collect()][0] == "1.5"
    x = 0.1234565 - 1e-16
    assert duckdb.connect().execute(f"select {rounded_sql('?::double', 6)}", [x]).fetchone()[0] == spark.createDataFrame([(x,)], "x double").select(F.round(F.round("x", 10), 6)).first()[0]


def test_equal_citations_go_by_page(spark):
    rows = [(1, 2, "C2", "2", None, None, p, 5.0) for p in (7, 3, 8, 4)]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "answer_id long, document_id long, chapter string, section string, line_start long, line_end long, page long, score double")
        assert knowledge.citations(df.coalesce(1)).first()["shown"].endswith("{Page:3}")


def test_the_trend_at_its_threshold_is_not_noise(spark):
    for start in range(1, 40):  # the share is exactly 0.001: not flat
        mean = start * 10.0
        rows = [(1, "s", f"2024-01-01 00:00:0{i}", i, mean + (i - 1) * mean / 1000) for i in range(3)]
        df = spark.createDataFrame(rows, "equipment_id long, sensor_id string, ts string, event_id long, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        if start in (3, 7, 11, 23):
            assert series.trend(df).first()["direction"] == "Increasing"


def test_a_fit_far_from_the_epoch_keeps_its_digits(spark):
    rows = [(1, "s", f"2094-01-01 00:00:00.{i:06d}", i, 1000.0 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "equipment_id long, sensor_id string, ts string, event_id long, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    fit = life.linear_fit(df).first()
    assert fit["intercept"] == pytest.approx(1000.0, abs=1e-7)
    assert fit["slope"] == pytest.approx(3.6e9, rel=1e-12)
